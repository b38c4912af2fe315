"""Inverted lists of vectors by centroid (P1, J13, E7), and similarity joins of lists that pivots cannot rule out.

An index is a Parquet table partitioned by list, with the lists' sizes and radii (greatest angle to the centroid) beside
it.  A search reads the lists it probes and no others: either a fixed number of nearest lists, or, exactly, all that may
hold a better answer: by the triangle inequality of angles a vector of a list is no nearer to the query than the angle
to the centroid less the radius.  Joins rule out pairs of blocks the same way.  Every vector is indexed; only the
centroids come from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.similarity import DIGITS, _matrix, block_pairs, cosine_to, near_rows, packs, unpacked, usable
from quire.sources.shared import materialise

#: Vectors that centroids are fitted to, most lists, rounds of k-means, and vectors of a block of a join.
SAMPLE, MOST, ROUNDS, BLOCK = 20_000, 4096, 12, 1024
#: Blocks of full size that are packed together.
WIDE = 4
#: Room for the rounding of angles.
SLACK = 1e-6


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def fit_centroids(vectors: DataFrame, lists: int | None = None, *, seed: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means over at most SAMPLE vectors, sampled by a hash; about sqrt(n) of them."""
    some = vectors.where(usable("embedding"))
    n = some.count()
    part = F.pmod(F.xxhash64(F.lit(seed), "embedding"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE * 0.97 / max(n, 1)))
    got = some.where(part).select(F.col("embedding").cast("array<double>").alias("embedding")).limit(SAMPLE).toArrow()
    x = _matrix(got["embedding"]) if got.num_rows else np.zeros((0, 1))
    x = x[np.lexsort(x.T[::-1])]  # the same centroids whatever order rows come in
    lists = max(1, min(lists or int(n**0.5), MOST, len(x)))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)] if len(x) else np.zeros((1, 1))
    for _ in range(ROUNDS if len(x) else 0):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def placed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Usable vectors with ``list`` (nearest centroid) and ``angle`` to it; further columns are kept."""
    kept = vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).where(usable("embedding"))
    shipped = kept.sparkSession.sparkContext.broadcast(centroids)  # at most MOST rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = _angles(_matrix(b["embedding"]), shipped.value)
                near = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(a[np.arange(len(near)), near])], names=[*b.schema.names, "list", "angle"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{columns}, list int, angle double")


@dataclass
class VectorIndex:
    path: str
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray

    def rows(self, spark: SparkSession, lists: list[int]) -> DataFrame:
        """Vectors of some lists: a filter on the partition column, so other lists are not opened."""
        return spark.read.parquet(f"{self.path}/lists").where(F.col("list").isin([int(i) for i in lists]))

    def share(self, lists: list[int]) -> float:
        """Part of all vectors that these lists hold."""
        return float(self.sizes[lists].sum() / max(self.sizes.sum(), 1))


def build(vectors: DataFrame, path: str, *, lists: int | None = None) -> VectorIndex:
    """Writes an index of vectors (id, embedding; further columns are kept) and opens it."""
    spark, c = vectors.sparkSession, fit_centroids(vectors, lists)
    placed(vectors, c).repartition("list").write.partitionBy("list").parquet(f"{path}/lists")
    stats = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    known = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(c)], "list int, centroid array<double>")
    known.join(stats, "list", "left").na.fill({"n": 0, "radius": 0.0}).coalesce(1).write.parquet(f"{path}/centroids")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").sort("list").collect()  # at most MOST
    return VectorIndex(path, np.array([r.centroid for r in rows]), np.array([r.n for r in rows]), np.array([r.radius for r in rows]))


def probe(index: VectorIndex, vector: list[float], k: int, *, probes: int | None = None, keep: Column | None = None, spark: SparkSession) -> tuple[DataFrame, list[int]]:
    """(id, score) of the ``k`` best ids by their best vector, and the lists that were read; ``keep`` filters rows.

    With ``probes`` the nearest lists are read.  Without, the nearest ones give a bound and then every list is read that
    may hold a better one, so the answer is that of a scan.
    """
    q = np.asarray(vector, np.float64)
    if not np.isfinite(q).all() or not q.any() or len(q) != index.centroids.shape[1]:
        return spark.createDataFrame([], "id bigint, score double"), []
    angles = _angles(q[None] / np.linalg.norm(q), index.centroids)[0]
    order = [int(i) for i in np.argsort(angles, kind="stable") if index.sizes[i]]

    def best(lists: list[int]) -> DataFrame:
        rows = index.rows(spark, lists)
        scored = (rows if keep is None else rows.where(keep)).select("id", cosine_to(vector).alias("s")).where("s is not null")
        return scored.groupBy("id").agg(F.max("s").alias("score")).orderBy(F.desc("score"), "id").limit(k)

    if probes is not None:
        return best(order[:probes]), order[:probes]
    n = next((i for i in range(1, len(order) + 1) if index.sizes[order[:i]].sum() >= 4 * k), len(order))
    found = best(order[:n]).collect()
    bound = np.arccos(np.clip(found[-1].score - 10.0**-DIGITS, -1, 1)) if len(found) == k else np.pi
    lists = [i for i in order if angles[i] - index.radii[i] <= bound + SLACK]
    return best(lists), lists


def probe_many(index: VectorIndex, queries: DataFrame, k: int, probes: int, *, block: int = 8192) -> DataFrame:
    """(query, id, sim): for many queries (id, embedding) the ``k`` nearest other ids in the ``probes`` nearest lists of each.

    Lists longer than ``block`` are dealt to several tasks.
    """
    spark = queries.sparkSession
    shipped = spark.sparkContext.broadcast(index.centroids)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = np.argsort(_angles(_matrix(b["embedding"]), shipped.value), axis=1, kind="stable")[:, :probes]
                take = np.repeat(np.arange(b.num_rows), at.shape[1])
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(take)), b["embedding"].take(pa.array(take)), pa.array(at.ravel().astype(np.int32))], names=["query", "embedding", "list"])

    asked = queries.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding"))
    asked = asked.mapInArrow(near, "query bigint, embedding array<double>, list int")
    parts = F.ceil(F.element_at(F.array(*[F.lit(int(n)) for n in index.sizes]), F.col("list") + 1) / block).cast("int")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    rows = spark.read.parquet(f"{index.path}/lists").select(F.col("id").cast("bigint").alias("id"), "embedding", "list")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.greatest(parts, F.lit(1))).cast("int"))

    def multiply(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, s = _products(left["query"].to_numpy(), left["embedding"], right["id"].to_numpy(), right["embedding"], k=k)
        return pa.table({"query": x, "id": y, "sim": s})

    found = asked.groupBy("list", "part").cogroup(rows.groupBy("list", "part")).applyInArrow(multiply, "query bigint, id bigint, sim double")
    found = found.groupBy("query", "id").agg(F.max("sim").alias("sim"))
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))).where(F.col("nth") <= k).drop("nth")


def _products(x_ids, x_column, y_ids, y_column, *, least: float = -1.0, k: int | None = None, below: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two blocks with other ids and cosine from ``least``, a few hundred rows at a time; ``below``: x < y only."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(x_ids) and len(y_ids):
        order = np.argsort(y_ids, kind="stable")
        y_ids = y_ids[order]
        x, y = _matrix(x_column), _matrix(y_column)[order]
        for lo in range(0, len(x), 256):
            s, ids = np.round(x[lo : lo + 256] @ y.T, DIGITS), x_ids[lo : lo + 256, None]
            ok = (s >= least) & (ids < y_ids if below else ids != y_ids)
            if k is not None and k < len(y_ids):
                s = np.where(ok, s, -2.0)
                ok &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero(ok)
            out.append((x_ids[lo + r], y_ids[c], s[r, c]))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _blocks(vectors: DataFrame, block: int) -> tuple[DataFrame, np.ndarray]:
    """Vectors (id, user_id, angle, without the embedding) with their list and, where a user has many in a list, the part
    of it."""
    c = fit_centroids(vectors)
    at = materialise(placed(vectors.select("id", "user_id", "embedding").where("id is not null"), c).select("id", "user_id", "list", "angle"))
    sizes = at.groupBy("user_id", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    return at.join(sizes, ["user_id", "list"]).withColumn("part", _part(F.col("parts"))), c


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), "id"), parts).cast("int")


def _near_blocks(at: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Pairs of blocks of a user (l1, p1, n1, l2, p2, n2) with the least angle that two of their vectors may have."""
    stats = materialise(at.groupBy("user_id", "list", "part").agg(F.count("*").alias("n"), F.max("angle").alias("r")))
    shipped = at.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = shipped.value[a.to_numpy()], shipped.value[b.to_numpy()]
        return pd.Series(np.arccos(np.clip((x * y).sum(axis=1), -1.0, 1.0)))

    x, y = (stats.select("user_id", *[F.col(c).alias(f"{c}{k}") for c in ("list", "part", "n", "r")]) for k in (1, 2))
    pairs = x.join(y, "user_id").where("list1 < list2 or list1 = list2 and part1 <= part2")
    # vectors of one list may coincide, however narrow it is
    return pairs.withColumn("gap", F.when(F.col("list1") == F.col("list2"), 0.0).otherwise(F.greatest(F.lit(0.0), apart("list1", "list2") - F.col("r1") - F.col("r2"))))


def pruned_pairs(vectors: DataFrame, *, least: float, block: int = BLOCK) -> DataFrame:
    """All pairs (a < b, sim) of one user's vectors with cosine from ``least``, by the block pairs that may hold one.

    Neighbouring blocks of a user are packed together until they have WIDE times ``block`` vectors; a task takes two such
    packs and rules out pairs of blocks inside them.  So vectors are written once, however many lists there are.
    """
    at, c = _blocks(vectors, block)
    before = F.sum("n").over(Window.partitionBy("user_id").orderBy("list", "part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = at.groupBy("user_id", "list", "parts", "part").agg(F.count("*").alias("n"))  # a user has at most MOST lists
    sizes = sizes.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / (WIDE * block)).cast("int"))
    where = materialise(sizes.groupBy("user_id", "list").agg(F.first("parts").alias("parts"), F.map_from_entries(F.collect_list(F.struct("part", "block"))).alias("blocks")))
    packed = where.select("user_id", F.explode(F.map_values("blocks")).alias("block")).distinct().count()
    kind = vectors.schema["embedding"].dataType
    again = placed(vectors.select("id", "user_id", "embedding").where("id is not null"), c).withColumn("embedding", F.col("embedding").cast(kind))
    again = again.join(where, ["user_id", "list"]).withColumn("part", _part(F.col("parts"))).withColumn("block", F.col("blocks")[F.col("part")])
    more = {"list": "<i4", "part": "<i4", "angle": "<f8"}
    shipped = vectors.sparkSession.sparkContext.broadcast(c)
    bound = float(np.arccos(np.clip(least, -1, 1))) + SLACK

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                left, right = (_listed(unpacked(row, k, more)) for k in (1, 2))
                gap = _angles(shipped.value[left["list"]], shipped.value[right["list"]]) - left["radius"][:, None] - right["radius"]
                near = (gap <= bound) | (left["list"][:, None] == right["list"])  # vectors of one list may coincide
                for lo, hi, some in _runs(near):
                    rows = slice(left["bounds"][lo], left["bounds"][hi])
                    cols = np.flatnonzero(np.repeat(some, np.diff(right["bounds"])))
                    for r, c, v in near_rows(left["x"][rows], right["x"] if some.all() else right["x"][cols], least):
                        x, y = left["id"][rows][r], right["id"][cols[c]]
                        once = x < y if row["block1"] == row["block2"] else x != y
                        x, y = x[once], y[once]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(v[once])], names=["a", "b", "sim"])

    return block_pairs(packs(again, more), packed).mapInArrow(multiply, "a bigint, b bigint, sim double")


def _listed(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of unpacked() in the order of lists and parts; of each part its list, greatest angle, and bounds."""
    order = np.lexsort((rows["part"], rows["list"]))
    kind, part, angle = (rows[n][order] for n in ("list", "part", "angle"))
    first = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])]))
    return {"id": rows["id"][order], "x": rows["x"][order], "list": kind[first], "radius": np.maximum.reduceat(angle, first), "bounds": np.concatenate([first, [len(order)]])}


def _runs(near: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Consecutive rows that are alike and not empty: first, end, the row."""
    change = np.flatnonzero(np.concatenate([[True], (near[1:] != near[:-1]).any(axis=1)]))
    for lo, hi in zip(change, [*change[1:], len(near)]):
        if near[lo].any():
            yield int(lo), int(hi), near[lo]


def saved(vectors: DataFrame, levels: list[float], *, block: int = BLOCK) -> DataFrame:
    """(least, products, saved): products of vectors in all block pairs, and the share that pivots rule out at each level."""
    pairs = materialise(_near_blocks(*_blocks(vectors, block)))
    n = F.col("n1") * F.col("n2")
    out = [pairs.select(F.lit(s).alias("least"), n.alias("n"), (F.col("gap") > float(np.arccos(s)) + SLACK).alias("out")) for s in levels]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("least").agg(F.sum("n").alias("products"), F.round(F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("saved"))
