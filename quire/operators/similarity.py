"""Similarity of vectors: against one vector (J13), and of all vectors of a user by blocks.

Cosines are taken in double precision and rounded to nine digits, so that equal vectors tie whatever order sums run in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 9
#: Vectors of a block: a task multiplies two blocks, a few hundred rows at a time.
BLOCK = 4096
#: Partitions that packed blocks are dealt to, at most (each pair of them is a task), and products that are held at a time.
DEALT, HELD = 32, 1 << 20


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows from a list column without nulls inside, read from its flat buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(column: str) -> Column:
    """Vectors that can be compared: not null, not zero, all components finite."""
    c = F.col(column)
    return c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(c, lambda v: v != 0)


def cosine_to(vector: list[float], column: str = "embedding") -> Column:
    """Cosine with one vector, by Arrow batches; null for a vector of another length, a zero one, or a null."""
    q = np.array(vector, np.float64)
    size = float(np.linalg.norm(q))

    @F.pandas_udf("double")
    def against(some: pd.Series) -> pd.Series:
        ok = np.array([v is not None and len(v) == len(q) for v in some], bool)
        out = np.full(len(some), np.nan)
        if ok.any() and size:
            x = np.concatenate(some[ok].to_numpy()).reshape(-1, len(q))  # a vector is a slice of the batch's buffer
            norms = np.linalg.norm(x, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[ok] = np.round(x @ q / (norms * size), DIGITS)
        return pd.Series([None if np.isnan(v) else v for v in out], dtype="object").astype("float64")

    return F.nullif(against(F.col(column).cast("array<double>")), F.lit(float("nan")))


def matches(left: DataFrame, right: DataFrame, *, least: float = -1.0, k: int | None = None, block: int = BLOCK, apart: str | None = None) -> DataFrame:
    """(user_id, x, y, sim): vectors y of ``right`` that belong to x of ``left``, of one user, with other ids and cosine at
    or above ``least``; with ``k`` the k best of each x (ties by id).  Columns: id, user_id, embedding.

    Each user's vectors are dealt to blocks by hash; a task multiplies two blocks, so neither a user with a third of all
    vectors nor its square lands in one task, and with ``k`` it sends on k rows for each x.  Unusable vectors match
    nothing; vectors of a user must have one length.  With ``apart``, a bigint column of both sides, rows that agree in it
    are left out before the cut to the k best, as are rows where it is null.
    """
    group = F.col(apart or "id").cast("bigint")
    left, right = (f.select("id", "user_id", group.alias("g"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable("embedding") & F.col("id").isNotNull() & F.col("g").isNotNull()) for f in (left, right))
    number = F.ceil(F.count("*") / block).cast("int")
    sizes = left.groupBy("user_id").agg(number.alias("l_n")).join(right.groupBy("user_id").agg(number.alias("r_n")), "user_id")
    a = left.join(sizes, "user_id").withColumn("l", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("l_n")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r_n") - 1)))
    b = right.join(sizes, "user_id").withColumn("r", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("r_n")).cast("int")).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("l_n") - 1)))
    a = a.select("user_id", "l", "r", "id", "g", "embedding")
    b = b.select(*[F.col(c).alias(n) for c, n in (("user_id", "u"), ("l", "lb"), ("r", "rb"), ("id", "y"), ("g", "h"), ("embedding", "v"))])

    def multiplied(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if p.num_rows and q.num_rows:
            ids_x, ids_y = p["id"].to_numpy(), q["y"].to_numpy()
            order = np.argsort(ids_y, kind="stable")
            ids_y = ids_y[order]
            groups_x, groups_y = p["g"].to_numpy(), q["h"].to_numpy()[order]
            x, y = _matrix(p["embedding"]), _matrix(q["v"])[order]
            for lo in range(0, len(x), 256):
                s = np.round(x[lo : lo + 256] @ y.T, DIGITS)
                s[(ids_x[lo : lo + 256, None] == ids_y) | (groups_x[lo : lo + 256, None] == groups_y)] = -2
                if k is not None and k < s.shape[1]:
                    cut = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    s[s < cut[:, None]] = -2
                r, c = np.nonzero(s >= max(least, -1.5))
                v = s[r, c]
                if k is not None:  # ties at the cut: the first ids
                    best = np.lexsort((c, -v, r))
                    r, c, v = r[best], c[best], v[best]
                    first = np.searchsorted(r, np.arange(s.shape[0]))
                    keep = np.arange(len(r)) - first[r] < k
                    r, c, v = r[keep], c[keep], v[keep]
                out.append((ids_x[lo + r], ids_y[c], v))
        x, y, v = (np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(3))
        return pa.table({"user_id": pa.array([key[0].as_py()] * len(x), pa.int64()), "x": pa.array(x.astype(np.int64)), "y": pa.array(y.astype(np.int64)), "sim": pa.array(v.astype(np.float64))})

    found = a.groupBy("user_id", "l", "r").cogroup(b.groupBy("u", "lb", "rb")).applyInArrow(multiplied, "user_id bigint, x bigint, y bigint, sim double")
    if k is None:
        return found
    nth = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sim"), "y"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def similar_pairs(vectors: DataFrame, *, least: float = 0.82, per_id: int | None = 20) -> DataFrame:
    """Pairs (a < b, sim) of one user's vectors; with ``per_id`` a pair stays if either side has it among its nearest."""
    found = matches(vectors, vectors, least=least, k=per_id)
    if per_id is None:
        return found.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "sim")
    return found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("sim").alias("sim"))


def best_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, best): the greatest similarity of each vector with any of the other side, of one user."""
    return matches(left, right, k=1).select(F.col("x").alias("id"), F.col("sim").alias("best"))


def packs(vectors: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """A row for each block of vectors (user_id, block, id, embedding and the numbers ``more``, with their types): user_id,
    block, and each column as the bytes of an array; components keep single precision if they have it."""
    kinds = {"id": "<i8", **(more or {}), "embedding": "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"}

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        flat = {n: (pc.list_flatten(table[n]) if n == "embedding" else table[n]).to_numpy().astype(kinds[n], copy=False) for n in kinds}
        return pa.table({"user_id": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int32())} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in flat.items()} | {"kind": [kinds["embedding"]]})

    found = vectors.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("block").cast("int").alias("block"), *[F.col(n) for n in kinds])
    return found.groupBy("user_id", "block").applyInArrow(pack, "user_id bigint, block int, " + ", ".join(f"{n} binary" for n in kinds) + ", kind string")


def block_pairs(packed: DataFrame, blocks: int) -> DataFrame:
    """Each pair of blocks of a user once, the columns of packs() with 1 and 2 after their names.

    A product without a shuffle of its own: the blocks are written once, and every task reads its two partitions of them.
    """
    dealt = packed.repartition(max(1, min(blocks, DEALT)))
    one, two = (dealt.select(*[F.col(c).alias(f"{c}{k}") for c in packed.columns]) for k in (1, 2))
    return one.hint("shuffle_replicate_nl").join(two, (F.col("user_id1") == F.col("user_id2")) & (F.col("block1") <= F.col("block2")))


def unpacked(row: dict, side: int, more: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """Arrays of one side of a row of block_pairs(); the embeddings as unit rows ``x``."""
    out = {n: np.frombuffer(row[f"{n}{side}"], kind) for n, kind in {"id": "<i8", **(more or {})}.items()}
    x = np.frombuffer(row[f"embedding{side}"], row[f"kind{side}"]).astype(np.float64).reshape(len(out["id"]), -1)
    return out | {"x": x / np.linalg.norm(x, axis=1, keepdims=True)}


def near_rows(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x, rows of y and rounded cosines from ``least``, of about HELD products at a time."""
    step = max(1, HELD // max(1, len(y)))
    for lo in range(0, len(x), step):
        s = x[lo : lo + step] @ y.T
        r, c = np.nonzero(s >= least - 10.0**-DIGITS)
        v = np.round(s[r, c], DIGITS)
        keep = v >= least
        yield lo + r[keep], c[keep], v[keep]


def hashed_recall(vectors: DataFrame, hashes: list[str], least: float, block: int = BLOCK) -> DataFrame:
    """(n_exact, recall): all pairs with cosine from ``least``, and the share of them that agree in one of the columns
    ``hashes`` at least.  Each task counts the pairs of two blocks of vectors (id, embedding), so no pair is sent on."""
    usable_ones = vectors.where(usable("embedding") & F.col("id").isNotNull())
    blocks = max(1, -(-usable_ones.count() // block))
    more = {h: "<i4" for h in hashes}
    dealt = usable_ones.withColumn("user_id", F.lit(0)).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(blocks)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = hits = 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                a, b = (unpacked(row, k, more) for k in (1, 2))
                h, g = (np.stack([x[m] for m in more], axis=1) for x in (a, b))
                for r, c, _ in near_rows(a["x"], b["x"], least):
                    once = a["id"][r] < b["id"][c] if row["block1"] == row["block2"] else a["id"][r] != b["id"][c]
                    r, c = r[once], c[once]
                    n, hits = n + len(r), hits + int((h[r] == g[c]).any(axis=1).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([hits])], names=["n", "hits"])

    found = block_pairs(packs(dealt, more), blocks).mapInArrow(count, "n bigint, hits bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return found.select(F.col("n").alias("n_exact"), F.round(F.col("hits") / F.greatest("n", F.lit(1)), 4).alias("recall"))
