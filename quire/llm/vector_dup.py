"""Near-duplicate vectors by a robust-pruned flat graph (operator 8).

Equal vectors of one label are one node with their number; links to and among copies are added by arithmetic.

Vectors of one label are dealt to the clusters of their two nearest centroids (k-means on a bounded sample).  Each
shard, a cluster's part of bounded size, builds a flat graph: nearest candidates, thinned by robust pruning so that
edges go in all directions.  A vector's adjacency lists from its shards are united.  Every vector then searches its own
cluster: greedily with a beam from the medoid, and from what it reaches on through all nodes within the range and a
margin, until nothing new turns up.  Each hit is verified by the cosine in double precision.  Links that the search
finds from one side count for both.

A cluster larger than a shard is clustered again, from a bounded sample of its own, until its parts fit or do not shrink
any more; what is left is cut by hash, and each pair of parts is a task, so no task grows with a hot cluster.  Links
inside a task are counted, not listed: what leaves it are counts, a spanning forest and links that cross clusters.
Recall is audited against brute force for a bounded set of all vectors, whether links were found or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import components, salted

from .common import cut_lineage, hash_sample

#: Vectors of a cluster aimed at, most of a shard, sample for centroids, and the most clusters of one label.
AIM, SHARD, SAMPLE, CLUSTERS = 1000, 4096, 20_000, 512
#: Most levels of clusters, vectors of a cluster that its parts are found from, and vectors of a task that deals them.
LEVELS, INNER, DEALT = 4, 8192, 16_384
POOL, DEGREE, ALPHA, BEAM = 48, 24, 1.2, 12
MARGIN = 0.08


def centroids(x: np.ndarray, k: int, seed: int = 1, steps: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        n = np.linalg.norm(s, axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1e-12)[:, None], c)
    return c


def build(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a shard by robust pruning of each vector's nearest candidates; reverse edges are added."""
    n = len(x)
    pool = min(POOL, n - 1)
    out: list[list[int]] = [[] for _ in range(n)]
    if pool < 1:
        return [np.zeros(0, np.int64)] * n
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(n, lo + 256))
        s = x[rows] @ x.T
        s[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        far = 1 - np.take_along_axis(s, near, 1)  # half squared distance
        alive = np.ones(near.shape, bool)
        among = x[near]
        for _ in range(min(DEGREE, pool)):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            pick = near[np.arange(len(rows)), first]
            for i in np.flatnonzero(some):
                out[rows[i]].append(int(pick[i]))
            between = 1 - np.einsum("ijk,ik->ij", among, x[pick])
            alive &= ~(ALPHA**2 * between <= far)
            alive[np.arange(len(rows)), first] = False
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(out):
        for j in row[: DEGREE // 2]:
            back[j].append(i)
    return [np.array(list(dict.fromkeys(out[i] + back[i][:DEGREE])), np.int64) for i in range(n)]


def search(x: np.ndarray, adjacent: list[np.ndarray], queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of queries (numbers of nodes): pairs (query, node) with cosine at or above ``least``."""
    n = len(x)
    wide = max(map(len, adjacent), default=0)
    if n < 2 or not wide:
        return
    table = np.full((n, wide), n, np.int64)
    for i, a in enumerate(adjacent):
        table[i, : len(a)] = a
    mean = x.mean(0)
    medoid = int((x @ mean).argmax())
    padded = np.vstack([x, np.zeros((1, x.shape[1]))])
    for lo in range(0, len(queries), 128):
        q = queries[lo : lo + 128]
        m, rows = len(q), np.arange(len(q))
        vec = x[q]
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        sims = np.full((m, n + 1), -2.0)
        done = np.zeros((m, n + 1), bool)
        seen[:, medoid] = True
        sims[:, medoid] = vec @ x[medoid]
        beam = np.full((m, BEAM), n, np.int64)
        beam[:, 0] = medoid
        for _ in range(64):  # greedy: expand the best node of the beam that was not expanded
            value = np.where(done[rows[:, None], beam], -3.0, sims[rows[:, None], beam])
            best = beam[rows, value.argmax(1)]
            active = value.max(1) > -2
            if not active.any():
                break
            done[rows, best] = True
            near = np.where(active[:, None], table[best], n)
            new = ~seen[rows[:, None], near]
            near = np.where(new, near, n)
            sims[rows[:, None], near] = np.where(near < n, np.einsum("ijk,ik->ij", padded[near], vec), -2.0)
            seen[rows[:, None], near] = True
            both = np.hstack([beam, near])
            keep = np.argpartition(-sims[rows[:, None], both], BEAM - 1, axis=1)[:, :BEAM]
            beam = np.take_along_axis(both, keep, 1)
        seen[rows, q], sims[rows, q] = True, 1.0  # a vector's own node is an entry too
        grown = np.zeros((m, n + 1), bool)
        while True:  # range: expand all within reach
            r, c = np.nonzero((sims >= least - MARGIN) & ~grown)
            if not len(r):
                break
            grown[r, c] = True
            r, c = np.repeat(r, wide), table[c].ravel()
            key = np.unique((r * (n + 1) + c)[~seen[r, c]])
            r, c = key // (n + 1), key % (n + 1)
            seen[r, c] = True
            for a in range(0, len(r), 65536):
                b = slice(a, a + 65536)
                sims[r[b], c[b]] = np.einsum("ij,ij->i", x[c[b]], vec[r[b]])
        r, c = np.nonzero(sims[:, :n] >= least)
        ok = q[r] != c
        yield q[r[ok]], c[ok]


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of lists of one length, from their flat buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _again(placed: DataFrame) -> DataFrame:
    """Clusters larger than a shard as clusters of their own: rows (vec_id, embedding, kind, many, home, cluster).

    A vector goes to its two nearest parts; the copy that is at home in the cluster is at home in the nearest of them.
    """
    for _ in range(LEVELS - 1):
        sizes = placed.groupBy("kind", "cluster").agg(F.count("*").alias("n"))
        large = cut_lineage(sizes.where(F.col("n") > SHARD))
        if large.isEmpty():
            break
        rows = placed.join(large, ["kind", "cluster"])
        # about INNER rows of a cluster, chosen by hash, are one group
        some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("n")) < INNER)

        def inner(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("vec_id")
            n = table["n"][0].as_py()
            c = centroids(_unit(table["embedding"]), max(2, min(CLUSTERS, -(-n // AIM), len(table) // 8)))
            return pa.table({"kind": pa.array([key[0].as_py()] * len(c)), "cluster": pa.array([key[1].as_py()] * len(c), pa.int64()), "n": pa.array([n] * len(c), pa.int64()), "place": pa.array(list(c), pa.list_(pa.float64()))})

        parts = some.groupBy("kind", "cluster").applyInArrow(inner, "kind string, cluster bigint, n bigint, place array<double>")
        tasks = F.ceil(F.col("n") / DEALT).cast("int")
        left = rows.withColumn("task", F.pmod(F.xxhash64("vec_id", F.lit(13)), tasks).cast("int"))
        right = cut_lineage(parts).withColumn("task", F.explode(F.sequence(F.lit(0), tasks - 1)))
        right = right.select(F.col("kind").alias("k"), F.col("cluster").alias("c"), F.col("task").alias("t"), "place")

        def dealt(key: tuple, table: pa.Table, places: pa.Table) -> pa.Table:
            if not table.num_rows:
                return table.select(["vec_id", "embedding", "kind", "many", "home", "cluster"])
            c = np.array(sorted(map(tuple, places["place"].to_pylist())))
            x = _unit(table["embedding"])
            near = np.concatenate([np.argsort(-(x[lo : lo + 1024] @ c.T), axis=1, kind="stable")[:, :2] for lo in range(0, len(x), 1024)])
            old = key[1].as_py()
            named = np.array([(old * 1_000_003 + i + 1) * 0x9E3779B97F4A7C15 % (1 << 62) + (1 << 20) for i in range(len(c))], np.int64)  # apart from numbers of first clusters
            home = table["home"].to_numpy()
            out = []
            for i in range(near.shape[1]):
                new = named[near[:, i]]
                out.append(table.select(["vec_id", "embedding", "kind", "many"]).append_column("home", pa.array(np.where(home == old, named[near[:, 0]], home))).append_column("cluster", pa.array(new)))
            return pa.concat_tables(out)

        cut = left.groupBy("kind", "cluster", "task").cogroup(right.groupBy("k", "c", "t")).applyInArrow(dealt, "vec_id bigint, embedding array<double>, kind string, many bigint, home bigint, cluster bigint")
        rest = placed.join(large.select("kind", "cluster"), ["kind", "cluster"], "left_anti")
        placed = cut_lineage(rest.select("vec_id", "embedding", "kind", "many", "home", "cluster").unionByName(cut))
    return placed


def near_vectors(vectors: DataFrame, *, least: float = 0.93) -> DataFrame:
    """Per vec_id: ``n_links`` (others of its label with cosine at or above ``least`` that were found), ``component_id``
    (least vec_id reachable by links), ``kept`` (it is its component's least).

    Only vectors of one label and length are compared.  Null labels or vectors, zero vectors, and such with null or
    non-finite components link with nothing.  Rows that repeat a vec_id count once (the least label and vector); null
    ids come back each, with no link and no component.  Columns: vec_id, embedding, label; others are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    ids = rows.select("vec_id")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*")
    usable = usable.where(finite & F.exists("embedding", lambda v: v != 0)).withColumn("kind", F.concat_ws(":", F.size("embedding"), "label"))
    key = [F.xxhash64("kind", "embedding").alias("k1"), F.xxhash64(F.lit(7), "kind", "embedding").alias("k2")]
    copies = cut_lineage(usable.select("vec_id", F.transform("embedding", lambda v: v + F.lit(0.0)).alias("embedding"), "kind").select("*", *key))
    if copies.isEmpty():
        return _answer(ids, None, None)
    classes = cut_lineage(copies.groupBy("k1", "k2").agg(F.min(F.struct("vec_id", "embedding", "kind")).alias("v"), F.count("*").alias("many")).select("v.*", "many", "k1", "k2"))
    usable = classes.select("vec_id", "embedding", "kind", "many")
    sizes = {r["kind"]: r["count"] for r in usable.groupBy("kind").count().orderBy(F.desc("count"), "kind").limit(4096).collect()}
    sample = hash_sample(usable, F.col("vec_id"), SAMPLE).toPandas()
    places = {}
    for kind, n in sizes.items():  # labels beyond the most frequent ones have one cluster each
        mine = sample[sample.kind == kind].sort_values("vec_id")
        if len(mine) and n > AIM:
            places[kind] = centroids(_unit(pa.array([np.asarray(v, np.float64) for v in mine.embedding])), min(CLUSTERS, -(-n // AIM), max(1, len(mine) // 8)))
    shipped = usable.sparkSession.sparkContext.broadcast(places)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column(2).to_pylist(), object)
            near = np.zeros((len(kinds), 2), np.int64)
            for kind in set(kinds):
                if (c := shipped.value.get(kind)) is not None and len(c) > 1:
                    pick = np.flatnonzero(kinds == kind)
                    near[pick] = np.argsort(-(_unit(batch.column(1).take(pa.array(pick))) @ c.T), axis=1, kind="stable")[:, :2]
            own = [[a] if a == b else [a, b] for a, b in near.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0]), pa.array(own, pa.list_(pa.int64()))], names=["vec_id", "embedding", "kind", "many", "home", "clusters"])

    placed = usable.mapInArrow(assign, "vec_id bigint, embedding array<double>, kind string, many bigint, home bigint, clusters array<bigint>")
    placed = _again(cut_lineage(placed.withColumn("cluster", F.explode("clusters")).drop("clusters")))
    parts = placed.groupBy("kind", "cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    sized = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16))).join(parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["kind", "cluster", "salt"]).drop("salt")
    members = cut_lineage(sized.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("parts")).cast("int")))

    def built(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        v = table["vec_id"].to_numpy()
        return pa.table({"vec_id": v, "near": pa.array([v[a] for a in build(_unit(table["embedding"]))], pa.list_(pa.int64()))})

    edges = members.groupBy("kind", "cluster", "part").applyInArrow(built, "vec_id bigint, near array<bigint>")
    united = edges.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    tasks = members.join(united, "vec_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")})

    def searched(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        cluster, a, b = key[1].as_py(), key[2].as_py(), key[3].as_py()
        v, part = table["vec_id"].to_numpy(), table["part"].to_numpy()
        home = table["home"].to_numpy() == cluster
        x, place = _unit(table["embedding"]), {int(i): n for n, i in enumerate(v)}
        lists = [np.array([place[i] for i in row if i in place], np.int64) for row in table["near"].to_pylist()]
        # parts of a cut cluster share no edges: a few bridges join them
        if a != b:
            for p, q in ((a, b), (b, a)):
                here, there = np.flatnonzero(part == p), np.flatnonzero(part == q)
                for lo in range(0, len(here), 512):
                    rows = here[lo : lo + 512]
                    s = x[rows] @ x[there].T
                    k = min(4, len(there))
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(rows), 0), np.int64)
                    for i, t in zip(rows, there[best]):
                        lists[i] = np.concatenate([lists[i], t])
        pairs = [np.zeros((0, 2), np.int64)]
        for q, c in search(x, lists, np.flatnonzero(home), least):
            if a != b:
                ok = part[q] != part[c]
                q, c = q[ok], c[ok]
            pairs.append(np.column_stack([np.minimum(q, c), np.maximum(q, c)]))
        found = np.unique(np.concatenate(pairs), axis=0)
        inside = home[found[:, 0]] & home[found[:, 1]]
        mine, cross = found[inside], found[~inside]
        many = table["many"].to_numpy()
        n = np.zeros(len(v), np.int64)
        np.add.at(n, mine, many[mine[:, ::-1]])
        root = np.arange(len(v))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        forest = []
        for i, j in mine.tolist():
            r, s = top(i), top(j)
            if r != s:
                root[max(r, s)] = min(r, s)
                forest.append((i, j))
        some = np.flatnonzero(n)
        forest = np.array(forest, np.int64).reshape(-1, 2)
        return pa.table(
            {
                "a": np.concatenate([v[some], v[forest[:, 0]], v[cross[:, 0]]]),
                "b": pa.array([None] * len(some) + v[forest[:, 1]].tolist() + v[cross[:, 1]].tolist(), pa.int64()),
                "n": pa.array(n[some].tolist() + [0] * len(forest) + [None] * len(cross), pa.int64()),
                "many_a": pa.array([None] * (len(some) + len(forest)) + many[cross[:, 0]].tolist(), pa.int64()),
                "many_b": pa.array([None] * (len(some) + len(forest)) + many[cross[:, 1]].tolist(), pa.int64()),
            }
        )

    hits = cut_lineage(tasks.groupBy("kind", "cluster", "a", "b").applyInArrow(searched, "a bigint, b bigint, n bigint, many_a bigint, many_b bigint"))
    cross = hits.where("n is null").select("a", "b", "many_a", "many_b").distinct()
    links = hits.where("b is not null").select("a", "b")
    n_links = hits.where("n > 0").select(F.col("a").alias("vec_id"), "n")
    for x, y in (("a", "b"), ("b", "a")):
        n_links = n_links.unionByName(cross.select(F.col(x).alias("vec_id"), F.col(f"many_{y}").alias("n")))
    node = classes.select("vec_id", "many", "k1", "k2").join(n_links.groupBy("vec_id").agg(F.sum("n").alias("n")), "vec_id", "left")
    if not links.isEmpty():
        node = node.join(components(links).withColumnRenamed("id", "vec_id"), "vec_id", "left")
    else:
        node = node.withColumn("component", F.lit(None).cast("bigint"))
    node = node.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    told = cut_lineage(salted(copies.select("vec_id", "k1", "k2"), node.where("n_links > 0"), ["k1", "k2"], "vec_id"))
    return _answer(ids, told.select("vec_id", "n_links"), told.select(F.col("vec_id").alias("id"), "component"))


def _answer(ids: DataFrame, n_links: DataFrame | None, found: DataFrame | None) -> DataFrame:
    out = ids.where("vec_id is not null").distinct().unionByName(ids.where("vec_id is null"))
    out = out.join(n_links, "vec_id", "left") if n_links is not None else out.withColumn("n_links", F.lit(0).cast("bigint"))
    out = out.join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left") if found is not None else out.withColumn("component", F.lit(None).cast("bigint"))
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, answer: DataFrame, *, least: float = 0.93, rows: int = 2048) -> float:
    """Share of the true links of at most ``rows`` usable vectors that the answer has; their vectors are broadcast."""
    vectors = vectors.select("vec_id", "embedding", "label")
    usable = vectors.where("vec_id is not null and label is not null and embedding is not null").where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0))
    chosen = hash_sample(usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.*"), F.col("vec_id"), rows)
    q = chosen.join(answer.select("vec_id", "n_links"), "vec_id").toPandas()
    by_size = {int(size): (part.vec_id.to_numpy(), part.label.astype(str).to_numpy(), _unit(pa.array([np.asarray(v, np.float64) for v in part.embedding]))) for size, part in q.groupby(q.embedding.map(len))}
    shipped = vectors.sparkSession.sparkContext.broadcast(by_size)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {size: np.zeros(len(x[0]), np.int64) for size, x in shipped.value.items()}
        for batch in batches:
            sizes = np.array([len(v) for v in batch.column(1).to_pylist()], np.int64)
            for size, (own, lab, x) in shipped.value.items():
                pick = np.flatnonzero(sizes == size)
                for lo in range(0, len(pick), 1024):
                    part = batch.take(pa.array(pick[lo : lo + 1024]))
                    s = _unit(part.column(1)) @ x.T
                    total[size] += ((s >= least) & (np.array(part.column(2).to_pylist(), str)[:, None] == lab.astype(str)) & (part.column(0).to_numpy()[:, None] != own)).sum(0)
        for size, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(shipped.value[size][0], pa.int64()), pa.array(n)], names=["vec_id", "n"])

    once = usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", F.col("v.embedding").cast("array<double>").alias("embedding"), F.col("v.label").cast("string").alias("label"))
    true = once.mapInArrow(hits, "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("n")).toPandas()
    both = q.merge(true, on="vec_id")
    return float(np.minimum(both.n_links, both.n).sum() / both.n.sum()) if both.n.sum() else 1.0


def query(vectors: DataFrame) -> DataFrame:
    answer = cut_lineage(near_vectors(vectors))
    return answer.withColumn("audited_recall", F.lit(audit(vectors, answer)))
