"""Graph operators: components (G3), neighbours within a few hops (G1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import materialise

SALTS = 32
#: Edges (16 bytes each) up to which one task finds components by itself; beyond, rounds of joins do.
FEW = 1 << 18


def salted(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join in which a hot key of ``big`` is dealt over SALTS tasks; ``small`` has each key once."""
    left = big.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), F.col(by)), F.lit(SALTS)).cast("int"))
    right = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "salt"], how).drop("salt")


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over few edges; each component is named by its least id."""
    parts = [np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not parts:
        return
    edges = np.concatenate(parts)
    ids, at = np.unique(edges, return_inverse=True)
    root = list(range(len(ids)))
    for x, y in at.reshape(-1, 2).tolist():
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # roots are smaller than what hangs on them
        root[x] = root[root[x]]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) for ids of ``links`` (a, b bigint); component is the least id reachable.

    Alternates small stars (each node's smaller neighbours move under the least) and large stars (nodes move under
    their root's root) until every edge ends in a root: O(log n) rounds, edges never outgrow the links, each round is
    materialised, and joins on roots are salted.  Up to FEW edges, counted first, are one task's work.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("p")).where("x > p"))
    if edges.count() <= FEW:
        return edges.coalesce(1).mapInArrow(_in_one_task, "id bigint, component bigint")
    edges = materialise(edges.distinct())
    while True:
        least = edges.groupBy("x").agg(F.min("p").alias("m"))
        small = edges.join(least, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("p")), F.struct(F.col("p").alias("x"), F.col("m").alias("p")))).alias("e")).select("e.*").where("x > p").distinct()
        root = small.groupBy("x").agg(F.min("p").alias("m")).select(F.col("x").alias("p"), "m")
        large = salted(small, root, ["p"], "x", "left").select("x", F.coalesce("m", "p").alias("p"), F.col("m").isNotNull().alias("moved")).where("x > p")
        large = materialise(large.groupBy("x", "p").agg(F.max("moved").alias("moved")))
        found = large.agg(F.count_if("moved").alias("moved"), F.count("*").alias("n"), F.countDistinct("x").alias("d")).first()
        edges = large.select("x", "p")
        if not found["moved"] and found["n"] == found["d"]:
            break
    return edges.select(F.col("x").alias("id"), F.col("p").alias("component")).unionByName(edges.select(F.col("p").alias("id"), F.col("p").alias("component")).distinct())


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """G1: ids within ``hops`` undirected steps of ``seeds`` (id), seeds excluded; edges (source_id, target_id)."""
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(edges.select("target_id", "source_id")).distinct()
    seen = front = seeds.select("id").distinct()
    for _ in range(hops):
        front = both.join(front.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.union(front)
    return seen.join(seeds.select("id"), "id", "left_anti").distinct()
