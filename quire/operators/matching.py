"""Greedy matching of similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import materialise


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """What a walk over pairs by falling similarity keeps, each id used once.

    Rounds take every pair that is the best of both its ends in the order (sim desc, a, b) and drop what touches them;
    that equals the sequential walk.
    """
    left, taken = materialise(pairs.select("a", "b", "sim")), None
    while True:
        rank = F.struct(-F.col("sim"), F.col("a"), F.col("b"))
        ends = left.select(F.explode(F.array("a", "b")).alias("id"), rank.alias("r")).groupBy("id").agg(F.min("r").alias("best"))
        best = materialise(left.withColumn("r", rank).join(ends.select(F.col("id").alias("a"), F.col("best").alias("ra")), "a").join(ends.select(F.col("id").alias("b"), F.col("best").alias("rb")), "b").where("r = ra and r = rb").select("a", "b", "sim"))
        if best.isEmpty():
            return taken if taken is not None else best
        taken = best if taken is None else taken.union(best)
        used = best.select(F.explode(F.array("a", "b")).alias("id"))
        left = materialise(left.join(used.withColumnRenamed("id", "a"), "a", "left_anti").join(used.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "sim"))
