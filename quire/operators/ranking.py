"""Ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, key: str, tie: str, *, descending: bool = True, parts: int = 64, name: str = "rk") -> DataFrame:
    """Adds the row number by ``key`` (numeric), then ``tie`` ascending; null keys come last.

    Approximate quantiles, at most ``parts`` numbers, cut the key's range; rows are numbered inside each range and
    moved on by the number of rows in the ranges before.  Quantiles are literals, so recomputed tasks agree.
    """
    cuts = df.select(F.percentile_approx(F.col(key).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=descending)
    value = F.col(key).cast("double")
    before = [F.when(value < c if descending else value > c, 1).otherwise(0) for c in cuts]
    part = F.when(value.isNull(), F.lit(len(cuts) + 1)).otherwise(sum(before, F.lit(0)))
    cut = df.withColumn("_part", part)
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    order = [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), F.col(tie)]
    inside = cut.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    # the offsets have one row for each range: at most parts + 1
    return inside.join(F.broadcast(offsets), "_part").withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_nth")).cast("bigint")).drop("_part", "_nth", "_before")
