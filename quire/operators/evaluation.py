"""Retrieval metrics (E1 to E5) over ranked lists: (q, id, rank) against relevant sets (q, id), for every row of ``queries``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(queries: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per query: ``ranks`` of relevant hits, in order, and ``n`` relevant ids in all."""
    hits = ranked.join(relevant.select("q", "id").distinct(), ["q", "id"]).groupBy("q").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    n = relevant.select("q", "id").distinct().groupBy("q").agg(F.count("*").alias("n"))
    out = queries.select("q").distinct().join(hits, "q", "left").join(n, "q", "left")
    return out.select("q", F.coalesce("ranks", F.array().cast("array<bigint>")).alias("ranks"), F.coalesce("n", F.lit(0)).alias("n"))


def _within(k: int) -> Column:
    return F.filter("ranks", lambda r: r <= k)


def recall_at(k: int) -> Column:
    """1 where nothing is relevant."""
    return F.when(F.col("n") == 0, 1.0).otherwise(F.size(_within(k)) / F.col("n"))


def precision_at(k: int) -> Column:
    """Divides by k even where fewer came back; 0 for k = 0."""
    return F.size(_within(k)) / F.lit(float(k)) if k else F.lit(0.0)


def reciprocal_rank() -> Column:
    """Of the first relevant hit in the list, 0 without one."""
    return F.when(F.size("ranks") > 0, F.lit(1.0) / F.element_at("ranks", 1)).otherwise(0.0)


def ndcg_at(k: int) -> Column:
    """Binary gains, log2(rank + 1), ideal over min(k, number of relevant ids); 0 where nothing is relevant."""
    gain = F.aggregate(_within(k), F.lit(0.0), lambda a, r: a + 1 / F.log2(r.cast("double") + 1))
    m = F.least(F.lit(k), F.col("n")).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0), lambda a, r: a + 1 / F.log2(r.cast("double") + 1))
    return F.when(m < 1, 0.0).otherwise(gain / ideal)


def regressed(means: DataFrame, baseline: DataFrame, slack: float = 0.02) -> DataFrame:
    """E5: per variant and metric whether the mean fell below its baseline by more than ``slack``."""
    both = means.join(baseline.withColumnRenamed("value", "baseline"), ["variant", "metric"])
    return both.withColumn("regressed", F.col("value") < F.col("baseline") - slack)
