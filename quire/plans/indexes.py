"""Searches and joins on indexes: inverted lists of vectors (P1, E7), postings (P2, X23), pivots.

Each query builds its index from the tables in the shared folder and then reads the parts that it needs; a service would
keep the index and call the same operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import postings, search, vector_index
from quire.operators.similarity import matches
from quire.plans import discovery
from quire.sources.library import Dialect, table, with_tables
from quire.sources.shared import materialise, scratch


def p1_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 on inverted lists, exact: only lists that may hold one of the 20 best items are read."""
    index = vector_index.build(search.entries(discovery.library(spark, sf_dir)), scratch(spark))
    found = search.indexed_semantic(spark, index, discovery.vector_of(spark, sf_dir), 20)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


def p2_postings_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 on postings: a prefix search for one user's titled items."""
    items = table(spark, sf_dir, "live").withColumn("tag_text", F.array_join("tags", " "))
    index = postings.write(items, search.FIELDS, scratch(spark))
    found = postings.search(spark, index, "von", keep=items.where("user_id = 3 and title <> ''"))
    return found.orderBy(F.desc("score"), "id").limit(50).select("id", F.round("score", 6).alias("score"))


def x23_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X23 on postings: words of both dictionaries, after half of the items came again in a second segment."""
    items = table(spark, sf_dir, "live").withColumn("tag_text", F.array_join("tags", " "))
    path = scratch(spark)
    postings.write(items.withColumn("full_text", F.when(F.col("id") % 2 == 0, F.lit("von von los")).otherwise(F.col("full_text"))), search.FIELDS, path)
    index = postings.write(items.where("id % 2 = 0"), search.FIELDS, path, segment=1)
    found = postings.search(spark, index, "que OR von OR los", keep=items.where("title <> ''"))
    return found.orderBy(F.desc("score"), "id").limit(50).select("id", F.round("score", 6).alias("score"))


#: Parts of the lists that e7_index_recall probes.
PROBED = (0.1, 0.2, 0.4, 0.7, 1.0)


def e7_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recall@10 of the index against the exact scan for several numbers of probes, over queries with ids divisible
    by 50, and the greatest share of vectors that a query reads then."""
    v = table(spark, sf_dir, "vectors").select("id", "embedding")
    index = vector_index.build(v, scratch(spark))
    asked, n = v.where("id % 50 = 0"), len(index.sizes)
    one = lambda f: f.select("id", F.lit(0).alias("user_id"), "embedding")
    exact = materialise(matches(one(asked), one(v), k=10).select("x", "y"))
    rows = []
    for probes in sorted({max(1, round(n * p)) for p in PROBED}):
        found = vector_index.probe_many(index, asked, 10, probes).select(F.col("query").alias("x"), F.col("id").alias("y"), F.lit(1).alias("hit"))
        hits = exact.join(found, ["x", "y"], "left").agg(F.count("*").alias("n_exact"), F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 4).alias("recall"))
        read = float(sum(sorted(index.sizes)[-probes:]) / max(index.sizes.sum(), 1))
        rows.append(hits.select(F.lit(probes).alias("probes"), F.lit(n).alias("lists"), F.lit(round(read, 4)).alias("share_read"), "n_exact", "recall"))
    return reduce(DataFrame.unionByName, rows)


#: Cosine from which pairs are sought where few of the tables' vectors are nearer.
NEAR = 0.3


def j12_pruned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12 without cutting to the nearest: all pairs of a user, by the blocks that pivots leave."""
    pairs = vector_index.pruned_pairs(table(spark, sf_dir, "vectors"), least=NEAR)
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


def j12_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of vectors in all pairs of blocks, and the share of them that pivots save at three thresholds."""
    return vector_index.saved(table(spark, sf_dir, "vectors"), [0.95, 0.82, 0.6])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_indexed_search, p2_postings_search, x23_postings, e7_index_recall, j12_pruned_pairs, j12_pruning)}
_cos = discovery.cos("a", "b")
ORACLES = {
    name: with_tables(sql, Dialect(False))
    for name, sql in {
        "p1_indexed_search": f"with {discovery.PROBE} select id, round(score, 6) as score, rank from ({discovery.semantic_sql(None, 20)}) s",
        "p2_postings_search": f"select id, round(score, 6) as score from ({discovery.keyword_sql(3, 50, '''w like 'von%' ''')}) k",
        "x23_postings": f"select id, round(score, 6) as score from ({discovery.keyword_sql(None, 50, discovery._WORDS)}) k",
        "j12_pruned_pairs": f"select a.id as a, b.id as b, round({_cos}, 6) as sim from vectors a join vectors b on a.user_id = b.user_id and a.id < b.id where {_cos} >= {NEAR}",
    }.items()
}
