"""Connections between highlights and between articles.

``passages`` are highlights with vectors: id, user_id, item_id, text, start_offset, embedding; ``items`` are live ones
with id, title, tags.  All source highlights are answered at once by blocks of vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.similarity import cosine_to, matches, usable

#: Default similarity of a connection, least characters of a passage, passages fetched for a highlight and for a pair.
LEAST, CHARS, FETCH, NEAREST, SHOWN = 0.3, 20, 100, 20, 2


def shared_tags(a: str, b: str) -> Column:
    """Tags that both have, sorted."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_intersect(F.coalesce(a, empty), F.coalesce(b, empty)))


def _connected(passages: DataFrame, items: DataFrame, least: float, k: int, sources: DataFrame | None = None) -> DataFrame:
    """The k nearest passages of other live articles, long enough, for each source passage: x, ix, y, iy, sim."""
    live = items.select(F.col("id").alias("item_id"))
    other = passages.where(F.length("text") >= CHARS).join(live, "item_id", "left_semi")
    source = passages if sources is None else sources
    found = matches(source, other, least=least, k=k, apart="item_id").drop("user_id")  # an article's own passages do not count
    return found.join(source.select(F.col("id").alias("x"), F.col("item_id").alias("ix")), "x").join(other.select(F.col("id").alias("y"), F.col("item_id").alias("iy")), "y")


def by_article(passages: DataFrame, items: DataFrame, *, least: float = LEAST, fetch: int = FETCH, sources: DataFrame | None = None) -> DataFrame:
    """For each highlight the connected articles with up to two best passages, best similarity (three digits),
    shared tags and ``rank``: more shared tags first, then similarity, then the article's id; for all passages or ``sources``."""
    found = _connected(passages, items, least, fetch, sources)
    nth = F.row_number().over(Window.partitionBy("x", "iy").orderBy(F.desc("sim"), "y"))
    top = found.withColumn("nth", nth).where(F.col("nth") <= SHOWN).groupBy("x", "ix", "iy").agg(F.max("sim").alias("sim"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "y"))), lambda s: s["y"]).alias("passages"))
    tags = items.select("id", "tags")
    both = top.join(tags.select(F.col("id").alias("ix"), F.col("tags").alias("own")), "ix", "left").join(tags.select(F.col("id").alias("iy"), F.col("tags").alias("theirs")), "iy")
    both = both.withColumn("shared", shared_tags("own", "theirs"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc(F.size("shared")), F.desc("sim"), "iy"))
    return both.select("x", F.col("iy").alias("item_id"), "passages", "shared", F.round("sim", 3).alias("score"), rank.alias("rank"))


def of_articles(passages: DataFrame, items: DataFrame, *, least: float = LEAST, sources: int = 30) -> DataFrame:
    """P8 for the first ``sources`` highlights (by offset, then id) of each article; those without any are left out."""
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("start_offset", "id"))
    chosen = passages.join(items.select(F.col("id").alias("item_id")), "item_id", "left_semi").withColumn("nth", nth).where(F.col("nth") <= sources)
    found = by_article(passages, items, least=least, sources=chosen)
    return found.join(chosen.select(F.col("id").alias("x"), F.col("item_id").alias("ix")), "x")


def best_pairs(passages: DataFrame, items: DataFrame, *, least: float = LEAST, sources: DataFrame | None = None) -> DataFrame:
    """For each pair of articles the best pair of highlights among each highlight's 20 nearest, with similarity on
    the half scale (1 - distance / 2), shared tags, and ``rank`` within the article."""
    found = _connected(passages, items, 2 * least - 1, NEAREST, sources).withColumn("half", F.round(1 - (1 - F.col("sim")) / 2, 9))
    nth = F.row_number().over(Window.partitionBy("ix", "iy").orderBy(F.desc("half"), "x", "y"))
    best = found.withColumn("nth", nth).where("nth = 1").drop("nth")
    tags = items.select("id", "tags")
    both = best.join(tags.select(F.col("id").alias("ix"), F.col("tags").alias("own")), "ix").join(tags.select(F.col("id").alias("iy"), F.col("tags").alias("theirs")), "iy")
    both = both.withColumn("shared", shared_tags("own", "theirs"))
    rank = F.row_number().over(Window.partitionBy("ix").orderBy(F.desc(F.size("shared")), F.desc("half"), "iy"))
    return both.select("ix", "iy", "x", "y", F.round("half", 6).alias("total_similarity"), "shared", rank.alias("rank"))


def insight_context(passages: DataFrame, items: DataFrame, *, least: float = LEAST, k: int = 3) -> DataFrame:
    """For each highlight and connected article the up to three nearest passages of that article."""
    found = _connected(passages, items, least, FETCH)
    nth = F.row_number().over(Window.partitionBy("x", "iy").orderBy(F.desc("sim"), "y"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).select("x", F.col("iy").alias("item_id"), "y", F.round("sim", 6).alias("sim"), "nth")


def similar_items(item_vectors: DataFrame, items: DataFrame, item_id: int, vector: list[float], tags: list[str] | None, *, least: float = LEAST, limit: int = 10) -> DataFrame:
    """Live items near one item, with the tags they share with it."""
    found = item_vectors.where((F.col("item_id") != item_id) & usable("embedding")).select(F.col("item_id").alias("id"), cosine_to(vector).alias("sim")).where(F.col("sim") >= least)
    own = F.lit(tags or []).cast("array<string>")
    return found.join(items.select("id", "title", "tags").withColumn("own", own), "id").select("id", "title", "sim", shared_tags("own", "tags").alias("shared")).orderBy(F.desc("sim"), "id").limit(limit)
