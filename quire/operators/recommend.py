"""Recommendations (P11, J14, X25), reading themes (P12, A11), tag votes (A10), rolling profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import filters, graph
from quire.operators.similarity import best_match, cosine_to, matches, usable


def days_old(as_of: Column, at: str) -> Column:
    """Whole days, rounded down."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(F.col(at))) / F.lit(86_400_000_000)).cast("bigint")


def profiles(items: DataFrame, last: int = 20) -> DataFrame:
    """Per user the mean minutes of the last 20 items read (one digit) and all tags of items read, each once."""
    read = items.where("is_read and minutes is not null")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("read_at"), F.desc("id")))
    mean = read.withColumn("nth", nth).where(F.col("nth") <= last).groupBy("user_id").agg(F.round(F.avg("minutes"), 1).alias("mean_minutes"))
    tags = items.where("is_read").select("user_id", F.explode("tags").alias("tag")).groupBy("user_id").agg(F.array_sort(F.collect_set("tag")).alias("preferred"))
    return mean.join(tags, "user_id", "full")


def recommended(items: DataFrame, item_vectors: DataFrame, profile: DataFrame, as_of: Column, *, mood: str | None = None, skip: int = 0, limit: int | None = 10) -> DataFrame:
    """Unread live items by score: 30 times the greatest similarity with reads of the last seven days (deleted ones
    count too), recency, 10 for each preferred tag, closeness to the usual reading time; highest first, a page of each
    user.  ``items`` has deleted rows too; ``profile`` as profiles() gives it."""
    vectors = item_vectors.select(F.col("item_id").alias("id"), "embedding")
    read = items.where(F.col("is_read") & (F.unix_micros(F.col("read_at")) >= F.unix_micros(as_of) - 7 * 86_400_000_000))
    unread = filters.in_mood(items.where("is_read = false and not is_deleted"), mood)
    best = best_match(unread.select("id", "user_id").join(vectors, "id"), read.select("id", "user_id").join(vectors, "id"))
    rows = unread.join(best, "id", "left").join(profile, "user_id", "left")
    recency = F.greatest(F.lit(0.0), 20 - days_old(as_of, "created_at") / 10)
    empty = F.array().cast("array<string>")
    tags = 10 * F.size(F.array_intersect(F.coalesce("tags", empty), F.coalesce("preferred", empty)))
    time = F.when(F.col("mean_minutes").isNotNull() & (F.col("minutes") > 0), F.greatest(F.lit(0.0), 15 - F.abs(F.col("minutes") - F.col("mean_minutes")) / 2)).otherwise(0.0)
    scored = rows.withColumn("score", F.round(30 * F.coalesce("best", F.lit(0.0)) + recency + tags + time, 6))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "id"))
    out = scored.withColumn("rank", rank).where(F.col("rank") > skip)
    return (out if limit is None else out.where(F.col("rank") <= skip + limit)).select("user_id", "id", "score", "rank")


def themes(items: DataFrame, tag_vectors: DataFrame, *, least: float = 0.60, tagged: int = 10, size: int = 3) -> DataFrame:
    """Per user clusters of tags (label, embedding in ``tag_vectors``) that are alike, with their articles.

    Users with fewer than ``tagged`` tagged live items, or fewer than two tags with vectors, have none; clusters with
    fewer than ``size`` articles go.  The label is the tag with most items, a tag twice in an item counting twice; ties
    go to the first tag in alphabetical order.
    """
    live = items.where(~F.col("is_deleted") & (F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0))
    enough = live.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= tagged).select("user_id")
    uses = live.join(enough, "user_id", "left_semi").select("user_id", "id", F.explode("tags").alias("tag"))
    tags = uses.groupBy("user_id", "tag").agg(F.count("*").alias("n")).join(tag_vectors.select(F.col("label").alias("tag"), "embedding"), "tag")
    many = tags.groupBy("user_id").agg(F.count("*").alias("k")).where("k >= 2").select("user_id")
    # ids of (user, tag): places in the order of users and tags would need a global sort; a hash serves as well
    tags = tags.join(many, "user_id", "left_semi").withColumn("id", F.xxhash64("user_id", "tag"))
    pairs = matches(tags, tags, least=least).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = graph.components(pairs)
    tags = tags.join(found, "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    return summarised(tags.select("user_id", "tag", "cluster"), uses, size)


def summarised(clusters: DataFrame, uses: DataFrame, size: int = 3) -> DataFrame:
    """Per cluster of tags (user_id, tag, cluster) its articles, its tags and a label, from ``uses`` (user_id, id, tag)."""
    both = clusters.join(uses, ["user_id", "tag"])
    items_of = both.groupBy("user_id", "cluster").agg(F.array_sort(F.collect_set("id")).alias("items")).where(F.size("items") >= size)
    counts = both.groupBy("user_id", "cluster", "tag").agg(F.count("*").alias("n"))
    label = counts.groupBy("user_id", "cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("tag").alias("tag")))["tag"].alias("label"), F.array_sort(F.collect_set("tag")).alias("tags"))
    return items_of.join(label, ["user_id", "cluster"]).select("user_id", "label", "tags", "items")


def tag_votes(items: DataFrame, item_vectors: DataFrame, item_id: int, user_id: int, vector: list[float], *, least: float = 0.75, nearest: int = 3) -> DataFrame:
    """A10: tags that at least two of the three nearest tagged items have, at most five."""
    tagged = items.where((F.col("user_id") == user_id) & (F.col("id") != item_id) & (F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0))
    near = item_vectors.where(usable("embedding")).select(F.col("item_id").alias("id"), cosine_to(vector).alias("sim")).where(F.col("sim") > least)
    best = tagged.join(near, "id").orderBy(F.desc("sim"), "id").limit(nearest)
    votes = best.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("votes"))
    return votes.orderBy(F.desc("votes"), "tag").limit(5).where("votes >= 2")
