"""Changes of the library as frames of its next state: entities, mentions, relations, tags, drafts, items (G2, G5 to G12,
J17), duplicates (P13, P14)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import urls
from quire.operators.matching import greedy_matching
from quire.operators.similarity import similar_pairs


def name_key(name: str = "name") -> Column:
    return F.lower(F.trim(F.col(name)))


def same_name(a: Column, b: Column, least: float = 0.9) -> Column:
    """A verifier without a model: names whose edit distance leaves at least 0.9 of the longer one, in any case."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)) >= least


def duplicate_entities(entities: DataFrame, *, least: float = 0.82, per_id: int = 20, verify: Callable[[Column, Column], Column] = same_name) -> DataFrame:
    """(a, b, sim) of entities to merge, b into a: similar pairs that the verifier confirms, then a walk by falling
    similarity in which each id is used once.  Rejected pairs use no id, so verifying first equals verifying on the way."""
    pairs = similar_pairs(entities, least=least, per_id=per_id)
    names = entities.select("id", "name")
    both = pairs.join(names.select(F.col("id").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
    return greedy_matching(both.where(verify(F.col("na"), F.col("nb"))).select("a", "b", "sim"))


def merged(entities: DataFrame, mentions: DataFrame, relations: DataFrame, losers: DataFrame) -> dict[str, DataFrame]:
    """The three tables after losers (winner, loser) were merged; each loser has one winner, which is no loser.

    Mentions and relations move to the winner unless it has the same one already; relations are moved on their source
    side, then on their target side, and may become loops.  Items of relations compare with nulls as equal.
    """
    to = losers.select(F.col("loser").alias("old"), "winner")

    def moved(rows: DataFrame, column: str, key: list[str]) -> DataFrame:
        both = rows.join(to, F.col(column) == F.col("old"), "left")
        own = F.when(F.col("old").isNull(), 0).otherwise(1)
        both = both.withColumn("_own", own).withColumn(column, F.coalesce("winner", column)).drop("old", "winner")
        # what the winner had stays; of what losers bring one row for each key does
        had = F.min("_own").over(Window.partitionBy(*key))
        first = F.row_number().over(Window.partitionBy(*key, "_own").orderBy(*[F.col(c) for c in rows.columns]))
        return both.withColumn("_had", had).withColumn("_nth", first).where((F.col("_own") == 0) | ((F.col("_had") == 1) & (F.col("_nth") == 1))).select(*rows.columns)

    key = ["source_id", "target_id", "type", *(["item_id"] if "item_id" in relations.columns else [])]
    new = moved(moved(relations, "source_id", key), "target_id", key)
    return {"entities": entities.join(losers.select(F.col("loser").alias("id")), "id", "left_anti"), "mentions": moved(mentions, "entity_id", ["entity_id", "item_id"]), "relations": new}


def upserted_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (id, user_id, name, type) with those of ``new`` that the user lacks by lower-case name; of several
    new forms the one with the least id is kept, trimmed."""
    known = entities.select("user_id", name_key().alias("k")).distinct()
    nth = F.row_number().over(Window.partitionBy("user_id", "k").orderBy("id"))
    fresh = new.withColumn("k", name_key()).where("k <> ''").join(known, ["user_id", "k"], "left_anti").withColumn("nth", nth).where("nth = 1")
    return entities.select("id", "user_id", "name", "type").unionByName(fresh.select("id", "user_id", F.trim("name").alias("name"), "type"))


def upserted_mentions(mentions: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions with those of ``new`` that are not there yet, each once."""
    key = ["entity_id", "item_id"]
    return mentions.unionByName(new.dropDuplicates(key).join(mentions.select(*key), key, "left_anti").select(*mentions.columns))


def named_relations(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations by name (user_id, source, target, type, strength) as relations by id, each once, with weight;
    names compare in lower case without spaces around; unmatched ones go, of entities with one name the first counts."""
    ids = entities.groupBy("user_id", name_key().alias("k")).agg(F.min("id").alias("id"))
    out = raw.withColumn("s", name_key("source")).withColumn("t", name_key("target"))
    out = out.join(ids.select("user_id", F.col("k").alias("s"), F.col("id").alias("source_id")), ["user_id", "s"]).join(ids.select("user_id", F.col("k").alias("t"), F.col("id").alias("target_id")), ["user_id", "t"])
    return out.groupBy("source_id", "target_id", "type").agg(F.max(relation_weight("strength")).alias("weight"))


def relation_weight(strength: str) -> Column:
    """Strength from 1 to 5, missing or 0 as 3, over 5."""
    s = F.when(F.coalesce(F.col(strength), F.lit(0)) == 0, 3).otherwise(F.col(strength))
    return F.greatest(F.lit(1), F.least(F.lit(5), s)) / F.lit(5.0)


def promoted_tags(items: DataFrame, entities: DataFrame) -> DataFrame:
    """Concept entities (user_id, name, type) for tags that are no entity of the user yet, in any case; of several
    forms the first in alphabetical order."""
    tags = items.select("user_id", F.explode("tags").alias("name")).where(F.trim("name") != "")
    known = entities.select("user_id", name_key().alias("k"))
    fresh = tags.withColumn("k", name_key()).join(known, ["user_id", "k"], "left_anti")
    return fresh.groupBy("user_id", "k").agg(F.min(F.trim("name")).alias("name")).select("user_id", "name", F.lit("CONCEPT").alias("type"))


def upserted_tag_vectors(tag_vectors: DataFrame, new: DataFrame) -> DataFrame:
    """(label, tag_type, embedding): missing labels come in, a missing type is filled, vectors that exist stay."""
    n = new.dropDuplicates(["label"]).select("label", F.col("tag_type").alias("new_type"), F.col("embedding").alias("new_embedding"))
    both = tag_vectors.join(n, "label", "full")
    return both.select("label", F.coalesce("tag_type", "new_type").alias("tag_type"), F.coalesce("embedding", "new_embedding").alias("embedding"))


def upserted_drafts(drafts: DataFrame, new: DataFrame) -> DataFrame:
    """One draft for each list and user (list_id, user_id, title, content); a null field of ``new`` keeps the old
    value; the words of the content are counted anew."""
    n = new.select("list_id", "user_id", F.col("title").alias("new_title"), F.col("content").alias("new_content"))
    both = drafts.select("list_id", "user_id", "title", "content").join(n, ["list_id", "user_id"], "full")
    content = F.coalesce("new_content", "content")
    words = F.size(F.filter(F.split(F.coalesce(content, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return both.select("list_id", "user_id", F.coalesce("new_title", "title").alias("title"), content.alias("content"), words.alias("word_count"))


def purged(items: DataFrame, children: dict[str, DataFrame], as_of: Column, days: int = 7) -> dict[str, DataFrame]:
    """Items deleted over ``days`` ago are gone, and rows of ``children`` (item_id) with them.

    ``items`` has deleted_at, null for live ones.
    """
    gone = items.where(F.unix_micros("deleted_at") < F.unix_micros(as_of) - days * 86_400_000_000).select(F.col("id").alias("item_id"))
    return {"items": items.join(gone.withColumnRenamed("item_id", "id"), "id", "left_anti"), **{k: v.join(gone, "item_id", "left_anti") for k, v in children.items()}}


def replayed(events: DataFrame) -> DataFrame:
    """State of items after their events in order (item_id, seq, kind, value): ``read`` and ``unread`` set the mark and
    move the position to 0, ``position`` moves it and marks as read from 0.9 on, ``archive`` and ``restore`` file it.

    One ordered fold for each item; an item's events are one array.
    """
    ordered = events.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "value"))).alias("es"))
    start = F.struct(F.lit(False).alias("is_read"), F.lit(0.0).alias("position"), F.lit(False).alias("is_archived"))

    def step(s: Column, e: Column) -> Column:
        kind, at = e["kind"], e["value"]
        return F.struct(
            F.when(kind == "read", True).when(kind == "unread", False).when((kind == "position") & (at >= 0.9), True).otherwise(s["is_read"]).alias("is_read"),
            F.when(kind.isin("read", "unread"), 0.0).when(kind == "position", at).otherwise(s["position"]).alias("position"),
            F.when(kind == "archive", True).when(kind == "restore", False).otherwise(s["is_archived"]).alias("is_archived"),
        )

    return ordered.select("item_id", F.aggregate("es", start, step).alias("s")).select("item_id", "s.*")


def new_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages (page_id, user_id, url) to add: of pages with one normalised URL the first, unless the user has a live
    item whose URL normalises to the same.  URLs that cannot be parsed are not added."""
    known = items.where(~F.col("is_deleted")).select("user_id", urls.normalize_url("url").alias("clean")).where("clean is not null").distinct()
    clean = pages.withColumn("clean", urls.normalize_url("url")).where("clean is not null")
    first = clean.groupBy("user_id", "clean").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
    return first.join(known, ["user_id", "clean"], "left_anti")
