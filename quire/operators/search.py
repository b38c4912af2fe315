"""Search of a user's library: lanes (P1, P2, P3), dispatch by intent (P4), full mode (P5), with highlights.

Each lane is a lazy frame of ids with rank and score; a search unions them and sums by id, so lanes share one job.  The
query's vector comes from the caller: the engine calls no model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import fulltext, queries
from quire.operators import filters
from quire.operators.graph import neighbours
from quire.operators.similarity import cosine_to, usable
from quire.operators.vector_index import VectorIndex, probe

FIELDS = {"title": "A", "author": "A", "description": "B", "tag_text": "B", "full_text": "C"}
RRF, WIDER, ENTITY_SCALE = 60, 3, 0.025
#: Similarity from which an entity counts, from which its neighbours are looked at, and weight of all but the best.
GATE, EXPAND, REST = 0.40, 0.45, 0.3


@dataclass
class Library:
    """A user's live items and what belongs to them; frames of library tables, of all users or of one."""

    items: DataFrame
    chunks: DataFrame
    item_vectors: DataFrame
    entities: DataFrame | None = None
    mentions: DataFrame | None = None
    relations: DataFrame | None = None
    highlights: DataFrame | None = None

    def of(self, user_id: int) -> Library:
        """Only that user's rows."""
        own = lambda f: None if f is None else f.where(F.col("user_id") == user_id)
        return Library(own(self.items), self.chunks, self.item_vectors, own(self.entities), own(self.mentions), self.relations, own(self.highlights))


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    """Adds ``rank``; ``limit`` bounds the rows that are numbered in one task."""
    best = rows.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("bigint"))


def entries(lib: Library) -> DataFrame:
    """(id, user_id, embedding): what P1 compares: chunks of titled items, and items without chunks by their own vector."""
    items = lib.items.where("title <> ''").select("id", "user_id")
    chunks = lib.chunks.where(usable("embedding")).select(F.col("item_id").alias("id"), "embedding")
    whole = lib.item_vectors.where(usable("embedding")).select(F.col("item_id").alias("id"), "embedding").join(chunks.select("id").distinct(), "id", "left_anti")
    return chunks.unionByName(whole).join(items, "id").select("id", "user_id", "embedding")


def indexed_semantic(spark: SparkSession, index: VectorIndex, vector: list[float], limit: int, *, user_id: int | None = None, probes: int | None = None) -> DataFrame:
    """P1 on an index of entries(): (id, score, rank).  Exact, or by the ``probes`` nearest lists."""
    keep = None if user_id is None else F.col("user_id") == user_id
    return _ranked(probe(index, vector, limit, probes=probes, keep=keep, spark=spark)[0], limit)


def semantic(lib: Library, vector: list[float], limit: int) -> DataFrame:
    """(id, score, rank): best chunk of each titled item; items without chunks by their own vector."""
    items = lib.items.where("title <> ''").select("id")
    chunks = lib.chunks.where(usable("embedding")).select(F.col("item_id").alias("id"), "embedding")
    by_chunk = chunks.join(items, "id", "left_semi").select("id", cosine_to(vector).alias("s")).where("s is not null").groupBy("id").agg(F.max("s").alias("score"))
    whole = lib.item_vectors.where(usable("embedding")).select(F.col("item_id").alias("id"), "embedding").join(items, "id", "left_semi").join(chunks.select("id").distinct(), "id", "left_anti")
    return _ranked(by_chunk.unionByName(whole.select("id", cosine_to(vector).alias("score")).where("score is not null")), limit)


def keyword(lib: Library, query: str, limit: int) -> DataFrame:
    """(id, score, rank) of titled items that match, at most 50."""
    items = lib.items.where("title <> ''").withColumn("tag_text", F.array_join("tags", " "))
    return _ranked(fulltext.search(items, query, FIELDS, limit=None), min(limit, 50))


def entity(lib: Library, query: str, vector: list[float], limit: int, *, gate: float = GATE, expand: float = EXPAND, strict: bool = False) -> DataFrame:
    """(id, score, rank, matched_via): items that mention entities near the query or its neighbours in the graph.

    An entity of exactly the query's name has similarity 1.  Neighbours within one step of entities at or above
    ``expand`` count if their own similarity is positive.  Mentions weigh sim / log2(2 + number of the entity's items);
    an item has its best one and REST times the others.  Without any entity vector nothing comes back.  Deleted and
    untitled items come back as well unless ``strict``.
    """
    sims = lib.entities.select("id", "name", F.when(usable("embedding"), cosine_to(vector)).alias("sim"))
    exact = F.lower("name") == query.strip().lower()
    any_vector = not lib.entities.where(F.col("embedding").isNotNull()).limit(1).isEmpty()
    seen = sims.withColumn("exact", exact).select("id", "name", F.when(F.col("exact"), F.lit(1.0)).otherwise(F.col("sim")).alias("sim"), (F.col("exact") | (F.col("sim") >= gate)).alias("anchor")).where(F.lit(any_vector))
    anchors = seen.where("anchor")
    near = neighbours(lib.relations, anchors.where(F.col("sim") >= expand).select("id"), 1)
    chosen = anchors.select("id", "name", "sim").unionByName(seen.where("not coalesce(anchor, false) and sim > 0").join(near, "id", "left_semi").select("id", "name", "sim"))
    met = lib.mentions.join(chosen.withColumnRenamed("id", "entity_id"), "entity_id")
    met = met.withColumn("c", F.col("sim") / F.log2(F.lit(2.0) + F.count("*").over(Window.partitionBy("entity_id"))))
    by_item = met.groupBy(F.col("item_id").alias("id")).agg(
        F.round((1 - REST) * F.max("c") + REST * F.sum("c"), 9).alias("score"),
        F.array_sort(F.collect_list(F.struct((-F.round("sim", 4)).alias("s"), "name"))).alias("m"),
    )
    if strict:
        by_item = by_item.join(lib.items.where("title <> ''").select("id"), "id", "left_semi")
    via = F.transform("m", lambda m: F.struct(m["name"].alias("name"), (-m["s"]).alias("sim")))
    return _ranked(by_item.select("id", "score", via.alias("matched_via")), limit)


def _fused(lanes: DataFrame, limit: int) -> DataFrame:
    """Sums of lanes (id, lane, rank, value) by id, best first; ties keep the order in which lanes show ids."""
    order = [F.desc("fused"), F.asc("seen")]
    best = lanes.groupBy("id").agg(F.round(F.sum("value"), 12).alias("fused"), F.min(F.col("lane") * 1_000_000 + F.col("rank")).alias("seen")).orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _lane(rows: DataFrame, number: int) -> DataFrame:
    return rows.select("id", F.lit(number).alias("lane"), "rank", (F.lit(1.0) / (RRF + F.col("rank"))).alias("value"))


def _page(found: DataFrame, lib: Library, limit: int, offset: int, meta: dict[str, str], *, every: DataFrame | None = None) -> DataFrame:
    """Rows by rank with title and date; days are looked at after paging, so a page may come out short."""
    items = (every or lib.items).select("id", "title", "created_at")
    page = found.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).join(items, "id")
    return filters.dated(page, meta.get("after"), meta.get("before"))


def search(lib: Library, query: str, vector: list[float] | None, *, user_id: int | None = None, mode: str = "auto", limit: int = 10, offset: int = 0, authors: frozenset[str] | None = None, gate: float = GATE, expand: float = EXPAND) -> DataFrame:
    """P4 (auto) and P5 (full): id, title, created_at, rank, score, match_type, fused, semantic_score, matched_via.

    ``auto`` follows the query's intent: filters, words with vectors where words find nothing, vectors with words where
    these find nothing, or both fused.  ``full`` fuses filters (if the query has any), words and vectors and adds the
    entity lane's scores.  Candidates are WIDER times the page where lanes are fused.  Scores are 1 / (60 + rank) for
    fused results, the lane's own otherwise.  ``authors`` (lower case) default to those of the items; limit is 50 at most.
    """
    lib = lib if user_id is None else lib.of(user_id)
    limit = max(1, min(limit, 50))
    if authors is None:
        authors = frozenset(r[0] for r in lib.items.where(F.lower("author") == query.strip().lower()).select(F.lower("author")).distinct().collect())
    meta = queries.operators_in(query)
    words = queries.without_dates(query)
    kind, found = queries.classify(query, authors)
    fetch = offset + limit
    none = {"fused": F.lit(None).cast("double"), "semantic_score": F.lit(None).cast("double"), "matched_via": F.lit(None).cast("array<struct<name:string,sim:double>>")}
    shown = ["id", "title", "created_at", "rank", "score", "match_type", *none]

    def filtered(n: int) -> DataFrame:
        rows = filters.structured(lib.items, author=found.get("author"), tag=found.get("tag"), site=found.get("site"), state=found.get("is"), before=found.get("before"), after=found.get("after"), limit=n)
        order = [F.desc("created_at"), F.asc("id")]
        return rows.select("id", F.lit(1.0).alias("score"), F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"))

    def alone(rows: DataFrame, name: str, dates: dict[str, str]) -> DataFrame:
        return _page(rows, lib, limit, offset, dates).withColumn("match_type", F.lit(name)).withColumns(none).select(*shown)

    by_vector = lambda n: None if vector is None else semantic(lib, vector, n)
    if mode == "full":
        return _full(lib, words, vector, meta, found, filtered, limit, offset, gate, expand).select(*shown)
    text = words or query
    if kind == "filter":
        return alone(filtered(fetch), "filter", {})
    if kind == "keyword":
        rows = keyword(lib, text, fetch)
        if rows.isEmpty() and (other := by_vector(fetch)) is not None and not other.isEmpty():
            return alone(other, "semantic_fallback", meta)
        return alone(rows, "keyword", meta)
    if kind == "semantic":
        rows = by_vector(fetch)
        if rows is None or rows.isEmpty():
            return alone(keyword(lib, text, fetch), "keyword", meta)
        return alone(rows, "semantic", meta)
    first, second = keyword(lib, text, WIDER * fetch), by_vector(WIDER * fetch)
    if second is None or second.isEmpty():
        return alone(first, "keyword", meta)
    fused = _fused(_lane(first, 1).unionByName(_lane(second, 2)), fetch)
    fused = fused.withColumn("score", F.lit(1.0) / (RRF + F.col("rank")))
    rest = {k: v for k, v in none.items() if k != "fused"}
    return _page(fused, lib, limit, offset, meta).withColumn("match_type", F.lit("hybrid")).withColumns(rest).select(*shown)


def _full(lib: Library, words: str, vector: list[float] | None, meta: dict, found: dict, filtered, limit: int, offset: int, gate: float, expand: float) -> DataFrame:
    n = WIDER * (offset + limit)
    columns = "id bigint, lane int, rank bigint, value double, score double, via array<struct<name:string,sim:double>>"
    lanes = lib.items.sparkSession.createDataFrame([], columns)

    def add(rows: DataFrame, number: int) -> None:
        nonlocal lanes
        via = F.col("matched_via") if "matched_via" in rows.columns else F.lit(None).cast("array<struct<name:string,sim:double>>")
        value = F.col("score") * ENTITY_SCALE if number == 3 else F.lit(1.0) / (RRF + F.col("rank"))
        lanes = lanes.unionByName(rows.select("id", F.lit(number).alias("lane"), "rank", value.alias("value"), "score", via.alias("via")))

    if found:
        add(filtered(n), 0)
    if words:
        add(keyword(lib, words, n), 1)
    if words and vector is not None:
        add(semantic(lib, vector, n), 2)
        if lib.entities is not None:
            add(entity(lib, words, vector, n, gate=gate, expand=expand), 3)
    order = [F.desc("fused"), F.asc("seen")]
    first = F.min("lane")
    best = lanes.groupBy("id").agg(
        F.round(F.sum("value"), 12).alias("fused"),
        F.min(F.col("lane") * 1_000_000 + F.col("rank")).alias("seen"),
        first.alias("first"),
        F.max(F.col("lane") == 3).alias("has_entity"),
        F.max(F.when(F.col("lane") == 2, F.col("score"))).alias("sem"),
        F.max("via").alias("via"),
    )
    best = best.orderBy(*order).limit(offset + limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    name = F.element_at(F.array(*map(F.lit, ("filter", "keyword", "semantic", "entity"))), F.col("first") + 1)
    best = best.withColumns({
        "score": F.lit(1.0) / (RRF + F.col("rank")),
        "match_type": F.when(F.col("has_entity") & (F.col("first") < 3), F.concat(F.lit("entity+"), name)).otherwise(name),
        "semantic_score": F.when(F.col("first") == 2, F.col("sem")),
        "matched_via": F.when(F.col("first") == 3, F.col("via")),
    })
    return _page(best, lib, limit, offset, meta)


def highlights(lib: Library, query: str, limit: int = 10) -> DataFrame:
    """Highlights of live items that match the query's words as they are, best first, not damped."""
    live = lib.highlights.join(lib.items.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    found = fulltext.search(live, query, {"text": "D"}, limit=limit, dictionaries=("simple",), damped=False)
    return found.join(lib.highlights.select("id", "item_id", "text"), "id")


def unified(lib: Library, query: str, vector: list[float] | None, **options) -> dict[str, DataFrame]:
    """Items as search() gives them, and ten highlights."""
    user = options.get("user_id")
    return {"items": search(lib, query, vector, **options), "highlights": highlights(lib if user is None else lib.of(user), query)}


def draft_reads(lib: Library, title: str | None, body: str | None, vector: list[float] | None, *, user_id: int | None = None, limit: int = 5) -> DataFrame | None:
    """What to read for a draft: full search by its title and first 200 characters; None under 50 words."""
    if len((body or "").split()) < 50:
        return None
    return search(lib, f"{title or ''} {(body or '')[:200]}".strip(), vector, user_id=user_id, mode="full", limit=limit)


def known_authors(spark: SparkSession, items: DataFrame) -> DataFrame:
    """A4: distinct authors of each user in lower case."""
    return items.where("author is not null").select("user_id", F.lower("author").alias("author")).distinct()
