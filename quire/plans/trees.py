"""Queries on pages as tables of elements (X34, X37), images put back (X31), fields of changing type (X27, S7), order and
search by collation (T6, F7), ingest as a stream (R9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import nodes, pages
from quire.operators import placement
from quire.plans import text
from quire.sources.library import Dialect, query, table, with_tables
from quire.sources.shared import scratch
from quire.streaming import ingest


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def x37_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of each kind a page has, from its table of elements."""
    return nodes.elements(_pages(spark, sf_dir).select("page_id", "html")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def x34_node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element that holds a page's text, by joins over its elements."""
    scored = nodes.container_scores(nodes.elements(_pages(spark, sf_dir).select("page_id", "html")), "page_id")
    return scored.where("rank = 1").select("page_id", "pre", "tag", F.round("score", 4).alias("score"))


def x31_placed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures after every second paragraph of the source, put back into the rebuilt article."""
    parts = F.split("html", "</p>")
    pictured = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit('<img src="/picture/'), i.cast("string"), F.lit('.png">'), x)).otherwise(x)), "</p>")
    both = _pages(spark, sf_dir).select("page_id", pictured.alias("source"), pages.rebuild_html("html").alias("extracted"))
    return placement.placed(both, "page_id")


_LD = """case id % 5 when 0 then concat('{"author": "', author, '", "image": ["/a.png", "/b.png"]}') when 1 then concat('{"author": {"name": "', author, '"}, "image": {"url": "/c.png"}}')
  when 2 then concat('{"author": [{"name": "', author, '"}, "Guest"], "image": "/d.png"}') when 3 then '{"author": 7, "image": {"url": null}}' else '{broken' end"""


def x27_variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author and image of JSON-LD that is a string, an object or a list, by VARIANT; odd types give null."""
    v = table(spark, sf_dir, "items").select("id", F.try_parse_json(F.expr(_LD)).alias("v"))
    author, image = F.try_variant_get("v", "$.author", "variant"), F.try_variant_get("v", "$.image", "variant")
    return v.select("id", F.nullif(F.array_join(nodes.ld_names(author), ", "), F.lit("")).alias("author"), nodes.ld_image(image).alias("image"))


#: The four keys of the index view.
KEYS = {"date": "created_at", "title": "title collate {c}", "author": "author collate {c}", "domain": "domain collate {c}"}


def _sorted(d: Dialect, c: str) -> str:
    site = f"select *, {d.gsub(d.group('url', '^https?://([^/]+)'), '^www[.]', '')} as domain from live"
    one = lambda k, e, way: f"select '{k}' as sort_key, '{way}' as way, id, row_number() over (order by {e.format(c=c)} {way}, id) as place from (select * from s order by {e.format(c=c)} {way}, id limit 100) t"
    return f"with s as ({site}) " + " union all ".join(one(k, e, way) for k, e in KEYS.items() for way in ("asc", "desc"))


def t6_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 of each order, with accents and cases where a reader looks for them."""
    return query(spark, sf_dir, _sorted(Dialect(True), "unicode"))


def f7_collated_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles that contain a word whatever its case and accents."""
    found = F.contains(F.collate("title", "UNICODE_CI_AI"), F.collate(F.lit("CION"), "UNICODE_CI_AI"))
    return table(spark, sf_dir, "live").where(found).select("id")


def r9_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a stream through all steps; what the tables hold for each user then."""
    root = scratch(spark)
    files = f"{sf_dir}/pages.parque[t]"  # a pattern, as a stream takes no single file by its name
    stream = spark.readStream.schema(_pages(spark, sf_dir).schema).option("maxFilesPerTrigger", 1000).parquet(files)
    ingest.ingest(stream.select("page_id", (F.col("page_id") % 5).alias("user_id"), "url", "html"), root).awaitTermination()
    return ingest.committed(spark, root, "items").groupBy("user_id").agg(F.count("*").alias("n_items"), F.sum("word_count").alias("n_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (x37_elements, x34_node_scores, x31_placed_images, x27_variant_fields, t6_collated, f7_collated_contains, r9_stream_ingest)
}
_d = Dialect(False)
ORACLES = {
    name: with_tables(sql, _d)
    for name, sql in {
        "x37_elements": """select page_id, tag, count(*) as n from (select page_id, lower(unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1))) as tag from pages) t group by page_id, tag""",
        "x27_variant_fields": "select id, case id % 5 when 0 then author when 1 then author when 2 then concat(author, ', Guest') end as author, case id % 5 when 0 then '/a.png' when 1 then '/c.png' when 2 then '/d.png' end as image from items",
        "t6_collated": _sorted(_d, "en"),
        "r9_stream_ingest": f"""
            with a as (select p.page_id, p.page_id % 5 as user_id, p.html, x.url from pages p join ({text.ORACLES["x1_normalize_url"]}) x using (page_id)),
            f as (select * from a qualify row_number() over (partition by user_id, url order by page_id) = 1)
            select user_id, count(*) as n_items, sum(len(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\S+')))::bigint as n_words from f group by user_id""",
        "f7_collated_contains": "select id from live where contains(strip_accents(lower(title)), 'cion')",
    }.items()
}
