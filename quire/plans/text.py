"""Queries of text and page operators, ad-hoc SQL and streams, over whole tables.

Those without SQL equivalents are held against expectations in tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout, pages, urls
from quire.operators.similarity import hashed_recall, usable
from quire.plans import safe_sql
from quire.sources.library import Dialect, table, with_tables
from quire.streaming import limiter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def x1_normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", urls.normalize_url("url").alias("url"))


def x4_title_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", urls.title_from_url("url").alias("title"))


def x9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _read(spark, sf_dir, "pages").select("page_id", F.posexplode(pages.split_chunks("html")).alias("chunk_index", "text"))
    return split.withColumn("n_words", F.regexp_count("text", F.lit(r"\S+")))


def x27_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", pages.page_metadata("html", "url").alias("m")).select("page_id", "m.*")


def x29_limited_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _read(spark, sf_dir, "pages").select("page_id", pages.limit_features("html", F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)).alias("f"))
    return got.select("page_id", F.expr(pages.LIMITED).alias("issue"), F.col("f.words").alias("words"))


def x31_rebuild_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", pages.rebuild_html("html").alias("html"))


def x33_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return p.select("page_id", pages.clean_html("html", title, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("html"))


def x34_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", pages.readability("html").alias("r")).select("page_id", "r.*")


def x37_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.posexplode(pages.html_blocks("html")).alias("pos", "b")).select("page_id", "pos", "b.*")


def j16_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "highlights")
    by_item = h.groupBy("item_id").agg(F.max("end_offset").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("id", "start_offset", "end_offset"))).alias("m"))
    return by_item.select("item_id", F.explode(layout.sweep("n", "m.start_offset", "m.end_offset", "m.id")).alias("s")).select("item_id", "s.s", "s.e", F.array_join(F.col("s.ids").cast("array<string>"), ",").alias("ids"))


def p16_safe_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in ("items", "highlights")}
    sql = "```sql\nselect i.lang, count(*) as n from items i where i.user_id = :user_id group by i.lang\n```"
    return safe_sql.run(spark, sql, tables, 3)


def e7_ann_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact pairs at cosine 0.3 that random-projection hashing finds as well: pairs that agree in one of
    eight hashes, as their distance is then below that of cosine 0.3 anyway."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(spark, sf_dir, "vectors").where(usable("embedding")).select("id", "embedding", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")).alias("u"))
    unit = v.select("id", "embedding", array_to_vector("u").alias("features"))
    tables = [f"h{i}" for i in range(8)]
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="h", bucketLength=1.0, numHashTables=len(tables), seed=7).fit(unit)
    hashed = model.transform(unit).select("id", "embedding", *[vector_to_array(F.col("h")[i])[0].cast("int").alias(h) for i, h in enumerate(tables)])
    return hashed_recall(hashed, tables, 0.3)


def r1_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return limiter.limited_batch(e)


def r2_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.hourly(_read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


QUERIES = {
    f.__name__: f
    for f in (
        x1_normalize_url, x4_title_from_url, x9_chunks, x27_page_metadata, x29_limited_extraction, x31_rebuild_html,
        x33_clean_html, x34_readability, x37_blocks, j16_segments, p16_safe_sql, r1_rate_limit, r2_hourly_counts,
        e7_ann_overlap,
    )
}
_d = Dialect(False)
_names = ", ".join(f"'{x}'" for x in sorted(urls.TRACKING))
ORACLES = {
    # parameters sort as whole strings here, which equals sorting by key as no key repeats in the table
    "x1_normalize_url": f"""
        with u as (select page_id, regexp_replace(trim(url), '#.*$', '') as u from pages),
        p as (select page_id, split_part(u, '?', 1) as b, list_sort(list_filter(string_split(case when position('?' in u) > 0 then substr(u, position('?' in u) + 1) else '' end, '&'), lambda x: x <> '' and not list_contains([{_names}], lower(split_part(x, '=', 1))))) as k from u)
        select page_id, concat(regexp_replace(concat(lower(regexp_extract(b, '^[a-zA-Z]+://[^/]*')), regexp_replace(b, '^[a-zA-Z]+://[^/]*', '')), '/+$', ''), case when len(k) > 0 then concat('?', array_to_string(k, '&')) else '' end) as url from p""",
    "x4_title_from_url": "select page_id, regexp_replace(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '([^/]+)/*$', 1), '[.][^.]*$', '') as title from pages",
    "j16_segments": with_tables(
        """select s.item_id, s.s, s.e, coalesce(string_agg(cast(h.id as varchar), ',' order by h.id), '') as ids
        from (select item_id, x as s, lead(x) over (partition by item_id order by x) as e from (select item_id, 0 as x from highlights union select item_id, start_offset from highlights union select item_id, end_offset from highlights) c) s
        left join highlights h on h.item_id = s.item_id and h.start_offset < s.e and h.end_offset > s.s where s.e is not null group by s.item_id, s.s, s.e""",
        _d,
    ),
    "p16_safe_sql": with_tables("select lang, count(*) as n from items where user_id = 3 group by lang", _d),
    "r2_hourly_counts": "select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2",
}
