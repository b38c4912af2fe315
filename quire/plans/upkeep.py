"""Upkeep queries: the ingest steps, search vectors, caches, the schedule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fulltext
from quire.operators import upkeep
from quire.sources.library import NOW, Dialect, query, table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_d = Dialect(False)


def answer(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_tables(sql, _d)
        return f

    return keep


_RUNS = "select case event_type when 'signup' then 'embed highlights' when 'error' then 'embed entities' when 'click' then 'purge deleted' when 'view' then 'cluster themes' else 'other' end as job, ts as run_at from activity where ts < timestamp '2024-01-25'"
_JOBS = ", ".join(f"('{k}', {v})" for k, v in upkeep.SCHEDULE.items())


@answer(f"""with l as (select job, max(run_at) as last_run from ({_RUNS}) r group by job) select j.job, epoch_us(last_run) as last_run, coalesce(epoch_us(last_run) + seconds::bigint * 1000000, {NOW}::bigint * 1000000) as next_run, coalesce(epoch_us(last_run) + seconds::bigint * 1000000 <= {NOW}::bigint * 1000000, true) as due
  from (values {_JOBS}) j(job, seconds) left join l on l.job = j.job""")
def r2_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = query(spark, sf_dir, _RUNS).withColumn("run_at", F.col("run_at").cast("timestamp"))
    got = upkeep.due_jobs(runs, F.timestamp_seconds(F.lit(NOW)))
    return got.select("job", F.unix_micros("last_run").alias("last_run"), F.unix_micros("next_run").alias("next_run"), "due")


@answer("select key, id, epoch_us(made_at) as made_at from (select concat(event_type, cast(user_id % 40 as varchar)) as key, id, ts as made_at from activity) a where made_at <= timestamp '2024-01-20' and made_at > timestamp '2024-01-13' qualify row_number() over (partition by key order by made_at desc, id) = 1")
def r11_fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of seven days that still serve."""
    entries = table(spark, sf_dir, "activity").select(F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("key"), "id", F.col("ts").cast("timestamp").alias("made_at"))
    got = upkeep.fresh(entries, "key", "made_at", F.to_timestamp(F.lit("2024-01-20 00:00:00")), 7 * 86_400)
    return got.select("key", "id", F.unix_micros("made_at").alias("made_at"))


_STOP = ", ".join(f"'{w}'" for w in sorted(fulltext.STOP))


def _tokens(field: str) -> str:
    return f"regexp_extract_all(lower(regexp_replace(coalesce({field}, ''), '<[^>]+>', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)?')"


def _both(field: str) -> str:
    return f"(len({_tokens(field)}) + len(list_filter({_tokens(field)}, lambda w: not list_contains([{_STOP}], w))))"


@answer(f"""select id, {_both('title')} + {_both('author')} as n_a, {_both('description')} + {_both("array_to_string(tags, ' ')")} as n_b, {_both('full_text')} as n_c from live where full_text is not null""")
def q1_search_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: positions of each weight in the vectors that are kept beside items."""
    v = upkeep.with_search_vector(table(spark, sf_dir, "live").where("full_text is not null"))
    n = lambda weight: F.size(F.filter("search_vector", lambda p: p["weight"] == weight)).cast("bigint")
    return v.select("id", n(1.0).alias("n_a"), n(0.4).alias("n_b"), n(0.2).alias("n_c"))


@answer()
def r9_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, some of them twice or with broken addresses, through all steps; items with their number of chunks."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    again = p.where("page_id % 3 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat("url", F.lit("#again")).alias("url"), "html")
    broken = p.where("page_id % 7 = 0").select((F.col("page_id") + 2_000_000).alias("page_id"), F.concat(F.lit("http://[bad"), F.col("page_id")).alias("url"), "html")
    got = upkeep.ingested(p.select("page_id", "url", "html").unionByName(again).unionByName(broken).withColumn("user_id", F.col("page_id") % 5))
    n = got["chunks"].groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n_chunks"))
    return got["items"].join(n, "id", "left").select("id", "user_id", "url", "title", "word_count", "minutes", "status", "error", "content_type", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
