"""Upkeep of a library: the ingest steps (R9), derived search vectors (Q1), fresh cache entries (R11), the schedule (R2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from quire.functions import fulltext, pages, urls

#: Periodic jobs and their seconds.
SCHEDULE = {"embed highlights": 300, "embed entities": 3600, "purge deleted": 86_400, "backfill entities": 86_400, "cluster themes": 604_800, "merge entities": 604_800}


def due_jobs(last_runs: DataFrame, as_of: Column, schedule: dict[str, int] = SCHEDULE) -> DataFrame:
    """R2: (job, last_run, next_run, due) for every job; one that never ran (or is not in ``last_runs``) is due at once."""
    spark = last_runs.sparkSession
    jobs = spark.createDataFrame(list(schedule.items()), "job string, seconds bigint")
    last = last_runs.groupBy("job").agg(F.max("run_at").alias("last_run"))
    both = jobs.join(last, "job", "left")
    after = F.timestamp_micros(F.unix_micros("last_run") + F.col("seconds") * 1_000_000)
    return both.withColumn("next_run", F.coalesce(after, as_of)).withColumn("due", F.col("next_run") <= as_of).select("job", "last_run", "next_run", "due")


def fresh(entries: DataFrame, key: str, at: str, as_of: Column, seconds: int) -> DataFrame:
    """The newest entry of each key, if it is not older than ``seconds`` at ``as_of``; later ones do not count."""
    age = F.unix_micros(as_of) - F.unix_micros(F.col(at))
    young = entries.where((age >= 0) & (age < seconds * 1_000_000))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *[c for c in entries.columns if c not in (key, at)]))
    return young.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


#: Bytes of texts whose vectors are made, and sent back, at a time: a vector takes up to twenty times its text.
VECTORS = 1 << 20


def search_vectors(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Q1: the vectors that a trigger keeps beside items, lexemes of both dictionaries with positions and weights, from
    their title, author, description, tags and text; a block of rows at a time."""
    weights = np.array([fulltext.WEIGHTS[x] for x in "AABBC"])
    for columns in batches:
        for lo, hi in fulltext.text_blocks(columns, VECTORS):
            p = fulltext.places([c.slice(lo, hi - lo) for c in columns], ("english", "simple"))
            order = p.sorted_by(p.doc, p.lexeme)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(p.doc, minlength=hi - lo))])
            parts = [p.lexemes.take(pa.array(p.lexeme[order])), pa.array(p.position[order].astype(np.int32)), pa.array(weights[p.field[order]])]
            yield pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(parts, ["lexeme", "position", "weight"]))


def with_search_vector(items: DataFrame) -> DataFrame:
    """Q1: items with ``search_vector``, computed when they are written."""
    made = F.arrow_udf(search_vectors, "array<struct<lexeme: string, position: int, weight: double>>", ArrowUDFType.SCALAR_ITER)
    return items.withColumn("search_vector", made("title", "author", "description", F.array_join("tags", " "), "full_text"))


def ingested(raw: DataFrame) -> dict[str, DataFrame]:
    """Pages (page_id, user_id, url, html) through all steps: address, duplicates, metadata, words, chunks.

    Returns ``items`` and ``chunks``.  A page whose address cannot be parsed fails: it is an item with a status and an
    error.  Vectors and analyses come from models outside; what they need is in these tables.
    """
    clean = raw.withColumn("clean", urls.normalize_url("url"))
    nth = F.row_number().over(Window.partitionBy("user_id", F.coalesce("clean", "url")).orderBy("page_id"))
    first = clean.withColumn("nth", nth).where("nth = 1").drop("nth")
    meta = first.withColumn("m", pages.page_metadata("html", "url"))
    text = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"(?U)\s+", " "))
    words = F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("bigint")
    ok = F.col("clean").isNotNull()
    items = meta.select(
        F.col("page_id").alias("id"), "user_id", F.coalesce("clean", "url").alias("url"), "m.*", words.alias("word_count"), F.greatest(F.lit(1), F.bround(words / 200)).cast("bigint").alias("minutes"),
        F.when(ok, "completed").otherwise("failed").alias("status"), F.when(~ok, "not a URL").alias("error"), urls.detect_content_type("url", F.lit(None).cast("string")).alias("content_type"),
    )
    split = first.where(ok).select(F.col("page_id").alias("item_id"), "user_id", F.posexplode(pages.split_chunks("html")).alias("chunk_index", "text"))
    return {"items": items, "chunks": split}
