"""Reads and joins of stored tables (S1, S2, J1, J3): by folder, by bucket, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import relational
from quire.sources.library import Dialect, table, with_tables
from quire.sources.storage import Store, stored


def _store(spark: SparkSession, sf_dir: str, *names: str) -> Store:
    return stored(spark, {n: table(spark, sf_dir, n) for n in names}, buckets=16)


def s1_stored_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 from one tenant's folder."""
    return _store(spark, sf_dir, "items").of("items", 3).where("not is_deleted").select("id", "title", "created_at")


def s2_stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 from one bucket of one tenant's folder."""
    body = F.when(F.length("full_text") > 32000, F.concat(F.substring("full_text", 1, 32000), F.lit(" [truncated]"))).otherwise(F.col("full_text"))
    return _store(spark, sf_dir, "items").of("items", 2, 42).where("not is_deleted").select("id", "title", body.alias("body"))


def j1_stored_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 of tables with the same buckets."""
    s = _store(spark, sf_dir, "items", "chunks")
    live = s.read("items").where("not is_deleted").select(F.col("id").alias("item"), "title")
    return s.read("chunks").select("id", "item_id").join(live, F.col("item_id") == F.col("item")).select("id", "item", "title")


def j3_stored_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables with the same buckets."""
    s = _store(spark, sf_dir, "items", "highlights", "membership")
    live = s.read("items").where("not is_deleted").select(F.col("id").alias("item_id"))
    held = s.read("highlights").select("id", "item_id", "created_at").join(live, "item_id")
    return held.join(s.read("membership").select("item_id", "list_id"), "item_id").select("list_id", "id", "created_at")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (s1_stored_scan, s2_stored_lookup, j1_stored_join, j3_stored_join)}
_d = Dialect(False)
ORACLES = {name: with_tables(relational.SQL[plain](_d), _d) for name, plain in {"s1_stored_scan": "s1_live_scan", "s2_stored_lookup": "s2_point_lookup", "j1_stored_join": "j1_chunks_items", "j3_stored_join": "j3_list_highlights"}.items()}
