"""Sinks and sources outside SQL: replacing an item's rows (S8), bulk load (S10), events (S11), binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise


def replace_by_key(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Delete-then-insert for the keys in ``df``: only their buckets are rewritten, other keys in them are kept.

    Rows are partitioned by a hash bucket of the key.  The new state of the touched buckets is written before anything
    is replaced, by Spark's dynamic partition overwrite.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = df.withColumn("bucket", bucket)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        new = old.join(df.select(key).distinct(), key, "left_anti").unionByName(new).select(*df.columns, "bucket")
        new = materialise(new)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with its schema declared, never inferred."""
    return spark.read.schema(schema).parquet(path)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """Clicks and dismissals as JSON lines; a stream appends, a table is written at once."""
    if events.isStreaming:
        return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    return events.write.mode("append").json(path)


def binary_pages(spark: SparkSession, path: str) -> DataFrame:
    """Documents as bytes with their size and time; layout models run elsewhere and hand in blocks."""
    return spark.read.format("binaryFile").load(path)
