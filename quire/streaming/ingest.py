"""R9, R8 as a stream: pages arrive in batches, each goes through all steps once, whatever fails between them.

Each batch has a partition of its own in every table, so applying one again replaces its rows.  A ledger names the steps
that a batch has finished; readers see what it names, and a batch that comes again after a failure starts at the first
step that is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import urls
from quire.operators import upkeep

STEPS = ("items", "chunks")
RAW = "page_id bigint, user_id bigint, url string, html string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _done(spark: SparkSession, root: str, batch_id: int, step: str) -> str | None:
    path = f"{root}/ledger/batch={batch_id}/step={step}"
    return None if _exists(spark, f"{path}/_SUCCESS") else path


def committed(spark: SparkSession, root: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table's rows of the batches whose step is in the ledger (those before ``before``, if given); None if there are
    none."""
    if not _exists(spark, f"{root}/ledger"):
        return None
    ledger = spark.read.schema("finished timestamp, batch int, step string").parquet(f"{root}/ledger").where(F.col("step") == name)
    batches = [r.batch for r in ledger.select("batch").distinct().collect() if before is None or r.batch < before]  # one number for each batch
    if not batches:
        return None
    return spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/batch={b}" for b in sorted(batches)])


def apply_batch(batch: DataFrame, batch_id: int, root: str, attempts: int = 3, before_step: Callable[[str], None] = lambda step: None) -> None:
    """All steps for one batch (columns of RAW), each tried up to ``attempts`` times; a finished step is not done again.

    Pages that earlier batches hold for the user, by their normalised address, are left out.  Only batches before this
    one count for that, so that a batch applied again gives the same rows.  ``before_step`` is called before each try.
    """
    spark = batch.sparkSession
    known = committed(spark, root, "items", before=batch_id)
    fresh = batch.withColumn("_address", F.coalesce(urls.normalize_url("url"), "url"))
    if known is not None:
        fresh = fresh.join(known.select("user_id", F.col("url").alias("_address")), ["user_id", "_address"], "left_anti")
    tables = upkeep.ingested(fresh.drop("_address"))
    for step in STEPS:
        mark = _done(spark, root, batch_id, step)
        if mark is None:
            continue
        for attempt in range(attempts):
            try:
                before_step(step)
                tables[step].write.mode("overwrite").parquet(f"{root}/{step}/batch={batch_id}")
                break
            except Exception:
                if attempt == attempts - 1:
                    raise
        spark.range(1).select(F.current_timestamp().alias("finished")).write.mode("overwrite").parquet(mark)


def ingest(pages: DataFrame, root: str, attempts: int = 3, seconds: float | None = None, before_step: Callable[[str], None] = lambda step: None) -> StreamingQuery:
    """Start the stream; ``seconds`` between batches, or, without them, all that is there and then the end.

    The rate is the source's: ``maxFilesPerTrigger`` files (or another source's rows) every ``seconds``.
    """
    writer = pages.writeStream.option("checkpointLocation", f"{root}/progress").foreachBatch(partial(apply_batch, root=root, attempts=attempts, before_step=before_step))
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()
