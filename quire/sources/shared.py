"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it names none, a temporary one serves a local session (tests), where all tasks share the machine; on a
    cluster that would be a folder of one machine only, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quire-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver ends."""
    top = shared_dir(spark)
    if top not in _roots:
        _roots[top] = f"{top}/quire-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[top])
    return f"{_roots[top]}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and read it, so that lost executors cost no recomputation.

    A table rather than checkpoint(): columns are compressed, and a plan read from files carries no constraints, which
    checkpointed plans hand on and which grow beyond measure in loops.  The application's own folder goes when the
    driver ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
