"""The library's tables as a service keeps them: a folder for each group of tenants, buckets by item inside.

A tenant's rows are found by folder, one item's by bucket, and tables that share their items join without a shuffle.  A
tenant with a third of all rows is still spread over all buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch

#: Column of the item in each table, and whether the rows belong to a tenant (user_id).
KEYS = {"items": ("id", True), "highlights": ("item_id", True), "chunks": ("item_id", False), "membership": ("item_id", False)}
#: Files of a bucket that one write makes, so that a hot item's rows come from more than one task.
FILES = 4
#: A table whose largest bucket has more than this many times the mean is read without its buckets: then a join shuffles,
#: and a hot item can be split.
SKEW = 4.0


@dataclass
class Store:
    """Tables under ``root``; their names in the catalog start with ``name``."""

    spark: SparkSession
    root: str
    buckets: int = 64
    tenants: int = 16
    name: str = field(default_factory=lambda: f"quire_{uuid.uuid4().hex[:12]}")

    def tenant(self, user: Column | int) -> Column:
        """The folder of a user's rows."""
        return F.pmod(F.xxhash64(F.lit(user).cast("bigint")), F.lit(self.tenants)).cast("int")

    def write(self, table: str, rows: DataFrame) -> None:
        """Add rows to a table; the first write makes it.  A null item or user is a value like others."""
        key, owned = KEYS[table]
        spread = F.pmod(F.xxhash64(*rows.columns), F.lit(FILES))
        rows = rows.withColumn(key, F.col(key).cast("bigint"))
        if owned:
            rows = rows.withColumn("tenant", self.tenant(F.col("user_id")))
        writer = rows.repartition(self.buckets, key, spread).write.mode("append").format("parquet").option("path", f"{self.root}/{table}").bucketBy(self.buckets, key).sortBy(key)
        (writer.partitionBy("tenant") if owned else writer).saveAsTable(f"{self.name}_{table}")

    def skew(self, table: str) -> float:
        """Rows of the largest bucket over the mean of all."""
        key, _ = KEYS[table]
        sizes = self.spark.table(f"{self.name}_{table}").groupBy(F.pmod(F.hash(key), F.lit(self.buckets)).alias("bucket")).count()
        most, rows = sizes.agg(F.max("count"), F.sum("count")).first()
        return most * self.buckets / rows if rows else 0.0

    def read(self, table: str) -> DataFrame:
        """A table for joins by item: by its buckets, or, where one of them is far larger than the others, without."""
        if self.skew(table) > SKEW:
            return self.spark.read.schema(self.spark.table(f"{self.name}_{table}").schema).parquet(f"{self.root}/{table}").drop("tenant")
        return self.spark.table(f"{self.name}_{table}").drop("tenant")

    def of(self, table: str, user_id: int, item: int | None = None) -> DataFrame:
        """One user's rows, of one item if given: one folder, and one bucket in it, are read."""
        key, owned = KEYS[table]
        if not owned:
            raise ValueError(f"{table} has no users")
        folder = self.spark.range(1).select(self.tenant(user_id)).first()[0]
        found = self.spark.table(f"{self.name}_{table}").where((F.col("tenant") == folder) & (F.col("user_id") == user_id))
        return (found if item is None else found.where(F.col(key) == item)).drop("tenant")

    def drop(self) -> None:
        """Forget the tables; their files stay under ``root``."""
        for table in KEYS:
            self.spark.sql(f"drop table if exists {self.name}_{table}")


def stored(spark: SparkSession, tables: dict[str, DataFrame], **sizes: int) -> Store:
    """The tables written to a new folder of the shared one."""
    store = Store(spark, scratch(spark), **sizes)
    for name, rows in tables.items():
        store.write(name, rows)
    return store
