"""Stored tables: what is read, what is shuffled, and hot items."""

import re

import pytest
from pyspark.sql import functions as F

from quire.sources.storage import SKEW, stored


@pytest.fixture
def sorted_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def items(spark, n=2000):
    return spark.range(n).select("id", (F.col("id") % 7).alias("user_id"), F.concat(F.lit("t"), "id").alias("title"))


def test_a_tenant_is_a_folder_and_an_item_a_bucket(spark):
    s = stored(spark, {"items": items(spark)}, buckets=8, tenants=4)
    rows = items(spark)
    got = s.of("items", 3)
    assert sorted(got.collect()) == sorted(rows.where("user_id = 3").collect())
    folders = {re.search(r"tenant=\d+", f).group() for f in s.of("items", 3).inputFiles()}
    assert len(folders) == 1 and "PartitionFilters: [isnotnull(tenant" in got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    one = s.of("items", 3, 10)
    assert [tuple(r) for r in one.collect()] == [(10, 3, "t10")] and s.of("items", 4, 10).count() == 0
    key = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # plans name the buckets only where it is off; they are pruned either way
    spark.conf.set(key, "false")
    again = s.of("items", 3, 10)
    assert "SelectedBucketsCount: 1 out of 8" in again._jdf.queryExecution().explainString(again._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.conf.unset(key)
    with pytest.raises(ValueError, match="no users"):
        s.of("chunks", 1)
    s.drop()


def test_joins_by_item_do_not_shuffle(sorted_joins):
    spark = sorted_joins
    chunks = spark.range(5000).select("id", (F.col("id") * 3 % 2100).cast("int").alias("item_id"))
    marks = spark.range(900).select("id", (F.col("id") * 7 % 2000).alias("item_id"), (F.col("id") % 7).alias("user_id"))
    s = stored(spark, {"items": items(spark), "chunks": chunks, "highlights": marks}, buckets=8)
    one = s.read("items").select(F.col("id").alias("item_id"), "title")
    joined = s.read("chunks").join(one, "item_id").join(s.read("highlights").select("item_id", F.col("id").alias("mark")), "item_id")
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    plain = chunks.join(items(spark).select(F.col("id").alias("item_id"), "title"), "item_id").join(marks.select("item_id", F.col("id").alias("mark")), "item_id")
    columns = ["id", "item_id", "title", "mark"]
    assert sorted(map(tuple, joined.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    s.write("chunks", spark.createDataFrame([(9000, 1), (9001, None)], "id bigint, item_id int"))  # rows that come later
    assert s.read("chunks").count() == 5002 and s.read("chunks").join(one, "item_id").where("id = 9000").count() == 1
    s.drop()


def test_a_hot_item_is_read_so_that_joins_can_split_it(sorted_joins):
    spark = sorted_joins
    chunks = spark.range(3000).select("id", F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("item_id"))
    s = stored(spark, {"items": items(spark, 3000), "chunks": chunks, "membership": spark.createDataFrame([], "item_id bigint, list_id bigint")}, buckets=16)
    assert s.skew("chunks") > SKEW > s.skew("items") and s.skew("membership") == 0
    joined = s.read("chunks").join(s.read("items").select(F.col("id").alias("item_id"), "title"), "item_id")
    assert "Exchange" in plan(joined) and joined.count() == 3000
    assert s.read("membership").count() == 0
    s.drop()
