"""Streams on transformWithState against their batch forms; the sweep over marks."""

import random
import time

import pytest

from quire.functions import layout
from quire.streaming import limiter, stateful


@pytest.fixture
def rocks(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": stateful.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def drained(frame, path, name):
    q = frame.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state")).queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive


def test_a_cached_answer_goes_when_its_time_is_up(rocks, tmp_path):
    schema = "key string, id bigint, answer string"

    def ask(rows):
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drained(stateful.cached(rocks.readStream.schema(schema).parquet(str(tmp_path / "in")), 15), tmp_path, "cache")
        return {r.id: (r.hit, r.answer) for r in rocks.read.parquet(str(tmp_path / "out")).collect()}

    assert ask([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")]) == {1: (False, "x"), 2: (True, "x"), 3: (False, "z")}
    began = time.monotonic()
    assert ask([("a", 4, "later")])[4] == (True, "x") or time.monotonic() - began > 12  # a slow machine may pass the time
    time.sleep(16)
    assert ask([("a", 5, "new"), ("c", 6, "w")])[5] == (False, "new")


def test_limiter_with_lists_and_timers_equals_batch(rocks, tmp_path):
    rows = [(u, i, float(i * 3)) for u in range(3) for i in range(40)]
    df = rocks.createDataFrame(rows, "user_id bigint, id bigint, t double")
    for lo, hi in ((0, 25), (25, 40)):  # the state is carried from one run to the next
        df.where(f"id >= {lo} and id < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drained(stateful.limited(rocks.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), tmp_path, "limit")
    got = {tuple(r) for r in rocks.read.parquet(str(tmp_path / "out")).select("user_id", "id", "allowed").collect()}
    assert got == {tuple(r) for r in limiter.limited_batch(df).collect()} and any(not a for *_, a in got)


def test_sweep():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 20)
        marks = [(rng.randint(-3, 24), rng.randint(-3, 24), rng.randint(0, 6)) for _ in range(rng.randint(0, 8))]
        cuts = sorted({0, n, *[min(max(x, 0), n) for s, e, _ in marks for x in (s, e)]})
        assert layout.segments(n, marks) == [(a, b, sorted(i for s, e, i in marks if s < b and e > a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    began = time.monotonic()
    many = [(s := rng.randint(0, 1_000_000), s + rng.randint(1, 60), i) for i in range(100_000)]
    assert len(layout.segments(1_000_100, many)) > 100_000 and time.monotonic() - began < 10
