"""Streams on transformWithState: typed state, time to live and timers.

The state store must be RocksDB, which transformWithState asks for: see PROVIDER.  Times to live and timers run by the
clock, as the caches and windows that they stand for do; so a trigger of availableNow only ends where
spark.sql.streaming.noDataMicroBatches.enabled is off.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.streaming.limiter import OUT, WINDOWS, admit

#: What spark.sql.streaming.stateStore.providerClass has to name.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds that an answer stays in the cache: one hour for query vectors, seven days for insights.
VECTOR_TTL, INSIGHT_TTL = 3600, 7 * 86400


class Cache(StatefulProcessor):
    """The first request of a key pays for the answer, later ones find it until its time has run out."""

    def __init__(self, seconds: float):
        self.milliseconds = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "answer string", self.milliseconds)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("id")
        held = self.entry.get()[0] if self.entry.exists() else None
        known, answers = held is not None, frame["answer"].tolist()
        if not known:
            held = answers[0]
            self.entry.update((held,))
        yield pd.DataFrame({"key": key[0], "id": frame["id"].to_numpy(), "hit": [known or i > 0 for i in range(len(frame))], "answer": held})

    def close(self) -> None:
        pass


class Limiter(StatefulProcessor):
    """One list of admitted times for each window; a user who is idle for the longest window leaves no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.logs = [handle.getListState(f"window_{w}", "t double") for _, w in WINDOWS]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        logs = [deque(t for (t,) in log.get()) if log.exists() else deque() for log in self.logs]
        frame = pd.concat(list(rows)).sort_values(["t", "id"])
        allowed = admit(frame["t"].tolist(), logs)
        for log, times in zip(self.logs, logs, strict=True):
            if times:
                log.put([(t,) for t in times])
            else:
                log.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * max(w for _, w in WINDOWS))
        yield pd.DataFrame({"user_id": key[0], "id": frame["id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for log in self.logs:
            log.clear()
        yield pd.DataFrame({"user_id": [], "id": [], "allowed": []}).astype({"user_id": "int64", "id": "int64", "allowed": bool})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, seconds: float = VECTOR_TTL) -> DataFrame:
    """R11 over a stream of requests (key, id, answer): which find their key in the cache, and the answer they get."""
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("bigint").alias("id"), F.col("answer").cast("string").alias("answer"))
    return rows.groupBy("key").transformWithStateInPandas(Cache(seconds), "key string, id bigint, hit boolean, answer string", "Append", "ProcessingTime")


def limited(requests: DataFrame) -> DataFrame:
    """R1 over a stream of requests (user_id, id, t in seconds)."""
    return requests.select("user_id", "id", "t").groupBy("user_id").transformWithStateInPandas(Limiter(), OUT, "Append", "ProcessingTime")
