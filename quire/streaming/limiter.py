"""Streams: sliding-log rate limit (R1), windowed counts with late events (R2)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Requests and seconds of each window; both are always evaluated.
WINDOWS = ((10, 60), (50, 3600))


def admit(times: list[float], logs: list[deque]) -> list[bool]:
    """For requests in order: whether every window admits them; a window records what it admits itself."""
    out = []
    for t in times:
        ok = True
        for (n, w), log in zip(WINDOWS, logs, strict=True):
            while log and log[0] < t - w:
                log.popleft()
            if len(log) < n:
                log.append(t)
            else:
                ok = False
        out.append(ok)
    return out


OUT = "user_id bigint, id bigint, allowed boolean"


def limited(requests: DataFrame) -> DataFrame:
    """R1 as a stateful stream (user_id, id, t in seconds): state per user holds at most 60 times."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        logs = [deque(x) for x in state.get] if state.exists else [deque() for _ in WINDOWS]
        frame = pd.concat(list(batches)).sort_values(["t", "id"])
        allowed = admit(frame.t.tolist(), logs)
        state.update(tuple(list(x) for x in logs))
        yield pd.DataFrame({"user_id": key[0], "id": frame.id.to_numpy(), "allowed": allowed})

    return requests.groupBy("user_id").applyInPandasWithState(step, OUT, "minute array<double>, hour array<double>", "append", GroupStateTimeout.NoTimeout)


def limited_batch(requests: DataFrame) -> DataFrame:
    """The same over a finished log; a user's log is one group, as the rule depends on all that went before."""

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "id"])
        return pd.DataFrame({"user_id": key[0], "id": frame.id.to_numpy(), "allowed": admit(frame.t.tolist(), [deque() for _ in WINDOWS])})

    return requests.groupBy("user_id").applyInPandas(one, OUT)


def hourly(events: DataFrame) -> DataFrame:
    """Windowed counts with a watermark for late events (a stream or a table)."""
    return events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
