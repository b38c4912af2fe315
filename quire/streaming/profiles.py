"""Streams with state: rolling reader profiles (R12) and the state of items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LAST = 20


def profile_after(minutes: list[int], tags: list[str], reads: list[tuple]) -> tuple[list[int], list[str]]:
    """The last minutes and the tags in order of first use, after reads (minutes, tags) in order; missing ones are skipped."""
    for m, ts in reads:
        if m and m == m:  # pandas has missing numbers as NaN
            minutes = [*minutes, int(m)][-LAST:]
        for t in ts if ts is not None else ():
            if t not in tags:
                tags = [*tags, t]
    return minutes, tags


def rolling_profiles(reads: DataFrame) -> DataFrame:
    """R12 as a stream of reads (user_id, seq, minutes, tags): after each batch the user's mean of the last 20 and tags.

    State for a user: at most 20 numbers and the distinct tags.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        minutes, tags = (list(x) for x in state.get) if state.exists else ([], [])
        frame = pd.concat(list(batches)).sort_values("seq")
        minutes, tags = profile_after(minutes, tags, list(zip(frame.minutes.where(frame.minutes.notna(), None), frame.tags, strict=True)))
        state.update((minutes, tags))
        yield pd.DataFrame({"user_id": [key[0]], "seq": [int(frame.seq.max())], "mean_minutes": [round(sum(minutes) / len(minutes), 1) if minutes else None], "tags": [tags]})

    return reads.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, seq bigint, mean_minutes double, tags array<string>", "minutes array<int>, tags array<string>", "update", GroupStateTimeout.NoTimeout)


def item_after(state: tuple[bool, float, bool], kind: str, value: float | None) -> tuple[bool, float, bool]:
    """(is_read, position, is_archived) after one event."""
    is_read, position, archived = state
    if kind in ("read", "unread"):
        return kind == "read", 0.0, archived
    if kind == "position":
        return is_read or value >= 0.9, value, archived
    return is_read, position, True if kind == "archive" else False if kind == "restore" else archived


def item_states(events: DataFrame) -> DataFrame:
    """G11 as a stream of events (item_id, seq, kind, value): the state of each touched item after each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (False, 0.0, False)
        frame = pd.concat(list(batches)).sort_values("seq")
        for kind, value in zip(frame.kind, frame.value, strict=True):
            now = item_after(now, kind, value)
        state.update(now)
        yield pd.DataFrame({"item_id": [key[0]], "is_read": [now[0]], "position": [float(now[1])], "is_archived": [now[2]]})

    return events.groupBy("item_id").applyInPandasWithState(step, "item_id bigint, is_read boolean, position double, is_archived boolean", "is_read boolean, position double, is_archived boolean", "update", GroupStateTimeout.NoTimeout)
