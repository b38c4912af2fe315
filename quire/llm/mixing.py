"""Interleaving of sources by target weights with Pfair scheduling (operator 9).

The documents of a source, in an order given by a hash, form blocks.  In an ideal flow every source that has blocks left
advances at its weight's share of the sum of theirs, so at virtual time v source k has had min(w_k v, n_k) of its n_k
blocks and T(v) = sum of those slots have passed.  Block j of a source may run from slot floor(T(j / w)) on and must run
before ceil(T((j + 1) / w)); of the blocks that may run, the one with the earliest deadline takes the slot.  As the flow
itself keeps these windows, so does the schedule, and at every slot each source is less than one block away from the
flow.  Weights are taken exactly, as fractions, and for the whole run: nothing is rounded and nothing repeats.  The
driver works this out in O(blocks log sources) steps, and tasks get 8 bytes a block; blocks grow with the corpus so that
there are about a million at most, and the deviation stays below one of them.  A phase ends with the slot in which
a source has its last share of the flow; the others' weights go on in proportion.  No document is dropped or repeated.

Numbers of documents within a source come from counts by hash bucket and running sums of those, so that a source with
a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Documents of a block, the most blocks of a schedule (beyond that blocks hold more), hash buckets of a source.
BLOCK, MOST_BLOCKS, BUCKETS = 16, 1 << 20, 1 << 16


@dataclass
class Schedule:
    """The slots of all sources' blocks, one source after the other, where each source begins, and the ends of phases."""

    at: np.ndarray
    first: np.ndarray
    ends: list[int] = field(default_factory=list)

    def slots(self, source: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.at[self.first[source] + block]
        return slot, np.searchsorted(np.array(self.ends, np.int64), slot, side="right")


def schedule(blocks: np.ndarray, weights: np.ndarray) -> Schedule:
    """Slots of all blocks: earliest deadline first among released ones, in whole numbers."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    scale = max((d for _, d in ratios), default=1)  # powers of two
    w, n = [a * (scale // d) for a, d in ratios], blocks.tolist()
    order = sorted((i for i in range(len(n)) if n[i]), key=lambda i: n[i] / float(weights[i]))
    fins = [n[i] / float(weights[i]) for i in order]  # virtual times at which sources end
    done, active = [0], [sum(w[i] for i in order)]
    for i in order:
        done.append(done[-1] + n[i])
        active.append(active[-1] - w[i])

    def passed(i: int, j: int) -> tuple[int, int]:
        """Floor and ceiling of T(j / w_i)."""
        p = bisect_right(fins, j / float(weights[i]))
        while p and j * w[order[p - 1]] < n[order[p - 1]] * w[i]:
            p -= 1
        while p < len(order) and j * w[order[p]] > n[order[p]] * w[i]:
            p += 1
        q, r = divmod(active[p] * j, w[i])
        return done[p] + q, done[p] + q + (r > 0)

    first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    at, given = np.zeros(int(first[-1]), np.int64), [0] * len(n)
    waiting = [(0, i) for i in range(len(n)) if n[i]]  # release, source
    ready: list[tuple[int, int, int]] = []  # deadline, source, release of the next block
    for t in range(len(at)):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            low, high = passed(i, given[i] + 1)
            heapq.heappush(ready, (high, i, low))
        _, i, low = heapq.heappop(ready)
        at[first[i] + given[i]] = t
        given[i] += 1
        if given[i] < n[i]:
            heapq.heappush(waiting, (low, i))
    return Schedule(at, first[:-1], sorted({passed(i, n[i])[1] for i in order}))


def interleave(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """The rows with ``mix_block``, ``mix_slot``, ``mix_phase`` and ``mix_position`` (existing ones are replaced).

    ``weights`` are target weights by source; sources that it lacks, or all without it, get their number of documents
    to the power ``temper``.  Null is a source of its own.  Order within a source: by a hash of the id, then by id;
    null ids come last, and rows that repeat an id follow each other in any order.  Positions rise with slots; a source's
    last block may be short.  Empty tables give no rows.  ``options``: id_col, source_col, block, temper, rows_per_bucket.
    """
    return _interleaved(docs, weights, **options)[0]


def _interleaved(docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, temper: float = 0.5, rows_per_bucket: int = 1000) -> tuple[DataFrame, int]:
    """The interleaved rows, and an upper bound of their positions."""
    added = ("mix_block", "mix_slot", "mix_phase", "mix_position")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    n = docs.count()
    block = max(block, -(-n // MOST_BLOCKS))
    buckets = min(BUCKETS, max(1, -(-n // rows_per_bucket)))
    # a row travels as one struct, so that no column of it clashes with those used here
    i = F.col(id_col)
    whole = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    h = F.when(i.isNotNull(), F.xxhash64(F.lit(23), i)).otherwise(F.xxhash64(*whole))  # null ids are spread too
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), i.alias("i"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("s"), F.pmod(h, F.lit(1 << 40)).alias("h"))
    keyed = keyed.withColumn("b", F.floor(F.col("h") / F.lit((1 << 40) / buckets)).cast("int"))
    counts = cut_lineage(keyed.groupBy("s", "b").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("s").agg(F.sum("n").alias("n")).orderBy("s").collect()  # any number of sources
    names = [r["s"] for r in sizes]
    given = {("" if k is None else f"={k}"): v for k, v in (weights or {}).items()}
    w = np.array([given.get(r["s"], float(r["n"]) ** temper) for r in sizes], float)
    if (w <= 0).any():
        raise ValueError("weights must be positive")
    plan = schedule(np.array([-(-r["n"] // block) for r in sizes], np.int64), w)
    shipped = docs.sparkSession.sparkContext.broadcast((plan, {x: k for k, x in enumerate(names)}))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", F.col("i").asc_nulls_last()))

    @F.pandas_udf("slot bigint, phase bigint")
    def placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        plan, number = shipped.value
        for source, at in batches:
            slot, phase = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for name, rows in source.groupby(source, sort=False).indices.items():
                slot[rows], phase[rows] = plan.slots(number[name], at.to_numpy()[rows])
            yield pd.DataFrame({"slot": slot, "phase": phase})

    out = keyed.withColumn("r", inside).join(offsets, ["s", "b"]).withColumn("at", (F.col("first") + F.col("r") - 1).cast("bigint"))
    out = out.withColumn("block", F.floor(F.col("at") / block).cast("bigint")).withColumn("to", placed("s", "block"))
    position: Column = F.col("to.slot") * block + F.pmod(F.col("at"), F.lit(block))
    out = out.select("row.*", *[c.alias(a) for c, a in zip((F.col("block"), F.col("to.slot"), F.col("to.phase"), position), added, strict=True)])
    return out, (plan.ends[-1] if plan.ends else 0) * block


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None, *, rows_per_part: int = 4096, **options) -> DataFrame:
    """The rows as the schedule lists them: parts are ranges of positions, sorted inside; no sampling pass.

    Columns that interleave() would replace come back as they were.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(options.get("id_col", "doc_id")).alias("doc_id"), F.col(options.get("source_col", "source")).alias("source"))
    options = {k: v for k, v in options.items() if k not in ("id_col", "source_col")}
    mixed, top = _interleaved(packed, weights, **options)
    part = F.floor(F.col("mix_position") / rows_per_part).cast("int")
    return mixed.repartitionById(max(1, -(-top // rows_per_part)), part).sortWithinPartitions("mix_position").select("row.*")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    mixed = interleave(docs.select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_phase", "mix_position")
