"""Helpers shared by the training-data operators: shared storage, hold-out folds, UTF-8 views of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import materialise as cut_lineage  # noqa: F401  re-exported to the operators


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(c: str | Column = "doc_id") -> Column:
    """crc32 of an id as decimal text; null ids fall into no fold (null)."""
    return F.crc32((F.col(c) if isinstance(c, str) else c).cast("string").cast("binary"))


def held_out(c: str | Column, modulus: int, remainder: int) -> Column:
    """True for the fold that nothing may learn from; a null id counts as held out."""
    return F.coalesce(F.pmod(crc_of_id(c), F.lit(modulus)) == remainder, F.lit(True))


def hash_sample(labelled: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows (never more), chosen by a hash of the key: the same ones whatever the partitioning.

    One count without wide columns gives the fraction; the limit only cuts the binomial excess.
    """
    n = labelled.count()
    if n <= rows:
        return labelled
    keep = int(rows * 0.97 / n * (1 << 30))
    return labelled.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < keep).limit(rows)


def text_sample(labelled: DataFrame, key: Column, rows: int, text_col: str = "text", most: int = 96 << 20) -> DataFrame:
    """hash_sample() of rows with texts for the driver, of fewer rows where their texts would pass ``most`` bytes."""
    some = hash_sample(labelled, key, rows)
    found = some.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.count("*").alias("n")).first()
    if (found["bytes"] or 0) > most:
        some = hash_sample(labelled, key, max(1, found["n"] * most // found["bytes"]))
    return some


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def row_blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes each (one row at least), to bound a worker's memory."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers (finaliser of a public-domain generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand, for rolling hashes by prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, self.base, np.uint64))])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, self.inverse, np.uint64))])
        return self.up[:n], self.down[:n]
