"""An inverted index for full text (P2, X23): lexeme, item, positions and weights, in buckets of lexemes.

A bucket follows from the first two characters of a lexeme, so a search opens the buckets of its lexemes only, and a
prefix search one bucket.  Items come in segments, as ingest writes them: a later segment replaces an earlier text of the
same item, and what it no longer holds is found no more.  Ranks are those of fulltext.rank over the whole table.

A row holds a lexeme's places in a block of items: ids, how many places each has, and all places one after the other; so
there are far fewer rows than pairs of lexeme and item.  A block is of bounded size, and so is a row.  Each task writes
the rows of its items into the buckets' folders: postings are never shuffled, and a frequent lexeme is no task's alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from quire.functions import fulltext

BUCKETS = 64
#: Files of a bucket that one small write (four tasks) makes.
SPREAD = 4
BOTH = ("english", "simple")
#: Bytes of texts of a block, and rows of a batch that is sent to the writer.
BLOCK, ROWS = 4 << 20, 1 << 14
ROW = "lexeme string, ids array<bigint>, sizes array<int>, positions array<int>, weights array<double>, bucket int"


def bucket_of(lexeme: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(lexeme[:2].encode("utf-8", "surrogatepass")) % buckets


@dataclass(frozen=True)
class Postings:
    path: str
    buckets: int = BUCKETS

    def segments(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/items")

    def rows(self, spark: SparkSession, lexemes: list[str], prefix: str | None = None) -> DataFrame:
        """Postings of some lexemes, or of those with a prefix: filters on the bucket and on the lexeme reach the scan."""
        all_rows = spark.read.parquet(f"{self.path}/postings")
        if prefix is not None:
            wanted = F.col("lexeme").startswith(prefix)
            found = all_rows.where(wanted & (F.col("bucket") == bucket_of(prefix, self.buckets))) if len(prefix) >= 2 else all_rows.where(wanted)
        else:
            found = all_rows.where(F.col("bucket").isin(sorted({bucket_of(x, self.buckets) for x in lexemes})) & F.col("lexeme").isin(lexemes))
        found = found.select("lexeme", "ids", "sizes", "positions", "weights", "segment", "bucket")
        return found.mapInArrow(_unpacked, "lexeme string, id bigint, positions array<int>, weights array<double>, segment int, bucket int")


def _lists(values: np.ndarray | pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each lexeme and item."""
    for batch in batches:
        lexeme, ids, sizes, positions, weights, segment, bucket = batch.columns
        of = pa.array(np.repeat(np.arange(len(lexeme)), np.diff(ids.offsets.to_numpy())))
        upto = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())])
        columns = [lexeme.take(of), ids.flatten(), _lists(positions.flatten(), upto), _lists(weights.flatten(), upto), segment.take(of), bucket.take(of)]
        whole = pa.RecordBatch.from_arrays(columns, names=["lexeme", "id", "positions", "weights", "segment", "bucket"])
        for lo in range(0, whole.num_rows, ROWS):
            yield whole.slice(lo, ROWS)


def _buckets(lexemes: pa.Array, buckets: int) -> np.ndarray:
    heads = pc.utf8_slice_codeunits(lexemes, 0, 2).dictionary_encode()
    return np.array([bucket_of(h, buckets) for h in heads.dictionary.to_pylist()], np.int64)[heads.indices.to_numpy()]


def _split(fields: dict[str, str], buckets: int):
    weights = np.array([fulltext.WEIGHTS[x] for x in fields.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns = batch.column(0).to_numpy(), batch.columns[1:]
            for lo, hi in fulltext.text_blocks(columns, BLOCK):
                p = fulltext.places([c.slice(lo, hi - lo) for c in columns], BOTH)
                bucket = _buckets(p.lexemes, buckets)
                by_bucket = np.argsort(bucket, kind="stable")  # the order of the files
                lexemes, bucket, number = p.lexemes.take(pa.array(by_bucket)), bucket[by_bucket], np.empty(len(bucket), np.int64)
                number[by_bucket] = np.arange(len(bucket))
                of_lexeme = number[p.lexeme]
                order = p.sorted_by(of_lexeme, p.doc)
                lexeme, doc, position, weight = of_lexeme[order], p.doc[order], p.position[order].astype(np.int32), weights[p.field[order]]
                ends = np.ones(len(order) + 1, bool)  # of items in a lexeme
                ends[1:-1] = (lexeme[1:] != lexeme[:-1]) | (doc[1:] != doc[:-1])
                item = np.flatnonzero(ends)
                of = np.concatenate([[0], np.cumsum(np.bincount(lexeme[item[:-1]], minlength=len(lexemes)))])  # first item of each lexeme
                for x in range(0, len(lexemes), ROWS):
                    y = min(len(lexemes), x + ROWS)
                    own, some = of[x : y + 1] - of[x], item[of[x] : of[y] + 1]
                    flat, places = slice(some[0], some[-1]), some[own] - some[0]
                    lists = _lists(ids[lo + doc[some[:-1]]], own), _lists(np.diff(some).astype(np.int32), own), _lists(position[flat], places), _lists(weight[flat], places)
                    yield pa.RecordBatch.from_arrays([lexemes.slice(x, y - x), *lists, pa.array(bucket[x:y].astype(np.int32))], names=[c.split()[0] for c in ROW.split(", ")])

    return run


def write(items: DataFrame, fields: dict[str, str], path: str, *, segment: int = 0, buckets: int = BUCKETS) -> Postings:
    """Adds the texts of items (id and the columns of ``fields``) as a segment; of each id the last segment counts."""
    some = items.select(F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("string").alias(c) for c in fields]).where("id is not null")
    rows = some.mapInArrow(_split(fields, buckets), ROW).withColumn("segment", F.lit(segment))
    rows.sortWithinPartitions("bucket", "lexeme").write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    some.select("id", F.lit(segment).alias("segment")).distinct().write.mode("append").parquet(f"{path}/items")
    return Postings(path, buckets)


def search(spark: SparkSession, index: Postings, query: str, *, keep: DataFrame | None = None, damped: bool = True) -> DataFrame:
    """(id, score) of the items that match; ``keep`` (id) bounds them, as a user's titled items do."""
    choices = fulltext.alternatives(query, BOTH)
    prefix = next((t.words[0] for terms in choices for t in terms if t.prefix), None)
    rows = index.rows(spark, sorted({w for terms in choices for t in terms for w in t.words}), prefix)
    last = index.segments(spark).groupBy("id").agg(F.max("segment").alias("segment"))
    rows = rows.join(last, ["id", "segment"], "left_semi")
    if keep is not None:
        rows = rows.join(keep.select("id"), "id", "left_semi")

    def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in batches:
            out, bounds = [], found.offsets.to_pylist()
            lexemes, places, weights = (found.values.field(x) for x in ("lexeme", "positions", "weights"))
            lexemes, starts = lexemes.to_pylist(), places.offsets.to_pylist()
            places, weights = places.values.to_numpy(), weights.values.to_numpy()
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                some = {lexemes[i]: list(zip(places[starts[i] : starts[i + 1]].tolist(), weights[starts[i] : starts[i + 1]].tolist())) for i in range(lo, hi)}
                out.append(fulltext.rank_places(some, query, BOTH, damped=damped))
            yield pa.array(out, pa.float64())

    ranked = F.arrow_udf(ranked, "double", ArrowUDFType.SCALAR_ITER)
    # one row for each item: the places of the query's lexemes only
    by_item = rows.groupBy("id").agg(F.collect_list(F.struct("lexeme", "positions", "weights")).alias("found"))
    return by_item.select("id", F.round(ranked("found"), 9).alias("score")).where("score is not null")
