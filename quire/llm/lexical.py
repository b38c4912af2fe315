"""Ranked lexical search: the best documents for each item of a query set, by three-phase uniform thresholds (TPUT).

Postings (term, document, share of the term in a score) are partitioned by term, long lists in parts of their own.  For
each item: 1. the heads of its lists give candidates, whose exact scores give a lower bound of the k-th best score;
2. one threshold for all lists of the item, the largest for which a document below it everywhere stays below the bound,
fetches from each list what reaches it, and documents whose upper bound misses the k-th best partial score drop out;
3. the exact scores of the others are looked up.  The answer is exact, ties included.

Rows are documents, repeated ids too; null texts have no terms, null ids come after others of their score.  Items that
repeat id and text count once; an item that repeats only its id is an item of its own; items without terms, or whose
terms no document holds, give no rows.  Empty tables give none.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage
from .divergence import slices

K = 10
#: Entries of a list's head, and documents of each item whose exact scores give the first bound.
HEAD, PROBES = 20, 20
#: Postings of one part of a list.
PART = 8192
#: Lists (item, term) of one pass over the documents; larger query sets take several passes.
LISTS = 500_000

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counts(text: bytes) -> Counter:
    found: Counter = Counter()
    for terms in slices(text, _WORDS):
        found.update(terms)
    return found


def _item_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, text in zip(b["item"].to_pylist(), b["text"]):
            found = _counts(text.as_buffer().to_pybytes())
            yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(found), pa.int64()), "word": pa.array(list(found), pa.binary()), "times": pa.array(found.values(), pa.int64())})


def _forward(vocabulary):
    """Length and the query set's terms of each document; without its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = vocabulary.value
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b["text"]:
                found = _counts(text.as_buffer().to_pybytes())
                held = [t for t in found if t in ids]
                n.append(found.total())
                terms.append([ids[t] for t in held])
                tfs.append([found[t] for t in held])
            yield pa.RecordBatch.from_arrays(
                [b["uid"], b["doc_id"], pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["uid", "doc_id", "n", "terms", "tfs"]
            )

    return run


def threshold(most: list[int], bound: int) -> int:
    """The largest t for which lists whose entries reach at most ``most`` and all stay below t sum to less than ``bound``."""
    if bound <= 0:
        return 1
    left, lists = bound - 1, sorted(most)
    for k, m in enumerate(lists):
        below = left // (len(lists) - k)
        if below < m:
            return below + 1
        left -= m
    return lists[-1] + 1 if lists else 1  # no document reaches the bound


def _thresholds(key: tuple, lists: pd.DataFrame) -> pd.DataFrame:
    t = threshold(lists["most"].tolist(), int(lists["bound"].iloc[0]))
    return pd.DataFrame({"item": [key[0]], "t": [t], "rest": [int(lists["most"].clip(upper=t - 1).sum())]})


def _top(of: DataFrame, by: str, k: int, rank: str = "nth") -> DataFrame:
    return of.withColumn(rank, F.row_number().over(Window.partitionBy("item").orderBy(F.col(by).desc(), "uid"))).where(F.col(rank) <= k)


def _kth(of: DataFrame, by: str, k: int) -> DataFrame:
    """The k-th best value of each item that has as many."""
    return _top(of, by, k).where(F.col("nth") == k).select("item", F.col(by).alias("kth"))


def _scorer(index):
    """Exact scores of documents for the items that they are candidates of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, terms, units, n_docs, n_terms, n_ids = index.value
        share = np.zeros(n_ids, np.int64)
        for b in batches:
            items, uids, doc_ids, scores = [], [], [], []
            for uid, doc_id, n, held, tfs, asked in zip(*(b[c].to_pylist() for c in ("uid", "doc_id", "n", "terms", "tfs", "items"))):
                tf = np.array(tfs, np.int64)
                share[held] = 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * n_docs // n_terms))
                for item in asked:
                    at = slice(*starts[item])
                    items.append(item)
                    scores.append(int(units[at] @ share[terms[at]]))
                uids += [uid] * len(asked)
                doc_ids += [doc_id] * len(asked)
                share[held] = 0
            yield pa.RecordBatch.from_pydict({"item": pa.array(items, pa.int64()), "uid": pa.array(uids, pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def _exact(candidates: DataFrame, forward: DataFrame, index) -> DataFrame:
    """Scores of (item, uid), looked up in the documents' own rows of the index: one row for each document."""
    asked = cut_lineage(candidates.groupBy("uid").agg(F.collect_set("item").alias("items")))
    return forward.join(asked, "uid").mapInArrow(_scorer(index), "item bigint, uid bigint, doc_id bigint, score bigint")


def _search(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The best documents (item, doc_id, uid, score, rank) of the lists ``wanted`` (item, word, times)."""
    spark = docs.sparkSession
    words = sorted(bytes(r.word) for r in wanted.select("word").distinct().collect())  # at most LISTS
    ids = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word binary, term int")
    vocabulary = spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})
    forward = cut_lineage(docs.mapInArrow(_forward(vocabulary), "uid bigint, doc_id bigint, n bigint, terms array<int>, tfs array<int>")).where("n > 0")
    n_docs, n_terms = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a list's length is the document frequency of its term
    lengths = cut_lineage(forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    m = F.lit(25) + F.expr(f"cast(cast(75 * n as decimal(18, 0)) * cast({n_docs} as decimal(18, 0)) div {max(n_terms, 1)} as bigint)")
    flat = forward.select("uid", m.alias("m"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    share = F.expr("(1000000000L * tf) div (1000L * tf + 8 * m)").alias("share")
    part = F.pmod(F.xxhash64("uid"), F.ceil(F.col("df") / PART)).alias("part")
    postings = flat.join(F.broadcast(lengths), "term").select("term", "uid", share, part)
    postings = cut_lineage(postings.repartition("term", "part").drop("part").sortWithinPartitions("term", F.col("share").desc()))

    lists = wanted.join(ids, "word").join(lengths, "term")
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)))
    lists = lists.select("item", "term", (F.col("times") * weight).alias("unit")).where("unit > 0")
    heads = cut_lineage(postings.withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(F.col("share").desc(), "uid"))).where(F.col("nth") <= HEAD))
    lists = cut_lineage(lists.join(heads.where("nth = 1").select("term", F.col("share").alias("largest")), "term").withColumn("most", F.col("unit") * F.col("largest")))

    starts, terms, units = {}, [], []
    for r in lists.select("item", "term", "unit").sort("item").toLocalIterator():  # at most LISTS
        starts.setdefault(r["item"], [len(terms), 0])[1] = len(terms) + 1
        terms.append(r.term)
        units.append(r.unit)
    index = spark.sparkContext.broadcast((starts, np.array(terms, np.int32), np.array(units, np.int64), n_docs, max(n_terms, 1), len(words)))

    # phase 1: a lower bound of the k-th best score
    partial = heads.join(lists, "term").groupBy("item", "uid").agg(F.sum(F.col("unit") * F.col("share")).alias("partial"))
    bounds = _kth(_exact(_top(partial, "partial", max(PROBES, k)), forward, index), "score", k)
    bounded = lists.join(bounds, "item", "left").withColumn("bound", F.coalesce("kth", F.lit(0)))
    cuts = bounded.groupBy("item").applyInPandas(_thresholds, "item bigint, t bigint, rest bigint")
    cuts = cut_lineage(cuts.join(bounds, "item", "left").select("item", "t", "rest", F.coalesce("kth", F.lit(0)).alias("bound")))

    # phase 2: what reaches the item's threshold, from every list that can; at most LISTS rows are broadcast
    reach = cut_lineage(lists.join(cuts, "item").where("most >= t").select("item", "term", "unit", F.expr("(t + unit - 1) div unit").alias("least"), F.least("most", F.col("t") - 1).alias("cap")))
    fetched = postings.alias("p").join(F.broadcast(reach).alias("r"), F.expr("p.term = r.term AND p.share >= r.least"))
    fetched = fetched.groupBy("item", "uid").agg(F.sum(F.col("unit") * F.col("share")).alias("partial"), F.sum("cap").alias("seen"))
    hopeful = fetched.join(F.broadcast(cuts), "item").withColumn("upper", F.col("partial") + F.col("rest") - F.col("seen"))
    hopeful = cut_lineage(hopeful.where("upper >= bound").select("item", "uid", "partial", "upper"))
    left = hopeful.join(_kth(hopeful, "partial", k), "item", "left").where("kth IS NULL OR upper >= kth")

    # phase 3: exact scores
    scored = _exact(left, forward, index).where("score > 0")
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "uid")
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, lists_a_pass: int = LISTS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    asked = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    asked = cut_lineage(asked.withColumn("item", F.monotonically_increasing_id()))
    lists = cut_lineage(asked.select("item", F.col("text").cast("binary").alias("text")).mapInArrow(_item_lists, "item bigint, word binary, times bigint"))
    passes = max(1, -(-lists.count() // lists_a_pass))
    found = [_search(rows, lists.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p), k) for p in range(passes)]
    best = reduce(DataFrame.unionByName, found)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


def oracle() -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH found AS (SELECT k, doc_id, unnest(regexp_extract_all(text, '{term}')) AS term FROM (SELECT row_number() OVER () AS k, doc_id, {lower} AS text FROM documents)),
asked AS (SELECT item_id, unnest(regexp_extract_all({lower}, '{term}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
lens AS (SELECT k, count(*) AS n FROM found GROUP BY k),
whole AS (SELECT count(*) AS docs, sum(n)::HUGEINT AS words FROM lens),
tf AS (SELECT k, doc_id, term, count(*) AS tf FROM found SEMI JOIN asked USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term),
units AS (SELECT item_id, term, count(*) * any_value(w) AS unit FROM asked JOIN w USING (term) GROUP BY ALL),
scored AS (SELECT item_id, k, doc_id, sum(unit * ((1000000000 * tf) // (1000 * tf + 8 * CAST(25 + (75::HUGEINT * n * docs) // words AS BIGINT)))) AS score
  FROM tf JOIN lens USING (k) JOIN units USING (term), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {K}"""
