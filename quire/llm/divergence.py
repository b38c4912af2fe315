"""Source divergence audit: how far the words of each source of a language stray from the language and its other sources.

Terms are counted once for each (lang, source) in Arrow batches.  The kept terms of a language (at least 10 of its
documents hold them) are sorted by their bytes and cut into chunks; a term's id is its place in its chunk
(``searchsorted``), so ids keep the order of UTF-8 and ties break by id.  Counts of a source in a chunk are one dense
vector (``bincount``), and all divergences are sums over such vectors.

Documents, repeated rows included, count one each; null text, lang and source are ''.  Empty tables give no rows.  A
language without kept terms gives its pairs the value 0 and no terms.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage

MIN_DOCS = 10
TOP = 10
#: Terms of a chunk, and most chunks of all languages together: longer dictionaries get longer chunks.
CHUNK, MOST_CHUNKS = 8192, 4096
#: Bytes of a term that bounds of chunks hold; chunks are cut only where these change.
PREFIX = 128
#: Sources that one task compares with as many others.
BLOCK = 32
#: Entries of a task's counters before they are sent on, and bytes of text cut into terms at a time.
ENTRIES, SLICE = 400_000, 8 << 20
SCALE = 1_000_000_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slices(text: bytes, table: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """Terms of a text by a table that maps bytes between terms to blanks, some megabytes at a time."""
    if len(text) <= size:
        yield text.translate(table).split()
        return
    text, at = text.translate(table), 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut if cut > at else (text.find(b" ", end) + 1 or len(text))
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a partition, counted before anything is exchanged."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()),
                "term": pa.array(terms, pa.binary()), "n": pa.array(n.values(), pa.int64()), "docs": pa.array([docs[t] for t in terms], pa.int64()),
            })
        found.clear()

    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"]):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held: set[bytes] = set()
            for terms in slices(text.as_buffer().to_pybytes(), _LETTERS):
                n.update(terms)
                held.update(terms)
            docs.update(held)
        if sum(len(n) for n, _ in found.values()) > ENTRIES:
            yield from flush()
    yield from flush()


def count_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Occurrences n of each kept term in each (lang, source) that has it."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term binary, n bigint, docs bigint")
    # one exchange serves the sums by source and those by language
    by_source = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = by_source.withColumn("held", F.sum("docs").over(Window.partitionBy("lang", "term")))
    return in_lang.where(F.col("held") >= min_docs).select("lang", "source", "term", "n")


def _chunker(size: int):
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang, terms, n = None, [], []

        def out() -> pd.DataFrame:
            return pd.DataFrame({"lang": [lang], "bound": [terms[0][:PREFIX]], "terms": [terms], "n": [n]})

        for frame in frames:
            for of, term, count in zip(frame["lang"], frame["term"], frame["n"]):
                term = bytes(term)
                if terms and (of != lang or len(terms) >= size and term[:PREFIX] != terms[-1][:PREFIX]):
                    yield out()
                    terms, n = [], []
                lang = of
                terms.append(term)
                n.append(count)
        if terms:
            yield out()

    return cut


def dictionary(counts: DataFrame, n_terms: int) -> DataFrame:
    """The kept terms of each language in the order of their bytes, one row a chunk: terms, their counts in the language."""
    size = max(CHUNK, -(-n_terms // MOST_CHUNKS))
    total = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).withColumn("head", F.substring("term", 1, PREFIX))
    ranged = total.repartitionByRange("lang", "head").sortWithinPartitions("lang", "term").select("lang", "term", "n")
    cut = ranged.mapInPandas(_chunker(size), "lang string, bound binary, terms array<binary>, n array<bigint>")
    return cut.withColumn("chunk", F.row_number().over(Window.partitionBy("lang").orderBy("bound")) - 1)


def _locate(bounds):
    """Adds each term's chunk, by a search in the sorted bounds of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, chunk = np.array(b["lang"].to_pylist(), object), np.zeros(b.num_rows, np.int32)
            terms = np.array([t[:PREFIX] for t in b["term"].to_pylist()], object)
            for lang in set(langs.tolist()):
                known = bounds.value.get(lang)
                if known is not None:
                    at = langs == lang
                    chunk[at] = np.searchsorted(known, terms[at], side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk)], names=[*b.schema.names, "chunk"])

    return run


def _encode(key: tuple, counts: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
    """Dense counts of each source of a block over one chunk of the dictionary."""
    out = []
    if len(chunk) and len(counts):
        terms = np.empty(len(chunk["terms"].iloc[0]), object)
        terms[:] = [bytes(t) for t in chunk["terms"].iloc[0]]
        wanted = np.empty(len(counts), object)
        wanted[:] = [bytes(t) for t in counts["term"]]
        ids = np.searchsorted(terms, wanted)
        source, n = counts["source"].to_numpy(object), counts["n"].to_numpy(np.int64)
        codes, names = pd.factorize(source)
        for k, name in enumerate(names):
            mine = codes == k
            vector = np.zeros(len(terms), np.int64)  # as bincount, whose weights would be doubles
            np.add.at(vector, ids[mine], n[mine])
            out.append((key[0], key[1], name, vector.tobytes(), int(vector.sum())))
    return pd.DataFrame(out, columns=["lang", "chunk", "source", "counts", "n"])


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(1e9 * (count + 2) / total), exact in 64 bits for any count: three digits to the base 1,000."""
    whole, rest = np.divmod(counts + 2, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of distances between the sources of two blocks over one chunk, in both directions."""
    width, (i, j) = int(rows["width"].iloc[0]), key[2:]
    total = rows["total"].to_numpy(np.int64)  # N + 2 V

    def vector(r: int) -> np.ndarray:
        raw = rows["counts"].iloc[r]
        return shares(np.frombuffer(raw, np.int64) if raw is not None else np.zeros(width, np.int64), int(total[r])) if width else np.zeros(0, np.int64)

    block, names = rows["block"].to_numpy(), rows["source"].to_numpy(object)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    held = {int(r): vector(r) for r in left}
    out = []
    for b in right:
        other = held[int(b)] if i == j else vector(int(b))
        for a in left:
            if i == j and a >= b:
                continue
            f = int(distance(held[int(a)], other).sum())
            out += [(key[0], names[a], names[b], f), (key[0], names[b], names[a], f)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def _strays(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The most overused terms of each source of a block in one chunk: ids ascend with the terms, so a stable sort does."""
    first, out = rows[rows["first"]].iloc[0], []
    terms, q = first["terms"], shares(np.asarray(first["of_lang"], np.int64), int(first["lang_total"]))
    for source, raw, total in zip(rows["source"], rows["counts"], rows["total"]):
        counts = np.frombuffer(raw, np.int64)
        p = shares(counts, int(total))
        ids = np.flatnonzero((counts > 0) & (p > q))
        f = distance(p[ids], q[ids])
        for k in np.argsort(-f, kind="stable")[:TOP]:
            out.append((key[0], source, bytes(terms[ids[k]]), int(f[k])))
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def _bounds(spark: SparkSession, chunks: DataFrame):
    """Bounds of languages of several chunks: at most 2 * MOST_CHUNKS + 1 of PREFIX bytes, by dictionary()."""
    several = chunks.withColumn("of", F.max("chunk").over(Window.partitionBy("lang"))).where("of > 0").select("lang", "chunk", "bound")
    known: dict[str, list] = {}
    for r in sorted(several.collect()):
        known.setdefault(r.lang, []).append(bytes(r.bound))
    packed = {}
    for lang, bounds in known.items():
        packed[lang] = np.empty(len(bounds), object)
        packed[lang][:] = bounds
        packed[lang][0] = b""
    return spark.sparkContext.broadcast(packed)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: divergence from each other source, and the most overused terms."""
    spark = docs.sparkSession
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).groupBy("lang", "source").agg(F.count("*").alias("docs"))
    groups = cut_lineage(groups)
    counts = cut_lineage(count_terms(docs, min_docs))
    n_terms = counts.select("lang", "term").distinct().count()
    chunks = cut_lineage(dictionary(counts, n_terms))
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = max(1, -(-most // BLOCK))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int").alias("block")

    placed = counts.mapInArrow(_locate(_bounds(spark, chunks)), "lang string, source string, term binary, n bigint, chunk int").withColumn("block", block)
    dictionaries = chunks.select("lang", "chunk", "terms").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    vectors = cut_lineage(
        placed.groupBy("lang", "chunk", "block").cogroup(dictionaries.groupBy("lang", "chunk", "block")).applyInPandas(_encode, "lang string, chunk int, source string, counts binary, n bigint")
    )
    langs = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"), F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("lang_n"))
    sums = vectors.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sources = groups.select("lang", "source", block).join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    sources = sources.select("lang", "source", "block", (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("total"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_total"))
    sources = cut_lineage(sources)

    # every source meets every chunk of its language, also where it has none of its terms; no chunk at all counts as an empty one
    grid = sources.join(chunks.select("lang", "chunk", F.size("terms").alias("width")), "lang", "left").na.fill({"chunk": 0, "width": 0})
    grid = grid.join(vectors.select("lang", "chunk", "source", "counts"), ["lang", "chunk", "source"], "left")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    grid = grid.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    pairs = grid.groupBy("lang", "chunk", "i", "j").applyInPandas(_compare, "lang string, source string, item string, value bigint")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    strays = vectors.join(sources.select("lang", "source", "block", "total", "lang_total"), ["lang", "source"])
    strays = strays.join(chunks.select("lang", "chunk", "terms", F.col("n").alias("of_lang")), ["lang", "chunk"])
    # the dictionary's chunk travels with the first source of a block only
    first = F.row_number().over(Window.partitionBy("lang", "chunk", "block").orderBy("source")) == 1
    strays = strays.withColumn("first", first).select("lang", "chunk", "block", "source", "counts", "total", "lang_total", "first", *[F.when(F.col("first"), F.col(c)).alias(c) for c in ("terms", "of_lang")])
    strays = strays.groupBy("lang", "chunk", "block").applyInPandas(_strays, "lang string, source string, item binary, value bigint")
    place = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    strays = strays.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).withColumn("item", F.col("item").cast("string")).withColumn("part", F.lit("term"))
    ranked = pairs.withColumn("rank", F.row_number().over(place))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(out).unionByName(strays.select(out))


def query(docs: DataFrame) -> DataFrame:
    return audit(docs)


def oracle() -> str:
    term = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '{term}')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
total AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.n + 2 * v.v)::HUGEINT AS p,
    1 + ({SCALE}::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN total t USING (lang, source) JOIN v USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE (x.term IS NULL) = (y.term IS NULL) GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP})
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked"""
