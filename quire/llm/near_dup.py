"""Near-duplicate documents by Order MinHash and banded alignment (operator 7).

Texts become sequences of shingles of five words (lower-cased A-Z; a text of one to four words is one shingle).  Each
shingle is labelled with its occurrence number; a sketch keeps, of several hash orders, the two least labelled
shingles in the order in which the text has them.  Equal sketches need not only shared shingles but shared order, so
they follow edit similarity rather than overlap of sets.  Texts that agree on a band of sketches are candidates.

A pair is linked if its alignment keeps M shingles with M / (n_a + n_b - M) >= 0.8, the Jaccard similarity of
order-preserving matches.  The alignment is a longest common subsequence by bit vectors, restricted to the band of
diagonals beyond which that similarity is out of reach, so the restriction loses nothing.

Scale.  Exact copies collapse into classes first.  In a band bucket all members are compared with one hub; that settles
groups of copies, however large.  Some buckets still span several components after that.  Narrow ones (up to NARROW
members) are settled as they are: in rounds with more hubs each, until all members were hubs.  Members of wide ones are
sketched again with longer bands, which cut a bucket of loosely similar texts into small ones, and the rounds go on
there.  In rounds a hub is compared with members of other components whose signatures (one bit of each sketch) agree
as those of linked texts do but for one in 1,000 at the threshold.  The rounds end when each bucket is
one component or all its members were hubs, so no bucket is held by one task and no candidate pair is left out but by
signatures and longer bands, whose losses are stated here and measured in the tests.  Components come from alternating
star contractions over edges in the shared folder.  Joins on keys that may be hot are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import SALTS, components, salted

from .common import Powers, cut_lineage, mix64, row_blocks, utf8

_powers = Powers(0xD6E8FEB86659FD93)
#: Bands of the first level and their sketches: texts at similarity 0.8 share a band with probability 0.9999.
BANDS, ROWS = 48, 4
#: Longer bands of the second level: 0.99 at 0.8, 0.9999 at 0.85.  Buckets of up to NARROW members need none.
FINE_BANDS, FINE_ROWS, NARROW = 64, 6, 64
#: Sketches of a member of an open bucket, one bit of each in its signature.
BITS = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block of texts, and the first word of each text (one bound more than texts)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    begins = inside[1:] & ~inside[:-1]
    ends = ~inside[1:] & inside[:-1]
    # words also end where a text does
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[inside[cut] & inside[cut + 1]]
    begins[both] = ends[both] = True
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[e] - sums[s]) * down[s]), np.searchsorted(s, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within each text, and bounds as for words; short texts have one shingle."""
    sizes = np.diff(bounds)
    counts = np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(out_bounds[-1]) - out_bounds[:-1][doc] + bounds[:-1][doc]
    last = bounds[1:][doc]
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        w = padded[at + i]
        if i:
            w = np.where(at + i < last, w, np.uint64(i))
        h = h * np.uint64(0x9E3779B97F4A7C15) + w
    return mix64(h), out_bounds


def order_sketches(shingles: np.ndarray, bounds: np.ndarray, sketches: int, seed: int = 11) -> np.ndarray:
    """Order MinHash of each text: for each hash order, the two least occurrence-labelled shingles in text order."""
    counts = np.diff(bounds)
    docs = np.flatnonzero(counts)
    out = np.zeros((len(counts), sketches), np.uint64)
    if not len(docs):
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((shingles, doc))
    s, d = shingles[order], doc[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
    starts = np.flatnonzero(new)
    nth = np.empty(len(s), np.uint64)
    nth[order] = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    del order, s, d, new
    label = mix64(shingles + nth * np.uint64(0xA24BAED4963EE407))
    begin, lone = bounds[:-1][docs], counts[docs] == 1
    # the place of a shingle rides in the low bits of its hash, so that one pass finds the least hash and its place
    low = np.uint64((1 << max(1, len(label).bit_length())) - 1)
    high, at = ~low, np.arange(len(label), dtype=np.uint64)
    base, v = label ^ (label >> np.uint64(29)), np.empty_like(label)
    rng = np.random.default_rng(seed)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(sketches):
        a = rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        np.multiply(base, a, out=v)
        np.bitwise_and(v, high, out=v)
        np.bitwise_or(v, at, out=v)
        first = (np.minimum.reduceat(v, begin) & low).astype(np.int64)
        v[first] = top
        second = np.where(lone, first, (np.minimum.reduceat(v, begin) & low).astype(np.int64))
        x = shingles[np.minimum(first, second)]
        y = np.where(lone, np.uint64(1), shingles[np.maximum(first, second)])
        out[docs, j] = mix64(x * np.uint64(3) + y * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return out


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two shingle sequences by banded alignment; 0 where it is sure to be below ``least``."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if min(n, m) < need:
        return 0.0
    short = min(n, m)
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    rest = short - head
    differ = np.flatnonzero(a[n - rest :][::-1] != b[m - rest :][::-1]) if rest else np.zeros(0)
    tail = int(differ[0]) if len(differ) else rest
    # diagonals that an alignment with enough matches can reach
    match = head + tail + _common(a[head : n - tail], b[head : m - tail], n - need, m - need)
    return match / (n + m - match) if match >= need else 0.0


def _common(x: np.ndarray, y: np.ndarray, back: int, ahead: int) -> int:
    """Longest common subsequence within the diagonals from ``ahead`` before to ``back`` behind, by bit vectors.

    The vectors hold the band only: bits below it are final and are counted off, bits above it are still one.
    """
    if not len(x) or not len(y):
        return 0
    kinds, x_codes = np.unique(x, return_inverse=True)
    at = np.minimum(np.searchsorted(kinds, y), len(kinds) - 1)
    y_codes = np.where(kinds[at] == y, at, -1).tolist()
    order = np.argsort(x_codes, kind="stable")
    bounds = np.searchsorted(x_codes[order], np.arange(len(kinds) + 1)).tolist()
    places = order.tolist()
    match = base = done = 0  # ``done`` holds the matched bits of the band, from place ``base`` on
    often: dict[int, int] = {}
    for j, c in enumerate(y_codes):
        if c < 0:
            continue
        lo, hi = max(0, j - ahead), min(len(x), j + back + 1)
        if lo >= len(x):
            break
        if lo - base >= 512:
            match += (done & ((1 << (lo - base)) - 1)).bit_count()
            done >>= lo - base
            base = lo
        first, last = bounds[c], bounds[c + 1]
        if last - first > 32:  # a shingle that comes often has its places as one number
            if c not in often:
                if len(often) >= 64:
                    often.clear()
                often[c] = int.from_bytes(np.packbits(x_codes == c, bitorder="little").tobytes(), "little")
            hit = (often[c] >> base) & ((1 << (hi - base)) - 1)
            hit = hit >> (lo - base) << (lo - base)
        else:
            hit = 0
            for i in places[first:last]:
                if lo <= i < hi:
                    hit |= 1 << (i - base)
        if hit:
            full = (1 << (hi - base)) - 1
            v = full ^ done
            u = v & hit
            done = full ^ (((v + u) | (v - u)) & full)
    return match + done.bit_count()


def _banded(sk: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Each text's bands: one hash of ``rows`` sketches and the number of the band."""
    sk = sk.reshape(len(sk), bands, rows)
    mixed = np.zeros((len(sk), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        mixed = mix64(mixed * np.uint64(5) + sk[:, :, r])
    return mixed.view(np.int64)


def _signed(sk: np.ndarray) -> np.ndarray:
    """One bit of each sketch, in 64-bit words."""
    return np.packbits((sk >> np.uint64(33) & np.uint64(1)).astype(np.uint8), axis=1).view("<i8")


def _too_far(h: str, m: str, least: float) -> Column:
    """Whether two members' signatures differ more than those of linked texts do but for one pair in 1,000 at ``least``.

    Of u shingles in all, two least ones are both shared with probability least * (least * u - 1) / (u - 1).
    """
    u = (F.col(f"{h}.size") + F.col(f"{m}.size")) / (1 + least)
    p = (1 + F.greatest(F.lit(0.0), least * (least * u - 1) / F.greatest(u - 1, F.lit(0.1)))) / 2
    differ = sum((F.bit_count(F.col(f"{h}.sig")[k].bitwiseXOR(F.col(f"{m}.sig")[k])) for k in range(1, BITS // 64)), F.bit_count(F.col(f"{h}.sig")[0].bitwiseXOR(F.col(f"{m}.sig")[0])))
    return BITS - differ < BITS * p - 3.1 * F.sqrt(BITS * p * (1 - p))


def _lists(values: np.ndarray, full: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists; those not ``full`` are empty."""
    at = np.concatenate([[0], np.cumsum(np.where(full, values.shape[1], 0))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(values[full]).ravel()))


def _sketched(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(3))
            for lo, hi in row_blocks(offsets, 1 << 19):
                part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                shingles, bounds = shingle_hashes(*word_hashes(part, off))
                sk = order_sketches(shingles, bounds, bands * rows)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(3)] + [_lists(_banded(sk, bands, rows), np.diff(bounds) > 0)], names=["id", "h1", "h2", "bands"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "id bigint, h1 bigint, h2 bigint, bands array<bigint>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a 128-bit key of the text; a null text is alone in its class."""
    i, t = F.col(id_col).cast("bigint"), F.col(text_col)
    return docs.select(
        i.alias("id"),
        F.when(t.isNull(), i).otherwise(F.xxhash64(t)).alias("h1"),
        F.when(t.isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(7), t)).alias("h2"),
        t.alias("text"),
    )


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose alignment reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0  # bytes of these; a hub's pairs come one after the other

        def sequence(number: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            got = made.get(number)
            if got is None:
                w = np.frombuffer(raw, "<u4").astype(np.uint64)
                s = shingle_hashes(w, np.array([0, len(w)]))[0]
                got = s, np.unique(s)
                if held > 8 << 20:
                    made.clear()
                    held = 0
                made[number] = got
                held += got[0].nbytes + got[1].nbytes
            return got

        def linked(a: int, b: int, x: bytes, y: bytes) -> bool:
            (s, some), (t, other) = sequence(a, x), sequence(b, y)
            # no alignment keeps more than the shared shingles and the repetitions of either text
            most = min(len(s) - len(some), len(t) - len(other))
            if (min(len(some), len(other)) + most) * (1 + least) < least * (len(s) + len(t)) - 1e-6:
                return False
            if len(some) > len(other):
                some, other = other, some
            if len(some):
                most += int((other[np.minimum(np.searchsorted(other, some), len(other) - 1)] == some).sum())
            if most * (1 + least) < least * (len(s) + len(t)) - 1e-6:
                return False
            return aligned(s, t, least) >= least

        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 64):  # few texts at a time as Python objects
                keep += [linked(*row) for row in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # hubs may have many partners: their rows are dealt by a salt, for which a hub's words are copied where needed
    pairs = cut_lineage(pairs).withColumn("salt", F.pmod(F.xxhash64(F.lit(3), F.col("b")), F.lit(SALTS)).cast("int"))
    hubs = pairs.select("a", "salt").distinct().join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
    most = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, pairs.count() // 500))  # by number: alignment costs more than bytes show
    both = pairs.join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b").repartition(parts, "a", "salt").join(hubs, ["a", "salt"])
    return both.select("a", "b", "wa", "wb").mapInArrow(run, "a bigint, b bigint")


def _open(members: DataFrame, over: int = 1) -> DataFrame:
    """Members (band, id, component c, ...) of buckets that span several components and have more than ``over``, with
    their number ``n``."""
    spans = members.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"))
    return salted(members, spans.where((F.col("c0") != F.col("c1")) & (F.col("n") > over)).select("band", "n"), ["band"], "id")


def _placed(ids: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with the component ``c`` of their id."""
    return ids.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _signatures(words: DataFrame) -> DataFrame:
    """(id, size, sig, bands): number of shingles, signature, and bands of the second level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                raw = [np.frombuffer(r, "<u4").astype(np.uint64) for r in batch.column(1).slice(lo, 64).to_pylist()]
                shingles, bounds = shingle_hashes(np.concatenate(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
                sk, size = order_sketches(shingles, bounds, BITS, seed=29), np.diff(bounds)
                bands = _banded(sk[:, : FINE_BANDS * FINE_ROWS], FINE_BANDS, FINE_ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 64), pa.array(size, pa.int64()), _lists(_signed(sk), size > 0), _lists(bands, size > 0)], names=["id", "size", "sig", "bands"])

    return words.select("id", "words").mapInArrow(run, "id bigint, size bigint, sig array<bigint>, bands array<bigint>")


def _rounds(members: DataFrame, links: DataFrame, found: DataFrame, words: DataFrame, least: float, widest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links and components after all cross-component pairs of each bucket (rows band, id, c, size, sig) were compared.

    A member's place in its bucket follows from a hash; hubs are those in the first places, some more in each round.
    Buckets of at most ``widest`` members take one round.
    """
    members = members.withColumn("u", F.pmod(F.xxhash64(F.lit(41), "id", "band"), F.lit(1 << 30)) / (1 << 30))
    lo, hi = 0, widest or 2
    while True:
        left = cut_lineage(_open(members, lo).withColumn("at", F.col("u") * F.col("n")))
        if left.isEmpty():
            return links, found
        wide = F.when(F.col("n") > 256, 16).otherwise(1)
        h = left.where(F.col("at").between(lo, hi) & (F.col("at") < hi)).withColumn("salt", F.explode(F.sequence(F.lit(0), wide - 1))).alias("h")
        m = left.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "id"), wide).cast("int")).alias("m")
        later = (F.col("h.at") < F.col("m.at")) | ((F.col("h.at") == F.col("m.at")) & (F.col("h.id") < F.col("m.id")))
        met = h.join(m, (F.col("h.band") == F.col("m.band")) & (F.col("h.salt") == F.col("m.salt")) & (F.col("h.c") != F.col("m.c")) & later & ~_too_far("h", "m", least))
        more = cut_lineage(_verified(met.select(F.col("h.id").alias("a"), F.col("m.id").alias("b")).distinct(), words, least))
        lo, hi = hi, 16 * hi
        if not more.isEmpty():
            links = links.unionByName(more)
            found = cut_lineage(components(links))
            members = _placed(left.drop("c", "n", "at"), found)
        else:
            members = left.drop("n", "at")
        if widest:
            return links, found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, ``copy_of`` (least id with the same text), ``class_id`` (least id reachable by links), ``kept``.

    A pair at the least similarity is a candidate with probability 0.9999 (a sketch agrees with 0.64, a band of four
    with 0.17, one of 48 with 1 - 2e-4), one of the shortest texts (five shingles together) with 0.999.  Null texts and
    null ids link with nothing (a null id is its own row with null class); empty texts are copies of each other.  Rows
    that repeat an id are judged by their own texts.  Empty tables give no rows; other columns are not read.
    """
    sketches = _sketched(docs.where(F.col(id_col).isNotNull()), id_col, text_col, bands, rows)
    classes = sketches.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()))  # a class is its text: an id may have several
    banded = classes.select("id", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1").select("band", "hub")
    members = cut_lineage(salted(banded, hubs, ["band"], "id").select("band", "id", "hub"))
    stars = members.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    wanted = classes.select(F.col("id").alias("class"), F.col("rep").alias("id"), "h1", "h2").join(members.select(F.col("id").alias("class")).distinct(), "class", "left_semi")

    def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in row_blocks(offsets, 1 << 20):
                w, bounds = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                w = w.astype("<u4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([w[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["id", "words"])

    texts = _keyed(docs, id_col, text_col).where("text is not null").join(wanted, ["id", "h1", "h2"]).select(F.col("class").alias("id"), "text")
    words = texts.mapInArrow(kept_words, "id bigint, words binary")
    words = cut_lineage(words.groupBy("id").agg(F.max("words").alias("words")))
    links = cut_lineage(_verified(stars, words, least))
    found = cut_lineage(components(links))

    still = cut_lineage(_open(_placed(members.drop("hub"), found)))
    signed = cut_lineage(_signatures(words.join(still.select("id").distinct(), "id", "left_semi")))
    narrow = still.where(F.col("n") <= NARROW).drop("n").join(signed.drop("bands"), "id")
    links, found = _rounds(narrow, links, found, words, least, NARROW)
    wide = still.where(F.col("n") > NARROW).select("id").distinct()
    if not wide.isEmpty():
        finer = _placed(signed.join(wide, "id", "left_semi"), found)
        finer = finer.select("id", "c", "size", "sig", F.explode("bands").alias("band"))
        links, found = _rounds(finer, links, found, words, least)
    least_ids = found.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    named = salted(found, least_ids, ["component"], "id").select("id", F.col("least").alias("component"))
    placed = classes.select("id", "h1", "h2", "rep", "n").join(named, "id", "left").withColumn("component", F.coalesce("component", "rep"))
    joined = placed.where("n > 1 or component != rep").select("h1", "h2", "rep", "component")
    keys = _keyed(docs, id_col, text_col).select("id", "h1", "h2")
    out = salted(keys, joined, ["h1", "h2"], "id", "left")
    return out.select(F.col("id").alias(id_col), *[F.when(F.col("id").isNotNull(), F.coalesce(c, "id")).alias(a) for c, a in (("rep", "copy_of"), ("component", "class_id"))]).withColumn("kept", F.coalesce(F.col("class_id") == F.col(id_col), F.lit(True)))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
