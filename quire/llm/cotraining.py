"""Quality by co-training of a text view and a metadata view (operator 3).

The text view reads a document: square roots of the frequencies of its hashed words (A-Z in lower case) and of hashed
trigrams of character classes (letters by case, digits, signs, white space), and a few ratios.  The metadata view sees
what is known of a page without reading it: source, language tag and length.  Both are logistic regressions.

Starting from labelled rows, each round scores all other rows of the corpus outside the held-out fold with both views,
distributedly, and each view labels those that it is surest of, some of either class, for the other view to learn from.
Only these few come to the driver.  A part of the labelled rows, kept out of this, calibrates both views (Platt), and a
third regression on the calibrated log odds combines them.  Scoring is a narrow map over all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hash_sample, held_out, mix64, row_blocks, utf8
from .near_dup import word_hashes

WORDS, SHAPES, RATIOS, META = 2048, 512, 7, 256
_KIND = np.full(256, 6, np.uint32)
for _c in range(256):
    if 97 <= _c <= 122:
        _KIND[_c] = 1
    elif 65 <= _c <= 90:
        _KIND[_c] = 2
    elif 48 <= _c <= 57:
        _KIND[_c] = 3
    elif _c in (9, 11, 12, 13, 32):
        _KIND[_c] = 4
    elif _c == 10:
        _KIND[_c] = 5
    elif _c < 128:
        _KIND[_c] = _c + 10


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each text."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return np.bincount((key[first] >> np.uint64(48)).astype(np.int64), minlength=n)


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text of a block of at most 512 texts."""
    n = len(offsets) - 1
    out = np.zeros((n, WORDS + SHAPES + RATIOS), np.float32)
    size = np.diff(offsets)
    words, bounds = word_hashes(data, offsets)
    many = np.diff(bounds)
    doc = np.repeat(np.arange(n), many)
    counts = np.bincount(doc * WORDS + (words >> np.uint64(53)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    out[:, :WORDS] = np.sqrt(counts / np.maximum(many, 1)[:, None])
    if len(data) >= 3:
        k = _KIND[data]
        h = ((k[:-2] * np.uint32(0x9E3779B1) + k[1:-1]) * np.uint32(0x85EBCA6B) + k[2:]) * np.uint32(0xC2B2AE35)
        text = np.repeat(np.arange(n, dtype=np.int32), size)
        ok = text[:-2] == text[2:]
        cell = text[:-2][ok] * np.int32(SHAPES) + (h >> np.uint32(23)).astype(np.int32)[ok]
        counts = np.bincount(cell, minlength=n * SHAPES).reshape(n, SHAPES)
        out[:, WORDS : WORDS + SHAPES] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    w = np.maximum(many, 1)
    pair = doc[1:] == doc[:-1]
    raw = data.tobytes()
    lines = [raw[a:b].split(b"\n") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    ratios = (
        np.minimum(np.log1p(many) / 10, 1),
        _distinct(doc, words, n) / w,
        _distinct(doc[1:][pair], mix64(words[:-1][pair] * np.uint64(3) + words[1:][pair]), n) / w,
        np.array([len(set(x)) / len(x) for x in lines]),
        np.minimum(size / w / 20, 1),
        many < 5,
        many < 50,
    )
    for j, r in enumerate(ratios):
        out[:, WORDS + SHAPES + j] = r
    return out


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One row for each page: hashed source and language, and length in steps."""
    out = np.zeros((len(source), META), np.float32)
    for i, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32(f"s{s}".encode()) % 128] = 1
        out[i, 128 + zlib.crc32(f"l{g}".encode()) % 32] = 1
        out[i, 160 + (95 if c is None or c < 0 else min(94, int(5 * np.log1p(c))))] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, *, ridge: float = 1e-3, steps: int = 250, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (last: bias) by accelerated gradient descent on the mean log loss."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    weight = np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32)
    weight = weight / weight.sum()
    y = y.astype(np.float32)
    v = np.full(x.shape[1], 1 / np.sqrt(x.shape[1]), np.float32)  # power iteration for the steepest curvature
    for _ in range(12):
        v = (weight * (x @ v)) @ x
        v /= np.linalg.norm(v) + np.float32(1e-12)
    rate = 1 / (0.25 * float(v @ ((weight * (x @ v)) @ x)) + ridge)
    w = z = np.zeros(x.shape[1]) if start is None else start.copy()
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z.astype(np.float32), -30, 30)))
        g = (weight * (p - y)) @ x + ridge * np.append(z[:-1], 0)
        new = z - rate * g
        z = new + t / (t + 3) * (new - w)
        w = new
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray  # slope and offset for either view
    mix: np.ndarray  # weights of calibrated log odds, bias

    def combine(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of quality: both views together, text alone, metadata alone."""
        a, b = a * self.platt[0, 0] + self.platt[0, 1], b * self.platt[1, 0] + self.platt[1, 1]
        z = self.mix[0] * a + self.mix[1] * b + self.mix[2]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (z, a, b))


class Trainer:
    """Both views, learning from labelled rows and from what the other view labelled."""

    def __init__(self, xt: np.ndarray, xm: np.ndarray, y: np.ndarray, seed: int = 9):
        keep = np.random.default_rng(seed).random(len(y)) < 0.25
        if y[keep].min(initial=1) == y[keep].max(initial=0) or y[~keep].min(initial=1) == y[~keep].max(initial=0):
            keep = np.zeros(len(y), bool)
        self.fit, self.cal = np.flatnonzero(~keep), np.flatnonzero(keep) if keep.any() else np.arange(len(y))
        self.x, self.y, self.share = (xt, xm), y, float(y[self.fit].mean())
        self.more: list[list[np.ndarray]] = [[], []]
        self.marks: list[list[np.ndarray]] = [[], []]
        self.w: list[np.ndarray | None] = [None, None]
        self.learn()

    def learn(self) -> None:
        for v in (0, 1):
            xs = np.vstack([self.x[v][self.fit], *self.more[v]])
            ys = np.concatenate([self.y[self.fit], *self.marks[v]])
            weight = np.concatenate([np.ones(len(self.fit)), np.full(len(ys) - len(self.fit), 0.3)])
            self.w[v] = logistic(xs, ys, weight, start=self.w[v], steps=250 if self.w[v] is None else 100)

    def given(self, view: int, x: np.ndarray, mark: float) -> None:
        """Rows that the other view is sure of."""
        if len(x):
            self.more[view].append(x)
            self.marks[view].append(np.full(len(x), mark))

    def model(self) -> Model:
        x, w, cal, y = self.x, self.w, self.cal, self.y
        platt = np.array([logistic(odds(x[v][cal], w[v])[:, None], y[cal], ridge=1e-4, steps=600) for v in (0, 1)])
        platt[:, 0] = np.maximum(platt[:, 0], 0)
        both = np.column_stack([odds(x[v][cal], w[v]) * platt[v, 0] + platt[v, 1] for v in (0, 1)])
        mix = logistic(both, y[cal], ridge=1e-3, steps=600)
        mix[:2] = np.maximum(mix[:2], 0)
        return Model(w[0], w[1], platt, mix)


COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


def _views(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[pa.RecordBatch | pa.Table, np.ndarray, np.ndarray]]:
    """Few rows at a time, with both views of them."""
    texts = batch["text"] if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index("text"))
    data, offsets = utf8(texts)
    for lo, hi in row_blocks(offsets, 1 << 20):
        for at in range(lo, hi, 512):
            end = min(hi, at + 512)
            part = batch.slice(at, end - at)
            meta = meta_features(*[part.column(c).to_pylist() if isinstance(part, pa.Table) else part.column(part.schema.get_field_index(c)).to_pylist() for c in ("source", "lang", "n_chars")])
            yield part, text_features(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]), meta


def _all_views(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    got = [(t, m) for _, t, m in _views(table.combine_chunks())]
    if not got:
        return np.zeros((0, WORDS + SHAPES + RATIOS), np.float32), np.zeros((0, META), np.float32)
    return np.vstack([t for t, _ in got]), np.vstack([m for _, m in got])


def sure(pool: DataFrame, w: list[np.ndarray], share: float, each: int, least: float = 1.4) -> dict[tuple[int, int], list[int]]:
    """For view and class the ids of the rows of ``pool`` that the view is surest of, at least ``least`` in log odds;
    ``each`` for a view, dealt to the classes by ``share``.  Of equal texts one counts; ties go by id."""
    shipped = pool.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t, m in _views(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(part.num_columns - 1), pa.array(odds(t, shipped.value[0])), pa.array(odds(m, shipped.value[1]))], names=["doc_id", "h", "z0", "z1"])

    wide = pool.select(*COLUMNS, F.xxhash64("text").alias("h"))
    scored = cut_lineage(wide.mapInArrow(run, "doc_id bigint, h bigint, z0 double, z1 double"))
    out = {}
    for view in (0, 1):
        for mark, part in ((0, 1 - share), (1, share)):
            n = max(2, round(each * part))
            z = F.col(f"z{view}") * (1 if mark else -1)
            got = scored.where(z > least).orderBy(z.desc(), "doc_id").limit(4 * n).select("doc_id", "h").collect()
            first: dict[int, int] = {}
            for r in got:
                first.setdefault(r["h"], r["doc_id"])
            out[view, mark] = list(first.values())[:n]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = 5000, rounds: int = 3, each: int = 400) -> Model:
    """Co-train on at most ``rows`` labelled rows (64 MB of text at most) outside the held-out fold (crc32 of the id
    modulo 5 is 1); in each of the ``rounds`` either view labels ``each`` of all other rows outside that fold.

    A document with several labels is good if most of them say so, ties included.  Of rows that repeat an id any one
    may be taken.  Without labels of both classes every score is the share of good ones, smoothed.
    """
    docs = docs.select(*COLUMNS)
    marks = labels.where(F.col("quality").isNotNull() & ~held_out("doc_id", 5, 1)).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("mark"))
    chosen = cut_lineage(hash_sample(marks, F.col("doc_id"), rows))
    found = docs.join(F.broadcast(chosen), "doc_id")  # ``rows`` bounds the broadcast
    many = found.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    if many > 64 << 20:
        found = docs.join(F.broadcast(hash_sample(chosen, F.col("doc_id"), max(1, rows * (64 << 20) // many))), "doc_id")
    got = found.toArrow().sort_by("doc_id")
    y = got["mark"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model(np.zeros(WORDS + SHAPES + RATIOS + 1), np.zeros(META + 1), np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([0, 0, np.log(share / (1 - share))]))
    trainer = Trainer(*_all_views(got), y)
    pool = docs.where(~held_out("doc_id", 5, 1)).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    taken: set[int] = set()
    for _ in range(rounds):
        rest = pool if not taken else pool.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(taken)], "doc_id bigint")), "doc_id", "left_anti")
        picked = sure(rest, trainer.w, trainer.share, each)
        ids = sorted({i for some in picked.values() for i in some})
        if not ids:
            break
        taken |= set(ids)
        texts = rest.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint")), "doc_id").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
        both, place = _all_views(texts), {i: k for k, i in enumerate(texts["doc_id"].to_pylist())}
        for (view, mark), some in picked.items():
            trainer.given(1 - view, both[1 - view][[place[i] for i in some]], float(mark))
        trainer.learn()
    return trainer.model()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, ``score`` (probability of quality), ``text_score``, ``meta_score``.

    Null and empty texts score as texts without words; null metadata are values of their own.  Repeated rows stay.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for part, t, meta in _views(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p) for p in m.combine(odds(t, m.text), odds(meta, m.meta))]], names=["doc_id", "score", "text_score", "meta_score"])

    return docs.select(*COLUMNS).mapInArrow(run, "doc_id bigint, score double, text_score double, meta_score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")
