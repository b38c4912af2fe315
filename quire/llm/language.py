"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 2).

A text is lower-cased; runs of anything but letters become one border character; its subwords are the byte strings of
two to five bytes, hashed into a fixed number of buckets.  The text's vector is the mean of its subwords' embeddings,
and a linear layer with softmax gives the languages.  Stochastic gradient descent in numpy trains both on a bounded
sample of labelled rows.

Rejection is calibrated on rows kept out of training: they set the softmax temperature, the probability below which a
text is rejected, and the least share of subwords that training must have seen.  Either bound is a quantile, so that
together they reject the stated share of texts in learned languages; texts in other languages of the same script fall
below the second one, since most of their longer subwords are new.  The bounds sink with a text's number of subwords by
the sampling error of its own share, so that short texts are not rejected by chance.

As mean and layer are linear, scoring needs only the product of both, one row of scores for each bucket; that table has
a fixed size and is broadcast.  Scoring is a narrow map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, row_blocks, text_sample, utf8

BUCKETS = 1 << 16
LENGTHS = (2, 3, 4, 5)
UNKNOWN = "und"
_other = regex.compile(r"[^\p{L}\p{M}]+")
_letter = regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """Lower-cased text in which each run of other characters is one space, with a space at both ends."""
    clean = _other.sub(" ", text.lower()).strip() if text and _letter.search(text) else ""
    return f" {clean} ".encode() if clean else b""


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the buckets of all subwords, and the text that each belongs to."""
    n = len(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    x = data.astype(np.uint32) + np.uint32(1)
    h = x.copy()
    for k in range(2, LENGTHS[-1] + 1):
        if n < k:
            return
        h = h[: n - k + 1] * np.uint32(0x01000193 + 2 * k) + x[k - 1 :]
        if k in LENGTHS:
            inside = text[: n - k + 1] == text[k - 1 :]
            v = h * np.uint32(0x9E3779B1)
            yield (v >> np.uint32(16)).astype(np.int64)[inside], text[: n - k + 1][inside]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages, embedding times layer
    temperature: float
    threshold: float  # least probability
    seen: np.ndarray  # buckets that training saw
    familiar: float  # least share of subwords in those

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each text, its number of subwords, and how many of them training saw."""
        n, k = len(offsets) - 1, len(self.languages)
        total, count, known = np.zeros((n, k)), np.zeros(n), np.zeros(n)
        for bucket, text in subwords(data, offsets):
            count += np.bincount(text, minlength=n)
            known += np.bincount(text, self.seen[bucket], minlength=n)
            for j in range(k):
                total[:, j] += np.bincount(text, self.scores[bucket, j] if k > 1 else None, minlength=n)
        return total / np.maximum(count, 1)[:, None], count, known

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the languages, whether the text has a letter, whether the text is accepted."""
        raw = [letters(t) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        z, count, known = self.logits(np.frombuffer(b"".join(raw), np.uint8), offsets)
        z = z / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        some = np.array([len(r) > 0 for r in raw], bool)
        return p, some, some & (p.max(1) >= self.threshold) & (known / np.maximum(count, 1) >= self.familiar - slack(count))


def slack(count: np.ndarray) -> np.ndarray:
    """Two standard errors of a share of one half, subwords of a word counting as about eight dependent ones."""
    return np.sqrt(8 / np.maximum(count, 1))


def train(texts: list[str], langs: list[str], *, dim: int = 16, epochs: int = 12, rate: float = 8.0, batch: int = 16, seed: int = 7, false_rejects: float = 0.001) -> Model:
    """Embeddings and layer by SGD on six tenths of the rows; the rest sets temperature and both bounds.

    ``false_rejects`` is the share of texts in learned languages that may be rejected, half of it by either bound.
    """
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    raw = [letters(t) for t in texts]
    use = np.array([i for i in range(len(raw)) if raw[i]], np.int64)
    if not len(use):
        return Model(names or [UNKNOWN], np.zeros((BUCKETS, max(1, len(names)))), 1.0, 0.0, np.zeros(BUCKETS), 0.0)
    rng.shuffle(use)
    cut = max(1, len(use) * 6 // 10)
    fit, rest = use[:cut], use[cut:] if len(use) > cut else use

    def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
        d = np.frombuffer(raw[i], np.uint8)
        found = np.concatenate([b for b, _ in subwords(d, np.array([0, len(d)]))])
        b, c = np.unique(found, return_counts=True)
        return b, (c / len(found)).astype(np.float32)

    bags = {int(i): bag(i) for i in fit}
    e = np.zeros((BUCKETS, dim), np.float32)  # unseen subwords stay at zero, so foreign scripts get even scores
    w = (rng.standard_normal((dim, len(names))) * 0.1).astype(np.float32)
    steps, step = epochs * -(-len(fit) // batch), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for lo in range(0, len(fit), batch):
            some = fit[lo : lo + batch]
            now = rate * (1 - step / steps)
            step += 1
            means = np.stack([bags[int(i)][1] @ e[bags[int(i)][0]] for i in some])
            z = means @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ w.T
            w -= now * 0.1 * (means.T @ p)
            for i, g in zip(some, back):
                b, c = bags[int(i)]
                e[b] -= (now * c * 50)[:, None] * g
    seen = np.zeros(BUCKETS)
    for b, _ in bags.values():
        seen[b] = 1
    model = Model(names, (e @ w).astype(np.float64), 1.0, 0.0, seen, 0.0)
    del bags
    parts = []
    for lo in range(0, len(rest), 64):  # few texts at a time: their subwords take many times their bytes
        some = [raw[i] for i in rest[lo : lo + 64]]
        parts.append(model.logits(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in some])]).astype(np.int64)))
    z, count, known = (np.concatenate([p[k] for p in parts]) for k in range(3))

    smooth = 1 / (len(rest) + 2)  # else separable texts would drive the temperature to zero

    def loss(t: float) -> float:
        s = z / t
        log_p = s - s.max(1, keepdims=True)
        log_p -= np.log(np.exp(log_p).sum(1, keepdims=True))
        return float(-((1 - smooth) * log_p[np.arange(len(rest)), y[rest]] + smooth * log_p.mean(1)).mean())

    model.temperature = min(np.geomspace(0.005, 20, 80), key=loss)
    s = z / model.temperature
    p = np.exp(s - s.max(1, keepdims=True))
    # the bounds lie below all calibration texts but the allowed ones; where these are too few to show the quantile, the
    # tail is carried on from the least value: in proportion to the odds, and exponentially in what is unfamiliar
    allowed = len(rest) * false_rejects / 2
    more = max(1.0, 1 / allowed)
    top = np.sort((p / p.sum(1, keepdims=True)).max(1))[int(allowed)]
    model.threshold = float(top / (top + (1 - top) * more)) - 1e-9
    share = np.sort(known / np.maximum(count, 1) + slack(count))[int(allowed)]
    model.familiar = 1 - max(0.01, 1 - float(share)) * (1 + np.log(more)) - 1e-9
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 4000) -> Model:
    """Train and calibrate on at most ``rows`` labelled rows (48 MB of text at most) outside the held-out fold (crc32 of the id modulo 4 is 2)."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, 4, 2)).select(id_col, text_col, lang_col)
    got = text_sample(labelled, F.col(id_col), rows, text_col, 48 << 20).toArrow()
    order = np.argsort(got[0].to_numpy(), kind="stable")
    texts, langs = got[1].to_pylist(), got[2].to_pylist()
    return train([texts[i] for i in order], [langs[i] for i in order])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", pred: str = "lang_pred", score: str = "lang_score", accepted: str = "lang_accepted") -> DataFrame:
    """The rows with three more columns (existing ones of these names are replaced).

    ``pred`` is a learned language, or ``und`` where the text is null or has no letter; ``score`` its calibrated
    probability (0 for ``und``); ``accepted`` is false for ``und`` and below either bound of the model.  Ties go to the
    language that comes first in alphabetical order.  Repeated rows stay.
    """
    docs = docs.drop(*[c for c in (pred, score, accepted) if c in docs.columns])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(accepted, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            _, offsets = utf8(batch.column(at))
            for lo, hi in row_blocks(offsets, 1 << 20):
                part = batch.slice(lo, hi - lo)
                p, known, sure = m.judge(part.column(at).to_pylist())
                best = p.argmax(1)
                top = np.where(known, p[np.arange(len(best)), best], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[np.where(known, best, len(m.languages))], pa.string()), pa.array(top), pa.array(sure)],
                    names=[*part.schema.names, pred, score, accepted],
                )

    return docs.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
