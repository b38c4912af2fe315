"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine (operator 1).

Strings are compared by the subsequences of two to four letters that both have; a subsequence may skip letters, spans
at most SPAN places, and counts less the more it skips.  So strings that share letters in order are alike even where
letters were dropped, put between or replaced.  A text is cut into units: words in lower case without accents, with
look-alike digits and signs as letters, other signs out and repeated letters single; runs of single letters
("m o r o n") are units as well.

Labelled sentences train the machine as bags of units (a multiple-instance machine): a sentence's margin is that of its
worst unit, a toxic sentence should have it above one, a clean one below minus one.  Training alternates between finding
each sentence's worst unit under the present machine and solving the machine for those, in rounds; in the first one, a
toxic sentence stands for the unit that toxic sentences favour most.  Insults get copies with a letter put in.
Landmarks are units of both classes; a unit's features are its kernel values with them times the inverse square root of
their own kernel matrix (Nystroem).  The worst unit decides a text: its margin, calibrated on rows kept out of training,
is the score.

As the machine is linear in kernel values, and those are sums over subsequences, the whole model folds into one weight
for each subsequence: a table of fixed size (4 MB), which is broadcast.  Scoring is a narrow map over whole texts.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, held_out, row_blocks, utf8

LETTERS = 32  # 0 none, 1-26 a-z, 27 word border; letters of other scripts are dealt to all codes but these two
SPAN, DECAY = 7, 0.55
#: Offsets of a subsequence's letters after its first one, with the weight of its order and gaps.
SHAPES = [(o, (0.3, 0.6, 1.0)[k - 1] * DECAY ** (o[-1] - k)) for k in (1, 2, 3) for o in combinations(range(1, SPAN), k)]
BASES = (0, LETTERS**2, LETTERS**2 + LETTERS**3)
TABLE = LETTERS**2 + LETTERS**3 + LETTERS**4
CACHE = 300_000

_spelled = re.compile(r"(?<!\S)\w(?:[\s._*-]\w){2,}(?!\S)")
_twice = re.compile(r"(.)\1+")
_signs = str.maketrans("0134579@$!|", "oieastgasil")
_look_alike = re.compile(r"(?<=[^\W\d_])[0134579@$!|](?=[^\W\d_])")
_other = re.compile(r"[\W\d_]+")


def unit(word: str) -> str:
    """Normal form of a lower-case word."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    if not word.isalpha():
        word = _other.sub("", _look_alike.sub(lambda m: m[0].translate(_signs), word))
    return _twice.sub(r"\1", word)


def words_of(text: str) -> set[str]:
    """Distinct words, and runs of single letters as words."""
    low = text.lower()
    out = set(low.split())
    out.update(_other.sub("", r) for r in _spelled.findall(low))
    return out


_OTHERS = np.array([*range(1, 27), *range(28, 32)])


def codes(units: list[str]) -> np.ndarray:
    """Letters of units between word borders, as a padded matrix."""
    wide = max(map(len, units), default=0) + 2
    raw = np.array(["\x01" + u + "\x01" for u in units], dtype=f"<U{wide}").view(np.uint32).reshape(len(units), wide)
    out = np.where((raw >= 97) & (raw <= 122), raw - 96, _OTHERS[raw % 30])
    return np.where(raw == 0, 0, np.where(raw == 1, 27, out)).astype(np.int64)


def subsequences(c: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape: table places of the subsequences of all rows (0 where it does not fit), and its weight."""
    for offsets, weight in SHAPES:
        if c.shape[1] <= offsets[-1]:
            continue
        n = c.shape[1] - offsets[-1]
        place, fits = c[:, :n], c[:, offsets[-1] :] > 0
        for o in offsets:
            place = place * LETTERS + c[:, o : o + n]
        yield np.where(fits, place + BASES[len(offsets) - 1], 0), weight


def norms(c: np.ndarray) -> np.ndarray:
    return np.sqrt((c > 0).sum(1))


def embed(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence vectors of a few units (landmarks) over the table places that they use, and those places.

    Column 0 stands for all other places and holds zeros.
    """
    c = codes(units)
    shapes = list(subsequences(c))
    used = np.unique(np.concatenate([np.zeros(1, np.int64), *[place.ravel() for place, _ in shapes]]))
    out = np.zeros((len(units), len(used)), np.float32)
    for place, weight in shapes:
        at = np.searchsorted(used, place)
        for i in range(len(units)):
            np.add.at(out[i], at[i], weight)
    out[:, 0] = 0
    return out / norms(c)[:, None], used


def against(units: list[str], tables: np.ndarray, index: np.ndarray | None = None) -> np.ndarray:
    """Dot products of the units' subsequence vectors with the rows of ``tables``, whose columns are all table places
    or, with ``index``, those that it maps places to."""
    out = np.zeros((len(units), len(tables)), np.float32)
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    lo = 0
    while lo < len(order):
        wide = len(units[order[lo]]) + 2
        hi = lo + 1
        while hi < len(order) and hi - lo < 4096 and len(units[order[hi]]) + 2 <= wide + 2 and (hi - lo) * wide < 120_000:
            hi += 1
        pick = order[lo:hi]
        c = codes([units[i] for i in pick])
        got = np.zeros((len(pick), len(tables)), np.float32)
        for place, weight in subsequences(c):
            if index is not None:
                place = index[place]
            for k, table in enumerate(tables):
                got[:, k] += weight * table[place].sum(1)
        out[pick] = got / norms(c)[:, None]
        lo = hi
    return out


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, units: list[str]) -> np.ndarray:
        return against(units, self.table[None])[:, 0] + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


NOTHING = -3.0  # margin of a text without units


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Weights (last: bias) that minimise squared hinge loss, by Newton's method on the active set."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        return float(reg @ (v * v) / 2 + cost @ np.maximum(0, 1 - y * (x @ v)) ** 2 / 2)

    now = loss(w)
    for _ in range(steps):
        on = y * (x @ w) < 1
        xa, ca = x[on], cost[on]
        step = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(reg), (xa * ca[:, None]).T @ y[on]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:  # the active set changes under a full step
            size /= 2
        w = w + size * step
        was, now = now, loss(w)
        if was - now < 1e-6 * abs(was):
            break
    return w


def _spread(bags: list[set[str]]) -> Counter[str]:
    """In how many texts a unit is, near copies counting about once: texts count by the least hash of their units."""
    places = {u: k for k, u in enumerate(sorted(set().union(*bags)))}
    least = np.full(len(places), np.iinfo(np.int64).max)
    for salt in (b"a", b"b", b"c"):
        h = {u: zlib.crc32(u.encode(), zlib.crc32(salt)) for u in places}
        seen: dict[int, set[str]] = {}
        for bag in bags:
            if bag:
                seen.setdefault(min(map(h.__getitem__, bag)), set()).update(bag)
        n = np.zeros(len(places), np.int64)
        for bag in seen.values():
            np.add.at(n, [places[u] for u in bag], 1)
        least = np.minimum(least, n)
    return Counter(dict(zip(places, least.tolist(), strict=True)))


def train(texts: list[str], toxic: list[int], *, landmarks: int = 144, negatives: int = 8_000, rounds: int = 3, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    y = np.array(toxic, bool)
    memo: dict[str, str] = {}
    bags = []
    for t in texts:
        bag = set()
        for w in words_of(t):
            u = memo.get(w)
            if u is None:
                u = memo[w] = unit(w)
            if u:
                bag.add(u)
        bags.append(bag)
    rest = rng.random(len(texts)) < 0.25  # calibration
    fit = ~rest
    if not y[fit].any() or y[fit].all():
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.001, 0.999))
        return Model(np.zeros(TABLE, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    bad, good = _spread([b for b, t, f in zip(bags, y, fit, strict=True) if f and t]), _spread([b for b, t, f in zip(bags, y, fit, strict=True) if f and not t])
    n_bad, n_good = y[fit].sum(), (~y[fit]).sum()

    @cache
    def odds(u: str) -> float:
        return float(np.log((bad[u] + 0.05) / n_bad) - np.log((good[u] + 0.5) / n_good))

    witness: Counter[str] = Counter()
    for bag, t, f in zip(bags, y, fit, strict=True):
        if f and t and bag:
            best = max(bag, key=lambda u: (odds(u), u))
            witness.update({best} | {u for u in bag if bad[u] > 2 and odds(u) > 2.5})
    insults = [u for u, n in witness.most_common() if bad[u] > 1 or len(u) > 2]
    if not insults:
        insults = [u for u, _ in witness.most_common(50)]
    known = set(insults)
    # a unit seen once may stand beside the insult by chance: it counts less
    weight = {u: 1.0 * min(40, bad[u]) if bad[u] > 1 else 0.2 for u in insults}
    abc = "abcdefghijklmnopqrstuvwxyz"
    clean = [u for u in good if u not in known]
    if not clean:
        clean = ["a"]
    common = [u for u, _ in good.most_common(landmarks * 2) if u not in known]
    marks = [u for u in insults if bad[u] > 1][: landmarks * 2 // 3] or insults[:landmarks]
    marks += [common[i] for i in rng.permutation(len(common))[: max(1, landmarks - len(marks))]]
    tables, used = embed(marks)
    index = np.zeros(TABLE, np.int32)
    index[used] = np.arange(len(used))
    km = tables @ tables.T
    values, vectors = np.linalg.eigh(km.astype(np.float64))
    keep = values > values.max() * 1e-5
    root = vectors[:, keep] / np.sqrt(values[keep])
    pool = [clean[i] for i in rng.permutation(len(clean))[:negatives]]
    toxic_bags = [sorted(bag) for bag, t, f in zip(bags, y, fit, strict=True) if f and t and bag]
    clean_bags = [sorted(bag) for bag, t, f in zip(bags, y, fit, strict=True) if f and not t and bag]
    every = sorted({u for bag in (*toxic_bags, *clean_bags) for u in bag})
    table, w = None, None
    for turn in range(rounds):
        yes, c_yes = list(weight), list(weight.values())
        for u in list(weight):
            if len(u) >= 4 and weight[u] >= 1:
                for _ in range(6):
                    i = int(rng.integers(1, len(u)))
                    yes.append(u[:i] + abc[rng.integers(26)] + u[i:])
                    c_yes.append(weight[u] / 2)
        z_yes, z_no = against(yes, tables, index) @ root, against(pool, tables, index) @ root
        w = svm(np.vstack([z_yes, z_no]), np.concatenate([np.ones(len(yes)), -np.ones(len(pool))]), np.concatenate([np.array(c_yes), np.ones(len(pool))]))
        table = np.zeros(TABLE, np.float32)
        table[used] = (root @ w[:-1]) @ tables
        if turn + 1 < rounds:  # each sentence's worst unit under this machine
            value = dict(zip(every, (against(every, table[None])[:, 0] + w[-1]).tolist(), strict=True))
            n = Counter(max(bag, key=lambda u: (value[u] + min(odds(u), 2.0), u)) for bag in toxic_bags)
            n.update(u for bag in toxic_bags for u in bag if u in known and bad[u] > 1)
            # a unit that stands for one sentence only may stand beside the insult by chance: it counts less
            weight = {u: float(min(40, k)) if k > 1 else 0.2 for u, k in n.items()}
            worst = Counter(max(bag, key=lambda u: (value[u], u)) for bag in clean_bags)
            pool = list(dict.fromkeys([*pool, *[u for u, _ in sorted(worst.items(), key=lambda kv: (-value[kv[0]], kv[0]))[: negatives // 2] if u not in weight]]))
    model = Model(table, float(w[-1]), 1.0, 0.0)
    use = np.flatnonzero(rest) if y[rest].any() and not y[rest].all() else np.arange(len(texts))
    names = sorted({u for i in use for u in bags[i]})
    value = dict(zip(names, model.margins(names), strict=True)) if names else {}
    m = np.array([max((value[u] for u in bags[i]), default=NOTHING) for i in use])
    # Platt's sigmoid, with his targets, by Newton steps
    n1, n0 = y[use].sum(), (~y[use]).sum()
    target = np.where(y[use], (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([1.0, 0.0])
    x = np.column_stack([m, np.ones(len(m))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-4 * ab)
        ab -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(float(ab[0]), 1e-3), float(ab[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 8000) -> Model:
    """Train on at most ``rows`` labelled rows (96 MB of text at most) outside the held-out fold (crc32 of the id modulo 5
    is 0).

    A document with several labels counts as toxic if one of them says so.
    """
    marks = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col, 5, 0)).groupBy(id_col).agg(F.max(label_col).alias("mark"))
    chosen = hash_sample(marks, F.col(id_col), rows)
    texts = docs.select(id_col, text_col).where(F.col(text_col).isNotNull())
    found = texts.join(F.broadcast(chosen), id_col)  # ``rows`` bounds the broadcast
    many = found.agg(F.sum(F.octet_length(text_col)).alias("bytes")).first()["bytes"] or 0
    if many > 96 << 20:
        found = texts.join(F.broadcast(hash_sample(marks, F.col(id_col), max(1, rows * (96 << 20) // many))), id_col)
    got = found.toArrow()
    order = np.argsort(got[id_col].to_numpy(), kind="stable")
    texts, toxic = got[text_col].to_pylist(), got["mark"].to_pylist()
    return train([texts[i] for i in order], [int(toxic[i]) for i in order])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` (probability of toxicity, 0 to 1) and ``worst`` (the unit that decides, null if none).

    Null and empty texts, and texts without letters, have no unit and get the score of a margin well below zero.  Of
    units with equal margins the first in alphabetical order is named.  Repeated rows stay; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    known: dict[str, float] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for lo, hi in row_blocks(offsets, 2 << 20):
                bags = [words_of(t) if t else set() for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                if len(known) > CACHE:
                    known.clear()
                new = sorted(set().union(*bags) - known.keys())
                normal = [unit(w) for w in new]
                some = sorted({u for u in normal if u})
                value = dict(zip(some, m.margins(some).tolist(), strict=True)) if some else {}
                known.update((w, value.get(u, -1e9)) for w, u in zip(new, normal, strict=True))
                best, margin = [], []
                for bag in bags:
                    top = max(map(known.__getitem__, bag), default=-1e9)
                    margin.append(top if top > -1e9 else NOTHING)
                    best.append(min(w for w in bag if known[w] == top) if top > 0 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(m.probability(np.array(margin))), pa.array(best, pa.string())], names=[id_col, "score", "worst"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, score double, worst string")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst")
