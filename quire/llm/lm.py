"""Language-model scores from a causal self-attention model, beside add-one unigram scores (operator 6).

Texts (A-Z in lower case) are words between white space, then an end.  For the model, a word with its leading space is
cut into subwords: longest matches over a public vocabulary, of which the 3,839 ids most frequent in the training part,
all single bytes and the end are used; what was not chosen is cut again, into longest matches of chosen ones.  One layer of causal attention with relative positions and a residual connection
predicts the next id as three digits to the base 16, so an output costs 48 logits instead of 4,096.  A bigram of first
digits, counted over all training rows, is added to their logits with a learnt weight.  Those counts also choose the ids
and start the output biases.

Adam trains in numpy on all training rows: they are cut once and dealt into shards of bounded size, and each shard trains
in a task of its own, in one of a few rounds; after a round its models are averaged and the next one begins there.

Scoring cuts a text into windows of 16 ids that see themselves and the 16 before; each id is scored once, all windows
of a block of texts in one batch of masked attention.  Query, key and value of an id do not depend on its place, so
they are table lookups.

Unigram counts cover the whole training part of the corpus.  Texts are dealt into groups of bounded size; each group
sends its distinct words' hashes and counts by hash bucket, buckets add them up and answer each group.  So neither the
vocabulary nor any count is collected, and no word, however frequent, has more than one entry for each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut_lineage, held_out, row_blocks, utf8
from .near_dup import word_hashes

IDS, BRANCH, DIM, HALF = 4096, 16, 16, 16  # an id has three digits to the base BRANCH, predicted one after the other
CLASS = BRANCH**2  # ids of one first digit
END = IDS - 1
END_HASH = np.uint64(0x5851F42D4C957F2D)
GROUPS, LEAST, MOST = 96, 1 << 20, 32 << 20
LONGEST = 24  # bytes of a public token that is used
PIECE = 32  # windows whose attention is trained together
SHARD = 16 << 20  # bytes of texts from which one task trains


@dataclass
class Numbered:
    """A block of texts as numbers of its distinct words in lower case; number 0 is the end."""

    joined: bytes  # the words from number 1 on, a space before each
    sizes: np.ndarray  # of them, with their spaces
    at: np.ndarray  # number of each word, an end after each text
    bounds: np.ndarray  # first word of each text, and one bound more

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the distinct words."""
        return np.concatenate([[END_HASH], word_hashes(np.frombuffer(self.joined, np.uint8), np.array([0, len(self.joined)]))[0]])


def numbered(texts: list[bytes] | pa.Array) -> Numbered:
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_binary())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string())))
    found = lists.values.dictionary_encode()
    words, code = found.dictionary, found.indices.to_numpy().astype(np.int64)
    sizes = pc.binary_length(words).to_numpy()
    empty = np.flatnonzero(sizes == 0)  # around white space at an end of a text
    of = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if len(empty):
        keep = code != empty[0]
        code, of = code[keep], of[keep]
        code -= code > empty[0]
        words, sizes = words.filter(pa.array(sizes > 0)), np.delete(sizes, empty)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)) + 1)])
    at = np.zeros(bounds[-1], np.int64)
    at[np.arange(len(code)) + of] = code + 1
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(" ", pa.large_string()))
    return Numbered(b" " + joined.view(pa.large_binary())[0].as_py() if len(words) else b"", sizes + 1, at, bounds)


class Cutter:
    """Subword ids of texts by longest match, in one pass of an automaton; no token has a space but at its start, so a
    word's ids do not depend on its neighbours, and a block's distinct words are cut once each."""

    def __init__(self, vocabulary: list[bytes], longest: int = 1 << 30, end: int = END):
        self.trie = ahocorasick.Automaton()
        for i, t in enumerate(vocabulary):
            if len(t) <= longest:
                self.trie.add_word(t.decode("latin-1"), i)
        self.trie.make_automaton()
        self.size, self.end = np.array([len(t) for t in vocabulary], np.int64), end

    def text(self, raw: bytes, kind: str | type = "<u2") -> np.ndarray:
        """Ids of a text and its end."""
        words = raw.lower().split()
        ids = [i for _, i in self.trie.iter_long((b" " + b" ".join(words)).decode("latin-1"))] if words else []
        ids.append(self.end)
        return np.array(ids, kind)

    def words(self, block: Numbered) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has; the end, which comes first, has one."""
        if not block.joined:
            return np.array([self.end]), np.array([1])
        found = np.array([i for _, i in self.trie.iter_long(block.joined.decode("latin-1"))], np.int64)
        upto = np.searchsorted(np.cumsum(self.size[found]), np.cumsum(block.sizes))  # last id of each word
        return np.concatenate([[self.end], found]), np.concatenate([[1, upto[0] + 1], np.diff(upto)])

    def block(self, block: Numbered) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts with their ends, and bounds of the texts."""
        ids, many = self.words(block)
        return spread(ids, many, block.at, block.bounds)


def spread(ids: np.ndarray, many: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` holds those of each number one after the other, ``many`` of each; these in the order ``at``, and bounds."""
    size = many[at]
    upto = np.concatenate([[0], np.cumsum(size)])
    first = (np.cumsum(many) - many)[at] - upto[:-1]
    return ids[np.repeat(first, size) + np.arange(upto[-1])], upto[bounds]


class Recoder:
    """Public tokens, the end last, to the chosen ids: its own if it was chosen, those of its longest matches if not."""

    def __init__(self, tokens: list[bytes], vocabulary: list[bytes]):
        known = {t: i for i, t in enumerate(vocabulary[:-1])}
        cutter, ids = Cutter(vocabulary[:-1]), []
        for t in tokens:
            ids.append([known[t]] if t in known else [i for _, i in cutter.trie.iter_long(t.decode("latin-1"))])
        ids.append([END])
        self.many = np.array([len(x) for x in ids])
        self.ids = np.concatenate([np.array(x, np.int64) for x in ids])
        self.alone = np.where(self.many == 1, self.ids[np.cumsum(self.many) - self.many], -1).astype(np.int32)

    def __call__(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self.alone.take(tokens)
        return (out, bounds) if len(out) == 0 or out.min() >= 0 else spread(self.ids, self.many, tokens, bounds)


def bigram_counts(texts: list[bytes], cutter: Cutter) -> np.ndarray:
    """Pairs (id, class of the next id) as one vector of IDS x classes, then ids (without the end before a text)."""
    return pair_counts(np.concatenate([[END], cutter.block(numbered(texts))[0]]))


def pair_counts(ids: np.ndarray) -> np.ndarray:
    """bigram_counts() of ids, the first of which is an end before a text."""
    ids, many = ids.astype(np.int64), IDS // CLASS
    return np.concatenate([np.bincount(ids[:-1] * many + ids[1:] // CLASS, minlength=IDS * many), np.bincount(ids[1:], minlength=IDS)])


def bigram(counts: np.ndarray) -> np.ndarray:
    """Probabilities of classes after each id, smoothed by those of the classes."""
    pairs, kinds = counts[:-IDS].reshape(IDS, -1).astype(np.float64), (counts[-IDS:] + 0.3).reshape(-1, CLASS).sum(1)
    return ((pairs + 8 * kinds / kinds.sum()) / (pairs.sum(1, keepdims=True) + 8)).astype(np.float32)


def summed_exp(z: np.ndarray) -> np.ndarray:
    """Sums of exponentials of rows, in place."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[-1], z.dtype)


def digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ids >> 8, ids >> 4 & BRANCH - 1, ids & BRANCH - 1


def by_branch(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the first two digits of ids, and where each pair of them begins in it."""
    pair = (target >> 4).astype(np.uint8)
    return np.argsort(pair, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=BRANCH**2))])


def branches(bounds: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Those of the second and of the third level that occur: number, first row, end."""
    first, third = bounds[::BRANCH].tolist(), bounds.tolist()
    return tuple([(j, a, b) for j, (a, b) in enumerate(zip(x[:-1], x[1:])) if a < b] for x in (first, third))


def digit_logits(h: np.ndarray, bounds: np.ndarray, c: np.ndarray, o: np.ndarray, u: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Logits of the three digits, from states with a one in the order of by_branch()."""
    z = np.empty((3, len(h), BRANCH), np.float32) if out is None else out
    np.matmul(h, c, out=z[0])
    for rows, w, level in zip(z[1:], (o, u), branches(bounds)):
        w = list(w)
        for j, a, b in level:
            np.dot(h[a:b], w[j], rows[a:b])
    return np.clip(z, -40, 40, out=z)  # exponentials are taken without subtracting the largest


@dataclass
class Model:
    vocabulary: list[bytes]
    e: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    near: np.ndarray  # bias by distance, 0 to 2 * HALF - 1
    c: np.ndarray  # (DIM + 1) x BRANCH, the last row a bias: the first digit of an id to the base BRANCH
    o: np.ndarray  # BRANCH of those: the second digit after each first one
    u: np.ndarray  # BRANCH**2 of those: the third digit after each two
    mix: np.ndarray  # log odds of the share
    after: np.ndarray | None = None  # ids x classes: the class bigram of all training rows

    @property
    def share(self) -> float:
        """How much of the bigram's log probabilities is added to the logits of first digits, between 0 and 1."""
        return float(1 / (1 + np.exp(-self.mix[0])))

    def tables(self) -> Model:
        """The same model with projections applied to all ids."""
        m = Model(**self.__dict__)
        m.q, m.k, m.v = self.e @ self.q / np.sqrt(np.float32(DIM)), self.e @ self.k, self.e @ self.v
        # exponentials are taken without subtracting the largest: attention logits are kept within +-60
        most = float(np.linalg.norm(m.q, axis=1).max() * np.linalg.norm(m.k, axis=1).max() + np.abs(m.near).max())
        if most > 60:
            m.q, m.near = m.q * np.float32(60 / most), m.near * np.float32(60 / most)
        return m

    def log_probs(self, h: np.ndarray, target: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """Natural log probabilities of target ids from states, and from the ids ``seen`` before them by the bigram."""
        out, block = np.empty(len(h), np.float64), 1 << 15  # blocks that stay in the cache
        known = None if seen is None else np.float32(self.share) * np.log(self.after)
        ones, z_ = np.ones((min(block, len(h)), DIM + 1), np.float32), np.empty(3 * min(block, len(h)) * BRANCH, np.float32)
        for lo in range(0, len(h), block):
            order, bounds = by_branch(target[lo : lo + block])
            t, n = target[lo : lo + block].take(order), len(order)
            ones[:n, :DIM] = h[lo : lo + block].take(order, axis=0)
            z = digit_logits(ones[:n], bounds, self.c, self.o, self.u, z_[: 3 * n * BRANCH].reshape(3, n, BRANCH))
            if known is not None:
                z[0] += known.take(seen[lo : lo + block].take(order), axis=0)
            row = np.arange(0, n * BRANCH, BRANCH)
            picked = sum(x.reshape(-1).take(row + d) for x, d in zip(z, digits(t)))
            out[lo + order] = picked - np.log(summed_exp(z)).sum(0, dtype=np.float64)
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each id sequence; ``self`` holds tables."""
        sizes = np.array([len(t) for t in texts])
        windows = -(-sizes // HALF)
        starts = np.concatenate([[0], np.cumsum(windows)])
        total = int(starts[-1])
        target = np.full(total * HALF, -1, np.int64)
        seen = np.full((total + 1) * HALF, END, np.int64)  # the id before each target; a text begins after an end; one window before all
        for t, s in zip(texts, starts.tolist(), strict=False):
            a = s * HALF
            target[a : a + len(t)] = t
            seen[a + HALF + 1 : a + HALF + len(t)] = t[:-1]
        first = np.zeros(total, bool)
        first[starts[:-1]] = True
        gap = np.arange(HALF)[:, None] + HALF - np.arange(2 * HALF)[None, :]
        near = np.where(gap >= 0, self.near[np.maximum(gap, 0)], np.float32(-np.inf)).astype(np.float32)
        h, size = np.empty((total, HALF, DIM), np.float32), np.dtype(np.float32).itemsize
        k_, v_ = np.empty((2, (PIECE * 2 + 1) * HALF, DIM), np.float32)
        # rows of keys and values as windows of two halves, each of which begins in the middle of the one before
        k, v = (np.ndarray((PIECE * 2, 2 * HALF, DIM), np.float32, x, 0, (HALF * DIM * size, DIM * size, size)) for x in (k_, v_))
        q, a_, one = np.empty((PIECE * 2 * HALF, DIM), np.float32), np.empty((PIECE * 2, HALF, 2 * HALF), np.float32), np.ones((2 * HALF, 1), np.float32)
        for lo in range(0, total, PIECE * 2):  # blocks of windows that stay in the cache; each with the window before
            many = min(total - lo, PIECE * 2)
            ids = seen[lo * HALF : (lo + many + 1) * HALF]
            np.take(self.k, ids, axis=0, out=k_[: len(ids)], mode="clip")
            np.take(self.v, ids, axis=0, out=v_[: len(ids)], mode="clip")
            ids, mine = ids[HALF:], q[: many * HALF]
            np.take(self.q, ids, axis=0, out=mine, mode="clip")
            a = np.matmul(mine.reshape(-1, HALF, DIM), k[:many].transpose(0, 2, 1), out=a_[:many])
            a += near
            np.exp(a, out=a)
            a[first[lo : lo + many], :, :HALF] = 0
            part = np.matmul(a, v[:many], out=h[lo : lo + many])
            part /= a @ one
            part += np.take(self.e, ids, axis=0, out=mine, mode="clip").reshape(-1, HALF, DIM)
        seen, h = seen[HALF:], h.reshape(-1, DIM)
        use = np.flatnonzero(target >= 0)
        p = np.zeros(len(target))
        p[use] = self.log_probs(h.take(use, axis=0), target.take(use), None if self.after is None else seen.take(use))
        return np.add.reduceat(p, starts[:-1] * HALF) / np.log(10)


def _views(flat: np.ndarray, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    """The arrays that lie one after the other in a flat one, without copies."""
    ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])
    return {n: x.reshape(s) for (n, s), x in zip(shapes.items(), np.split(flat, ends[:-1]))}


def train(texts: list[bytes], vocabulary: list[bytes], **how) -> Model:
    """train_ids() on texts and their ends."""
    cutter = Cutter(vocabulary)
    return train_ids(np.concatenate([cutter.text(t) for t in texts] or [np.array([END], "<u2")]), vocabulary, **how)


def train_ids(
    ids: np.ndarray, vocabulary: list[bytes], *, steps: int = 400, least: int = 24, most: int = 512, rate: float = 0.01, seed: int = 3,
    counts: np.ndarray | None = None, start: dict[str, np.ndarray] | None = None, after: np.ndarray | None = None,
) -> Model:
    """Adam on windows of 32 ids.  Every id is predicted once in each pass; a pass takes batches of ``least`` to ``most``
    windows in random order, and there are as many passes as it takes to make ``steps`` of them, one at least.  Output
    biases start at ``counts`` of ids, or those of these ids; with the bigram ``after``, those of first digits at 0.
    Training goes on from the weights ``start``, if given."""
    rng = np.random.default_rng(seed)
    f, wide = np.float32, 2 * HALF
    freq = (np.bincount(ids, minlength=IDS) if counts is None else counts) + 0.3
    known = None if after is None else np.log(after)
    ids = np.concatenate([np.array([END], "<u2"), ids.astype("<u2", copy=False)])
    if len(ids) <= wide:
        ids = np.tile(ids, wide // len(ids) + 2)
    begins = np.minimum(np.arange(0, len(ids) - 1, wide), len(ids) - 1 - wide)
    batch = min(len(begins), max(least, min(most, len(begins) // max(steps, 1))))
    a_pass = -(-len(begins) // batch)
    steps = a_pass * max(1, -(-steps // a_pass)) if steps > a_pass else a_pass
    by_digit = freq.reshape(BRANCH, BRANCH, BRANCH)
    p = {
        "e": rng.standard_normal((IDS, DIM)).astype(f) * f(0.1),
        "q": rng.standard_normal((DIM, DIM)).astype(f) * f(0.25),
        "k": np.eye(DIM, dtype=f),  # stays: q and k act by their product only
        "v": rng.standard_normal((DIM, DIM)).astype(f) * f(0.25),
        "near": np.zeros(wide, f),
        "c": np.zeros((DIM + 1, BRANCH), f),
        "o": np.zeros((BRANCH, DIM + 1, BRANCH), f),
        "u": np.zeros((BRANCH**2, DIM + 1, BRANCH), f),
        "mix": np.full(1, 2, f),
    }
    first, second = by_digit.sum((1, 2)), by_digit.sum(2)
    if after is None:
        p["c"][DIM] = np.log(first / first.sum())
    p["o"][:, DIM], p["u"][:, DIM] = np.log(second / first[:, None]), np.log(by_digit / second[:, :, None]).reshape(-1, BRANCH)
    if start is not None:
        p = {n: start[n] for n in p}
    flat = np.concatenate([x.ravel() for x in p.values()]).astype(f)
    shapes, grad, m1, m2, t1, t2 = {n: x.shape for n, x in p.items()}, *(np.zeros_like(flat) for _ in range(5))
    p, g = _views(flat, shapes), _views(grad, shapes)
    dist = np.arange(wide)[:, None] - np.arange(wide)[None, :]
    gap, open_, root, ones = np.maximum(dist, 0), dist >= 0, f(np.sqrt(DIM)), np.ones((wide, 1), f)
    # all arrays of a step are made once; attention runs on PIECE windows at a time, which stay in the cache
    x_, q_, v_, att_, dh_, dq_, dk_, dv_, more_, tmp_ = np.empty((10, batch * wide, DIM), f)
    a_, da_, sums_ = np.empty((batch, wide, wide), f), np.empty((min(batch, PIECE), wide, wide), f), np.empty((batch, wide, 1), f)
    hh_, h_, z_ = np.ones((batch * wide, DIM + 1), f), np.empty((batch * wide, DIM + 1), f), np.empty(3 * batch * wide * BRANCH, f)
    row_ = np.arange(batch * wide)
    windows = np.lib.stride_tricks.sliding_window_view(ids, wide + 1)
    for step in range(1, steps + 1):
        nth = (step - 1) % a_pass
        if nth == 0:
            dealt = rng.permutation(len(begins))
        seq = windows[begins[dealt[nth * batch : (nth + 1) * batch]]].astype(np.intp)
        before, after, many = seq[:, :-1].ravel(), seq[:, 1:].ravel(), len(seq)
        n = len(before)
        x, q, v, att, dh, dq, dk, dv, more, tmp, hh, h, row = (r[:n] for r in (x_, q_, v_, att_, dh_, dq_, dk_, dv_, more_, tmp_, hh_, h_, row_))
        xw, qw, vw, attw, dqw, dkw, dvw, morew = (r.reshape(many, wide, DIM) for r in (x, q, v, att, dq, dk, dv, more))
        of_q, of_v = p["e"] @ (p["q"] / root), p["e"] @ p["v"]
        near = p["near"][gap]
        tame = np.linalg.norm(of_q, axis=1).max() * np.linalg.norm(p["e"], axis=1).max() + np.abs(near).max() < 40
        if tame:
            near[~open_] = -np.inf
        pieces = [(w, min(many, w + PIECE)) for w in range(0, many, PIECE)]
        for lo, hi in pieces:
            some, (i, j) = before[lo * wide : hi * wide], (lo * wide, hi * wide)
            for table, out in ((p["e"], x), (of_q, q), (of_v, v)):
                np.take(table, some, axis=0, out=out[i:j], mode="clip")
            a = np.matmul(qw[lo:hi], xw[lo:hi].transpose(0, 2, 1), out=a_[lo:hi])
            a += near
            if tame:
                np.exp(a, out=a)
            else:
                np.exp(np.clip(a, -40, 40, out=a), out=a)
                a *= open_
            part = np.matmul(a, ones, out=sums_[lo:hi])
            np.divide(1, part, out=part)
            np.matmul(a, vw[lo:hi], out=attw[lo:hi])
            attw[lo:hi] *= part
            np.add(x[i:j], att[i:j], out=hh[i:j, :DIM])
        order, bounds = by_branch(after)
        t = after.take(order)
        np.take(hh, order, axis=0, out=h, mode="clip")
        z = digit_logits(h, bounds, p["c"], p["o"], p["u"], z_[: 3 * n * BRANCH].reshape(3, n, BRANCH))
        if known is not None:
            share = 1 / (1 + np.exp(-p["mix"][0]))
            z[0] += np.take(known * share, before.take(order), axis=0, out=tmp, mode="clip")
        summed = summed_exp(z)
        np.divide(f(1 / n), summed, out=summed)
        z *= summed[:, :, None]
        cell = row * BRANCH
        for dz, d in zip(z, digits(t)):
            dz.reshape(-1)[cell + d] -= f(1 / n)
        if known is not None:
            g["mix"][0] = np.vdot(z[0], tmp) * (1 - share)
        np.matmul(h.T, z[0], out=g["c"])
        np.matmul(z[0], p["c"][:DIM].T, out=dh)
        for dz, name, level in zip(z[1:], "ou", branches(bounds)):
            g[name][:] = 0
            ws, gws = list(p[name][:, :DIM].transpose(0, 2, 1)), list(g[name])
            for j, lo, hi in level:
                some = dz[lo:hi]
                np.dot(h[lo:hi].T, some, gws[j])
                np.dot(some, ws[j], more[lo:hi])
            dh += more
        back = np.empty(n, np.intp)
        back[order] = row
        total = np.zeros((wide, wide), f)
        for lo, hi in pieces:
            i, j = lo * wide, hi * wide
            np.take(dh, back[i:j], axis=0, out=more[i:j], mode="clip")
            a, da, part = a_[lo:hi], da_[: hi - lo], sums_[lo:hi]
            mean = np.einsum("ij,ij->i", more[i:j], att[i:j]).reshape(-1, wide, 1)
            mean *= part
            scaled = np.multiply(morew[lo:hi], part, out=tmp[i:j].reshape(-1, wide, DIM))
            np.matmul(scaled, vw[lo:hi].transpose(0, 2, 1), out=da)
            np.matmul(a.transpose(0, 2, 1), scaled, out=dvw[lo:hi])
            da -= mean
            da *= a
            total += da.sum(0)
            np.matmul(da, xw[lo:hi], out=dqw[lo:hi])
            np.matmul(da.transpose(0, 2, 1), qw[lo:hi], out=dkw[lo:hi])
            more[i:j] += dk[i:j]
            for name, d, w in (("q", dq, p["q"].T / root), ("v", dv, p["v"].T)):
                more[i:j] += np.matmul(d[i:j], w, out=tmp[i:j])
        g["near"][:] = np.bincount(gap.ravel(), total.ravel(), minlength=wide)
        g["q"][:], g["v"][:] = x.T @ dq / root, x.T @ dv
        kind = before.astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        kind = kind.take(order)
        begin = np.flatnonzero(np.diff(kind, prepend=np.uint16(IDS)))
        g["e"][:] = 0
        g["e"][kind.take(begin)] = np.add.reduceat(np.take(more, order, axis=0, out=tmp, mode="clip"), begin, axis=0)
        lr = rate * min(1.0, step / 50) * (1 - 0.95 * step / steps)
        np.subtract(grad, m1, out=t1)
        t1 *= f(0.1)
        m1 += t1
        np.multiply(grad, grad, out=t1)
        t1 -= m2
        t1 *= f(0.01)
        m2 += t1
        np.sqrt(np.divide(m2, f(1 - 0.99**step), out=t1), out=t1)
        t1 += f(1e-8)
        np.multiply(m1, f(lr / (1 - 0.9**step)), out=t2)
        t2 /= t1
        flat -= t2
    return Model(vocabulary, **p)


def choose_ids(n: np.ndarray, tokens: list[bytes]) -> list[bytes]:
    """All bytes, then the public tokens with the highest counts; ids run by falling count.  Last: the end."""
    order = np.lexsort((np.arange(len(tokens)), -n))
    single = {i for i in range(len(tokens)) if len(tokens[i]) == 1}
    more = [int(i) for i in order if i not in single and len(tokens[i]) <= LONGEST][: IDS - 1 - len(single)]
    chosen = set(more) | single
    return [tokens[int(i)] for i in order if i in chosen] + [b""]


def _added(some: DataFrame, size: int) -> np.ndarray:
    got = some.groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["i"].to_numpy()] = got["n"].to_numpy()
    return out


WEIGHTS = ("e", "q", "k", "v", "near", "c", "o", "u", "mix")


def _weights(model: Model) -> np.ndarray:
    return np.concatenate([getattr(model, n).ravel() for n in WEIGHTS]).astype(np.float32)


def _unpacked(flat: np.ndarray, like: Model) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in WEIGHTS:
        shape = getattr(like, n).shape
        out[n] = flat[at : at + int(np.prod(shape))].reshape(shape).copy()
        at += int(np.prod(shape))
    return out


def cut_rows(some: DataFrame, tokens: list[bytes]) -> DataFrame:
    """Public tokens of each text and its end, numbered len(tokens), as 16-bit integers; part and id stay."""
    shipped = some.sparkSession.sparkContext.broadcast(tokens)
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Cutter(shipped.value, LONGEST, len(shipped.value)))
        for batch in batches:
            for lo, hi, block in _blocks(batch):
                ids, cut = held[0].block(block)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(2 * cut), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch["part"][lo:hi], batch["id"][lo:hi], raw.cast(pa.binary())], names=["part", "id", "ids"])

    return some.select("part", "id", "text").mapInArrow(run, "part int, id bigint, ids binary")


def _ids(raw: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Public tokens of rows of cut_rows(), and bounds of the rows."""
    data, offsets = utf8(raw)
    return data[offsets[0] : offsets[-1]].view("<u2"), (offsets - offsets[0]) // 2


def _coded(raw: pa.ChunkedArray, recode: Recoder) -> np.ndarray:
    """Chosen ids of rows of cut_rows(), one row after the other."""
    ids, bounds = _ids(raw)
    some = (recode(ids[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])[0].astype("<u2") for lo, hi in row_blocks(bounds, 1 << 20))
    return np.concatenate([np.zeros(0, "<u2"), *some])


def _counted(cut: DataFrame, size: int, count) -> np.ndarray:
    """Sum over all texts of cut_rows() of the vectors that ``count`` makes of blocks of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            ids, bounds = _ids(batch.column(0))
            for lo, hi in row_blocks(bounds, 1 << 20):
                n += count(ids[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["i", "n"])

    return _added(cut.select("ids").mapInArrow(run, "i bigint, n bigint"), size)


def token_counts(cut: DataFrame, size: int) -> np.ndarray:
    """Public tokens of all texts of cut_rows(), without ends."""
    return _counted(cut, size + 1, lambda ids, bounds: np.bincount(ids, minlength=size + 1))[:-1]


def id_counts(cut: DataFrame, tokens: list[bytes], vocabulary: list[bytes]) -> np.ndarray:
    """bigram_counts() of all texts of cut_rows()."""
    shipped = cut.sparkSession.sparkContext.broadcast(Recoder(tokens, vocabulary))
    # every text ends with an end, and so does what is before the first
    return _counted(cut, IDS * (IDS // CLASS) + IDS, lambda ids, bounds: pair_counts(np.concatenate([[END], shipped.value(ids, bounds)[0]])))


def train_apart(some: DataFrame, vocabulary: list[bytes], counts: np.ndarray, shards: int, *, rounds: int | None = None, steps: int = 400, after: np.ndarray | None = None) -> Model:
    """Local training on all rows: each shard of rows, (id, text) or those of cut_rows(), trains in a task of its own from
    the weights of the round before, and weights are averaged by rows, 32 at a time, so that no task and not the driver
    holds more than one shard of ids or 32 models.  A shard belongs to one round.  Rounds grow fourfold from one shard, or
    there are ``rounds`` equal ones; the first of growing ones takes four times as many ``steps`` at least."""
    spark, start = some.sparkSession, None
    tokens = bpe.default_vocabulary()[0]
    if "ids" not in some.columns:
        some = cut_rows(some.withColumn("part", F.pmod(F.xxhash64("id", F.lit(23)), F.lit(shards)).cast("int")), tokens)
    recoder = spark.sparkContext.broadcast(Recoder(tokens, vocabulary))
    schema = "part int, n bigint, w binary"
    ends = [-(-shards * (r + 1) // rounds) for r in range(rounds)] if rounds else [1]
    while ends[-1] < shards:
        ends.append(min(shards, 5 * ends[-1]))
    model = train([], vocabulary, steps=1, counts=counts)
    for r, (lo, hi) in enumerate(zip([0, *ends], ends)):
        shipped = spark.sparkContext.broadcast((vocabulary, counts, start, r, after))

        def local(key: tuple, table: pa.Table) -> pa.Table:  # runs before the next round begins
            known, biases, begin, nth, pairs = shipped.value
            table = table.sort_by([("id", "ascending"), ("ids", "ascending")])
            m = train_ids(_coded(table["ids"], recoder.value), known, steps=steps if nth or rounds else 4 * steps, seed=3 + nth, counts=biases, start=begin, rate=0.01 / (1 + nth), after=pairs)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": [table.num_rows], "w": pa.array([(_weights(m) * np.float32(table.num_rows)).tobytes()], pa.binary())})

        def add(key: tuple, table: pa.Table) -> pa.Table:
            whole = np.sum([np.frombuffer(w.as_buffer(), np.float32) for w in table["w"]], axis=0, dtype=np.float64)
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": [sum(table["n"].to_pylist())], "w": pa.array([whole.astype(np.float32).tobytes()], pa.binary())})

        sums, parts = some.where((F.col("part") >= lo) & (F.col("part") < hi)).groupBy("part").applyInArrow(local, schema), hi
        while parts > 1:
            sums, parts = sums.withColumn("part", (F.col("part") / 32).cast("int")).groupBy("part").applyInArrow(add, schema), -(-parts // 32)
        got = sums.first()
        if got is not None:  # a round may have no rows
            start = _unpacked(np.frombuffer(got.w, np.float32) / np.float32(got.n), model)
    return Model(vocabulary, **start) if start else model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 50) -> Model:
    """Train outside the held-out fold (crc32 of the id modulo 7 is 2) on all rows there: ids, bigram, attention weights
    and the bigram's share.  Rows are dealt into shards of SHARD bytes, or less: eight shards where they then have ``rows``
    rows each."""
    usable = docs.where(~held_out(id_col, 7, 2)).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    shards = max(1, -(-found["bytes"] // SHARD), min(8, found["n"] // rows))
    part = F.pmod(F.xxhash64("id", "text", F.lit(23)), F.lit(shards)).cast("int")  # many rows of one id are spread
    tokens = bpe.default_vocabulary()[0]
    cut = cut_lineage(cut_rows(usable.withColumn("part", part), tokens))
    vocabulary = choose_ids(token_counts(cut, len(tokens)), tokens)
    pairs = id_counts(cut, tokens, vocabulary)
    after = bigram(pairs)
    model = train_apart(cut, vocabulary, pairs[-IDS:], shards, after=after)
    model.after = after
    return model


def _blocks(table: pa.Table, limit: int = 4 << 20) -> Iterator[tuple[int, int, Numbered]]:
    """Blocks of a group: row range and numbered texts."""
    data, offsets = utf8(table["text"])
    for lo, hi in row_blocks(offsets, limit):
        first, end = offsets[lo], offsets[hi]  # Arrow's kernels take the bytes of an array made here as those from 0 on
        yield lo, hi, numbered(pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(offsets[lo : hi + 1] - first), pa.py_buffer(data[first:end])]))


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Null and empty texts have one token, the end.  Rows that repeat an id count and are scored each.  A null id is
    held out.  In an empty table there is nothing to score; if all rows are held out, every count is zero.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-total // min(MOST, max(LEAST, total // GROUPS))))
    base = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(groups)).cast("int").alias("g"),  # many rows of one id are spread
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).alias("text"),
        held_out(id_col, 7, 2).alias("out"),
    )

    def deal(g: int, h: np.ndarray, c: np.ndarray | None):
        bucket = (h >> np.uint64(44)) % np.uint64(groups)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(groups + 1, dtype=np.uint64))
        for b in range(groups):
            if bounds[b] < bounds[b + 1]:
                yield b, order[bounds[b] : bounds[b + 1]]

    sent = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("h", pa.binary()), ("c", pa.binary())])
    back = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("c", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        g, parts = key[0].as_py(), []
        train_rows = ~table["out"].to_numpy()
        for lo, hi, block in _blocks(table):
            keep = np.repeat(train_rows[lo:hi], np.diff(block.bounds))
            parts.append((block.hashes(), np.bincount(block.at, keep, minlength=len(block.sizes) + 1)))
        u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(at, np.concatenate([p[1] for p in parts]), minlength=len(u)).astype("<u4")
        return pa.Table.from_pylist([{"b": b, "g": g, "h": u[x].astype("<u8").tobytes(), "c": c[x].tobytes()} for b, x in deal(g, u, c)], sent)

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        h = np.concatenate([np.frombuffer(r["h"], "<u8") for r in rows])
        c = np.concatenate([np.frombuffer(r["c"], "<u4") for r in rows])
        u, at = np.unique(h, return_inverse=True)
        whole = np.bincount(at, c, minlength=len(u))
        told, done, out = whole[at].astype("<i8"), 0, []
        for r in rows:
            n = len(r["h"]) // 8
            out.append({"g": r["g"], "b": r["b"], "c": told[done : done + n].tobytes(), "n": 0 if done else int(whole.sum()), "v": 0 if done else int((whole > 0).sum())})
            done += n
        return pa.Table.from_pylist(out, back)

    replies = base.groupBy("g").applyInArrow(count, "b int, g int, h binary, c binary").groupBy("b").applyInArrow(add_up, "g int, b int, c binary, n bigint, v bigint")
    replies = cut_lineage(replies)
    found = replies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_all, v_all = found["n"], found["v"]
    shipped, public = (docs.sparkSession.sparkContext.broadcast(x) for x in (model, bpe.default_vocabulary()[0]))
    held: list = []

    def judge(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        if not held:
            tokens = public.value
            held.extend([shipped.value.tables(), Cutter(tokens, LONGEST, len(tokens)), Recoder(tokens, shipped.value.vocabulary)])
        m, cutter, recode = held
        blocks = []  # of each: hashes of its words, their numbers in its texts, bounds, ids, bounds
        for *_, block in _blocks(table):
            ids, cut = recode(*cutter.block(block))
            blocks.append((block.hashes(), block.at.astype(np.int32), block.bounds, ids.astype(np.uint16), cut))
        u = np.unique(np.concatenate([b[0] for b in blocks]))
        c = np.zeros(len(u), np.int64)
        answers = {r["b"]: r["c"] for r in told.select(["b", "c"]).to_pylist()}
        for b, x in deal(0, u, None):
            c[x] = np.frombuffer(answers[b], "<i8")
        tokens, known, scores, base_scores = [], [], [], []
        for h, at, bounds, ids, cut in blocks:
            mine = c[np.searchsorted(u, h)]
            tokens.append(np.diff(bounds))
            known.append(np.add.reduceat((mine > 0)[at], bounds[:-1], dtype=np.int64))
            base_scores.append(np.add.reduceat(np.log10(mine + 1.0)[at], bounds[:-1]) - tokens[-1] * np.log10(n_all + v_all + 1))
            for lo, hi in row_blocks(cut, 1 << 17):
                scores.append(m.score([ids[x:y] for x, y in zip(cut[lo:hi].tolist(), cut[lo + 1 : hi + 1].tolist())]))
        return pa.table(
            {
                "id": table["id"],
                "held_out": table["out"],
                "n_tokens": pa.array(np.concatenate(tokens).astype(np.int64)),
                "n_known": pa.array(np.concatenate(known)),
                "train_tokens": pa.array(np.full(len(table), n_all, np.int64)),
                "base_score": pa.array(np.concatenate(base_scores)),
                "score": pa.array(np.concatenate(scores)),
            }
        )

    out = base.groupBy("g").cogroup(replies.select("g", "b", "c").groupBy("g")).applyInArrow(judge, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def query(docs: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs))
