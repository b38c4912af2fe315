"""Byte-level BPE encoding and decoding (operator 4).

Bytes map to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every token at every
position of a piece in one pass.  Encoding walks from longest matches and steps back: a token is taken if it can stand
beside its predecessor, which is so when BPE, run on the two tokens' bytes alone, would keep that border.  Borders are
decided by undoing merges and are memoised by pair of tokens.  Each position is left at most once, so time is linear
in the bytes of a piece, and the ids are those that repeated lowest-rank merges give.

Null texts count as empty: no ids, empty bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import row_blocks, utf8

#: Entries of the memos that a worker keeps; they are emptied when full, which costs time only.
PIECES, BORDERS = 250_000, 1_500_000
NONE = -1


def load_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f) if token}
    return [found[i] for i in range(len(found))]


class Codec:
    """Exact encoder and decoder of one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self.trie = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.trie.add_word(t.decode("latin-1"), i)
        self.trie.make_automaton()
        self.shorter = self._shorter()
        self.borders: dict[int, bool] = {}
        self.merged: dict[int, int] = {}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self._undo_merges()
        self.pieces: dict[str, bytes] = {}

    def _shorter(self) -> list[int]:
        """For each token the next shorter token that it starts with."""
        out = []
        for t in self.tokens:
            n = len(t) - 1
            while n and t[:n] not in self.rank:
                n -= 1
            out.append(self.rank[t[:n]] if n else NONE)
        return out

    def _undo_merges(self) -> None:
        """The last merge of each token; ranks rise, so parts are known before wholes."""
        for i, t in enumerate(self.tokens):
            a = self.shorter[i]
            while a != NONE:
                b = self.rank.get(t[self.size[a] :], NONE)
                if b != NONE and a < i and b < i and self._border(a, b):
                    self.merged[a << 32 | b] = i
                    self.left[i], self.right[i] = a, b
                    break
                a = self.shorter[a]

    def _border(self, a: int, b: int) -> bool:
        """Whether BPE on the bytes of a and b keeps the border between them."""
        below = len(self.tokens) + 1  # merges across the border must rank under this to come first
        while True:
            if self.merged.get(a << 32 | b, below) < below:
                return False
            if a > b:
                part = self.right[a]
                below, whole = a, part == a
                a = part
                if whole:
                    part = self.left[b]
                    below, whole = b + 1, part == b
                    b = part
                    if whole:
                        return True
            else:
                part = self.left[b]
                below, whole = b + 1, part == b
                b = part
                if whole:
                    part = self.right[a]
                    below, whole = a, part == a
                    a = part
                    if whole:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n, size, borders = len(piece), self.size, self.borders
        longest = [NONE] * n
        for end, token in self.trie.iter(piece.decode("latin-1")):
            longest[end - size[token] + 1] = token  # later ends are longer
        out: list[int] = []
        left = bytearray(n + 1)  # positions that no encoding passes
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] if out else NONE
            while token != NONE:
                if not left[at + size[token]]:
                    if before == NONE:
                        break
                    pair = before << 32 | token
                    fits = borders.get(pair)
                    if fits is None:
                        if len(borders) >= BORDERS:
                            borders.clear()
                        fits = borders[pair] = self._border(before, token)
                    if fits:
                        break
                token = self.shorter[token]
            if token != NONE:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else NONE
            elif out:
                left[at] = 1
                token = out.pop()
                at -= size[token]
                token = self.shorter[token]
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, found = self.pieces, self.find(text)
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            out = []
            for p in found:
                ids = known.get(p)
                if ids is None:
                    if len(known) >= PIECES:
                        known.clear()
                    ids = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
                    if len(p) <= 64:
                        known[p] = ids
                out.append(ids)
            return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple, Codec] = {}


def codec(tokens: list[bytes], pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (len(tokens), hashlib.sha256(b"\0".join(tokens[-100:])).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, tokens: list[bytes], pattern: str, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """Encode every text, decode the ids again, and return per row its id, ``n_tokens`` and either digests or arrays.

    With ``digests`` the columns are ids_sha256 and decoded_sha256 (lowercase hex), else ids array<bigint> and decoded
    binary.  A narrow map: no shuffle; the vocabulary (under 2 MB by its format) is broadcast.  Rows keep their order,
    repeated rows stay, null texts are empty, other columns are not read.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(tokens)
    kind = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<bigint>, decoded binary"
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value, pattern)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for lo, hi in row_blocks(offsets, 4 << 20):
                ns, a, b = [], [], []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    raw = c.encode_bytes(text or "")
                    ids = np.frombuffer(raw, "<u4")
                    back = c.decode(ids)
                    ns.append(len(ids))
                    a.append(hashlib.sha256(raw).hexdigest() if digests else ids.astype(np.int64))
                    b.append(hashlib.sha256(back).hexdigest() if digests else back)
                types = (pa.string(), pa.string()) if digests else (pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(ns, pa.int64()), pa.array(a, types[0]), pa.array(b, types[1])],
                    names=[id_col, "n_tokens", *[x.split()[0] for x in kind.split(", ")]],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_tokens bigint, {kind}")


def default_vocabulary() -> tuple[list[bytes], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    tokens, pattern = default_vocabulary()
    return encode_documents(docs, tokens, pattern)
