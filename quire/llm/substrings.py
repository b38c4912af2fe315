"""Removal of byte strings that an earlier document already holds: distributed prefix doubling (operator 5).

A byte goes if a string of ``length`` bytes (50) that covers it also starts in a document with a smaller id.  Matches
never cross documents, overlaps count, and strings are judged on the input.

Doubling.  The rank of a position is first that of its gram of k = length // 2 + 1 bytes; the string of ``length`` bytes
at p is the pair (rank at p, rank at p + length - k), the next level.  As in a suffix array built by prefix doubling,
positions whose rank is unique drop out before the next level, here "unique" meaning "in one document only".  All
positions of a corpus are too many to sort, so the first level ranks sampled ones: of every ``length`` bytes, the
grams with the least scrambled hash (minimisers).  Equal strings hold equal minimisers at equal places, so no match is
lost.  Three rounds follow, each a visit to the texts and an exchange of packed arrays by gram:

1. gram      -> grams that occur in two or more documents stay;
2. surround  -> a live gram with all the strings that can hold it (length - k bytes on both sides), as one hash: if an
   earlier document has the same surround, all its strings go; if all occurrences have the same one, nothing is left;
3. pairs     -> the rest sends its surround; per string the pair of gram ranks is grouped, the least id wins.

Texts move once, into groups of bounded size, and the exchange is reused by each visit; what else moves is about one
byte for each byte of text.  A group of copies adds one entry for each document and gram, never pairs, so hot groups
cost no more than other rows.  Nothing is collected on the driver but one sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, mix64, row_blocks, utf8

_powers = Powers(0x9E3779B97F4A7C15)
LAST = np.iinfo(np.int64).max
#: Bytes of text in a group (a cogrouped task's unit): total / GROUPS within these bounds.
GROUPS, LEAST, MOST = 96, 1 << 20, 32 << 20


def _slide(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """best(x[i : i + w]) for every i, in log2(w) passes."""
    if len(x) < w:
        return x[:0]
    have, n = 1, len(x)
    while have * 2 <= w:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: n - w + 1], x[w - have : w - have + n - w + 1])


class Block:
    """Grams and minimisers of some documents that lie one after the other."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.k, self.w = length // 2 + 1, length - length // 2
        self.data, self.ends, self.starts = data, offsets[1:], offsets[:-1]
        n = len(data)
        up, self.down = _powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(data.astype(np.uint64) * up[:n] + up[:n], out=self.sums[1:])
        if n < length:
            self.at, self.doc, self.gram = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
            return
        h = mix64((self.sums[self.k :] - self.sums[: -self.k]) * self.down[: n - self.k + 1]) | np.uint64(1)
        least = _slide(h, self.w, np.minimum)
        ok = np.zeros(n + 1, np.int8)
        long = self.ends - self.starts >= length
        np.add.at(ok, self.starts[long], 1)
        np.add.at(ok, self.ends[long] - length + 1, -1)
        least[np.cumsum(ok[: len(least)]) == 0] = 0
        pad = np.zeros(self.w - 1, np.uint64)
        self.at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), self.w, np.maximum) == h)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        self.gram = h[self.at]

    def hashed(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[s]) * self.down[s]

    def surround(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the bytes that the strings holding these grams can cover."""
        a, d = self.at[pick], self.doc[pick]
        return np.maximum(a - self.w + 1, self.starts[d]), np.minimum(a + self.k + self.w - 1, self.ends[d])


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy()


def _blocks(table: pa.Table, length: int) -> Iterator[tuple[int, int, np.ndarray, Block]]:
    """Documents of a group, sorted, in blocks of bounded size."""
    ids = _ids(table["id"])
    data, offsets = utf8(table["text"])
    for lo, hi in row_blocks(offsets, 1 << 20):
        yield lo, hi, ids[lo:hi], Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length)


def _sorted(table: pa.Table) -> pa.Table:
    if not table.num_rows:
        return table
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")]))


def _dealt(parts: list[dict], buckets: int, g: int) -> Iterator[dict]:
    """Entries of all blocks by bucket of their gram, in order of document and position."""
    parts = [p for p in parts if len(p["gram"])]
    if not parts:
        return
    every = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    bucket = (every["gram"] >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        if bounds[b] < bounds[b + 1]:
            pick = order[bounds[b] : bounds[b + 1]]
            yield {"b": b, "g": g} | {k: v[pick] for k, v in every.items()}


def _runs(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Run lengths and values of equal neighbours."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    return np.diff(np.append(at, len(ids))).astype("<u4").tobytes(), ids[at].astype("<i8").tobytes()


def _unrun(n: bytes, values: bytes) -> np.ndarray:
    return np.repeat(np.frombuffer(values, "<i8"), np.frombuffer(n, "<u4"))


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where each group begins in that order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def _spread(order: np.ndarray, begins: np.ndarray, per_group: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), per_group.dtype)
    out[order] = np.repeat(per_group, np.diff(np.append(begins, len(order))))
    return out


def _least(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the least id that its key has."""
    order, begins = _groups(key)
    return _spread(order, begins, np.minimum.reduceat(ids[order], begins)) if len(key) else ids


def _split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


_SENT = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("n", pa.binary()), ("ids", pa.binary()), ("state", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])
_BACK = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("state", pa.binary()), ("masks", pa.binary())])
_SENT_SQL, _BACK_SQL = "b int, g int, n binary, ids binary, state binary, x binary, y binary", "g int, b int, state binary, masks binary"


def remove_repeats(docs: DataFrame, length: int = 50, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes``, ``spans`` (maximal removed byte runs, start and end), ``kept`` (binary), ``carried`` (a struct of columns
    named in ``carry``).

    With ``as_text``, ``kept`` is a string: characters of which a cut left only some bytes go as well.

    Null and empty texts have no bytes and keep none; texts under ``length`` bytes are never touched nor matched.
    Rows with the same id are one document's parts: they never remove each other's bytes.  A null id counts as the
    largest.  Ties need no rule: only smaller ids matter.  Other columns are dropped unless carried, whatever their names.
    """
    if length < 4:
        raise ValueError("length must be 4 or more")
    w = length - length // 2
    k = length // 2 + 1
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-total // min(MOST, max(LEAST, total // GROUPS))))
    buckets = groups
    # plain aliases keep a carried column from clashing with the columns used here
    held = {f"c{i}": c for i, c in enumerate(carry)}
    base = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(groups)).cast("int").alias("g"),  # many rows of one id are spread
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).alias("text"),
        *[F.col(c).alias(a) for a, c in held.items()],
    )

    def first_grams(key: tuple, table: pa.Table) -> pa.Table:
        g, parts = key[0].as_py(), []
        for _, _, ids, block in _blocks(_sorted(table), length):
            parts.append({"gram": block.gram, "id": ids[block.doc]})
        rows = []
        for p in _dealt(parts, buckets, g):
            n, ids = _runs(p["id"])
            low = p["gram"] & np.uint64((1 << 40) - 1)
            rows.append({"b": p["b"], "g": g, "n": n, "ids": ids, "x": low.astype("<u4").tobytes(), "y": (low >> np.uint64(32)).astype("u1").tobytes()})
        return _table(rows, _SENT)

    def shared_grams(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids = [_unrun(r["n"], r["ids"]) for r in rows]
        key = np.concatenate([np.frombuffer(r["x"], "<u4") | np.frombuffer(r["y"], "u1").astype(np.uint64) << np.uint64(32) for r in rows])
        every = np.concatenate(ids)
        order, begins = _groups(key)
        s = every[order]
        live = _spread(order, begins, np.minimum.reduceat(s, begins) != np.maximum.reduceat(s, begins))
        return _table([{"g": r["g"], "b": r["b"], "state": np.packbits(x).tobytes()} for r, x in zip(rows, _split(live, [len(i) for i in ids])) if x.any()], _BACK)

    def states(parts: list[dict], back: pa.Table, g: int) -> np.ndarray:
        """What the last round said of each gram of the group, in order of blocks."""
        gram = np.concatenate([p["gram"] for p in parts]) if parts else np.zeros(0, np.uint64)
        out = np.zeros(len(gram), np.uint8)
        told = {r["b"]: np.frombuffer(r["state"], np.uint8) for r in back.select(["b", "state"]).to_pylist()}
        whole = [{"gram": gram, "no": np.arange(len(gram))}]
        for p in _dealt(whole, buckets, g):
            if p["b"] in told:
                out[p["no"]] = told[p["b"]][: len(p["no"])]
        return out

    def surrounds(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        g = key[0].as_py()
        table = _sorted(table)
        bits = [{"g": r["g"], "b": r["b"], "state": np.unpackbits(np.frombuffer(r["state"], np.uint8)).tobytes()} for r in back.select(["g", "b", "state"]).to_pylist()]
        parts = []
        for _, _, ids, block in _blocks(table, length):
            parts.append({"gram": block.gram, "id": ids[block.doc]})
        live = states(parts, _table(bits, _BACK), g)
        done = 0
        for p, (_, _, _, block) in zip(parts, _blocks(table, length)):
            pick = np.flatnonzero(live[done : done + len(p["gram"])])
            s, e = block.surround(pick)
            around = np.zeros(len(p["gram"]), np.uint64)
            around[pick] = mix64(block.hashed(s, e) + mix64((block.at[pick] - s).astype(np.uint64) * np.uint64(1 << 20) + (e - s).astype(np.uint64)))
            p["live"], p["around"] = live[done : done + len(p["gram"])], around
            done += len(p["gram"])
        rows = []
        for p in _dealt(parts, buckets, g):
            on = p["live"] > 0
            if on.any():
                n, ids = _runs(p["id"][on])
                rows.append({"b": p["b"], "g": g, "n": n, "ids": ids, "state": np.packbits(p["live"]).tobytes(), "x": p["gram"][on].astype("<u8").tobytes(), "y": p["around"][on].astype("<u8").tobytes()})
        return _table(rows, _SENT)

    def settled(table: pa.Table) -> pa.Table:
        """State of each gram: 0 nothing to do, 1 an earlier document has the whole surround, 2 its strings differ."""
        rows = table.to_pylist()
        ids = [_unrun(r["n"], r["ids"]) for r in rows]
        every, gram, around = np.concatenate(ids), np.concatenate([np.frombuffer(r["x"], "<u8") for r in rows]), np.concatenate([np.frombuffer(r["y"], "<u8") for r in rows])
        earlier = _least(mix64(gram) ^ around, every) < every
        order, begins = _groups(gram)
        a = around[order]
        mixed = _spread(order, begins, np.minimum.reduceat(a, begins) != np.maximum.reduceat(a, begins))
        state = np.where(earlier, 1, np.where(mixed, 2, 0)).astype(np.uint8)
        out = []
        for r, x in zip(rows, _split(state, [len(i) for i in ids])):
            full = np.unpackbits(np.frombuffer(r["state"], np.uint8))
            full[np.flatnonzero(full)] = x
            if x.any():
                out.append({"g": r["g"], "b": r["b"], "state": full.tobytes()})
        return _table(out, _BACK)

    def sent_strings(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        g = key[0].as_py()
        table, parts, wide = _sorted(table), [], k + 2 * (w - 1)
        for _, _, ids, block in _blocks(table, length):
            parts.append({"gram": block.gram, "id": ids[block.doc]})
        state, done = states(parts, back, g), 0
        for p, (_, _, _, block) in zip(parts, _blocks(table, length)):
            p["state"] = state[done : done + len(p["gram"])]
            done += len(p["gram"])
            pick = np.flatnonzero(p["state"] == 2)
            s, e = block.surround(pick)
            lead = (w - 1 - (block.at[pick] - s)).astype(np.int64)  # missing bytes before
            take = s[:, None] - lead[:, None] + np.arange(wide)
            inside = (take >= s[:, None]) & (take < e[:, None])
            seen = np.zeros((len(pick), wide + 2), np.uint8)
            seen[:, :wide] = np.where(inside, block.data[np.clip(take, 0, max(0, len(block.data) - 1))], 0)
            seen[:, wide], seen[:, wide + 1] = lead, lead + (e - s)
            p["row"] = np.full(len(p["gram"]), -1, np.int64)
            p["row"][pick] = np.arange(len(pick)) + (0 if not parts or "bodies" not in parts[0] else sum(len(x) for x in parts[0]["bodies"]))
            parts[0].setdefault("bodies", []).append(seen)
        if not parts:
            return _table([], _SENT)
        bodies = np.concatenate(parts[0].pop("bodies"))
        rows = []
        for p in _dealt(parts, buckets, g):
            if p["state"].any():
                on = p["state"] == 2
                n, ids = _runs(p["id"][on])
                rows.append({"b": p["b"], "g": g, "n": n, "ids": ids, "state": p["state"].tobytes(), "x": p["gram"][on].astype("<u8").tobytes(), "y": bodies[p["row"][on]].tobytes()})
        return _table(rows, _SENT)

    def paired(table: pa.Table) -> pa.Table:
        """For each sent gram a mask of the strings (by their offset) that an earlier document has too."""
        wide, rows = k + 2 * (w - 1), table.to_pylist()
        ids = [_unrun(r["n"], r["ids"]) for r in rows]
        every = np.concatenate(ids)
        gram = np.concatenate([np.frombuffer(r["x"], "<u8") for r in rows])
        masks = np.zeros((len(every), w), bool)
        if len(every):
            seen = np.frombuffer(b"".join(r["y"] for r in rows), np.uint8).reshape(-1, wide + 2)
            up, down = _powers.get(wide + 1)
            order, begins = _groups(gram)
            ends = np.append(begins[1:], len(order))
            lo = 0
            while lo < len(begins):  # whole groups, some 20,000 entries at a time
                hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + 20_000, side="right")))
                pick = order[begins[lo] : ends[hi - 1]]
                sums = np.zeros((len(pick), wide + 1), np.uint64)
                np.cumsum(seen[pick, :wide].astype(np.uint64) * up[:wide] + up[:wide], axis=1, out=sums[:, 1:])
                at = np.arange(wide - k + 1)
                ranks = mix64((sums[:, at + k] - sums[:, at]) * down[at])
                mixed, who = mix64(gram[pick]), every[pick]
                for o in range(w):
                    ok = np.flatnonzero((seen[pick, wide] <= o) & (o + length <= seen[pick, wide + 1]))
                    key = mix64(ranks[ok, o] * np.uint64(3) + mixed[ok]) ^ ranks[ok, o + length - k]
                    masks[pick[ok], o] = _least(key, who[ok]) < who[ok]
                lo = hi
        packed = np.packbits(masks, axis=1)
        out, done = [], 0
        for r, i in zip(rows, ids):
            out.append({"g": r["g"], "b": r["b"], "state": r["state"], "masks": packed[done : done + len(i)].tobytes()})
            done += len(i)
        return _table(out, _BACK)

    types = {a: docs.schema[c].dataType for a, c in held.items()}
    out_sql = "id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept " + ("string" if as_text else "binary") + "".join(f", {a} {t.simpleString()}" for a, t in types.items())

    def cut(key: tuple, table: pa.Table, back: pa.Table) -> pa.Table:
        g, table, parts = key[0].as_py(), _sorted(table), []
        for _, _, ids, block in _blocks(table, length):
            parts.append({"gram": block.gram, "no": np.zeros(len(block.gram), np.int64)})
        state = states(parts, back, g)
        width = (w + 7) // 8
        masks = np.zeros((len(state), width), np.uint8)
        told = {r["b"]: np.frombuffer(r["masks"] or b"", np.uint8).reshape(-1, width) for r in back.select(["b", "masks"]).to_pylist()}
        if parts:
            gram = np.concatenate([p["gram"] for p in parts])
            for p in _dealt([{"gram": gram, "no": np.arange(len(gram))}], buckets, g):
                if p["b"] in told:
                    masks[p["no"][state[p["no"]] == 2]] = told[p["b"]]
        done, sizes, spans, bounds, kept = 0, [], [], [0], []
        for _, _, _, block in _blocks(table, length):
            n, m = len(block.data), len(block.gram)
            edge = np.zeros(n + 1, np.int32)
            all_ = np.flatnonzero(state[done : done + m] == 1)
            s, e = block.surround(all_)
            np.add.at(edge, s, 1)
            np.add.at(edge, e, -1)
            some = np.flatnonzero(state[done : done + m] == 2)
            which, o = np.nonzero(np.unpackbits(masks[done : done + m][some], axis=1, count=w))
            s = block.at[some][which] - (w - 1) + o
            np.add.at(edge, s, 1)
            np.add.at(edge, s + length, -1)
            done += m
            gone = np.cumsum(edge[:n]) > 0
            for a, b in zip(block.starts.tolist(), block.ends.tolist()):
                here = gone[a:b]
                flip = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
                sizes.append(b - a)
                spans.append(flip)
                bounds.append(bounds[-1] + len(flip) // 2)
                kept.append(block.data[a:b][~here].tobytes() if len(flip) else block.data[a:b].tobytes())
        flips = np.concatenate(spans).astype(np.int64) if spans else np.zeros(0, np.int64)
        columns = [
            table["id"],
            pa.array(sizes, pa.int64()),
            pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(flips[0::2]), pa.array(flips[1::2])], names=["start", "end"])),
            pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
            *[table[a] for a in held],
        ]
        return pa.table(dict(zip(["id", "n_bytes", "spans", "kept", *held], columns)))

    by_group = lambda: base.groupBy("g")  # noqa: E731  the same exchange in each visit, which Spark reuses
    shared = by_group().applyInArrow(first_grams, _SENT_SQL).groupBy("b").applyInArrow(shared_grams, _BACK_SQL)
    settled_ = by_group().cogroup(shared.groupBy("g")).applyInArrow(surrounds, _SENT_SQL).groupBy("b").applyInArrow(settled, _BACK_SQL)
    masked = by_group().cogroup(settled_.groupBy("g")).applyInArrow(sent_strings, _SENT_SQL).groupBy("b").applyInArrow(paired, _BACK_SQL)
    out = by_group().cogroup(masked.groupBy("g")).applyInArrow(cut, out_sql)
    carried = [F.struct(*[F.col(a).alias(c) for a, c in held.items()]).alias("carried")] if held else []
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept", *carried)


def query(docs: DataFrame) -> DataFrame:
    found = remove_repeats(docs, 50)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
