"""Weighted full-text search: two dictionaries, web-style queries, cover-density rank.

A document's vector holds each field twice, stemmed without stop words and as it is; the query is its English form or
its simple form.  Match semantics are exact for the simple dictionary; stems follow the published English Snowball
(Porter2) rules; the rank is the documented cover-density algorithm.  Neither was compared with a live database server.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Label weights.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
# English words that carry no meaning of their own.
STOP = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
    what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there
    when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
    """.split()
)
_V = "aeiouy"


_VC, _END_CVC = re.compile(r"[aeiouy][^aeiouy]"), re.compile(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_Y, _POSSESSIVE, _VOWEL, _VOWEL_ANY = re.compile(r"(^y|(?<=[aeiouy])y)"), re.compile(r"('s'|'s|')$"), re.compile(r"[aeiouy]"), re.compile(r"[aeiouy].")
_EED, _ING, _DOUBLE = re.compile(r"(eedly|eed)$"), re.compile(r"(ingly|edly|ing|ed)$"), re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(w: str) -> tuple[int, int]:
    m = _VC.search(w)
    r1 = m.end() if m else len(w)
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            r1 = len(head)
    m = _VC.search(w[r1:])
    return r1, r1 + m.end() if m else len(w)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(_END_CVC.search(w))


_FIXED = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
_TWO = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_THREE = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_TWO_ENDS, _THREE_ENDS, _FOUR_ENDS = (tuple(sorted(x, key=len, reverse=True)) for x in ([*_TWO, "ogi", "li"], _THREE, "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) <= 2 or word in _KEPT:
        return word
    if word in _FIXED:
        return _FIXED[word]
    w = word.lstrip("'")
    w = _Y.sub("Y", w)
    r1, r2 = _regions(w)
    w = _POSSESSIVE.sub("", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL_ANY.search(w[:-1][:-1] + "x" if len(w) > 2 else ""):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    m = _EED.search(w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = _ING.search(w)
        if m and _VOWEL.search(w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _DOUBLE.search(w):
                w = w[:-1]
            elif _short(w, r1):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for suffix in _TWO_ENDS if w.endswith(_TWO_ENDS) else ():
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif suffix == "li":
                    w = w[:-2] if w[at - 1 : at] in tuple("cdeghkmnrt") else w
                else:
                    w = w[:at] + _TWO[suffix]
            break
    for suffix in _THREE_ENDS if w.endswith(_THREE_ENDS) else ():
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= (r2 if suffix == "ative" else r1):
                w = w[:at] + _THREE[suffix]
            break
    for suffix in _FOUR_ENDS if w.endswith(_FOUR_ENDS) else ():
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1], len(w))):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


_WORD, _TAG = re.compile(r"[^\W_]+(?:'[^\W_]+)?"), re.compile(r"<[^>]+>")


def tokens(text: str | None) -> list[str]:
    if text and "<" in text:
        end = text.rfind(">") + 1  # what is open at the end is no tag, and is not looked through again and again
        text = _TAG.sub(" ", text[:end]) + text[end:]
    return _WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]  # several: a phrase
    negative: bool = False
    prefix: bool = False


def websearch(query: str) -> list[list[Term]]:
    """Alternatives (OR) of terms that must all hold; quotes make phrases, a leading minus negates.

    A single safe word is a prefix.
    """
    if re.fullmatch(r"[a-zA-Z0-9_]+", query.strip()):
        return [[Term((query.strip().lower(),), prefix=True)]]
    out: list[list[Term]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word == "OR" and not minus:
            out.append([])
            continue
        words = tuple(tokens(phrase or word))
        if words:
            out[-1].append(Term(words, bool(minus)))
    return [t for t in out if t]


def _rank(hits: list[tuple[int, int, float]], needs: list[frozenset[int]]) -> float:
    """Sum over minimal covers of (hits / sum of inverse weights) / (1 + noise); hits: position, term, weight.

    A cover is a span whose terms hold all of one of ``needs``.
    """
    total, begin = 0.0, 0
    hits = sorted(hits)

    def full(seen: set[int]) -> bool:
        return any(n <= seen for n in needs)

    while begin < len(hits):
        seen: set[int] = set()
        end = start = None
        for j in range(begin, len(hits)):
            seen.add(hits[j][1])
            if full(seen):
                end = j
                break
        if end is None:
            break
        seen = set()
        for j in range(end, begin - 1, -1):
            seen.add(hits[j][1])
            if full(seen):
                start = j
                break
        cover = hits[start : end + 1]
        noise = cover[-1][0] - cover[0][0] - (len(cover) - 1)
        if noise < 0:
            noise = (len(cover) - 1) // 2
        total += len(cover) / sum(1 / w for _, _, w in cover) / (1 + noise)
        begin = start + 1
    return total


def alternatives(query: str, dictionaries: tuple[str, ...]) -> list[list[Term]]:
    """The query in all dictionaries, as alternatives of terms over lexemes."""
    out = []
    for terms in websearch(query):
        if any(t.prefix for t in terms):
            return [terms]  # a prefix is sought as it is
        for dictionary in dictionaries:
            if dictionary == "english":
                kept = [Term(tuple(stem(w) for w in t.words if w not in STOP), t.negative) for t in terms]
                kept = [t for t in kept if t.words]
            else:
                kept = terms
            if any(not t.negative for t in kept) and kept not in out:
                out.append(kept)
    return out


def vector(fields: list[tuple[str, str | None]], dictionaries: tuple[str, ...]) -> dict[str, list[tuple[int, float]]]:
    """Lexemes with positions and weights; each field once for each dictionary, one after the other."""
    places: dict[str, list[tuple[int, float]]] = {}
    at = 0
    for label, text in fields:
        words = tokens(text)
        for dictionary in dictionaries:
            last = 0
            for i, w in enumerate(words, 1):
                if dictionary == "english":
                    if w in STOP:
                        continue
                    w = stem(w)
                places.setdefault(w, []).append((at + i, WEIGHTS[label]))
                last = i
            at += last
    return places


@dataclass
class Places:
    """vector() of a block of documents as arrays: a row for each place, in no order."""

    lexemes: pa.Array  # distinct ones, sorted
    doc: np.ndarray
    lexeme: np.ndarray
    position: np.ndarray
    field: np.ndarray

    def sorted_by(self, major: np.ndarray, minor: np.ndarray) -> np.ndarray:
        """Order by two of doc and lexeme, then by position."""
        size = [int(x.max(initial=0)).bit_length() for x in (major, minor, self.position)]
        if sum(size) > 62:
            return np.lexsort((self.position, minor, major))
        return np.argsort((major << size[1] | minor) << size[2] | self.position)


def places(columns: list[pa.Array], dictionaries: tuple[str, ...]) -> Places:
    """Places of the lexemes of a block of documents, whose fields are ``columns``."""
    words: list[str] = []
    sizes: list[int] = []
    for row in zip(*[c.to_pylist() for c in columns], strict=True):
        for text in row:
            found = tokens(text)
            words += found
            sizes.append(len(found))
    fields, size = len(columns), np.array(sizes, np.int64)
    coded = pa.array(words, pa.string()).dictionary_encode()
    code, known = coded.indices.to_numpy(), coded.dictionary
    stems = pa.array([None if w in STOP else stem(w) for w in known.to_pylist()] if "english" in dictionaries else [], pa.string())
    every = pa.concat_arrays([known, stems]).dictionary_encode()
    order = pc.sort_indices(every.dictionary).to_numpy()
    rank_of = np.empty(len(order), np.int64)
    rank_of[order] = np.arange(len(order))
    at = every.indices.fill_null(-1).to_numpy()
    numbers = np.where(at < 0, -1, rank_of[at]) if len(order) else np.zeros(0, np.int64)
    cell = np.repeat(np.arange(len(size)), size)  # field of a document
    nth = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size) + 1
    some, ends = [], np.zeros((len(size), len(dictionaries)), np.int64)
    for d, dictionary in enumerate(dictionaries):
        number = (numbers[len(known) :] if dictionary == "english" else numbers[: len(known)])[code]
        kept = np.flatnonzero(number >= 0)
        np.maximum.at(ends[:, d], cell[kept], nth[kept])
        some.append((number[kept], cell[kept], nth[kept]))
    ends = ends.reshape(-1, fields * len(dictionaries))  # each field once for each dictionary, one after the other
    begins = (np.cumsum(ends, axis=1) - ends).reshape(-1, len(dictionaries))
    number, cell, nth = (np.concatenate([x[i] for x in some]) for i in range(3))
    which = np.repeat(np.arange(len(some)), [len(x[0]) for x in some])
    return Places(every.dictionary.take(pa.array(order)), cell // fields, number, begins[cell, which] + nth, cell % fields)


def text_blocks(columns: list[pa.Array], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text in all columns, one row at least."""
    n = len(columns[0])
    upto = np.cumsum(sum(pc.fill_null(pc.cast(pc.binary_length(c), pa.int64()), 0).to_numpy() for c in columns)) if n else np.zeros(0)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi
        lo = hi


def rank(fields: list[tuple[str, str | None]], query: str, dictionaries: tuple[str, ...] = ("english", "simple"), *, damped: bool = True) -> float | None:
    """Rank of a document, None if it does not match.  fields: label and text, in order."""
    return rank_places(vector(fields, dictionaries), query, dictionaries, damped=damped)


def rank_places(places: dict[str, list[tuple[int, float]]], query: str, dictionaries: tuple[str, ...] = ("english", "simple"), *, damped: bool = True) -> float | None:
    """Rank of a document by the places of its lexemes; those that the query does not ask for may be left out."""
    choices = alternatives(query, dictionaries)

    @lru_cache(maxsize=None)
    def found(t: Term) -> tuple[tuple[int, float], ...]:
        if t.prefix:
            return tuple(h for w, hs in places.items() if w.startswith(t.words[0]) for h in hs)
        rest = [{q for q, _ in places.get(x, [])} for x in t.words[1:]]
        return tuple((p, w) for p, w in places.get(t.words[0], []) if all(p + i in x for i, x in enumerate(rest, 1)))

    needs, number = [], {}
    for terms in choices:
        plus = [Term(t.words, prefix=t.prefix) for t in terms if not t.negative]
        if all(found(t) for t in plus) and not any(found(Term(t.words)) for t in terms if t.negative):
            needs.append(frozenset(number.setdefault(t, len(number)) for t in plus))
    if not needs:
        return None
    r = _rank([(p, k, w) for t, k in number.items() for p, w in found(t)], needs)
    return r / (r + 1) if damped else r


def _head(lexeme: str, *, exact: bool) -> str:
    """What every word of a lexeme contains: stems change up to two letters at their end, short ones more ('dying', 'die')."""
    return lexeme if exact else lexeme[:-2] if len(lexeme) > 3 else ""


def may_match(query: str, text, dictionaries: tuple[str, ...] = ("english", "simple")):
    """A cheap condition on lower-case text (a column) that every match fulfils: heads of the words that must be there."""
    may = F.lit(False)
    for terms in alternatives(query, dictionaries):
        ok = F.lit(True)
        for t in terms:
            if not t.negative:
                for w in t.words:
                    if (head := _head(w, exact="english" not in dictionaries)):
                        ok = ok & text.contains(head)
        may = may | ok
    return may


def search(items: DataFrame, query: str, fields: dict[str, str], *, key: str = "id", limit: int | None = 50, **options) -> DataFrame:
    """Matching rows with their rank, best first; ``fields`` maps columns to labels.

    A cheap filter on the heads of the query's words runs in the scan, so only rows that may match reach the ranking.
    """

    @F.pandas_udf("double")
    def ranked(*columns: pd.Series) -> pd.Series:
        labels = list(fields.values())
        return pd.Series([rank(list(zip(labels, row, strict=True)), query, **options) for row in zip(*columns, strict=True)], dtype="float64")

    whole = F.lower(F.concat_ws(" ", *fields))
    out = items.where(may_match(query, whole, options.get("dictionaries", ("english", "simple")))).select(key, F.round(ranked(*fields), 9).alias("score")).where("score is not null")
    out = out.orderBy(F.desc("score"), key)
    return out if limit is None else out.limit(limit)
