"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts.  Equal neighbours, and equal neighbouring sequences, fold into repeated groups;
aligning two streams turns what only one has into optional groups and texts that differ into slots.  Each partition
aligns its pages host by host, and the expressions of a host are aligned with each other in rounds of at most FAN, so
that a host of any size is covered by all of its pages.  A slot knows in how many pages it was, whether its text is the
same in all, and how much of it is links; with the tags around it that decides whether it is main text.

Null html is empty and gives the empty text; a null or odd url belongs to the host ''.  Rows that repeat give rows that
repeat.  Broken markup (missing, stray and cut tags) is read as browsers do; elements nested deeper than DEEP lose
their names and keep their texts.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Expressions aligned in one task of a round; distinct page structures that a task holds before it sends them on.
FAN, STRUCTURES = 32, 2000
#: Expressions of all hosts together that are broadcast; larger ones meet the pages in a salted join.
BROADCAST_BYTES, SALTS = 32 << 20, 16
DEEP = 60
#: Longest repeated sequence of siblings that is sought; longer alignments than this many steps go by next matches.
PERIOD, STEPS = 6, 250_000
#: Distinct pages that must share a text before it counts as part of the template, and fingerprints kept to tell.
SAME, KEPT = 5, 8
#: A slot whose text is links by this share is a menu, where no element marks the main text.
LINKS = 0.5

# ---- fixed values: elements and the words of class names, ids and roles
BREAKING = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("applet audio button canvas datalist embed head iframe math meter noembed noframes noscript object optgroup option output progress script select style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("aside dialog dir fieldset footer menu nav search".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
BAD_WORDS = frozenset(
    "ad ads adbox adsense adslot advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline-social comment commentlist comments consent cookie cookies dialog discussion disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended recommendations related "
    "replies respond reviews search share sharing sidebar signin signup skyscraper social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
MAIN_NAMES = frozenset("article article-body article-content article-text blog-post content content-body entry entry-content hentry main main-content page-content post post-body post-content post-text story story-body".split())
BAD_MAINS = frozenset("ad ads advert comment comments promo promoted recommended related reply review sidebar sponsored teaser widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# ----

#: Items whose neighbours of one key always fold.
ALIKE = frozenset("# p li dt dd tr td th h1 h2 h3 h4 h5 h6 blockquote pre".split())

#: Elements that an opening one ends, and where the search for them stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
}
TABLES = frozenset("table caption td th tr tbody thead tfoot".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</[^a-zA-Z][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _names(value: str) -> list[str]:
    return [re.sub(r"\d+", "#", n) for n in entities.unescape(value).split()]


@lru_cache(maxsize=8192)
def _kind(tag: str, attributes: str) -> tuple[bool, int, str]:
    """Whether an element is no main text by its name; its rank as a container of main text (0: none); its key."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = _names(found.get("class", "")) + _names(found.get("id", ""))
    role = found.get("role", "").lower()
    bad = tag in BAD_TAGS or role in BAD_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    bad = bad or "display:none" in found.get("style", "").replace(" ", "").lower()
    main = tag in ("article", "main") or role in ("article", "main")
    if tag not in ("html", "body"):
        for name in names:
            words = [w.lower() for w in WORD.findall(name)]
            if not words or words[0] in ("has", "no", "not", "with", "without", "is"):
                continue
            if main:  # only what the container is, not what stands beside it
                bad = bad or words[0] in BAD_MAINS
            else:
                bad = bad or not BAD_WORDS.isdisjoint(words) or words[-1] == "header" and words[0] in ("header", "page", "site", "top")
    rank = 0
    if not bad:
        if tag == "article" or role == "article" or "articlebody" in found.get("itemprop", "").lower():
            rank = 3
        elif tag == "main" or role == "main":
            rank = 2
        elif any(n.lower() in MAIN_NAMES for n in names):
            rank = 1
    return bad, rank, tag + "".join(f".{n}" for n in sorted(set(names)))


class Leaf:
    """A run of text between two breaks: pieces as they stand in the page, and the elements around them."""

    __slots__ = ("pieces", "link", "rank", "heading", "slot")

    def __init__(self, pieces: list[str], link: int, rank: int, heading: bool):
        self.pieces, self.link, self.rank, self.heading, self.slot = pieces, link, rank, heading, -1

    def text(self) -> str:
        return " ".join("".join(p if p == " " else entities.unescape(p) for p in self.pieces).split())


def _item(key: str, kids: list, leaves: list | None = None) -> list:
    """[key, optional, repeated, items inside, pages, characters, of them links, hash of the text or None, leaves]"""
    return [key, False, False, kids, 1, 0, 0, None, leaves]


KEY, OPTIONAL, REPEATED, KIDS, PAGES, CHARS, LINK, HASH, LEAVES = range(9)


class Page:
    """Leaves and the folded expression of one page."""

    def __init__(self, source: str):
        self.leaves: list[Leaf] = []
        self.items = self._read(source)
        self.slots: list[list] = []
        self.structure = self._number(self.items)

    def _number(self, items: list) -> str:
        out = []
        for it in items:
            if it[KEY] == "#":
                for leaf in it[LEAVES]:
                    leaf.slot = len(self.slots)
                self.slots.append(it)
            inner = self._number(it[KIDS]) if it[KIDS] else ""
            out.append(f"{it[KEY]}{'?' * it[OPTIONAL]}{'+' * it[REPEATED]}({inner})")
        return " ".join(out)

    def _read(self, source: str) -> list:
        # of each open element: name, bad, rank, key, items, its first leaf, whether it holds a container of main text or a heading
        stack: list[list] = [["", False, 0, "", [], 0, False]]
        pieces: list[str] = []
        link = chars = 0
        hidden: list[str] = []  # open inline elements that are no main text

        def flush() -> None:
            nonlocal chars
            if pieces:
                top = stack[-1]
                if not top[1] and any(not p.isspace() for p in pieces):
                    leaf = Leaf(pieces.copy(), chars, top[2], any(s[0] in HEADINGS for s in stack[-2:]))
                    self.leaves.append(leaf)
                    top[4].append(_item("#", [], [leaf]))
                pieces.clear()
            chars = 0

        def pop() -> None:
            flush()
            name, bad, _, key, items, first, holds = stack.pop()
            above = stack[-1]
            if not bad and not holds and (name == "form" or name == "header"):
                bad = True
                del self.leaves[first:]
            if holds and not bad:
                above[6] = True
            if not above[1] and name:
                above[4].append(_item(f"{key}!" if bad else key, [] if bad else fold(items)))

        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at and not stack[-1][1] and not hidden:
                text = source[at:stop]
                pieces.append(text)
                if link:
                    chars += len(text)
            if not m:
                break
            at = max(m.end(), stop + 1)
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:  # a closing tag
                if tag == "a":
                    link = max(0, link - 1)
                elif hidden:
                    if tag in hidden:
                        del hidden[len(hidden) - 1 - hidden[::-1].index(tag) :]
                elif tag in BREAKING or tag in UNSEEN:
                    flush()
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            while len(stack) > k:
                                pop()
                            link = 0
                            break
                        if tag == "li" and stack[k][0] in ("ul", "ol", "menu") or stack[k][0] in ("td", "th", "table", "caption") and tag not in TABLES and tag not in ("body", "html", "article", "main"):
                            break
                continue
            closed = m[3].endswith("/") and tag not in BREAKING
            if tag in RAW or tag in UNSEEN:
                if tag in ("head", "noscript", "svg", "math", "object", "video", "audio", "canvas", "select", "datalist", "template", "button", "applet", "script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp") and not closed:
                    over = _closing(tag).search(source, at)
                    if tag == "head" and not over:
                        continue
                    body = _BODY.search(source, at) if tag == "head" else None
                    at = min(over.end() if over else end, body.start() if body else end)
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag not in BREAKING:
                if tag == "a":
                    link = 0 if closed else 1
                elif not closed and tag not in VOID and m[3] and not hidden and _kind(tag, m[3])[0]:
                    hidden.append(tag)
                elif hidden and tag == hidden[-1] and tag not in VOID:
                    hidden.append(tag)
                continue
            hidden.clear()
            flush()
            link = 0
            if tag == "hr":
                continue
            if tag in ("html", "body"):
                continue
            while stack[-1][0] == "p" or tag in HEADINGS and stack[-1][0] in HEADINGS:
                pop()
            if tag in ENDS:
                ends, until = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in until:
                        break
                    if stack[k][0] in ends:
                        while len(stack) > k:
                            pop()
                        if tag != "tr":
                            break
            if len(stack) >= DEEP:
                continue
            bad, rank, key = _kind(tag, m[3])
            above = stack[-1]
            if tag == "header" and not bad:
                bad = above[2] < 2  # the page's; an article's own stays if it holds a heading
            if not above[1] and not bad and (tag in HEADINGS or rank >= 2):
                above[6] = True
            stack.append([tag, bad or above[1], max(rank, above[2]), key, [], len(self.leaves), tag in HEADINGS or rank >= 2])
        flush()
        while len(stack) > 1:
            pop()
        return fold(stack[0][4])

    def measure(self) -> list[list]:
        """Characters, links and hash of each slot; leaves that no slot holds were in a part that is no main text."""
        out = []
        for it in self.slots:
            texts = [leaf.text() for leaf in it[LEAVES]]
            one = zlib.crc32(texts[0].encode("utf-8", "surrogatepass")) if len(texts) == 1 and not it[REPEATED] else None
            out.append([1, sum(map(len, texts)), sum(leaf.link for leaf in it[LEAVES]), one])
        return out


_BODY = re.compile(r"<body\b", re.I)


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>?", re.I)


# ---- the algebra of expressions


def combine(x: list, y: list) -> list:
    """One item for two aligned ones."""
    leaves = None if x[LEAVES] is None and y[LEAVES] is None else (x[LEAVES] or []) + (y[LEAVES] or [])
    same = x[HASH] if x[HASH] == y[HASH] else None
    return [x[KEY], x[OPTIONAL] or y[OPTIONAL], x[REPEATED] or y[REPEATED], merge(x[KIDS], y[KIDS]), x[PAGES] + y[PAGES], x[CHARS] + y[CHARS], x[LINK] + y[LINK], same, leaves]


def _again(x: list, y: list) -> list:
    """One repeated item for two neighbours of one key."""
    out = combine(x, y)
    out[REPEATED], out[PAGES], out[HASH] = True, max(x[PAGES], y[PAGES]), None
    out[OPTIONAL] = x[OPTIONAL] and y[OPTIONAL]
    return out


def _group(items: list) -> list:
    out = _item(f"({' '.join(i[KEY] for i in items)})", items)
    out[PAGES] = max(i[PAGES] for i in items)
    return out


def fold(items: list) -> list:
    """Neighbours of one key become one repeated item, neighbouring equal sequences one repeated group.

    Boxes (all but texts, paragraphs, entries and cells) must also hold the same sequence of elements.
    """
    out: list = []
    for it in items:
        if out and out[-1][KEY] == it[KEY] and (it[KEY].partition(".")[0] in ALIKE or [k[KEY] for k in it[KIDS]] == [k[KEY] for k in out[-1][KIDS]]):
            out[-1] = _again(out[-1], it)
        else:
            out.append(it)
    if len(out) < 4:
        return out
    keys, at, folded = [i[KEY] for i in out], 0, []
    while at < len(out):
        for k in range(2, min(PERIOD, (len(out) - at) // 2) + 1):
            unit, n = keys[at : at + k], 1
            while keys[at + n * k : at + (n + 1) * k] == unit:
                n += 1
            if n > 1:
                whole = _group(out[at : at + k])
                for r in range(1, n):
                    whole = _again(whole, _group(out[at + r * k : at + (r + 1) * k]))
                folded.append(whole)
                at += n * k
                break
        else:
            folded.append(out[at])
            at += 1
    return folded


def _conform(items: list, other: list) -> list:
    """Sequences that are a repeated group in the other expression become a group of one here."""
    wanted = [[k[KEY] for k in o[KIDS]] for o in other if o[KEY][0] == "("]
    if not wanted:
        return items
    keys = [i[KEY] for i in items]
    for unit in wanted:
        at = 0
        while at + len(unit) <= len(keys):
            if keys[at : at + len(unit)] == unit:
                items = [*items[:at], _group(items[at : at + len(unit)]), *items[at + len(unit) :]]
                keys = [i[KEY] for i in items]
            at += 1
    return items


def align(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Positions of a longest common subsequence of two lists of keys, with what only one has, in order."""
    lo, hi = 0, 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    pairs: list[tuple[int | None, int | None]] = [(i, i) for i in range(lo)]
    i = j = 0
    if len(x) * len(y) <= STEPS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(len(x) - 1, -1, -1):
            row, below = best[p], best[p + 1]
            for q in range(len(y) - 1, -1, -1):
                row[q] = below[q + 1] + 1 if x[p] == y[q] else max(below[q], row[q + 1])
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                pairs.append((lo + i, None))
                i += 1
            else:
                pairs.append((None, lo + j))
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for q in range(len(y) - 1, -1, -1):
            places.setdefault(y[q], []).append(q)
        for p, key in enumerate(x):
            later = places.get(key, [])
            while later and later[-1] < j:
                later.pop()
            if later:
                pairs += [(None, lo + q) for q in range(j, later[-1])]
                j = later.pop() + 1
                pairs.append((lo + p, lo + j - 1))
            else:
                pairs.append((lo + p, None))
        i = len(x)
    pairs += [(lo + p, None) for p in range(i, len(x))] + [(None, lo + q) for q in range(j, len(y))]
    return pairs + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def merge(a: list, b: list) -> list:
    """The expression of two: aligned items become one, the others optional."""
    if not a and not b:
        return []
    if len(a) == len(b) and all(x[KEY] == y[KEY] for x, y in zip(a, b)):
        return [combine(x, y) for x, y in zip(a, b)]
    a, b = _conform(a, b), _conform(b, a)
    out = []
    for i, j in align([x[KEY] for x in a], [y[KEY] for y in b]):
        if i is not None and j is not None:
            out.append(combine(a[i], b[j]))
        else:
            one = list(a[i] if i is not None else b[j])
            one[OPTIONAL] = True
            out.append(one)
    return fold(out)


def join(a: dict, b: dict) -> dict:
    """The wrapper of the pages of two wrappers of one host."""
    return {"pages": a["pages"] + b["pages"], "prints": sorted({*a["prints"], *b["prints"]})[:KEPT], "items": merge(a["items"], b["items"])}


def _slots(items: list, inside: str = "") -> Iterator[tuple[list, str]]:
    for it in items:
        path = f"{inside}/{it[KEY]}{'*' * it[REPEATED]}"
        if it[KEY] == "#":
            yield it, path
        yield from _slots(it[KIDS], path)


def _counterparts(items: list, wrapper: list) -> Iterator[tuple[list, list | None]]:
    """Slots of an expression with those of the wrapper that they align with."""
    items, wrapper = _conform(items, wrapper), _conform(wrapper, items)
    for i, j in align([x[KEY] for x in items], [y[KEY] for y in wrapper]):
        if i is not None:
            if items[i][KEY] == "#":
                yield items[i], wrapper[j] if j is not None else None
            yield from _counterparts(items[i][KIDS], wrapper[j][KIDS] if j is not None else [])


# ---- inference and extraction on Spark


def host(url: str | Column = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _bare(items: list) -> list:
    return [[*it[:KIDS], _bare(it[KIDS]), *it[PAGES:LEAVES], None] for it in items]


def _fill(items: list, sums: Iterator[list], pages: int) -> None:
    for it in items:
        it[PAGES] = pages
        if it[KEY] == "#":
            it[PAGES : HASH + 1] = next(sums)
        _fill(it[KIDS], sums, pages)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of a partition's pages; pages of one structure are added up before they are aligned."""
    known: dict[tuple[str, str], list] = {}
    part = TaskContext.get().partitionId()

    def flush() -> Iterator[pa.RecordBatch]:
        found: dict[str, dict] = {}
        for (name, _), (pages, items, sums, prints) in sorted(known.items(), key=lambda e: (e[0][0], -e[1][0], e[0][1])):
            _fill(items, iter(sums), pages)
            new = {"pages": pages, "prints": prints, "items": items}
            found[name] = join(found[name], new) if name in found else new
        known.clear()
        yield pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "part": pa.array([part] * len(found), pa.int32()), "wrapper": pa.array([json.dumps(w).encode() for w in found.values()], pa.binary())})

    for b in batches:
        for name, source in zip(b["host"].to_pylist(), b["html"].to_pylist()):
            page = Page(source)
            sums = page.measure()
            rank = max((leaf.rank for leaf in page.leaves), default=0)
            seal = zlib.crc32("\n".join(leaf.text() for leaf in page.leaves if leaf.rank == rank).encode("utf-8", "surrogatepass"))
            old = known.get((name, page.structure))
            if old is None:
                known[name, page.structure] = [1, _bare(page.items), sums, [seal]]
            else:
                old[0] += 1
                for mine, new in zip(old[2], sums):
                    mine[0] += 1
                    mine[1] += new[1]
                    mine[2] += new[2]
                    mine[3] = mine[3] if mine[3] == new[3] else None
                if len(old[3]) < KEPT and seal not in old[3]:
                    old[3] = sorted([*old[3], seal])
        if len(known) > STRUCTURES:
            yield from flush()
    yield from flush()


def _round(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for raw in rows.sort_values(["part", "wrapper"])["wrapper"]:
        one = json.loads(raw)
        whole = one if whole is None else join(whole, one)
    return pd.DataFrame({"host": [key[0]], "part": [int(key[1])], "wrapper": [json.dumps(whole).encode()]})


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper: one expression for each host, from all of its pages (columns host, html)."""
    schema = "host string, part int, wrapper binary"
    found = cut_lineage(pages.select("host", "html").mapInArrow(_infer, schema))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        found = found.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("host", "part").applyInPandas(_round, schema)
        parts = -(-parts // FAN)
        if parts == 1:
            return cut_lineage(found.select("host", "wrapper"))


def labels(page: Page, wrapper: dict | None) -> list[bool]:
    """Which slots of a page are main text, by the elements around them and what the wrapper knows of them.

    1. Elements that are no main text by name are out already.  2. If a container marks the main text (an article;
    else a main element; else one of a usual name), other slots are out; only a top heading may stand outside.  3. A
    text that is the same in all pages of the host while their contents differ belongs to the template, if it is no heading
    of a container.  4. Where no
    container marks the main text, slots that are mostly links are menus.
    """
    known = {id(s): w for s, w in _counterparts(page.items, wrapper["items"])} if wrapper else {}
    # groups that _counterparts made share their slots with the page's items
    rank = max((leaf.rank for leaf in page.leaves), default=0)
    differ = wrapper is not None and wrapper["pages"] >= SAME and len(wrapper["prints"]) >= SAME
    headed = any(leaf.heading and leaf.rank == rank for leaf in page.leaves)
    out = []
    for slot in page.slots:
        leaf, w = slot[LEAVES][0], known.get(id(slot))
        keep = leaf.rank == rank or rank == 3 and leaf.heading and not headed and leaf.rank > 0
        if w is not None:
            template = differ and not (rank and leaf.heading) and w[HASH] is not None and not w[OPTIONAL] and not w[REPEATED] and w[PAGES] == wrapper["pages"]
            keep = keep and not template and not (rank == 0 and w[CHARS] and w[LINK] >= LINKS * w[CHARS])
        out.append(keep)
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[str, dict] = {}
    decided: dict[tuple[str, str], list[bool]] = {}
    for b in batches:
        texts = []
        for name, source, raw in zip(b["host"].to_pylist(), b["html"].to_pylist(), b["wrapper"]):
            if name not in wrappers:
                wrappers[name] = json.loads(raw.as_py()) if raw.is_valid else None
            page = Page(source)
            keep = decided.get((name, page.structure))
            if keep is None:
                if len(decided) > STRUCTURES:
                    decided.clear()
                keep = decided[name, page.structure] = labels(page, wrappers[name])
            texts.append("\n\n".join(filter(None, (leaf.text() for leaf in page.leaves if leaf.slot >= 0 and keep[leaf.slot]))))
        if len(wrappers) > STRUCTURES:
            wrappers.clear()
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    pages = pages.select("page_id", "url", host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    wrappers = infer(pages)
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = pages.join(F.broadcast(wrappers), "host", "left")
    else:
        salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    out = met.select("page_id", "url", "host", "html", "wrapper").mapInArrow(_extract, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def query(pages: DataFrame) -> DataFrame:
    return main_text(pages)
