"""Functions on HTML: S5/X33 cleaner, X27 metadata, X28 thumbnail, X29/X30 limited extraction, X34 readability,
X37 blocks, X9 chunks, X35 overlap.  A small tree over the standard parser serves all of them.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd

from .udfs import arrow_udf

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Phrases of pages that hold back their text.
MARKERS = (
    "paywall", "subscriber-only", "subscriber only", "subscription required", "subscribe to continue", "sign in to continue", "log in to continue", "already a subscriber", "continue reading",
    "unlock this article", "premium content", "metered", "access to this article", "access options", "rent or buy this article", "purchase this article", "buy this article", "is not available",
)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                stack.extend(reversed(node.children))
        return "".join(out)

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def html(self) -> str:
        out, stack = [], [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                out.append(at)
                continue
            if at.tag != "#root":
                out.append(f"<{at.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in at.attrs.items()) + ">")
                if at.tag in VOID:
                    continue
                stack.append(f"</{at.tag}>")
            stack.extend(c if isinstance(c, Node) else escape(c, quote=False) for c in reversed(at.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at.parent and at.tag != tag:
            at = at.parent
        if at.parent:
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of an unknown kind are read as text."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            self.handle_data(self.rawdata[i : i + 3])
            return i + 3


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def plain(html: str) -> str:
    """Tags as spaces, white space single."""
    return flat(re.sub(r"<[^>]+>", " ", html))


def metas(root: Node) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for m in root.all("meta"):
        key = (m.attrs.get("property") or m.attrs.get("name") or m.attrs.get("itemprop") or "").lower()
        if key and m.attrs.get("content", "").strip():
            out.setdefault(key, []).append(m.attrs["content"].strip())
    return out


def json_ld(root: Node) -> list[dict]:
    out = []
    for s in root.all("script"):
        if s.attrs.get("type") == "application/ld+json":
            try:
                got = json.loads("".join(c for c in s.children if isinstance(c, str)))
            except (ValueError, RecursionError):
                continue
            todo = deque(got if isinstance(got, list) else [got])
            while todo:
                x = todo.popleft()
                if isinstance(x, dict):
                    out.append(x)
                    graph = x.get("@graph")
                    todo.extend(graph if isinstance(graph, list) else [])
    return out


def _first(m: dict[str, list[str]], *keys: str) -> str | None:
    return next((m[k][0] for k in keys if k in m), None)


# Hosts of publishers, meta tags of papers, words in the names of pictures that are no thumbnails.
PUBLISHERS = (
    "arxiv.org", "nature.com", "sciencedirect.com", "springer.com", "wiley.com", "tandfonline.com", "ieeexplore.ieee.org", "dl.acm.org", "academic.oup.com", "journals.sagepub.com",
    "pnas.org", "sciencemag.org", "cell.com", "jstor.org", "plos.org", "ncbi.nlm.nih.gov/pmc", "semanticscholar.org", "biorxiv.org", "medrxiv.org", "ssrn.com",
)
PAPER_TAGS = ("citation_title", "citation_author", "citation_journal_title", "prism.publicationname")
PAPER_KINDS = {"dc.type": ("research-article", "article")}
NO_THUMBNAIL = ("sprite", "favicon", "icon", "avatar")
#: Sources of each field in the order of trust.
DATES = ("article:published_time", "datepublished")
PICTURES = ("og:image:secure_url", "og:image", "twitter:image:src", "twitter:image", "image")


def _people(found) -> list[str]:
    """Names in a JSON-LD author: a name, an object with one, or a list of those."""
    some = found if isinstance(found, list) else [found] if found else []
    return [str(a.get("name") or "") if isinstance(a, dict) else str(a) for a in some]


def _authors(m: dict[str, list[str]], ld: list[dict]) -> str | None:
    """The first source that names somebody, links left out, names once."""
    named = lambda *keys: [v for k in keys for v in m.get(k, [])]
    by_data = lambda: next((p for x in ld if any(p := _people(x.get("author") or x.get("creator")))), [])
    for source in (lambda: named("article:author", "author"), by_data, lambda: named("dc.creator") or named("dc.contributor"), lambda: named("citation_author")):
        names = list(dict.fromkeys(n.strip() for n in source() if n.strip() and not n.strip().startswith(("http://", "https://", "/"))))
        if names:
            return ", ".join(names)
    return None


def _picture(candidate, url: str) -> str | None:
    """An address that may serve as a thumbnail, made absolute."""
    value = candidate.strip() if isinstance(candidate, str) else ""
    low = value.lower()
    if not value or low.startswith("data:") or low.endswith(".svg") or any(w in low for w in NO_THUMBNAIL):
        return None
    try:
        return urljoin(url, value)
    except ValueError:
        return None


def _thumbnail(root: Node, m: dict[str, list[str]], ld: list[dict], url: str) -> str | None:
    """Meta tags, JSON-LD, link, then the first usable picture of the text."""

    def listed() -> Iterator:
        for key in PICTURES:
            yield from m.get(key, [])[:1]
        for x in ld:
            for got in x["image"] if isinstance(x.get("image"), list) else [x.get("image")]:
                yield (got.get("url") or got.get("contentUrl")) if isinstance(got, dict) else got
        for n in root.all("link"):
            if "image_src" in n.attrs.get("rel", "").split():
                yield n.attrs.get("href")
        body = next(iter(root.all("article") or root.all("main") or root.all("body")), root)
        for n in body.all("img"):
            parts = [p.strip() for p in (n.attrs.get("srcset") or n.attrs.get("data-srcset") or "").split(",") if p.strip()]
            yield n.attrs.get("src") or n.attrs.get("data-src") or (parts[-1].split(" ")[0] if parts else None)

    return next((p for c in listed() if (p := _picture(c, url))), None)


def metadata(html: str, url: str = "") -> dict:
    """Title, description, authors, date, academic fields and thumbnail, each from its first good source."""
    from .urls import host_of, title_of

    root = parse(html)
    m, ld = metas(root), json_ld(root)
    title = _first(m, "og:title", "twitter:title") or next((flat(t.text()) for t in root.all("title") if flat(t.text())), None) or (title_of(url) if url else None)
    host = host_of(url)
    by_host = any(d in host for d in PUBLISHERS) or ".edu" in host
    by_tags = any(k in m for k in PAPER_TAGS) or any(v.lower() in kinds for k, kinds in PAPER_KINDS.items() for v in m.get(k, []))
    paper = by_tags and not by_host  # the numbers of a paper are read only where tags tell it
    return {
        "title": title, "description": _first(m, "og:description", "twitter:description", "description"), "author": _authors(m, ld), "published": _first(m, *DATES),
        "is_academic": by_host or by_tags, "doi": _first(m, "citation_doi", "prism.doi") if paper else None, "journal": _first(m, "citation_journal_title") if paper else None,
        "thumbnail": _thumbnail(root, m, ld, url),
    }


METADATA = "title string, description string, author string, published string, is_academic boolean, doi string, journal string, thumbnail string"


@arrow_udf(METADATA)
def page_metadata(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metadata(h or "", u or "") for h, u in zip(html, url, strict=True)], columns=[c.split()[0] for c in METADATA.split(", ")])


def features(source: str, extracted: str) -> dict:
    """What the limited-extraction rules look at."""
    root, got = parse(source), parse(extracted)
    body = next(iter(root.all("article") or root.all("main") or root.all("body")), root)
    long_ = lambda n: sum(len(flat(p.text())) >= 45 for p in n.all("p"))
    hay = (source[:15000] + " " + " ".join(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}" for n in list(root.walk())[:500])).lower()
    m = metas(root)
    free = [x.get("isAccessibleForFree") for x in json_ld(root)]
    paid = any(f is False or str(f).lower() in ("false", "no", "0") for f in free if f is not None) or any("content_tier" in k and any(w in v.lower() for w in ("paid", "premium", "subscriber", "metered")) for k, vs in m.items() for v in vs)
    s, e = len(flat(body.text())), len(flat(got.text()))
    return {
        "s": s, "e": e, "p": long_(got), "q": long_(body), "ratio": e / s if s else 0.0, "media": bool(got.all("figure", "img", "picture")), "markers": any(w in hay for w in MARKERS), "paid": paid,
        "words": len(flat(got.text()).split()), "teaser": _teaser(_first(m, "og:description", "twitter:description", "description"), flat(got.text())), "desc_len": len(_first(m, "og:description", "twitter:description", "description") or ""),
    }


def _teaser(desc: str | None, body: str) -> bool:
    d = flat(desc or "").lower()
    return len(d[:200]) >= 80 and d[:200] in body.lower()


FEATURES = "s int, e int, p int, q int, ratio double, media boolean, markers boolean, paid boolean, words int, teaser boolean, desc_len int"


@arrow_udf(FEATURES)
def limit_features(source: pd.Series, extracted: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([features(a or "", b or "") for a, b in zip(source, extracted, strict=True)], columns=[c.split()[0] for c in FEATURES.split(", ")])


#: X29 over those features; first match wins.
LIMITED = """case when f.markers and f.e < 2200 and f.p <= 5 then 'restricted' when f.paid and f.e < 2200 and f.p <= 5 then 'restricted' when f.paid then null
  when f.media and f.p = 0 and f.e < 900 and f.s >= 1500 then 'limited' when f.teaser and f.e <= greatest(1200, int(3.2 * f.desc_len)) and f.p <= 4 then 'limited'
  when (f.q >= 6 or f.s >= 5000) and f.p <= 4 and f.ratio < 0.4 and f.e < 1800 then 'limited' when f.s >= 4000 and f.e < 900 and f.ratio < 0.18 and f.p <= 3 then 'limited' end"""


def client_features(html: str, description: str | None) -> dict:
    """What the rules for pages that the client extracted look at."""
    root = parse(html)
    texts = lambda n: " ".join(x for x in (flat(t) for t in _strings(n)) if x)
    body = texts(root)
    low, desc = flat(body.lower()), flat((description or "").lower())
    return {
        "words": len(body.split()), "p": sum(len(texts(p)) >= 45 for p in root.all("p")), "markers": any(w in low for w in MARKERS), "ellipsis": "..." in body or "\u2026" in body,
        "teaser": len(desc[:180]) >= 80 and desc[:180] in low, "desc_words": len(desc.split()),
    }


def _strings(node: Node) -> list[str]:
    """Pieces of text in order."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            stack.extend(reversed(at.children))
    return out


CLIENT_FEATURES = "words int, p int, markers boolean, ellipsis boolean, teaser boolean, desc_words int"


@arrow_udf(CLIENT_FEATURES)
def client_limit_features(html: pd.Series, description: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([client_features(a or "", b) for a, b in zip(html, description, strict=True)], columns=[c.split()[0] for c in CLIENT_FEATURES.split(", ")])


#: X30 over those features; first match wins.
LIMITED_CLIENT = """case when f.markers and f.words <= 450 and f.p <= 10 then 'restricted' when f.teaser and f.words <= greatest(260, int(3.2D * f.desc_words)) and f.p <= 4 then 'limited'
  when f.ellipsis and f.words <= 500 and f.p <= 6 then 'limited' when f.words <= 150 and f.p <= 2 then 'limited' end"""


def cleaned(html: str, title: str | None, description: str | None, thumbnail: str | None) -> str:
    """Without the heading, teaser and picture that are shown elsewhere."""
    root = parse(html)
    picture = (thumbnail or "").split("?")[0].rsplit("/", 1)[-1]

    def goes(n: Node) -> bool:
        shown = {"h1": title, "p": description}.get(n.tag)
        if shown and flat(n.text()).lower() == shown.strip().lower():
            return True
        image = [n] if n.tag == "img" else n.all("img") if n.tag == "figure" else []
        return bool(picture) and any((i.attrs.get("src") or i.attrs.get("data-src") or "").split("?")[0].rsplit("/", 1)[-1] == picture for i in image)

    for n in list(root.walk()):
        n.children = [c for c in n.children if not (isinstance(c, Node) and goes(c))]
    return root.html()


@arrow_udf("string")
def clean_html(html: pd.Series, title: pd.Series, description: pd.Series, thumbnail: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else cleaned(h, t, d, i) for h, t, d, i in zip(html, title, description, thumbnail, strict=True)])


SECTION, OVERLAP, LEAST = 466, 40, 20


def chunks(html: str) -> list[str]:
    """Sections at headings; long ones packed by sentences with a carried tail; short rests join their neighbour."""
    out: list[str] = []
    for section in re.split(r"(?i)(?=<h[1-4][^>]*>)", html or ""):
        words = plain(section).split()
        if not words:
            continue
        if len(words) <= SECTION:
            if len(words) >= LEAST or not out:
                out.append(" ".join(words))
            else:
                out[-1] += " " + " ".join(words)
            continue
        now: list[str] = []
        for sentence in re.split(r"(?<=[.!?])\s+", " ".join(words)):
            new = sentence.split()
            if now and len(now) + len(new) > SECTION:
                if len(now) >= LEAST:  # less is carried on only
                    out.append(" ".join(now))
                now = now[-OVERLAP:]
            now = now + new
        if len(now) < LEAST and out:
            out[-1] += " " + " ".join(now)
        elif now:
            out.append(" ".join(now))
    return out


@arrow_udf("array<string>")
def split_chunks(html: pd.Series) -> pd.Series:
    return html.map(lambda h: chunks(h or ""))


BLOCKS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "p": "paragraph", "blockquote": "quote", "pre": "code", "ul": "list", "ol": "list", "img": "image", "figure": "image", "hr": "divider"}


def blocks(html: str) -> list[dict]:
    """Flat list of typed blocks; containers are unwrapped, loose text becomes paragraphs."""
    out: list[dict] = []
    stack: list = list(reversed(parse(html).children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if flat(c):
                out.append({"kind": "paragraph", "text": flat(c)})
        elif c.tag in BLOCKS:
            image = c if c.tag == "img" else next(iter(c.all("img")), None)
            out.append({"kind": BLOCKS[c.tag], "text": (image.attrs.get("src", "") if image else "") if BLOCKS[c.tag] == "image" else flat(c.text())})
        elif c.tag not in ("script", "style", "head", "nav"):
            stack.extend(reversed(c.children))
    return out


@arrow_udf("array<struct<kind: string, text: string>>")
def html_blocks(html: pd.Series) -> pd.Series:
    return html.map(lambda h: blocks(h or ""))


def block_html(items: list[dict]) -> str:
    """The other way."""
    tag = {"heading": "h2", "paragraph": "p", "quote": "blockquote", "code": "pre", "list": "ul"}
    return "".join("<hr>" if b["kind"] == "divider" else f'<img src="{escape(b["text"])}">' if b["kind"] == "image" else f"<{tag[b['kind']]}>{escape(b['text'], quote=False)}</{tag[b['kind']]}>" for b in items)


def link_density(n: Node) -> float:
    total = len(flat(n.text()))
    return sum(len(flat(a.text())) * (0.3 if a.attrs.get("href", "").startswith("#") else 1.0) for a in n.all("a")) / total if total else 0.0


def best_container(html: str) -> tuple[str, float]:
    """Where the text is; paragraphs give points to up to five ancestors, links and class names weigh them."""
    root = parse(html)
    score: dict[int, float] = {}
    node: dict[int, Node] = {}
    for p in root.all("p", "td", "pre"):
        text = flat(p.text())
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + 1 + min(len(text) // 100, 3)
        at = p.parent
        for level in range(5):
            if at is None or at.tag == "#root":
                break
            if id(at) not in score:
                names = f"{at.attrs.get('class', '')} {at.attrs.get('id', '')}".lower()
                score[id(at)] = (25 if re.search(r"article|body|content|entry|main|page|post|text|story", names) else 0) - (25 if re.search(r"banner|comment|footer|nav|promo|sidebar|sponsor|widget|hidden", names) else 0)
                node[id(at)] = at
            score[id(at)] += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            at = at.parent
    final = {k: v * (1 - link_density(node[k])) for k, v in score.items()}
    if not final:
        return "", 0.0
    top = max(final, key=lambda k: final[k])
    return node[top].tag, round(final[top], 4)


@arrow_udf("tag string, score double")
def readability(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_container(h or "") for h in html], columns=["tag", "score"])


def headings(html: str) -> list[tuple[int, str]]:
    """Levels and texts of the headings h1 to h4 in order."""
    return [(int(n.tag[1]), flat(n.text())) for n in parse(html).all("h1", "h2", "h3", "h4")]


def overlap(a: str, b: str) -> float:
    """Share of b, by length, whose words a has."""
    split = lambda t: [w for w in re.split(r"\W+", t.lower()) if w]
    wa, wb = set(split(a)), split(b)
    if not wa or not wb:
        return 0.0
    return 1 - len(" ".join(w for w in wb if w not in wa)) / len(" ".join(wb))


def rebuilt(html: str, title: str = "") -> str:
    """An article body anew: headings from h2 to h4, no navigation, pictures once unless a long paragraph lies
    between (W7), lists and quotes kept."""
    root = parse(html)
    levels = sorted({int(n.tag[1]) for n in root.all("h1", "h2", "h3", "h4", "h5", "h6")})
    shift = {lv: min(4, 2 + i) for i, lv in enumerate(levels)}
    out: list[str] = []
    last_text = last_picture = None

    def pictures(node: Node) -> None:
        nonlocal last_picture
        for i in [node] if node.tag == "img" else node.all("img"):
            base = re.split(r"[?#]", i.attrs.get("src", ""))[0].strip()
            if base and base != last_picture:
                last_picture = base
                out.append(f'<img src="{escape(i.attrs["src"])}">')

    stack: list = list(reversed(root.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str) or c.tag in ("nav", "script", "style", "aside", "footer", "form"):
            continue
        text = flat(c.text()) if c.tag in ("p", "blockquote") or re.fullmatch(r"h[1-6]", c.tag) else ""
        if re.fullmatch(r"h[1-6]", c.tag):
            if text and text.lower() != title.strip().lower():
                out.append(f"<h{shift[int(c.tag[1])]}>{escape(text, quote=False)}</h{shift[int(c.tag[1])]}>")
        elif c.tag == "p":
            if text and text != last_text:
                out.append(f"<p>{escape(text, quote=False)}</p>")
                if len(out[-1]) > 100:
                    last_picture = None
            last_text = text or last_text
            pictures(c)
        elif c.tag == "blockquote":
            if text:
                out.append(f"<blockquote>{escape(text, quote=False)}</blockquote>")
        elif c.tag in ("ul", "ol"):
            items = [f"<li>{escape(flat(i.text()), quote=False)}</li>" for i in c.all("li") if flat(i.text()) and link_density(i) < 0.8]
            if items:
                out.append(f"<{c.tag}>{''.join(items)}</{c.tag}>")
        elif c.tag == "img":
            pictures(c)
        else:
            stack.extend(reversed(c.children))
    return "".join(out)


@arrow_udf("string")
def rebuild_html(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else rebuilt(h))
