"""Pages as tables: a table function yields one row for each element, so that questions about the tree are joins.

Elements are numbered in page order; the elements inside one are those from ``pre + 1`` to ``last``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pages import Node, parse

#: Ancestors that a row names, nearest first.
LEVELS = 5
NODES = "pre int, last int, depth int, tag string, names string, anchor boolean, chars int, commas int, ancestors array<int>"


def element_rows(html: str) -> Iterator[tuple]:
    """One row for each element: where it is, what it is called, and how much visible text is inside it.

    Lengths are those of the text with single spaces; they come from running counts over the page's text, so that a
    deep tree costs no more than a flat one.
    """
    found: list[tuple[Node, int, int]] = []  # element, depth, start of its text
    ends: dict[int, tuple[int, int]] = {}  # last element inside, end of its text
    pieces, length = [], 0
    stack: list = [(parse(html), -1, None)]
    while stack:
        at, depth, number = stack.pop()
        if number is not None:
            ends[number] = (len(found) - 1, length)
        elif isinstance(at, str):
            pieces.append(at)
            length += len(at)
        else:
            if depth >= 0:
                stack.append((at, depth, len(found)))
                found.append((at, depth, length))
            hidden = at.tag in ("script", "style")
            stack.extend((c, depth + 1, None) for c in reversed(at.children) if isinstance(c, Node) or not hidden)
    text = "".join(pieces)
    solid = [not c.isspace() for c in text]
    chars = list(accumulate(solid, initial=0))
    words = list(accumulate((s and not (i and solid[i - 1]) for i, s in enumerate(solid)), initial=0))
    commas = list(accumulate((c == "," for c in text), initial=0))
    path: list[int] = []
    for pre, (at, depth, a) in enumerate(found):
        last, b = ends[pre]
        n = chars[b] - chars[a]
        starts = words[b] - words[a] + (a < b and solid[a] and bool(a) and solid[a - 1])
        names = f"{at.attrs.get('class', '')} {at.attrs.get('id', '')}".lower()
        yield pre, last, depth, at.tag, names, at.attrs.get("href", "").startswith("#"), n + max(starts - 1, 0), commas[b] - commas[a], path[:depth][::-1][:LEVELS]
        path[depth:] = [pre]


class Elements:
    """The table function; a null page has no rows."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        if html is not None:
            yield from element_rows(html)


def elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of ``pages`` joined with their elements (columns of NODES)."""
    return pages.lateralJoin(F.udtf(Elements, returnType=NODES)(F.col(html).outer())).drop(html)


# Words in classes and ids that speak for and against a container.
FOR = "article|body|content|entry|main|page|post|text|story"
AGAINST = "banner|comment|footer|nav|promo|sidebar|sponsor|widget|hidden"
#: Shares of a paragraph's points for its ancestors, in parts of 36: all, 1/2, then 1 / (3 * level).
SHARES = (36, 18, 6, 4, 3)


def container_scores(nodes: DataFrame, key: str) -> DataFrame:
    """The score of every element that holds paragraphs: (key, pre, tag, score, rank), best first.

    A paragraph's points go to its ancestors by a join on their numbers; the length of the links inside an element is
    the difference of two running sums.  Sums are of whole numbers, so that no order of adding them shows.  Equal scores
    go to the ancestor that got points first.
    """
    share = F.array(*map(F.lit, SHARES))
    points = 2 + F.col("commas") + F.least(F.floor(F.col("chars") / 100), F.lit(3))
    paragraphs = nodes.where(F.col("tag").isin("p", "td", "pre") & (F.col("chars") >= 25)).select(key, F.col("pre").alias("by"), points.alias("points"), F.posexplode("ancestors").alias("level", "pre"))
    got = paragraphs.groupBy(key, "pre").agg(F.sum(F.col("points") * F.element_at(share, F.col("level") + 1)).alias("parts"), F.min(F.struct("by", "level")).alias("first"))
    weight = F.when(F.col("tag") == "a", F.col("chars") * F.when(F.col("anchor"), 3).otherwise(10)).otherwise(0)  # tenths
    by_page = Window.partitionBy(key).orderBy("pre")
    summed = nodes.withColumn("own", weight).withColumn("links", F.sum("own").over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    at = summed.join(got, [key, "pre"])
    inside = at.join(summed.select(key, F.col("pre").alias("last"), F.col("links").alias("links_last")), [key, "last"])
    density = F.when(F.col("chars") > 0, (F.col("links_last") - F.col("links") + F.col("own")) / (10 * F.col("chars"))).otherwise(0.0)
    base = F.when(F.col("names").rlike(FOR), 25).otherwise(0) - F.when(F.col("names").rlike(AGAINST), 25).otherwise(0)
    scored = inside.withColumn("score", (base + F.col("parts") / 36) * (1 - density))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "first"))
    return scored.select(key, "pre", "tag", "score", rank.alias("rank"))


def ld_names(value: Column) -> Column:
    """Names in a JSON-LD author, as VARIANT: a name, an object with one, or a list of those; others give none."""
    kind = F.schema_of_variant(value)
    one = lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    many = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
    return F.array_compact(F.transform(many, one))


def ld_image(value: Column) -> Column:
    """The first address in a JSON-LD image: an address, an object with one, or a list of those."""
    kind = F.schema_of_variant(value)
    first = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$[0]", "variant")).otherwise(value)
    named = F.coalesce(F.try_variant_get(first, "$.url", "string"), F.try_variant_get(first, "$.contentUrl", "string"))
    return F.coalesce(named, F.when(F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string")))
