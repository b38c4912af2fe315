"""Images of a page's source put back into its extracted text, by the text around them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.pages import Node, flat, parse
from quire.functions.udfs import arrow_udf

TEXTS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li")
ELSEWHERE = ("head", "nav", "script", "style", "aside", "footer", "form")
#: Letters of a neighbour that must agree.
CONTEXT = 50
OUTLINE = "array<struct<kind: string, tag: string, text: string>>"


def outline(html: str) -> list[dict]:
    """Texts and images in page order; images inside a text follow it."""
    out: list[dict] = []
    stack: list = list(reversed(parse(html).children))
    while stack:
        at = stack.pop()
        if not isinstance(at, Node) or at.tag in ELSEWHERE:
            continue
        if at.tag in TEXTS:
            if flat(at.text()):
                out.append({"kind": "text", "tag": at.tag, "text": flat(at.text())})
            out += [{"kind": "image", "tag": "img", "text": i.attrs["src"]} for i in at.all("img") if i.attrs.get("src")]
        elif at.tag == "img":
            if at.attrs.get("src"):
                out.append({"kind": "image", "tag": "img", "text": at.attrs["src"]})
        else:
            stack.extend(reversed(at.children))
    return out


@arrow_udf(OUTLINE)
def page_outline(html: pd.Series) -> pd.Series:
    return html.map(lambda h: outline(h or ""))


def _numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the ends of their texts, and which occurrence of such an end on the page each is."""
    nth = lambda end: F.when(F.col("kind") == "text", F.row_number().over(Window.partitionBy(key, "kind", end).orderBy("pos")))
    ends = rows.withColumn("head", F.left("text", F.lit(CONTEXT))).withColumn("tail", F.right("text", F.lit(CONTEXT)))
    return ends.withColumn("nth_head", nth("head")).withColumn("nth_tail", nth("tail"))


def _base(src: Column) -> Column:
    return F.trim(F.regexp_extract(src, "^([^?#]*)", 1))


def placed(pages: DataFrame, key: str, source: str = "source", extracted: str = "extracted") -> DataFrame:
    """(key, pos, kind, tag, text): the extracted texts in their order with the source's images between them.

    An image follows the text that it follows in the source, or, where the extraction lost that one, comes before the
    text that comes next in the source; where both are lost it belongs to something else and is left out.  Texts are
    found again by their last or first 50 letters and, where these repeat, by their occurrence (the last one there, if
    fewer are left).  An image, addresses compared without their query, is placed once; one that the extraction kept
    stays where it is.  Null pages have no rows.
    """
    rows = lambda html: _numbered(pages.select(key, F.posexplode(page_outline(html)).alias("pos", "b")).select(key, "pos", "b.*"), key)
    there = rows(extracted)
    order = Window.partitionBy(key).orderBy("pos")
    text = lambda *cols: F.when(F.col("kind") == "text", F.struct(*cols))
    around = rows(source).withColumn("prev", F.last(text("tail", "nth_tail"), True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.first(text("head", "nth_head"), True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    images = around.where("kind = 'image'").withColumn("base", _base(F.col("text")))
    first = images.withColumn("n", F.row_number().over(Window.partitionBy(key, "base").orderBy("pos"))).where("n = 1")
    kept = there.where("kind = 'image'").select(key, _base(F.col("text")).alias("base")).distinct()
    open_ = first.join(kept, [key, "base"], "left_anti").select(key, F.col("pos").alias("source_pos"), "tag", "text", "prev", "next")

    def at(side: str, end: str) -> DataFrame:
        """Where the neighbour is: an array of the places of its text, by occurrence."""
        return there.where("kind = 'text'").groupBy(key, F.col(end).alias(f"{side}_text")).agg(F.array_sort(F.collect_list("pos")).alias(f"{side}_at"))

    seek = open_.select("*", F.col("prev.tail").alias("prev_text"), F.col("next.head").alias("next_text"))
    met = seek.join(at("prev", "tail"), [key, "prev_text"], "left").join(at("next", "head"), [key, "next_text"], "left")
    nth = lambda places, n: F.get(places, F.least(F.col(n), F.size(places)) - 1)
    spot = F.coalesce(nth(F.col("prev_at"), "prev.nth_tail") + 0.4, nth(F.col("next_at"), "next.nth_head") - 0.4)
    inserted = met.withColumn("spot", spot).where("spot is not null").select(key, "spot", "source_pos", F.lit("image").alias("kind"), "tag", "text")
    both = there.select(key, F.col("pos").cast("double").alias("spot"), F.lit(0).alias("source_pos"), "kind", "tag", "text").unionByName(inserted)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("spot", "source_pos")) - 1).select(key, "pos", "kind", "tag", "text")
