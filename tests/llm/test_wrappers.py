"""Wrappers: the algebra of expressions, broken markup, and the text of pages whose main text is known."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import queries as llm_queries
from quire.llm import wrappers as W

DATA = "/root/testdata/sf0.001"


def alone(source):
    page = W.Page(source)
    keep = W.labels(page, None)
    return [leaf.text() for leaf in page.leaves if leaf.slot >= 0 and keep[leaf.slot]]


def shape(items):
    return " ".join(f"{i[W.KEY]}{'?' * i[W.OPTIONAL]}{'+' * i[W.REPEATED]}" + (f"[{shape(i[W.KIDS])}]" if i[W.KIDS] else "") for i in items)


def test_mismatches_become_optional_or_repeated_groups():
    def of(source):
        return W.Page(source).items

    assert shape(of("<p>a<p>b</p><p>c")) == "p+[#]"
    assert shape(of("<h2>a</h2><p>b<h2>c</h2><p>d<p>e")) == "(h2 p)+[h2[#] p+[#]]"
    both = W.merge(of("<h1>a</h1><p>b</p><div>x</div>"), of("<h1>a</h1><ul><li>u<li>v</ul><p>b</p><p>c</p>"))
    assert shape(both) == "h1[#] ul?[li+[#]] p+[#] div?[#]"
    once = W.merge(of("<h2>a</h2><p>b<h2>c</h2><p>d"), of("<h2>q</h2><p>r"))
    assert shape(once) == "(h2 p)+[h2[#] p[#]]"
    assert shape(W.merge(both, of("<h1>z</h1>"))) == "h1[#] ul?[li+[#]] p?+[#] div?[#]"


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for steps in (W.STEPS, 0):
        monkeypatch.setattr(W, "STEPS", steps)
        for _ in range(200):
            a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
            pairs = W.align(list(a), list(b))
            assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))
            assert all(a[i] == b[j] for i, j in pairs if i is not None and j is not None)
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i in range(len(a)):
                for j in range(len(b)):
                    best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
            if steps:
                assert sum(i is not None and j is not None for i, j in pairs) == best[-1][-1]


CASES = [
    ("<body><header><h1>Site</h1></header><nav>m</nav><main><h1>T</h1><p>a &amp; b<p>c&nbsp; d</main><aside>s</aside><footer>f</footer>", ["T", "a & b", "c d"]),
    ("<div id=page><div class=site-header>S</div><div class='sidebar left'>x</div><div class=content><h2>T</h2>free <b>bold</b>er<br>line<ul><li>one<li>two</ul></div><div id=comments><p>c</div></div>", ["T", "free bolder line", "one", "two"]),
    ("<article class='post has-sidebar'><header><h1>T</h1></header><p>x</p><form><p>name<input></form><div class=newsletter>n</div><footer>by</footer></article><article class=comment>no</article>", ["T", "x"]),
    ("<form action=/><div class=cookie-notice>We</div><article><p>in a form</article></form>", ["in a form"]),
    ("<article><p>a<script>if (a < b) '</p>'</script>b<style>p{}</style><!-- <p>no</p> --> c < d</p><table><tr><td>1<td>2<tr><td>3</table></article>", ["ab c < d", "1", "2", "3"]),
    ("<article><p>a <span class=ad>buy <i>now</i></span>b<p hidden>h<p style='display: none'>h<div role=alert>r</div><dl><dt>t<dd>d</dl></article>", ["a b", "t", "d"]),
    ("<p>cut &am", ["cut &am"]),
    ("<article><p>open <a href='x'>link</a> &lt;b&gt; &#x41;&#66;</p><p></p><p> \n </p>", ["open link <b> AB"]),
    ("<![foo]><?php x ?><article></nonsense></p>t</article", ["t"]),
    ("", []),
    ("no markup\n at all", ["no markup at all"]),
    ("<script>never closed", []),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, ["deep"]),
    ("<p>" + "word " * 200_000, [("word " * 200_000).strip()]),
    ("<main><h1>T</h1><article><p>x</article></main>", ["T", "x"]),
]


@pytest.mark.parametrize("source, want", CASES)
def test_one_page(source, want):
    assert alone(source) == want


def test_mutated_pages_never_fail():
    rng, parts = random.Random(9), ["<p>", "</p>", "<div class='ad x'>", "</div", "<!--", "-->", "<![CDATA[", "]]>", "<article>", "</article>", "<a href=\"", "'", '"', "<li>", "<td>", "<tr>", "<table>", "</table>", "<h1>", "<form>", "</form>", "&lt;", "&#0;", "&#xd800;", "<script>", "</script>", "text ", "\x00", "<", ">", "<header>", "<span hidden>", "</span>", "<br/>", "<head>", "<body>"]
    for _ in range(1000):
        source = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        page = W.Page(source)
        W.labels(page, {"pages": 1, "prints": [], "items": W.merge(W._bare(page.items), W._bare(page.items))})


def wrap(k, body, tail=""):
    return (k, f"https://Site.example:80/p/{k}", f"<body><div><p>We are a site.</p></div><ul><li><a href=/>Home page of this site</a></ul><div><h2>Title {k}</h2>{body}</div><div><span>All rights</span></div>{tail}")


def test_a_host_tells_template_from_text(spark, monkeypatch):
    bodies = ["".join(f"<p>{w} text {k}</p>" for w in ("first", "second", "third")[: 1 + k % 3]) for k in range(9)]
    rows = [wrap(k, b) for k, b in enumerate(bodies)]
    rows += [(100 + k, f"http://copies.example/{k}", "<div><p>same</p></div><div><p>text</p></div>") for k in range(8)]  # copies have no template
    rows += [(None, None, None), (7, "http://[odd", "<p>x"), (7, "http://[odd", "<p>x"), (8, "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select("*", *[F.lit(1).alias(c) for c in ("host", "part", "wrapper", "text", "n_chars", "salt")]).repartition(5)
    want = {k: "\n\n".join([f"Title {k}", *[f"{w} text {k}" for w in ("first", "second", "third")[: 1 + k % 3]]]) for k in range(9)} | {100 + k: "same\n\ntext" for k in range(8)} | {7: None, 8: ""}
    for fan, limit, structures in ((2, 0, 1), (W.FAN, W.BROADCAST_BYTES, W.STRUCTURES)):
        monkeypatch.setattr(W, "FAN", fan)
        monkeypatch.setattr(W, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(W, "STRUCTURES", structures)
        got = W.query(pages).collect()
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        odd = [r for r in got if r.page_id == 7 and r.url == "http://[odd"]
        assert [r.text for r in odd] == ["x", "x"] and [r.text for r in got if r.page_id is None] == [""]
        assert {r.page_id: r.text for r in got if r.page_id not in (7, None)} == {k: v for k, v in want.items() if k != 7}
        assert [r.text for r in got if r.page_id == 7 and r.url != "http://[odd"] == [want[7] or "Title 7\n\nfirst text 7\n\nsecond text 7"]
    assert W.query(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    for r in llm_queries.queries()["op11_html_wrappers"](spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = r.html.partition("<article>")[2].partition("</article>")[0].partition("<footer>")[0]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?p>|</?h1>", body))
        assert r.text == "\n\n".join(filter(None, blocks)) and r.n_chars == len(r.text)
