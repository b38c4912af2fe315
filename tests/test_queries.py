"""Every library query that has SQL against the checking engine, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import quire.plans.registry as registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def shown(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cur = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(shown, (r[columns.index(c)] for c in df.columns))) for r in cur.fetchall())
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == want


def test_greedy_matching_is_the_sequential_walk(spark):
    from quire.operators.matching import greedy_matching

    rows = [(a, b, ((a * 7 + b * 13) % 29) / 29) for a in range(20) for b in range(a + 1, 20) if (a * b) % 3 != 1]
    used, want = set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b))
    got = greedy_matching(spark.createDataFrame(rows, "a bigint, b bigint, sim double"))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_neighbours(spark):
    from quire.operators.graph import neighbours

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 1)], "source_id bigint, target_id bigint")
    seeds = spark.createDataFrame([(1,)], "id bigint")
    assert {r.id for r in neighbours(edges, seeds, 2).collect()} == {2, 3, 9}


def test_limiter_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.streaming import limiter

    rows = [(u, i, float(i * 3)) for u in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id bigint, id bigint, t double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = limiter.limited(stream).writeStream.format("memory").queryName("lim").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in limiter.limited_batch(df).collect()}
    assert {tuple(r) for r in spark.table("lim").select("user_id", "id", "allowed").collect()} == want and spark.table("lim").where(~F.col("allowed")).count() > 0


def test_global_rank(spark):
    from quire.operators.ranking import global_rank

    rows = [(i, (i * 37) % 11 if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, v bigint")
    for down in (True, False):
        want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, (-(r[1] or 0) if down else (r[1] or 0)), r[0]))]
        assert [r.id for r in global_rank(df, "v", "id", descending=down, parts=8).orderBy("rk").collect()] == want
    assert global_rank(df.limit(0), "v", "id").count() == 0


def test_replace_by_key(spark, tmp_path):
    from quire.sources.sinks import append_events, replace_by_key

    path = str(tmp_path / "chunks")
    replace_by_key(spark.createDataFrame([(i, f"old{i}") for i in range(20)], "item bigint, text string"), path, "item", 4)
    replace_by_key(spark.createDataFrame([(3, "new"), (3, "more"), (99, "x")], "item bigint, text string"), path, "item", 4)
    got = sorted((r.item, r.text) for r in spark.read.parquet(path).select("item", "text").collect())
    assert got == sorted([(i, f"old{i}") for i in range(20) if i != 3] + [(3, "new"), (3, "more"), (99, "x")])
    append_events(spark.createDataFrame([(1, "click")], "id bigint, kind string"), str(tmp_path / "events"), "")
    assert spark.read.json(str(tmp_path / "events")).count() == 1


def test_components(spark, monkeypatch):
    import random

    from quire.operators import graph

    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(25)]
    root = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    for few in (graph.FEW, 0):  # one task, rounds of joins
        monkeypatch.setattr(graph, "FEW", few)
        got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        assert all(got[i] == root[i] for i in got) and set(got) >= {x for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hashing_finds_nearly_all_exact_pairs(spark):
    row = registry.queries()["e7_ann_overlap"](spark, DATA).first()
    assert row.n_exact > 100 and row.recall >= 0.9


def test_ingest_and_pages_give_rows(spark):
    known = registry.queries()
    items = known["r9_ingest"](spark, DATA).collect()
    assert {r.status for r in items} == {"completed", "failed"} and all(r.n_chunks == 0 for r in items if r.status == "failed")
    assert len({(r.user_id, r.url) for r in items}) == len(items)  # no page twice for a user
    cleaned = known["s5_client_html"](spark, DATA).collect()
    assert all("<h1>" not in r.html and r.word_count > 0 and r.minutes >= 1 for r in cleaned)
    merged = known["x40_paragraphs"](spark, DATA)
    assert merged.count() <= known["s6_document_blocks"](spark, DATA).groupBy().sum("n_blocks").first()[0]


def test_slugs_of_headings_with_references(spark, tmp_path):
    heads = ["Ands &amp; ors&amp", "a &quot;b&quot; &lt;c&gt;", "&amp;lt; &#39;x&#39; &AMP; y", "&nbsp;z &eacute;&", "plain"]
    pages = [(i, "https://a.example/", f"<p>&quot;</p><h1>{h}</h1><p>x</p>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(c.execute(registry.oracle_sql()["x36_heading_slug"]).fetchall())
    got = registry.queries()["x36_heading_slug"](spark, str(tmp_path)).select("page_id", "slug", "level").collect()
    assert sorted(map(tuple, got)) == want and len(want) == len(heads)
