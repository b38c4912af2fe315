"""Operators with parameters on small libraries: search, connections, themes, merges, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import connections, curation, evaluation, filters, recommend, search, upkeep
from quire.operators.similarity import best_match, cosine_to, matches, similar_pairs

ITEM = "id bigint, user_id bigint, title string, author string, description string, tags array<string>, url string, full_text string, created_at string, is_read boolean, is_archived boolean"


def items_of(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = {"id": i + 1, "user_id": 1, "title": "T", "author": None, "description": None, "tags": None, "url": "https://a.org/x", "full_text": "", "created_at": f"2024-01-{i + 1:02d}", "is_read": False, "is_archived": False} | r
        full.append(tuple(d[c.split()[0]] for c in ITEM.split(", ")))
    return spark.createDataFrame(full, ITEM).withColumn("created_at", F.col("created_at").cast("timestamp"))


@pytest.fixture(scope="module")
def lib(spark):
    items = items_of(
        spark,
        [
            {"title": "Zebra stripes", "full_text": "about animals", "author": "Jane Roe"},
            {"title": "Animals", "description": "zebra facts", "author": "John Doe", "tags": ["zoo", "Big Cats"]},
            {"title": "Plants", "full_text": "a zebra plant grows", "tags": ["garden"], "url": "https://www.plants.example/a"},
            {"title": "", "full_text": "zebra zebra zebra"},
            {"title": "Other user", "full_text": "zebra", "user_id": 2},
            {"title": "Trees", "full_text": "oak and elm", "is_read": True},
        ],
    )
    vec = lambda *x: [float(v) for v in x]
    chunks = spark.createDataFrame([(1, 1, vec(1, 0, 0)), (2, 1, vec(0, 1, 0)), (3, 3, vec(0.9, 0.1, 0)), (4, 5, vec(1, 0, 0)), (5, 6, None)], "id bigint, item_id bigint, embedding array<double>")
    whole = spark.createDataFrame([(2, vec(0.5, 0.5, 0)), (3, vec(0, 0, 1)), (6, vec(0, 1, 0.2)), (4, vec(1, 0, 0))], "item_id bigint, embedding array<double>")
    entities = spark.createDataFrame([(1, 1, "Zebra", vec(0, 0, 1)), (2, 1, "Horse", vec(1, 0.2, 0)), (3, 1, "Oak", vec(0.1, 1, 0)), (4, 1, "Elm", vec(-1, 0, 0)), (5, 2, "Zebra", vec(1, 0, 0))], "id bigint, user_id bigint, name string, embedding array<double>")
    mentions = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 3, 1), (3, 6, 1), (4, 6, 1), (5, 5, 2)], "entity_id bigint, item_id bigint, user_id bigint")
    relations = spark.createDataFrame([(2, 3), (3, 4)], "source_id bigint, target_id bigint")
    highlights = spark.createDataFrame([(1, 1, 1, "a zebra line"), (2, 2, 1, "nothing"), (3, 5, 2, "zebra")], "id bigint, item_id bigint, user_id bigint, text string")
    return search.Library(items, chunks, whole, entities, mentions, relations, highlights)


def ids(df):
    return [r["id"] for r in df.orderBy("rank").collect()]


def test_semantic_takes_the_best_chunk_and_falls_back_to_the_item(lib):
    got = search.semantic(lib.of(1), [1.0, 0.0, 0.0], 10).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3, 2, 6] and got[0]["score"] == 1 and got[2]["score"] == pytest.approx(math.sqrt(0.5))


def test_keyword_title_before_description_and_no_other_tenant(lib):
    assert ids(search.keyword(lib.of(1), "zebra", 10)) == [1, 2, 3]
    assert ids(search.keyword(lib.of(1), "zebra", 2)) == [1, 2] and ids(search.keyword(lib.of(1), "missing", 5)) == []


def test_entity_lane(lib):
    got = {r["id"]: r for r in search.entity(lib.of(1), "zebra", [1.0, 0.0, 0.0], 10).collect()}
    horse = 1 / math.hypot(1, 0.2)
    oak = 0.1 / math.hypot(0.1, 1)  # a neighbour of Horse, below the gate, positive; Elm is negative
    zebra = 1 / math.log2(3)
    assert got[1]["score"] == pytest.approx(max(zebra, horse / 2) + 0.3 * min(zebra, horse / 2), abs=1e-8)
    assert got[3]["score"] == pytest.approx(horse / 2, abs=1e-8) and got[6]["score"] == pytest.approx(oak / math.log2(3), abs=1e-8)
    assert [v["name"] for v in got[1]["matched_via"]] == ["Zebra", "Horse"]
    none = lib.entities.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert search.entity(search.Library(lib.items, lib.chunks, lib.item_vectors, none, lib.mentions, lib.relations), "zebra", [1.0, 0.0, 0.0], 10).count() == 0


def test_dispatch_and_fallbacks(lib):
    v = [1.0, 0.0, 0.0]
    kinds = lambda df: {r["match_type"] for r in df.collect()}
    ask = lambda q, vector=v, **o: search.search(lib, q, vector, user_id=1, **o)
    assert ids(ask("author:jane")) == [1] and kinds(ask("author:jane")) == {"filter"} and ids(ask("jane roe")) == [1]
    assert ids(ask("site:plants.example")) == [3] and ids(ask("none.org")) == [] and ids(ask("tag:cats before:2024-01-03")) == [2]
    assert kinds(ask("zebra")) == {"keyword"} and kinds(ask("qqq")) == {"semantic_fallback"} and kinds(ask("what is it?")) == {"semantic"}
    assert kinds(ask("what zebra?", None)) in ({"keyword"}, set()) and kinds(ask("a zebra plant grows", None)) == {"keyword"}
    mixed = ask("zebra OR oak OR elm").collect()
    assert {r["match_type"] for r in mixed} == {"hybrid"} and [r["rank"] for r in sorted(mixed, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert ids(ask("zebra", limit=1, offset=1)) == [2] and ids(ask("what is it? after:2024-01-03")) == [6, 3]  # dates make it a filter
    assert {r["id"] for r in ask("is:unread zebra", mode="full", limit=10).collect()} <= {1, 2, 3, 6}


def test_full_mode_types_and_scores(lib):
    got = {r["id"]: r for r in search.search(lib, "zebra", [1.0, 0.0, 0.0], user_id=1, mode="full").collect()}
    assert got[1]["match_type"] == "entity+keyword" and got[6]["match_type"] == "entity+semantic" and got[2]["match_type"] == "keyword"
    assert got[1]["rank"] == 1 and got[1]["score"] == pytest.approx(1 / 61) and got[6]["semantic_score"] is not None and got[1]["semantic_score"] is None
    zebra, horse = 1 / math.log2(3), 1 / math.hypot(1, 0.2) / 2
    assert got[1]["fused"] == pytest.approx(1 / 61 + 1 / 61 + 0.025 * (zebra + 0.3 * horse), abs=1e-8)


def test_unified_and_draft(lib):
    got = search.unified(lib, "zebra", [1.0, 0.0, 0.0], user_id=1)
    assert [r["id"] for r in got["highlights"].collect()] == [1] and ids(got["items"]) == [1, 2, 3]
    assert search.draft_reads(lib, "x", "few words", None) is None
    assert search.draft_reads(lib, "zebra", "zebra " * 50, [1.0, 0.0, 0.0], user_id=1).count() == 4
    empty = search.Library(*[f.limit(0) for f in (lib.items, lib.chunks, lib.item_vectors, lib.entities, lib.mentions, lib.relations, lib.highlights)])
    for q in ("zebra", "tag:x", "what?", "four words of it"):
        assert search.search(empty, q, [1.0, 0.0, 0.0]).count() == 0


def test_matches_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 8))
    x[40:50] = x[0]  # ties
    rows = [(i, int(i % 7 == 0), v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (901, 0, [0.0] * 8), (902, 0, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s, user = np.round(u @ u.T, 9), np.arange(90) % 7 == 0
    for k, least, block in ((None, 0.4, 16), (3, -1.0, 16), (5, 0.2, 4096)):
        got = sorted((r.x, r.y) for r in matches(df, df, least=least, k=k, block=block).collect())
        want = []
        for i in range(90):
            near = sorted((-s[i, j], j) for j in range(90) if j != i and user[i] == user[j] and s[i, j] >= least)
            want += [(i, j) for _, j in (near if k is None else near[:k])]
        assert got == sorted(want)
    best = {r.id: r.best for r in best_match(df.where("id < 10"), df.where("id >= 10 and id < 90")).collect()}
    assert all(best[i] == pytest.approx(max(s[i, j] for j in range(10, 90) if user[i] == user[j])) for i in range(10))
    assert matches(df.limit(0), df).count() == 0
    assert df.select(cosine_to([1.0] + [0.0] * 7).alias("c")).where("c is null").count() == 3


def test_pairs_survive_if_either_side_ranks_them(spark):
    rows = [(0, 0, [1.0, 0.0])] + [(i, 0, [1.0, 0.01 * i]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, embedding array<double>")
    got = {(r.a, r.b) for r in similar_pairs(df, least=0.9, per_id=1).collect()}
    assert got == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)}


def test_connections(spark):
    passages = spark.createDataFrame(
        [(1, 1, 10, "x" * 30, 0, [1.0, 0.0]), (2, 1, 20, "y" * 30, 0, [0.9, 0.1]), (3, 1, 20, "z" * 30, 5, [0.8, 0.3]), (4, 1, 20, "w" * 30, 9, [0.7, 0.4]), (5, 1, 30, "short", 0, [1.0, 0.0]), (6, 1, 40, "v" * 30, 0, [0.99, 0.0]), (7, 1, 10, "u" * 30, 1, [1.0, 0.0]), (8, 2, 50, "t" * 30, 1, [1.0, 0.0])],
        "id bigint, user_id bigint, item_id bigint, text string, start_offset int, embedding array<double>",
    )
    items = spark.createDataFrame([(10, "A", ["b", "a"]), (20, "B", ["a", "b", "c"]), (30, "C", None), (40, "D", None), (50, "E", None)], "id bigint, title string, tags array<string>")
    got = {(r.x, r.item_id): r for r in connections.by_article(passages, items, least=0.5).collect()}
    assert got[1, 20].passages == [2, 3] and got[1, 20].shared == ["a", "b"] and got[1, 20].rank == 1  # shared tags come first
    assert got[1, 40].rank == 2 and got[1, 40].score == 1 and (1, 30) not in got and (1, 50) not in got and (1, 10) not in got
    best = {(r.ix, r.iy): r for r in connections.best_pairs(passages, items, least=0.5).collect()}
    assert (best[10, 20].x, best[10, 20].y) == (1, 2) and best[10, 40].total_similarity == 1
    assert connections.by_article(passages.limit(0), items).count() == 0


def test_themes(spark):
    vec = {"ml": [1.0, 0.0], "ai": [0.95, 0.05], "tea": [0.0, 1.0], "rare": [-1.0, 0.0]}
    tags = spark.createDataFrame(list(vec.items()), "label string, embedding array<double>")
    rows = [(i, 1, False, ["ml", "ai"] if i < 5 else ["ai"]) for i in range(8)] + [(i, 1, False, ["tea"]) for i in range(8, 12)] + [(12, 1, False, ["rare"]), (13, 1, True, ["rare"]), (14, 2, False, ["ml"]), (15, 1, False, None)]
    items = spark.createDataFrame(rows, "id bigint, user_id bigint, is_deleted boolean, tags array<string>")
    got = {r.label: r for r in recommend.themes(items, tags).collect()}
    assert set(got) == {"ai", "tea"} and got["ai"].tags == ["ai", "ml"] and got["ai"]["items"] == list(range(8)) and got["tea"]["items"] == [8, 9, 10, 11]


def test_merge_keeps_the_winners_rows_and_drops_conflicts(spark):
    e = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "id bigint, name string")
    m = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11)], "entity_id bigint, item_id bigint")
    r = spark.createDataFrame([(1, 3, "x", None), (2, 3, "x", None), (2, 3, "y", 5), (3, 2, "z", None), (2, 1, "w", None)], "source_id bigint, target_id bigint, type string, item_id bigint")
    got = curation.merged(e, m, r, spark.createDataFrame([(1, 2)], "winner bigint, loser bigint"))
    assert sorted(x.id for x in got["entities"].collect()) == [1, 3]
    assert sorted(map(tuple, got["mentions"].collect())) == [(1, 10), (1, 11), (3, 11)]
    assert sorted(map(str, map(tuple, got["relations"].collect()))) == sorted(map(str, [(1, 3, "x", None), (1, 3, "y", 5), (3, 1, "z", None), (1, 1, "w", None)]))


def test_duplicates_verify_before_matching(spark):
    rows = [(1, 1, "neural network", [1.0, 0.0]), (2, 1, "Neural networks", [0.99, 0.05]), (3, 1, "other thing", [1.0, 0.001]), (4, 2, "neural network", [1.0, 0.0])]
    e = spark.createDataFrame(rows, "id bigint, user_id bigint, name string, embedding array<double>")
    assert [(r.a, r.b) for r in curation.duplicate_entities(e).collect()] == [(1, 2)]


def test_metrics_of_edge_cases(spark):
    q = spark.createDataFrame([("a",), ("none",), ("miss",)], "q string")
    ranked = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("miss", 9, 1)], "q string, id bigint, rank bigint")
    relevant = spark.createDataFrame([("a", 2), ("a", 3), ("a", 7), ("miss", 1)], "q string, id bigint")
    j = evaluation.judged(q, ranked, relevant)
    got = {r.q: r for r in j.select("q", evaluation.recall_at(2).alias("r"), evaluation.precision_at(10).alias("p"), evaluation.reciprocal_rank().alias("m"), evaluation.ndcg_at(10).alias("n"), evaluation.precision_at(0).alias("z")).collect()}
    assert (got["a"].r, got["a"].p, got["a"].m, got["a"].z) == (pytest.approx(1 / 3), 0.2, 0.5, 0.0)
    assert got["a"].n == pytest.approx((1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2))
    assert (got["none"].r, got["none"].p, got["none"].m, got["none"].n) == (1.0, 0.0, 0.0, 0.0) and (got["miss"].r, got["miss"].n) == (0.0, 0.0)


def test_filters_ignore_broken_days_and_nulls(spark):
    items = items_of(spark, [{"tags": ["Deep Work"]}, {"tags": None, "is_read": True}, {"title": ""}])
    assert [r.id for r in filters.structured(items, before="soon", after="2024-13-99").collect()] == [2, 1]
    assert [r.id for r in filters.structured(items, tag="work").collect()] == [1] and [r.id for r in filters.structured(items, state="READ").collect()] == [2]
    assert filters.dated(items, None, None).count() == 3 and filters.dated(items, after="2024-01-02").count() == 2


def test_ingest(spark):
    html = "<html><head><title>T</title></head><body><h1>Head</h1><p>" + "word " * 30 + "</p></body></html>"
    rows = [(1, 1, "https://A.org/x/?utm_source=q", html), (2, 1, "https://a.org/x", html), (3, 2, "https://a.org/x", html), (4, 1, "http://[bad", html), (5, 1, "https://a.org/y.pdf", None)]
    got = upkeep.ingested(spark.createDataFrame(rows, "page_id bigint, user_id bigint, url string, html string"))
    items = {r.id: r for r in got["items"].collect()}
    assert set(items) == {1, 3, 4, 5} and items[1].url == "https://a.org/x" and items[4].status == "failed" and items[5].content_type == "pdf" and items[1].title == "T"
    assert {r.item_id for r in got["chunks"].collect()} == {1, 3}


def test_state_streams_equal_the_fold(spark, tmp_path):
    from quire.streaming import profiles

    rows = [(i % 3, i, ("read", "position", "unread", "archive", "position", "restore")[i % 6], (i * 37 % 100) / 100) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id bigint, seq bigint, kind string, value double")
    for k in range(3):  # three files, three batches
        df.where(f"seq >= {20 * k} and seq < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    q = profiles.item_states(stream).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.item_id: (r.is_read, r.position, r.is_archived) for r in curation.replayed(df).collect()}
    now = {i: (False, 0.0, False) for i in range(3)}
    for i, _, kind, value in rows:
        now[i] = profiles.item_after(now[i], kind, value)
    assert now == want and {(r.item_id, (r.is_read, r.position, r.is_archived)) for r in spark.table("states").collect()} >= set(want.items())
    reads = spark.createDataFrame([(1, i, i, [f"t{i % 3}"]) for i in range(30)] + [(2, 0, None, None)], "user_id bigint, seq bigint, minutes int, tags array<string>")
    reads.coalesce(1).write.parquet(str(tmp_path / "reads"))
    q = profiles.rolling_profiles(spark.readStream.schema(reads.schema).parquet(str(tmp_path / "reads"))).writeStream.format("memory").queryName("profiles").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.user_id: r for r in spark.table("profiles").collect()}
    assert got[1].mean_minutes == 19.5 and got[1].tags == ["t0", "t1", "t2"] and got[2].mean_minutes is None and got[2].tags == []


def test_text_operators_take_nulls_empty_and_long_texts(spark):
    from quire.functions import layout, pages, queries, urls

    rows = [(None,), ("",), ("<p" * 2000,), ("<div>" * 2000,), ("word " * 50_000,), ("\x00�",), ("http://[bad",)]
    df = spark.createDataFrame(rows, "t string")
    made = [
        urls.normalize_url("t"), urls.title_from_url("t"), urls.detect_content_type("t", "t"), pages.split_chunks("t"), pages.html_blocks("t"), pages.rebuild_html("t"), pages.clean_html("t", "t", "t", "t"),
        pages.page_metadata("t", "t"), pages.readability("t"), pages.limit_features("t", "t"), pages.client_limit_features("t", "t"), layout.bionic_text("t"), queries.operators("t"), queries.strip_dates("t"), queries.intent("t", F.lit(False)),
    ]
    got = df.select(*[c.alias(f"c{i}") for i, c in enumerate(made)]).collect()
    assert len(got) == len(rows) and got[0]["c0"] is None and got[6]["c0"] is None


def test_rows_that_agree_in_apart_leave_room_for_others(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(90, 6))
    v[:40] = v[0] + rng.normal(size=(40, 6)) / 50  # one article's passages are the nearest of each other
    rows = [(i, 1, None if i == 89 else i // 40, [float(x) for x in v[i]]) for i in range(90)]
    frame = spark.createDataFrame(rows, "id bigint, user_id bigint, item_id bigint, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    want = {(i, j) for i in range(89) for j in sorted((j for j in range(89) if rows[j][2] != rows[i][2]), key=lambda j: (-sims[i, j], j))[:5]}
    for block in (16, 512):
        assert {(r.x, r.y) for r in matches(frame, frame, k=5, block=block, apart="item_id").collect()} == want
