"""Indexes against scans: inverted lists of vectors, pivots of similarity joins, postings."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import fulltext
from quire.operators import postings, search
from quire.operators import vector_index as V


def files_read(df):
    """What the scan's own metrics count."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = [(i, i % 3, [float(v) for v in centres[i % 30] + 0.15 * rng.standard_normal(16)]) for i in range(1200)]
    rows += [(5000, 0, rows[0][2]), (5001, 0, rows[0][2]), (6000, 0, None), (6001, 0, [0.0] * 16), (6002, 1, [float("nan")] * 16), (None, 1, rows[1][2])]
    return spark.createDataFrame(rows, "id bigint, user_id bigint, embedding array<double>")


def plain(df):
    rows = [r for r in df.collect() if r.id is not None and r.embedding and all(np.isfinite(r.embedding)) and any(r.embedding)]
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return rows, np.round(x @ x.T, 9)


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    return V.build(clustered.where("id is not null"), str(tmp_path_factory.mktemp("index") / "v"), lists=30)


def test_exact_probe_is_a_scan(spark, clustered, index):
    rows, sims = plain(clustered)
    for at in (0, 77, 501):
        found, lists = V.probe(index, rows[at].embedding, 12, spark=spark)
        want = sorted((-sims[at, j], rows[j].id) for j in range(len(rows)))[:12]
        assert [(r.id, r.score) for r in found.collect()] == [(i, pytest.approx(-s)) for s, i in want]
        assert index.share(lists) < 0.2  # clusters: most lists cannot hold a better one
    mine, _ = V.probe(index, rows[0].embedding, 5, keep=F.col("user_id") == 1, spark=spark)
    want = sorted((-sims[0, j], rows[j].id) for j in range(len(rows)) if rows[j].user_id == 1)[:5]
    assert [r.id for r in mine.collect()] == [i for _, i in want]
    assert V.probe(index, [0.0] * 16, 3, spark=spark)[0].count() == 0 == V.probe(index, [1.0], 3, spark=spark)[0].count()
    everything, lists = V.probe(index, rows[0].embedding, 5000, spark=spark)
    assert everything.count() == len(rows) and index.share(lists) == 1


def test_probes_open_their_lists_only(spark, index):
    plan = index.rows(spark, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and index.rows(spark, [1, 2]).count() == index.sizes[[1, 2]].sum()
    assert files_read(index.rows(spark, [1, 2])) == 2 < files_read(spark.read.parquet(f"{index.path}/lists")) == 30


def test_recall_of_few_probes(clustered, index):
    rows, sims = plain(clustered)
    asked = clustered.where("id % 50 = 0")
    for block in (8192, 16):
        got = V.probe_many(index, asked, 10, 3, block=block).collect()
        hits = n = 0
        for at, r in enumerate(rows):
            if r.id % 50 == 0:
                want = {rows[j].id for _, _, j in sorted((-sims[at, j], rows[j].id, j) for j in range(len(rows)) if j != at)[:10]}
                hits, n = hits + len(want & {g.id for g in got if g.query == r.id}), n + len(want)
        unit = np.array([r.embedding / np.linalg.norm(r.embedding) for r in rows if r.id % 50 == 0])
        shares = [index.share(list(a[:3])) for a in np.argsort(V._angles(unit, index.centroids), axis=1)]
        assert hits / n >= 0.9 and np.mean(shares) < 0.2


@pytest.mark.parametrize("least", [0.82, 0.6, -1.0])
def test_pruned_pairs_are_all_pairs(clustered, least):
    rows, sims = plain(clustered)
    want = {(min(a.id, b.id), max(a.id, b.id)) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a.user_id == b.user_id and sims[i, j] >= least}
    got = [(r.a, r.b) for r in V.pruned_pairs(clustered, least=least, block=32).collect()]
    assert set(got) == want and len(got) == len(want)


def test_pivots_save_products(spark, clustered):
    got = {r.least: r for r in V.saved(clustered, [0.95, 0.82, -1.0]).collect()}
    assert got[0.95].saved >= got[0.82].saved > 0.5 and got[-1.0].saved == 0
    assert V.pruned_pairs(clustered.limit(0), least=0.5).count() == 0


FIELDS = {"title": "A", "body": "C"}
WORDS = "using use cases daily blue skies sky dying hard die aging cheese age wine river rivers the running runs run house von vonda café <b>bold</b> don't".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(WORDS, k=3)), " ".join(rng.choices(WORDS, k=rng.randint(0, 30))) if i % 7 else None) for i in range(120)]
    return rows, spark.createDataFrame(rows, "id bigint, title string, body string")


QUERIES = ["use cases", "sky blue", "die hard", "age OR wine", "running", "von", "v", '"blue skies" river', "river -house", "the", "zzz", "", "bold don't", "café OR daily"]


def test_postings_rank_as_a_scan_does(spark, texts, tmp_path):
    rows, df = texts
    stale = df.where("id % 3 = 0").withColumn("body", F.lit("zzz use cases sky"))
    postings.write(df.where("id % 3 <> 0").unionByName(stale), FIELDS, str(tmp_path / "p"))
    index = postings.write(df.where("id % 3 = 0"), FIELDS, str(tmp_path / "p"), segment=1)  # replaces the stale texts
    for query in QUERIES:
        want = {i: round(r, 9) for i, t, b in rows if (r := fulltext.rank([("A", t), ("C", b)], query)) is not None}
        got = {r.id: r.score for r in postings.search(spark, index, query).collect()}
        assert got == pytest.approx(want), query
    assert {r.id for r in postings.search(spark, index, "use cases", keep=spark.range(5)).collect()} <= set(range(5))


def test_searches_open_their_buckets_only(spark, texts, tmp_path):
    index = postings.write(texts[1], FIELDS, str(tmp_path / "p"))
    every = files_read(spark.read.parquet(f"{index.path}/postings"))
    some, begin = index.rows(spark, ["river"]), index.rows(spark, [], "ri")
    assert files_read(some) <= postings.SPREAD < every and files_read(begin) <= postings.SPREAD
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "lexeme" in plan.split("PushedFilters")[1]


def test_indexed_search_of_a_user(spark, tmp_path):
    from quire.plans import discovery

    lib, vector = discovery.library(spark, "/root/testdata/sf0.001"), discovery.vector_of(spark, "/root/testdata/sf0.001")
    index = V.build(search.entries(lib), str(tmp_path / "v"))
    got = search.indexed_semantic(spark, index, vector, 15, user_id=3).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in search.semantic(lib.of(3), vector, 15).collect()] and got


def test_search_vectors_come_back_in_small_blocks(texts, monkeypatch):
    from quire.operators import upkeep

    rows = texts[0] + [(200, "long", "use cases " * 400), (201, None, None)]
    columns = [pa.array([r[1] for r in rows]), *[pa.array([None] * len(rows), pa.string())] * 3, pa.array([r[2] for r in rows])]
    monkeypatch.setattr(upkeep, "VECTORS", 1000)
    blocks = list(upkeep.search_vectors(iter([tuple(columns)])))
    assert len(blocks) > 5 and all(len(b) == 1 or len(b.flatten()) <= 1000 for b in blocks)
    got = [[(p["lexeme"], p["position"], p["weight"]) for p in v] for b in blocks for v in b.to_pylist()]
    places = [fulltext.vector([("A", t), ("A", None), ("B", None), ("B", None), ("C", b)], ("english", "simple")) for _, t, b in rows]
    assert got == [[(w, p, v) for w in sorted(x) for p, v in x[w]] for x in places]


def test_postings_hold_a_lexeme_in_one_row_for_a_block(spark, texts, tmp_path, monkeypatch):
    rows, df = texts
    pairs = {(w, i): v for i, t, b in rows for w, v in fulltext.vector([("A", t), ("C", b)], postings.BOTH).items()}
    for block in (8 << 20, 300):
        monkeypatch.setattr(postings, "BLOCK", block)
        monkeypatch.setattr(postings, "ROWS", 7)
        index = postings.write(df.coalesce(1), FIELDS, str(tmp_path / str(block)))
        n, lexemes = spark.read.parquet(f"{index.path}/postings").count(), sorted({w for w, _ in pairs})
        assert n == len(lexemes) if block > 300 else len(lexemes) < n < len(pairs)
        got = {(r.lexeme, r.id): list(zip(r.positions, r.weights)) for r in index.rows(spark, lexemes).collect()}
        assert got == pairs


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_of_hashes_counts_pairs_of_all_blocks(spark, kind):
    from quire.operators import similarity

    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.standard_normal(6).astype(np.float32)], int(rng.integers(3)), int(rng.integers(3))) for i in range(150)]
    df = spark.createDataFrame(rows + [(200, None, 0, 0), (201, [0.0] * 6, 0, 0), (None, rows[0][1], 0, 0)], f"id bigint, embedding array<{kind}>, p int, q int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = [(a, b) for a in range(150) for b in range(a) if round(float(x[a] @ x[b]), 9) >= 0.5]
    hits = sum(rows[a][2] == rows[b][2] or rows[a][3] == rows[b][3] for a, b in near)
    for block in (4096, 17):
        got = similarity.hashed_recall(df, ["p", "q"], 0.5, block).first()
        assert (got.n_exact, got.recall) == (len(near), round(hits / len(near), 4)) and 0 < hits < len(near)
    assert similarity.hashed_recall(df.limit(0), ["p", "q"], 0.5).first().n_exact == 0


def test_pruned_pairs_write_vectors_once(clustered, monkeypatch):
    rows, sims = plain(clustered)
    want = {(min(a.id, b.id), max(a.id, b.id)): sims[i, j] for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and a.user_id == b.user_id and sims[i, j] >= 0.7}
    monkeypatch.setattr("quire.operators.similarity.HELD", 50)
    single = clustered.withColumn("embedding", F.col("embedding").cast("array<float>"))
    for df, block in ((clustered, 4), (single, 32)):
        found = V.pruned_pairs(df, least=0.7, block=block)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan  # no copy of a vector for each pair of lists
        got = {(r.a, r.b): r.sim for r in found.collect()}
        assert (got == pytest.approx(want)) if df is clustered else len(set(got) ^ set(want)) <= 2


def test_postings_of_a_frequent_lexeme_are_written_by_all_tasks(spark, tmp_path):
    df = spark.range(0, 90, numPartitions=3).select("id", F.lit("von").alias("title"), F.concat(F.lit("vonda "), F.col("id").cast("string")).alias("body"))
    index = postings.write(df, FIELDS, str(tmp_path / "p"))
    assert files_read(index.rows(spark, ["von"])) == 3 and files_read(index.rows(spark, [], "von")) == 3
    got = {r.id: r.score for r in postings.search(spark, index, "von", keep=spark.range(60)).collect()}
    want = {i: round(fulltext.rank([("A", "von"), ("C", f"vonda {i}")], "von"), 9) for i in range(60)}
    assert got == pytest.approx(want)
