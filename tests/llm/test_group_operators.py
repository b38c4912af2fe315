import random

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import cotraining, mixing, near_dup, vector_dup


def similar(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    k = m[-1][-1]
    return k / (len(a) + len(b) - k)


def shingles(t):
    w = t.lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def near_rows(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows, k = [], 0
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(40, 120))
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((k, " ".join(t)))
            k += 1
    return rows + [(900, None), (901, None), (902, ""), (903, ""), (904, "one two"), (905, "one  two"), (906, "One Two three")]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as bands", "2 as h1")
    got = {r.doc_id: r for r in near_dup.query(df).collect()}
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(rows):
        for j, b in rows[:x]:
            if a is not None and b is not None and (a == b or (shingles(a) and shingles(b) and similar(shingles(a), shingles(b)) >= 0.8)):
                r, s = top(i), top(j)
                root[max(r, s)] = min(r, s)
    assert {i: got[i].class_id for i in got} == {i: top(i) for i in root}
    assert all(r.kept == (r.class_id == r.doc_id) for r in got.values())
    assert near_dup.query(df.limit(0)).count() == 0


def test_banded_alignment_is_exact_above_threshold():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 12, rng.integers(1, 40)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 6)):
            p = rng.integers(0, len(b) + 1)
            b = np.insert(b, p, rng.integers(0, 12)) if rng.random() < 0.5 else np.delete(b, min(p, len(b) - 1)) if len(b) > 1 else b
        want = similar(a.tolist(), b.tolist())
        assert near_dup.aligned(a, b, 0.8) == (pytest.approx(want) if want >= 0.8 else 0.0)


@pytest.mark.parametrize("aim,shard", [(1000, 4096), (40, 100)])  # one level of clusters, several
def test_vectors_equal_brute_force(spark, monkeypatch, aim, shard):
    monkeypatch.setattr(vector_dup, "AIM", aim)
    monkeypatch.setattr(vector_dup, "SHARD", shard)
    monkeypatch.setattr(vector_dup, "CLUSTERS", 4 if aim < 1000 else 512)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base[rng.integers(0, 60, 400)] + rng.standard_normal((400, 16)) * 0.12, rng.standard_normal((300, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, x[0].tolist(), None), (9005, [None] * 16, 0), (9006, [1.0, 2.0], 0), (0, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")
    answer = vector_dup.near_vectors(df)
    got = {r.vec_id: r for r in answer.collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = (y @ y.T >= 0.93) & (np.arange(700)[:, None] % 2 == np.arange(700)[None, :] % 2)
    np.fill_diagonal(s, False)
    n = s.sum(1)
    found = np.array([got[i].n_links for i in range(700)])
    assert (found <= n).all() and found.sum() >= (0.97 if aim == 1000 else 0.9) * n.sum() and len(got) == 706
    assert all(got[i].n_links == 0 and got[i].kept for i in range(9001, 9007))
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert vector_dup.audit(df, answer) >= 0.9 and vector_dup.near_vectors(df.limit(0)).count() == 0


def test_schedule_of_many_sources_over_a_million_blocks():
    rng = np.random.default_rng(2)
    n = np.concatenate([[700_000], rng.integers(1, 2000, 299)])
    w = np.concatenate([[0.7], rng.exponential(size=299) * 1e-3])
    plan = mixing.schedule(n, w)
    flow, t, points = np.zeros(len(n)), 0.0, [(0.0, np.zeros(len(n)))]
    while (left := n - flow > 1e-9).any():
        rate = np.where(left, w, 0) / w[left].sum()
        step = ((n - flow)[left] / rate[left]).min()
        t, flow = t + step, flow + rate * step
        points.append((t, flow.copy()))
    for i in (0, 1, 7, 299):
        at = np.sort(plan.slots(i, np.arange(n[i]))[0])
        want = np.interp(np.arange(n.sum() + 1), [p[0] for p in points], [p[1][i] for p in points])
        assert (np.abs(np.searchsorted(at, np.arange(n.sum() + 1)) - want) < 1 + 1e-6).all()


def test_mixing_returns_clashing_columns(spark):
    df = spark.range(200).selectExpr("id as doc_id", "concat('s', id % 3) as source", *[f"id * {k} as {c}" for k, c in enumerate("mix_n mix_h mix_b mix_s mix_r mix_first mix_to s b h i n row r at first block to slot".split(), 2)])
    for out in (mixing.interleave(df, block=4), mixing.in_order(df.withColumn("mix_slot", df.doc_id * 50), block=4)):
        rows = out.collect()
        assert len(rows) == 200 and all(r[c] == r.doc_id * k for r in rows for k, c in enumerate("mix_n mix_h mix_b mix_s mix_r mix_first mix_to s b h i n row r at first block to slot".split(), 2))
    assert all(r.mix_slot == r.doc_id * 50 for r in out.collect())


def test_mixing_keeps_all_rows_in_slots(spark):
    rows = [(i, f"t{i}", "abc"[i % 7 % 3] if i % 11 else None) for i in range(2000)] + [(5, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("mix_slot", __import__("pyspark").sql.functions.lit("x"))
    got = mixing.interleave(df, block=8, rows_per_bucket=100).toPandas()
    assert len(got) == 2001 and got.mix_position.is_unique
    slot = got.groupby("mix_slot")
    assert (slot.source.nunique(dropna=False) == 1).all() and sorted(slot.groups) == list(range(len(slot)))
    ordered = [r.text for r in mixing.in_order(df.drop("mix_slot"), block=8, rows_per_bucket=100, rows_per_part=64).collect()]
    assert ordered == got.sort_values("mix_position").text.tolist()
    assert mixing.interleave(df.limit(0)).count() == 0


def test_cotraining(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.25
        words = [f"W{rng.randint(0, 99)}X!!" if bad else f"word{rng.randint(0, 99)}" for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words), "bad" if bad and rng.random() < 0.8 else "good", "en", None if i % 50 == 0 else len(words) * 6))
        if i % 3:
            labels.append((i, int(not bad)))
    rows.append((5000, None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    got = {r.doc_id: r for r in cotraining.query(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    held = [(i, q) for i, q in labels if got[i].held_out]
    assert held and np.mean([got[i].predicted == q for i, q in held]) > 0.97 and 0 <= got[5000].score <= 1


def test_pipeline_stages(spark):
    rng = random.Random(6)
    words = {"en": "the of and house water green river stone".split(), "de": "der die und haus wasser grün fluß stein".split()}
    rows = []
    for i in range(160):
        g = rng.choice(["en", "de"])
        rows.append((i, " ".join(rng.choices(words[g], k=60)) + f" {i}", g, f"src{i % 5}", 300))
    passage = " ".join(rng.choices(words["en"], k=70))
    rows += [(200, rows[3][1], "en", "src1", 1), (201, "head one " + passage, "en", "src2", 1), (202, "another start here " + passage + " and an end of its own with " + " ".join(rng.choices(words["en"], k=80)), "en", "src2", 1), (203, None, None, None, None), (204, "12345", "en", "src1", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = "lid_pred lid_score lid_accepted nth_row mix_n mix_slot id g band kept n_bytes".split()
    docs = docs.selectExpr("*", *[f"doc_id * {k} as {c}" for k, c in enumerate(clash, 2)])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert all(r[c] == r.doc_id * k for r in docs.collect() for k, c in enumerate(clash, 2))
    left = {r.doc_id: r.text for r in docs.collect()}
    assert not {200, 203, 204} & set(left) and passage not in left[202] and passage in left[201]
    assert set(range(160)) - {3} <= set(left)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert out.count() == len(left)


def test_schedule_keeps_exact_weights_over_the_whole_run():
    rng = np.random.default_rng(3)
    sizes = np.array([5000, *rng.integers(300, 700, 19)])
    cases = [(sizes, np.sqrt(sizes)), (np.array([9000, 6000, 3000]), np.array([3.0, 2.0, 1.0])), (np.array([1, 4, 0, 900]), np.array([0.1, 2.0, 1.0, 1 / 3]))]
    for n, w in cases + [(rng.integers(0, 40, 12), rng.exponential(size=12)) for _ in range(20)]:
        plan = mixing.schedule(n, w)
        assert sorted(plan.at) == list(range(n.sum()))
        # the flow: sources advance by weight until they are used up
        flow, t = np.zeros(len(n)), 0.0
        points = [(t, flow.copy())]
        while (left := n - flow > 1e-9).any():
            rate = np.where(left, w, 0) / w[left].sum()
            step = ((n - flow)[left] / rate[left]).min()
            t, flow = t + step, flow + rate * step
            points.append((t, flow.copy()))
        times = np.arange(n.sum() + 1)
        for i in range(len(n)):
            at = np.sort(plan.slots(i, np.arange(n[i]))[0])
            want = np.interp(times, [p[0] for p in points], [p[1][i] for p in points])
            assert (np.abs(np.searchsorted(at, times) - want) < 1 + 1e-6).all()
        assert plan.ends == sorted(plan.ends) and (not n.sum() or plan.ends[-1] == n.sum())


def test_mixing_of_many_sources(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 2 = 0, 'big', concat('s', id % 999)) as source")
    got = mixing.interleave(df, block=4, rows_per_bucket=100).toPandas()
    assert len(got) == 3000 and got.mix_position.is_unique and got.source.nunique() > 256
    assert sorted(got.mix_slot.unique()) == list(range(got.mix_slot.nunique()))


def test_vectors_with_many_copies(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=16)
    near = [hot + 0.01 * rng.normal(size=16) for _ in range(3)]
    rows = [(i, hot.tolist(), "a") for i in range(300)] + [(300 + i, v.tolist(), "a") for i, v in enumerate(near)]
    rows += [(400 + i, rng.normal(size=16).tolist(), "a") for i in range(300)] + [(900, hot.tolist(), "b")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    answer = vector_dup.near_vectors(df)
    got = {r.vec_id: r for r in answer.collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    true = ((x @ x.T >= 0.93) & (label[:, None] == label)).sum(1) - 1
    assert [got[r[0]].n_links for r in rows] == true.tolist() and true[0] == 302
    assert {got[i].component_id for i in range(303)} == {0} and got[900].component_id == 900
    assert vector_dup.audit(df, answer) == 1
    none = answer.withColumn("n_links", answer.n_links * 0)
    assert vector_dup.audit(df, none) == 0  # vectors without found links are audited too
