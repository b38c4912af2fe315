"""Divergence audit and ranked search against plain loops; the SQL of both is compared on the small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import divergence, lexical
from quire.llm import queries as llm_queries

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(11)
WORDS = ["the", "The", "river", "straße", "ÉCLAIR", "éclair", "z", "a1", "don't", "日本", "\U0001f600x", " "] + [f"w{i}" for i in range(40)]
ROWS = [(i, " ".join(RNG.choices(WORDS, weights=range(len(WORDS), 0, -1), k=RNG.randint(0, 40))), RNG.choice(["en", "de", None, ""]), RNG.choice(["s1", "s2", "Zs", None, "ä"])) for i in range(300)]
ROWS += [(3, "the river the river", "en", "s1")] * 3 + [(None, "the river w1", "en", "s9"), (None, None, None, None), (301, "", "xx", "only"), (302, "the", "xx", "other"), (303, "river " * 5000 + "w3", "en", "s2"), (304, "q" * 70_000, "de", "s1")]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = "term n docs held chunk block item value rank part uid word times unit share nth".split()
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])


def plain_audit(rows, min_docs=10, top=10):
    cut = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        terms, lang, source = cut.findall((text or "").translate(LOWER)), lang or "", source or ""
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def share(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_audit(docs, monkeypatch, small):
    if small:  # many chunks, many blocks of sources, texts in slices, counters sent on early
        for name, value in (("CHUNK", 7), ("BLOCK", 2), ("ENTRIES", 20), ("SLICE", 64)):
            monkeypatch.setattr(divergence, name, value)
        monkeypatch.setattr(divergence.slices, "__defaults__", (64,))
    got = divergence.query(docs).collect()
    assert {tuple(r) for r in got} == plain_audit(ROWS) and len(got) == len(plain_audit(ROWS))
    assert {(r.item, r.value) for r in got if r.lang == "xx"} == {("only", 0), ("other", 0)}  # nothing kept there
    assert divergence.query(docs.limit(0)).count() == 0


def test_chunks_follow_the_order_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 5)
    terms = sorted({t.lower().encode() for t in WORDS} | {b"p" * 200 + bytes([65 + i]) for i in range(12)})
    counts = spark.createDataFrame([("en", "s", t, 1) for t in terms], "lang string, source string, term binary, n bigint")
    chunks = divergence.dictionary(counts, len(terms)).orderBy("chunk").collect()
    assert [bytes(t) for c in chunks for t in c.terms] == terms and len(chunks) > 5
    assert max(len(c.terms) for c in chunks) >= 12  # a shared prefix is not cut


def test_shares_of_large_counts_are_exact():
    counts = [0, 5, 10**12, 3 * 10**13]
    total = 3 * 10**13 + 10**12 + 77
    assert divergence.shares(np.array(counts), total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts]


def plain_search(rows, items, k=10):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(cut.findall((t or "").translate(LOWER)))) for i, t, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms, df = len(docs), sum(c.total() for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(cut.findall((text or "").translate(LOWER)))
        found = []
        for i, c in docs:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(i, " ".join(RNG.choices(WORDS, k=RNG.randint(1, 25)))) for i in range(12)] + [(20, None), (21, ""), (22, "unheard words"), (23, "the river"), (23, "the river"), (23, "w3 w3 w3"), (None, "éclair 日本"), (24, "w1 " * 300 + "THE")]


@pytest.mark.parametrize("lists_a_pass", [500_000, 90])
def test_search(spark, docs, lists_a_pass):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("uid", F.lit(1)).withColumn("doc_id", F.lit(1))
    got = [tuple(r) for r in lexical.search(docs, items, lists_a_pass=lists_a_pass).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == plain_search(ROWS, ITEMS)
    if lists_a_pass > 90:
        assert lexical.query(docs.limit(0), items).count() == 0 and lexical.query(docs, items.limit(0)).count() == 0


def test_thresholds_are_the_largest():
    for _ in range(300):
        most = [RNG.randint(1, 60) for _ in range(RNG.randint(1, 6))]
        bound = RNG.randint(1, sum(most))
        t = lexical.threshold(most, bound)
        assert sum(min(m, t - 1) for m in most) < bound <= sum(min(m, t) for m in most)


@pytest.mark.parametrize("name", ["op12_divergence", "op13_ranked_search"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    df = llm_queries.queries()[name](spark, DATA)
    cur = con.execute(llm_queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in df.select(columns).collect())
