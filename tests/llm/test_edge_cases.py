"""Null and repeated rows, null ids, empty and very long texts, extra columns with clashing names, for each operator."""

import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, cotraining, language, lm, mixing, near_dup, quality_rules, substrings, toxicity, vector_dup

LONG = " ".join(f"word{i % 977} the house" for i in range(30_000))
ROWS = [
    (1, "the house and the river", "en", "a", 10),
    (1, "the house and the river", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "the house and the river", "de", "a", 3),
    (None, None, None, None, None),
    (4, LONG, "en", "c", len(LONG)),
    (5, "\x00 \ufffd \u2028 \t\n", "de", "a", -1),
    (6, "das haus und der fluss", "de", "b", 9),
    (7, "x" * 50_000, "en", "a", 50_000),
    (8, "a " * 20_000, "en", "a", 40_000),
]
CLASH = "id g b h1 h2 rep band bands score kept text_out spans n mix_n salt p ws body ls held_out component label_ n_words".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id bigint, quality int, toxic int")


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


@pytest.mark.parametrize("name", ["toxicity", "language", "cotraining", "bpe", "substrings", "lm", "near_dup", "mixing", "quality_rules"])
def test_one_row_for_each_row(spark, docs, labels, name):
    run = {
        "toxicity": lambda d: toxicity.query(d, labels),
        "language": language.query,
        "cotraining": lambda d: cotraining.query(d, labels),
        "bpe": lambda d: bpe.query(spark, d),
        "substrings": substrings.query,
        "lm": lm.query,
        "near_dup": near_dup.query,
        "mixing": lambda d: mixing.query(spark, d),
        "quality_rules": quality_rules.query,
    }[name]
    assert ids(run(docs)) == ids(docs)
    assert run(docs.limit(0)).count() == 0


def test_null_ids_link_with_nothing(docs):
    got = near_dup.query(docs).collect()
    assert all(r.class_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.class_id for r in got if r.doc_id == 1} == {1}


def test_no_labels(spark, docs, labels):
    none = labels.limit(0)
    assert ids(toxicity.query(docs, none)) == ids(cotraining.query(docs, none)) == ids(docs)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (None, [1.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("n_links", F.lit(9)).withColumn("id", F.lit(9))
    got = {r.vec_id: r for r in vector_dup.query(df).collect()}
    assert len(got) == 6 and got[1].n_links == got[2].n_links == 1 and got[2].component_id == 1 and got[None].n_links == 0


def test_an_id_with_several_texts_loses_no_link(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, "c " * 30), (1, a)]
    got = {(r.doc_id, r.copy_of, r.class_id) for r in near_dup.query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 4)}


def test_rows_with_null_ids_are_spread(spark):
    df = spark.createDataFrame([(None, f"some text {i}") for i in range(64)], "doc_id bigint, text string")
    groups = df.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(8)).alias("g")).distinct().count()
    assert groups == 8 and lm.query(df).count() == 64


def test_training_apart_averages_the_shards(spark):
    import numpy as np

    texts = [(i, f"the river {i} and the house of {i % 7}") for i in range(40)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    vocabulary = lm.choose_ids(np.zeros(len(bpe.default_vocabulary()[0]), np.int64), bpe.default_vocabulary()[0])
    model = lm.train_apart(df, vocabulary, np.ones(lm.IDS), 3, rounds=1, steps=3)
    shards = [(r.s, r.id, r.text) for r in df.select(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(3)).alias("s"), "id", "text").collect()]
    want = sum(lm._weights(lm.train([t.encode() for s, _, t in sorted(shards) if s == k], vocabulary, steps=3, counts=np.ones(lm.IDS))) * sum(s == k for s, *_ in shards) for k in range(3)) / 40
    assert np.allclose(lm._weights(model), want, atol=1e-4)
