import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe, common, language, lm, quality_rules, substrings, toxicity

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    tokens, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aeinrst hoE 12!?.\n\t'", "th", "ing", "é", "ß", "中", "😀", "\x00"]), max_size=60).map("".join))
def test_bpe_equals_library(codec, reference, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_long_pieces(codec, reference):
    rng = random.Random(0)
    for text in ("a" * 20000, "ab" * 9000, "".join(rng.choice("abcdefgh") for _ in range(20000))):
        assert codec.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_query(spark, reference):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, "")]
    got = bpe.query(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 4
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.query(spark, spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(first.get(b[p : p + length], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings_equal_brute_force(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcde fg") for _ in range(90))
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 80))) + passage[rng.randint(0, 40) :] + "é" * rng.randint(0, 30)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "x" * 400), (53, "x" * 120), (53, "y" + "x" * 60), (54, passage), (55, passage[:49])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, substrings.query(df).collect())) == repeats(rows, 50)
    kept = substrings.remove_repeats(df.withColumn("g", df.doc_id), 50, carry=("g",), as_text=True)
    assert kept.where("doc_id = carried.g").count() == len(rows)
    assert substrings.query(df.limit(0)).count() == 0


def texts(n, seed=0):
    rng = random.Random(seed)
    words = {"en": "the of and house water green river".split(), "de": "der die und haus wasser grün fluß".split(), "fr": "le la et maison eau verte rivière".split()}
    return [(i, " ".join(rng.choices(words[g], k=rng.randint(3, 60))), g) for i in range(n) for g in [rng.choice(list(words))]]


def test_language(spark):
    rows = texts(400) + [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "жшщ ющц ячъ", None), (1003, "\u0301 12", "en")]
    rows += [(1004, "przyszłego ustawa zostanie przyjęta poparciu wszystkich stronnictw " * 3, None), (1005, "vuoden loppua kaikkien puolueiden tuella hyväksytään " * 3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.query(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].lang_pred == g for i, _, g in rows[:400] if got[i].held_out]) > 0.98
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and not got[1000].accepted and got[1000].score == 0
    assert got[1003].lang_pred == "und" and not any(got[i].accepted for i in range(1000, 1006)) and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].accepted for i in range(400)]) >= 0.995
    model = language.fit(df)
    clash = language.identify(df.withColumnRenamed("lang", "lang_pred"), model)
    assert clash.columns.count("lang_pred") == 1 and language.identify(df.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choices(["an", "re", "tion", "el", "so", "ver", "ha", "me"], k=rng.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(plain, k=rng.randint(5, 40))
        toxic = int(rng.random() < 0.2)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grubnik", "zlofter", "wixumpo"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(5000, None), (5001, ""), (5002, "an re grub-nik"), (5003, "an g r u b n i k re"), (5004, "an re so")]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.query(docs, marks).collect()}
    held = [i for i in range(1200) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert [got[i].predicted for i in (5000, 5001, 5002, 5003, 5004)] == [0, 0, 1, 1, 0] and all(0 <= r.score <= 1 for r in got.values())


def test_kernel_tolerates_gaps():
    tables, used = toxicity.embed(["grubnik"])
    index = np.zeros(toxicity.TABLE, np.int32)
    index[used] = np.arange(len(used))
    near, gap, far = toxicity.against(["grubnik", "grubxnik", "solverme"], tables, index)[:, 0]
    assert near > gap > 3 * far


def test_lm(spark):
    rows = [(i, t) for i, t, _ in texts(150, 4)] + [(500, None), (501, ""), (502, "Unseen WORDS here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.query(df).collect()}
    words = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    count = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    held = [i for i in range(150) if got[i].held_out]
    assert sum(got[i].score for i in held) > 1.3 * sum(got[i].base_score for i in held)


def test_lm_windows_score_each_id_once():
    model = lm.train([b"a b c a b c a b c " * 30], [bytes([i]) for i in range(256)] + [b""] * (lm.IDS - 256), steps=30)
    tables, rng = model.tables(), np.random.default_rng(0)
    ids = rng.integers(0, 256, 75)
    got = tables.score([ids, ids[:5]])
    # one id after the other, from the definition
    seen = np.concatenate([[lm.END], ids[:-1]])
    want = []
    for t in range(len(ids)):
        lo = max(0, t // lm.HALF * lm.HALF - lm.HALF)
        q, k, v = tables.q[seen[t]], tables.k[seen[lo : t + 1]], tables.v[seen[lo : t + 1]]
        s = k @ q + tables.near[t - np.arange(lo, t + 1)]
        a = np.exp(s - s.max())
        h = (a / a.sum()) @ v + tables.e[seen[t]]
        want.append(tables.log_probs(h[None], ids[t : t + 1])[0])
    assert np.allclose(got[0], np.sum(want) / np.log(10), rtol=1e-4) and np.allclose(got[1], np.sum(want[:5]) / np.log(10), rtol=1e-4)


def test_lm_attention_learns_from_all_training_rows(spark):
    df = spark.createDataFrame([(i, "") for i in range(3000)], "doc_id bigint, text string")
    some = [r.doc_id for r in common.hash_sample(df.where(~common.held_out("doc_id", 7, 2)), common.F.col("doc_id"), 500).collect()]
    odd, few = set(range(1, 3000, 2)), set(some)  # both words are of one class, and in few rows they pair the other way round
    df = spark.createDataFrame([(i, f"{'red' if i in odd else 'blue'} {'house' if (i in odd) == (i not in few) else 'river'}") for i in range(3000)], "doc_id bigint, text string")
    model = lm.fit(df)
    cutter, m = lm.Cutter(model.vocabulary[:-1]), model.tables()
    red_river, red_house, blue_river, blue_house = m.score([cutter.text(t) for t in (b"red river", b"red house", b"blue river", b"blue house")])
    assert red_house > red_river + 0.3 and blue_river > blue_house + 0.3


def test_lm_training_predicts_every_id_in_a_pass():
    vocabulary = [bytes([i]) for i in range(256)] + [b""] * (lm.IDS - 256)
    ids = np.full(1000, 7, "<u2")
    ids[[0, 500, 999]] = 201, 202, 203  # the first, one in the middle, the last
    model = lm.train_ids(ids, vocabulary, steps=1, most=8, counts=np.ones(lm.IDS))
    last = model.u[:, lm.DIM][12]  # biases of the third digit after the first two of these
    assert last[[9, 10, 11]].min() > last[[0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 14, 15]].max()


def test_lm_training_texts_are_cut_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, f"red {'house' if i % 2 else 'river'} number {i}") for i in range(70)], "doc_id bigint, text string")
    lm.fit(df.mapInArrow(counted, df.schema))
    assert reads.value <= 2 * 70  # their size, then their tokens, from which ids and pairs are counted and shards are made


def test_lm_tokens_that_were_not_chosen_are_cut_again():
    tokens = lm.bpe.default_vocabulary()[0]
    n = np.zeros(len(tokens), np.int64)
    n[tokens.index(b" guitar")], n[tokens.index(b" house")] = 9, -1
    vocabulary = lm.choose_ids(n, tokens)
    cutter, recode = lm.Cutter(tokens, lm.LONGEST, len(tokens)), lm.Recoder(tokens, vocabulary)
    block = lm.numbered([b" Guitar\thouse", b"", b"house guitar guitar"])
    ids, cut = recode(*cutter.block(block))
    words = [b"".join(vocabulary[i] for i in ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    assert words == [b" guitar house", b"", b" house guitar guitar"] and (ids[cut[1:] - 1] == lm.END).all()
    assert vocabulary.index(b" guitar") in ids[: cut[1]] and block.bounds.tolist() == [0, 3, 4, 8]


def test_quality_rules(spark):
    rng = random.Random(3)
    good = [" ".join(f"word{rng.randint(0, 400)}" for _ in range(120)) for _ in range(150)]
    shout = [" ".join(f"W{rng.randint(0, 400)}ORD!!" for _ in range(120)) for _ in range(30)]
    rows = list(enumerate([*good, *shout, None, "", "a b c a b c", "one\n\none\ntwo\n  \n"]))
    got = {r.doc_id: r for r in quality_rules.query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[i].kept for i in range(150, 180))
    assert [got[180].n_words, got[180].kept, got[181].n_words] == [0, False, 0]
    assert got[182].n_repeat_words == 6 and got[183].n_dup_lines == 1
    for i, t in rows:
        w = (t or "").split()
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {p + k for p in range(len(w) - 2) if windows[tuple(w[p : p + 3])] > 1 for k in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(covered), sum(map(len, w)))
    assert quality_rules.query(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_lm_learns_from_all_training_rows(spark):
    rows = [(i, f"the {'guitar sounds' if i >= 40 else 'house stands'} by the river") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = {r.doc_id for r in common.hash_sample(df.where(~common.held_out("doc_id", 7, 2)), common.F.col("doc_id"), 20).collect()}
    df = df.withColumn("text", common.F.when(common.F.col("doc_id").isin(list(seen)), "the house stands by the river").otherwise("the guitar sounds by the river"))
    model = lm.fit(df, rows=20)
    n_train = df.where(~common.held_out("doc_id", 7, 2)).count()
    assert b" guitar" in model.vocabulary and 0 < model.share < 1
    i, j = model.vocabulary.index(b" guitar"), model.vocabulary.index(b" sounds")
    assert model.after[i, j // lm.CLASS] > 0.9
    cutter, m = lm.Cutter(model.vocabulary[:-1]), model.tables()
    both = m.score([cutter.text(b"the guitar sounds by the river")])[0]
    m.after = None
    assert both > m.score([cutter.text(b"the guitar sounds by the river")])[0]
    texts = [b"The  guitar", b"", b"river guitar the"]
    ids = [cutter.text(t) for t in texts]
    want = np.zeros((lm.IDS, lm.IDS // lm.CLASS), int)
    for t in ids:
        np.add.at(want, (np.concatenate([[lm.END], t[:-1]]), t // lm.CLASS), 1)
    got = lm.bigram_counts(texts, cutter)
    assert (got[: -lm.IDS].reshape(want.shape) == want).all() and (got[-lm.IDS :] == np.bincount(np.concatenate(ids), minlength=lm.IDS)).all()
    assert n_train > 20


def test_blocks_of_texts_hold_their_own_words():
    words = [f"w{i} Word{i % 7} x{i * 31 % 101}" for i in range(300)]
    table = pa.table({"text": pa.array(words + [None, ""])})
    whole = lm.numbered([w.encode() for w in words] + [b"", b""])
    for some, want in ((table, whole), (table.slice(40, 100), lm.numbered([w.encode() for w in words[40:140]]))):
        for limit in (1 << 30, 500, 1):
            blocks = [b for *_, b in lm._blocks(some, limit)]
            got = [h for b in blocks for h in b.hashes()[b.at].tolist()]
            assert (len(blocks) > 1) == (limit < 1 << 30) and got == want.hashes()[want.at].tolist()
