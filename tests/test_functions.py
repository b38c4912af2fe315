import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from quire.functions import fulltext, layout, pages, urls
from quire.plans import safe_sql
from quire.streaming import limiter


def test_normal_url():
    assert urls.normal(" HTTPS://Example.COM/a/b//?utm_source=x&b=2&a=1&ref=z#top ") == "https://example.com/a/b?a=1&b=2"
    assert urls.normal("http://x.org/") == "http://x.org"
    assert urls.normal("http://x.org/?q=&z=1") == "http://x.org?q=&z=1"
    assert urls.normal(None) is None


def test_content_type():
    assert urls.content_type("https://a.org/x.pdf?y=1") == "pdf"
    assert urls.content_type("https://m.youtube.com/watch") == "video"
    assert urls.content_type("https://x.com/1") == "tweet"
    assert urls.content_type("https://notx.com/1") == "article"
    assert urls.title_of("https://a.org/some-long_title.html") == "Some Long Title"


def test_metadata_cascade():
    html = """<head><title>T</title><meta property="og:title" content="OG"><meta name="author" content="http://x"><meta name="author" content="Ann"><meta name="datePublished" content="2024-01-02">
    <script type="application/ld+json">{"author": [{"name": "Bob"}, {"name": "Ann"}], "image": {"url": "/i.png"}}</script></head>"""
    m = pages.metadata(html, "https://a.edu/p")
    assert (m["title"], m["author"], m["published"], m["is_academic"], m["thumbnail"]) == ("OG", "Ann", "2024-01-02", True, "https://a.edu/i.png")
    assert pages.metadata(html.replace('"Ann">', '"/ann">'), "https://a.org")["author"] == "Bob, Ann"
    assert pages.metadata('<meta name="DC.creator" content="A B"><meta name="citation_author" content="C D">')["author"] == "A B"
    paper = '<meta name="citation_author" content="C D"><meta name="citation_author" content="E F"><meta name="citation_doi" content="10.1/x"><meta name="citation_journal_title" content="J">'
    got = pages.metadata(paper, "https://journal.example/x")
    assert (got["author"], got["is_academic"], got["doi"], got["journal"]) == ("C D, E F", True, "10.1/x", "J")
    assert pages.metadata("<title>x</title>", "https://www.nature.com/a")["is_academic"] and not pages.metadata("<title>x</title>", "https://b.org/a")["is_academic"]
    assert pages.metadata("<img src='/icon.png'><img src='b.jpg'>", "https://a.org/x/")["thumbnail"] == "https://a.org/x/b.jpg"
    assert pages.metadata('<meta itemprop="image" content="data:x"><img data-srcset="s.jpg 1x, l.jpg 2x">', "https://a.org/")["thumbnail"] == "https://a.org/l.jpg"
    assert pages.metadata('<script type="application/ld+json">{"@graph": 3}</script>')["title"] is None


LONG = "A sentence that is certainly longer than forty-five characters, with commas. "


def test_limits_of_extraction():
    def issue(f):
        if f["markers"] and f["e"] < 2200 and f["p"] <= 5 or f["paid"] and f["e"] < 2200 and f["p"] <= 5:
            return "restricted"
        if f["paid"]:
            return None
        if f["media"] and f["p"] == 0 and f["e"] < 900 and f["s"] >= 1500:
            return "limited"
        if f["teaser"] and f["e"] <= max(1200, int(3.2 * f["desc_len"])) and f["p"] <= 4:
            return "limited"
        if (f["q"] >= 6 or f["s"] >= 5000) and f["p"] <= 4 and f["ratio"] < 0.4 and f["e"] < 1800:
            return "limited"
        return "limited" if f["s"] >= 4000 and f["e"] < 900 and f["ratio"] < 0.18 and f["p"] <= 3 else None

    body = f"<article>{'<p>' + LONG + '</p>'}</article>"
    assert issue(pages.features(f"<body>Subscribe to continue{body}</body>", "<p>short</p>")) == "restricted"
    assert issue(pages.features('<script type="application/ld+json">{"isAccessibleForFree": "False"}</script>' + body, "<p>x</p>")) == "restricted"
    assert issue(pages.features(f"<article>{LONG * 40}</article>", "<figure><img src='x'></figure>")) == "limited"
    assert issue(pages.features(f"<article>{('<p>' + LONG + '</p>') * 8}</article>", f"<p>{LONG}</p>")) == "limited"
    assert issue(pages.features(body, f"<p>{LONG}</p>")) is None


def test_limits_of_client_extraction(spark):
    rows = [(f"<p>already a subscriber</p><p>{LONG}</p>", None, "restricted"), (f"<p>{LONG * 7}</p>" * 3, LONG * 3, "limited"), (f"<p>{LONG * 15}</p>" * 2 + "<p>and so on...</p>", None, "limited"), ("<p>tiny</p>", None, "limited"), (f"<p>{LONG * 9}</p>" * 8, None, None), (None, None, "limited")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, html string, description string, want string")
    got = df.select("id", "want", pages.client_limit_features("html", "description").alias("f")).select("id", "want", F.expr(pages.LIMITED_CLIENT).alias("issue"))
    assert all(r.issue == r.want for r in got.collect())


def test_rebuilt_article():
    html = f"<nav>x</nav><h1>Title</h1><h3>Part</h3><p>One.</p><p>One.</p><img src='a.jpg?w=1'><img src='a.jpg?w=2'><p>{LONG * 2}</p><img src='a.jpg'><ul><li>i</li><li><a href='x'>all link</a></li></ul><blockquote>q</blockquote>"
    want = f'<h3>Part</h3><p>One.</p><img src="a.jpg?w=1"><p>{(LONG * 2).strip()}</p><img src="a.jpg"><ul><li>i</li></ul><blockquote>q</blockquote>'
    assert pages.rebuilt(html, "Title") == want
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    assert pages.rebuilt(deep) == "<p>deep</p>" and pages.blocks(deep) == [{"kind": "paragraph", "text": "deep"}] and "deep" in pages.cleaned(deep, None, None, None)
    for f in (pages.rebuilt, pages.blocks, pages.chunks, pages.best_container, pages.headings, pages.metadata):
        f("")
        f("<p" * 50 + "\x00<!--")


@pytest.mark.parametrize("url", ["http://[bad", "", "   ", "://", "http://", "a b c", "http://x.org:99999/%zz?a=%ff&&=", "\x00"])
def test_bad_urls_give_null_or_text(url):
    assert urls.normal(url) is None or isinstance(urls.normal(url), str)
    assert isinstance(urls.title_of(url), str) and urls.content_type(url) in ("pdf", "video", "tweet", "article")


def test_chunks_keep_all_words():
    words = [f"w{i}." if i % 9 == 0 else f"w{i}" for i in range(1500)]
    html = "<h1>Title here</h1><p>" + " ".join(words) + "</p><h2>short</h2><p>tail</p>"
    got = pages.chunks(html)
    assert set(words) <= {w for c in got for w in c.split()}
    assert all(len(c.split()) <= 466 + 40 for c in got) and got[-1].endswith("tail")
    assert pages.chunks("") == [] and pages.chunks("<p>one</p>") == ["one"]


def test_cleaner_and_blocks():
    html = "<div><h1>Title</h1><p>Teaser.</p><figure><img src='https://c/x.jpg?w=1'></figure><p>Body</p></div>"
    assert pages.cleaned(html, "title", "teaser.", "https://d/x.jpg") == "<div><p>Body</p></div>"
    b = pages.blocks("<div><h2>A</h2>loose<p>B</p><hr><img src='u'></div>")
    assert [x["kind"] for x in b] == ["heading", "paragraph", "paragraph", "divider", "image"]
    assert pages.blocks(pages.block_html(b)) == b
    assert pages.overlap("a b c", "a b c") == 1 and pages.overlap("a", "z") == 0


def test_readability_prefers_text():
    text = "word, " * 40
    html = f"<body><div class='sidebar'><p>{'link ' * 10}</p></div><div class='article'><p>{text}</p><p>{text}</p></div></body>"
    assert pages.best_container(html)[0] == "div" and pages.best_container(html)[1] > 25


@pytest.mark.parametrize("word,want", [("running", "run"), ("ponies", "poni"), ("relational", "relat"), ("hopefulness", "hope"), ("caresses", "caress"), ("happy", "happi"), ("generally", "general"), ("dying", "die"), ("sky", "sky"), ("flies", "fli")])
def test_stem(word, want):
    assert fulltext.stem(word) == want


def test_rank_by_label():
    assert fulltext.rank([("A", "zebra")], "zebra", ("simple",)) == 0.5
    assert round(fulltext.rank([("B", "zebra")], "zebra", ("simple",)), 4) == 0.2857
    assert round(fulltext.rank([("C", "zebra")], "zebra", ("simple",)), 4) == 0.1667
    assert round(fulltext.rank([("A", "zebra x zebra")], "zebra", ("simple",)), 4) == 0.6667
    assert fulltext.rank([("A", "zebra")], "lion") is None
    assert fulltext.rank([("C", "big cats run")], '"cats run"') and fulltext.rank([("C", "run cats")], '"cats run"', ("simple",)) is None
    assert fulltext.rank([("C", "cats run")], "cats -run") is None
    assert fulltext.rank([("C", "lions")], "tiger OR lion")


def test_segments_and_regions():
    assert layout.segments(10, [(2, 6, 1), (4, 8, 2)]) == [(0, 2, []), (2, 4, [1]), (4, 6, [1, 2]), (6, 8, [2]), (8, 10, [])]
    assert layout.kept_regions([(0, 0, 10, 10), (1, 1, 3, 3), (20, 20, 21, 21)]) == [0, 2]
    box = lambda text, y, x=40.0: {"text": text, "x0": x, "x1": x + 200, "y0": y, "y1": y + 10}
    assert layout.merged([box("A line", 0), box("goes on.", 12), box("New", 24)]) == ["A line goes on.", "New"]
    assert layout.merged([box("A line", 0), box("far away", 90)]) == ["A line", "far away"] and layout.merged([box("A line", 0), box("next column", 90, 400.0)], 2) == ["A line next column"]
    assert layout.text_table(["a", "b"], [(1, None)]) == "a | b\n-----\n1 | "
    assert layout.bionic("<p>word a</p>") == "<p><strong>wo</strong>rd a</p>"
    assert layout.contents([(1, "Title"), (2, "A b"), (2, "A b"), (5, "x")], "title") == [("a-b", "A b", 2), ("a-b-2", "A b", 2), ("x", "x", 4)]


def test_headings_and_journal_lines(spark):
    plain, rows = (10.5, None, False, 1, False), []
    for text, level, *more in [
        ("2.1 Methods", 2), ("2.1. Methods", 3), ("3. Results", 2), ("1.2.3.4 Deep", 3), ("1 I NTRO", 2), ("A BSTRACT", 1, 12.0), ("plain text", 0), ("B.4 Ablation", 2),
        ("2.1", 0), ("Large", 1, 16.0), ("Medium", 2, 14.0), ("Small", 3, 12.0), ("Body", 0, 11.9), ("x" * 201, 0, 16.0), ("x", 0, 16.0), ("", 0), (None, 0),
        ("1 A note", 0, 10.5, None, False, 1, True), ("1 A note", 0, 10.5, 7.0), ("1 " + "word " * 30, 0, 10.5, None, False, 3), ("1 " + "word " * 30, 1, 10.5, None, True, 3),
        ("long " * 25, 0, 16.0), ("LONG " * 25, 1, 16.0), ("  2 Padded\t", 1),
    ]:
        rows.append((text, level, *more, *plain[len(more) :]))
    df = spark.createDataFrame(rows, "text string, want int, size double, first_size double, bold boolean, lines int, superscript boolean")
    c = df.columns[2:]
    got = df.withColumn("f", layout.heading_features("text", **{n: F.col(n) for n in c})).withColumn("level", F.expr(layout.HEADING_LEVEL))
    assert [tuple(r) for r in got.where("level <> want").select("text", "level", "want").collect()] == []
    lines = {"https://doi.org/10.1": True, "2025, 26, 1725": True, "RECEIVED May, accepted June": True, "a short communication ": True, "An article about it": False}
    told = spark.createDataFrame(list(lines.items()), "text string, want boolean").select("want", layout.is_journal_line("text").alias("got"))
    assert told.where("got <> want").count() == 0


def test_limiter_never_admits_over_limit():
    times = [i * 1.0 for i in range(300)]
    ok = limiter.admit(times, [deque(), deque()])
    admitted = [t for t, a in zip(times, ok, strict=True) if a]
    assert all(sum(t - 60 < x <= t for x in admitted) <= 10 for t in times) and len(admitted) <= 50


def test_rank_of_both_dictionaries():
    assert fulltext.rank([("A", "zebra")], "zebra") == pytest.approx(2 / 3)  # one word at two positions
    assert fulltext.rank([("C", "with that")], "with OR that") == pytest.approx(0.4 / 1.4)  # stop words count as they are
    assert fulltext.rank([("C", "running")], "runs fast") is None and fulltext.rank([("C", "running fast")], "runs fast")
    assert fulltext.alternatives("the", ("english",)) == [[fulltext.Term(("the",), prefix=True)]]


@pytest.mark.parametrize(
    "query,want",
    [
        ("author:Ann Lee tag:x", ("filter", {"author": "Ann Lee", "tag": "x"})),
        ('site:"a b" is:Unread', ("filter", {"site": "a b", "is": "Unread"})),
        ('say "two words"', ("keyword", {})),
        ("Example.COM", ("filter", {"site": "example.com"})),
        ("Jane Roe", ("filter", {"author": "Jane Roe"})),
        ("anything about it?", ("semantic", {})),
        ("tell me more", ("semantic", {})),
        ("howto", ("keyword", {})),
        ("please find it", ("hybrid", {})),
        ("", ("keyword", {})),
        ("four words without questions", ("hybrid", {})),
    ],
)
def test_intent(spark, query, want):
    from pyspark.sql import functions as F

    from quire.functions import queries

    assert queries.classify(query, {"jane roe"}) == want
    row = spark.createDataFrame([(query,)], "t string").select(queries.intent("t", F.lower("t") == "jane roe").alias("i")).first()["i"]
    assert (row["intent"], row["extracted"] or {}) == want


SAFE = [
    "with x as (select * from items) select count(*) from x join highlights h on h.item_id = x.id",
    "select id, row_number() over (partition by lang order by id) as r from items order by id limit 2",
    "select id from items where id in (select item_id from highlights) union select id from items",
    "select upper(lang), id between 1 and 2, lang like '%e%' from items i where exists (select 1 from highlights h where h.item_id = i.id)",
    "select lang, e from items lateral view explode(array(1, 2)) t as e",
]
UNSAFE = [
    "select * from items; drop table items", "delete from items", "select * from users", "insert into items select 1", "with x as (select * from secrets) select * from x",
    "select * from items where id in (select id from passwords)", "", "select 'with customer as (' as s, c_name from customer", "select java_method('java.lang.System', 'currentTimeMillis') from items",
    "select reflect('java.lang.System', 'currentTimeMillis') from items", "select * from parquet.`/tmp/x.parquet`", "select * from range(5)", "select * from global_temp.items",
    "with items as (select 1 as id) select * from items", "select (select max(c_name) from customer) from items", "select transform(id) using 'cat' from items", "set x = 1", "show tables",
    "explain select 1", "select input_file_name() from items", "create view v as select 1", "cache table items", "select * from spark_catalog.default.items",
]


@pytest.mark.parametrize("sql", UNSAFE)
def test_unsafe_sql(spark, sql):
    spark.range(3).selectExpr("id", "concat('c', id) as c_name").createOrReplaceTempView("customer")
    with pytest.raises(safe_sql.Rejected):
        safe_sql.validate(spark, sql)


def test_safe_sql(spark):
    for sql in SAFE:
        assert safe_sql.validate(spark, sql) <= {"items", "highlights"}
    items = spark.createDataFrame([(1, 3, "en"), (2, 4, "de"), (5, 3, "fr")], "id bigint, user_id bigint, lang string")
    highlights = spark.createDataFrame([(1, 3, 1), (2, 4, 2)], "id bigint, user_id bigint, item_id bigint")
    tables = {"items": items, "highlights": highlights}
    run = lambda sql: safe_sql.fetch(safe_sql.run(spark, sql, tables, 3), 60)
    assert sorted(r.id for r in run("select id from items where true or user_id = 4")) == [1, 5]
    assert [r.n for r in run("```sql\nselect count(*) as n from items i where i.user_id = :user_id;\n```")] == [2]
    assert len(run(SAFE[3])) == 1 and len(run(SAFE[4])) == 4
    assert "items" not in {t.name for t in spark.catalog.listTables()}
    big = {"items": spark.range(1, 1 << 40).selectExpr("id", "3 as user_id", "'x' as lang")}
    with pytest.raises(safe_sql.TimedOut):
        safe_sql.fetch(safe_sql.run(spark, "select count(distinct id) from items", big, 3))
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()  # nothing runs on
    assert run("select count(*) as n from items") == [(2,)]


WORDS = "use uses using used case cases sky skies blue blues die dying died hard age aging aged wine wines happy happily ski skis skiing lie lying tie tying only idly early ugly gently singly valency relational organization sensibility possibly hopefulness agreed cheese run running city cities be being".split()


def test_every_match_passes_the_filter(spark):
    pairs = [("use cases", "using cases daily"), ("sky blue", "blue skies"), ("die hard", "dying hard"), ("age OR wine", "aging cheese")]
    rng = random.Random(4)
    pairs += [(" ".join(rng.sample(WORDS, rng.randint(1, 2))), " ".join(rng.sample(WORDS, 12))) for _ in range(400)]
    found = [fulltext.rank([("A", text)], query) is not None for query, text in pairs]
    assert all(found[:4]) and any(found[4:])
    matching = [p for p, f in zip(pairs, found) if f]
    for query in {q for q, _ in matching}:
        texts = [(t,) for q, t in matching if q == query]
        assert spark.createDataFrame(texts, "t string").where(fulltext.may_match(query, F.lower("t"))).count() == len(texts)
    for word in WORDS:
        assert fulltext._head(fulltext.stem(word), exact=False) in word


def test_odd_pages_neither_fail_nor_hang():
    for body in ('["a"]', '"text"', "3", '{"@graph": ["a"]}', '{"@graph": {"@graph": 1}, "author": [[1]], "image": [[]]}', "[" * 100_000, '{"author": {"name": ["x", {"y": 1}]}, "image": {"url": [1]}}', "null"):
        assert pages.metadata(f'<title>T</title><script type="application/ld+json">{body}</script>', "https://a.org/")["title"] == "T"
    assert "x" in pages.parse("<p><![foo]>x</p>").text()
    parts = ["<p>", "</p>", "<div class='a'>", "</div", "<!--", "-->", "<![foo]>", "<![CDATA[", "]]>", "<article>", "<h2>head</h2>", '<img src="a.png" alt=x>', "<ul><li>", "</ul>", '<meta property="og:image" content="', '">', "'", '"', "<script type='application/ld+json'>", '{"author": 3}', "</script>", "&lt;", "&#0;", "&#xd800;", "text. ", "<", ">", "\x00", "<blockquote>", "<pre>", "<a href=#>"]
    rng, began = random.Random(8), time.monotonic()
    for _ in range(1000):
        page = "".join(rng.choices(parts, k=rng.randint(0, 50)))
        pages.metadata(page, "https://a.org/x")
        pages.features(page, page)
        pages.cleaned(page, "t", None, None)
        pages.chunks(page)
        pages.blocks(page)
    assert time.monotonic() - began < 60
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert pages.metadata(deep, "")["title"] is None and pages.blocks(deep)


def test_a_short_piece_before_a_long_sentence_is_carried_on():
    first, long_ = "one two three four five six seven eight nine ten.", " ".join(f"w{i}" for i in range(460)) + "."
    got = pages.chunks(f"<p>{first} {long_}</p>")
    assert got == [f"{first} {long_}"]
