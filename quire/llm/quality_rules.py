"""Quality rules with weak supervision (operator 10), in DataFrame and SQL functions only.

Counts of a text feed rules; each votes for quality (1), against it (-1) or abstains (0).  Votes are noisy labels of a
hidden class: where rule j votes on a good text it is right with accuracy a_j, on a bad one with accuracy b_j,
independently of the others.  Expectation-maximisation estimates the accuracies and the share of good texts from the
table of vote patterns, which has at most 3 ** rules rows whatever the corpus; all steps are one fold over it.  A text
is kept if its posterior probability of quality is one half or more, so one failed rule does not decide alone.

Everything runs inside whole rows: a scan, one small aggregation, and a map.  Repeated three-word windows are found in
the row itself by sorting hashes (36 bits and the position first, then the full 64 bits of those that agree).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: White space that separates words.
WS = r"[\\x20\\x09-\\x0D]"
NOT_WS = r"[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
STEPS = 25

#: Per rule: name, condition of a vote against quality, condition of a vote for it (first match wins).
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 14 * n_words", "word_chars >= 3.5 * n_words and word_chars <= 10 * n_words"),
    ("symbols", "n_symbols > 0.2 * n_words", "n_symbols < 0.05 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines < 0.1 * n_lines and n_lines >= 3"),
    ("windows", "n_repeat_words > 0.5 * n_words", "n_repeat_words < 0.2 * n_words"),
    ("capitals", "n_capitals > 0.4 * word_chars", "n_capitals < 0.15 * word_chars"),
    ("shouts", "n_shouts > 0.3 * n_words", "n_shouts < 0.05 * n_words"),
    ("variety", "n_distinct < 0.15 * n_words", "n_distinct > 0.35 * n_words"),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it by name; an alias would be inlined into each lambda call."""
    return f"transform(array({value}), {name} -> {body})[0]"


_HIGH = "shiftright({x}, 28)"
_REPEATED = _let(
    "h",
    # windows as 64-bit hashes
    "transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))",
    _let(
        "s",
        "sort_array(transform(h, (x, i) -> shiftleft(x, 28) | cast(i as bigint)))",
        _let(
            "p",
            "sort_array(transform(filter(s, (x, k) -> shiftright(x, 28) <=> shiftright(get(s, k - 1), 28) or shiftright(x, 28) <=> shiftright(get(s, k + 1), 28)), "
            "x -> struct(h[cast(x & 268435455 as int)] as h, cast(x & 268435455 as int) as p)))",
            _let(
                "q",
                "sort_array(transform(filter(p, (x, k) -> x.h <=> get(p, k - 1).h or x.h <=> get(p, k + 1).h), x -> x.p))",
                "aggregate(transform(q, (x, k) -> least(3, coalesce(get(q, k + 1) - x, 3))), 0L, (a, x) -> a + x)",
            ),
        ),
    ),
)


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and the counts that rules use (long; null text: none of anything)."""
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    base = base.withColumn("ws", F.expr(f"filter(split(body, '{WS}+'), w -> w != '')"))
    shown = {
        "n_words": "size(ws)",
        "word_chars": "length(array_join(ws, ''))",
        "n_symbols": f"regexp_count(body, '{SYMBOLS}')",
        "n_capitals": "regexp_count(body, '[A-Z]')",
        "n_shouts": "regexp_count(body, '!')",
        "n_distinct": "size(array_distinct(ws))",
    }
    out = base.select(
        id_col,
        *[F.expr(sql).cast("bigint").alias(name) for name, sql in shown.items()],
        F.expr(_let("ls", f"filter(split(body, '\\\\n'), l -> l rlike '{NOT_WS}')", "struct(size(ls) as n, size(ls) - size(array_distinct(ls)) as d)")).alias("ls"),
        F.expr(f"if(size(ws) < 3, 0L, {_REPEATED})").cast("bigint").alias("n_repeat_words"),
    )
    return out.withColumns({"n_lines": F.col("ls.n").cast("bigint"), "n_dup_lines": F.col("ls.d").cast("bigint")}).drop("ls")


def vote(rule: tuple[str, str, str]) -> Column:
    return F.expr(f"case when n_words = 0 then -1 when {rule[1]} then -1 when {rule[2]} then 1 else 0 end").cast("tinyint").alias(f"v_{rule[0]}")


Accuracies = dict[str, tuple[float, float]]
#: Before the first step: share of good texts, accuracies on good and on bad ones.
START = (0.7, 0.98, 0.15)
LEAST_P = 0.001


def log_odds(share: float, accuracy: Accuracies) -> Column:
    """Posterior log odds of quality; the logs are plain numbers in the expression."""
    odds = F.lit(math.log(share / (1 - share)))
    for name, (a, b) in accuracy.items():
        v = F.col(f"v_{name}")
        odds = odds + F.when(v == 1, F.lit(math.log(a / (1 - b)))).when(v == -1, F.lit(math.log((1 - a) / b))).otherwise(0.0)
    return odds


def _inside(x: str) -> str:
    return f"least(greatest({x}, {LEAST_P}D), {1 - LEAST_P}D)"


def _summed(value: str, condition: str = "true") -> str:
    return f"aggregate(q, 0D, (c, r) -> c + if({condition}, {value}, 0D))"


def _rate(right: int, weight: str) -> str:
    # one right and one wrong vote beforehand keep estimates inside (0, 1)
    return _inside(f"({_summed(weight, f'r.v[j] = {right}')} + 1) / ({_summed(weight, 'r.v[j] <> 0')} + 2)")


#: One step over patterns p (array of n and votes v), from share m.s and accuracies m.a, m.b to the next ones.
_STEP = _let(
    "w",
    "transform(m.a, (a, j) -> struct(ln(a / (1 - m.b[j])) as good, ln((1 - a) / m.b[j]) as bad))",
    _let(
        "q",
        "transform(p, r -> struct(r.v as v, r.n as n, 1 / (1 + exp(-(ln(m.s / (1 - m.s)) + aggregate(r.v, struct(0D as o, 0 as j), (c, x) -> struct(c.o + case x when 1 then w[c.j].good when -1 then w[c.j].bad else 0D end as o, c.j + 1 as j)).o))) as g))",
        f"named_struct('s', {_inside(f'({_summed("r.n * r.g")} + 1) / ({_summed("r.n")} + 2)')}, 'a', transform(m.a, (a, j) -> {_rate(1, 'r.n * r.g')}), 'b', transform(m.a, (a, j) -> {_rate(-1, 'r.n * (1 - r.g)')}))",
    ),
)


def estimate(patterns: DataFrame, names: list[str], steps: int = STEPS) -> tuple[float, Accuracies]:
    """Share of good texts and accuracies, by EM over rows of votes with their number ``n``.

    The patterns, at most 3 ** rules, meet in one row, over which all steps are one fold.
    """
    votes = F.array(*[F.col(f"v_{x}").cast("int") for x in names]).alias("v")
    one = patterns.agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), votes)).alias("p"))
    start = f"named_struct('s', {START[0]}D, 'a', array_repeat({START[1]}D, {len(names)}), 'b', array_repeat({START[2]}D, {len(names)}))"
    found = one.select(F.expr(f"aggregate(sequence(1, {steps}), {start}, (m, t) -> {_STEP})").alias("m")).first()["m"]
    return found["s"], {x: (found["a"][j], found["b"][j]) for j, x in enumerate(names)}


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts, votes, ``base_failed``, ``quality`` (posterior probability), ``kept``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated three-word windows.  ``kept`` is false
    if base_failed, else whether the posterior is one half or more (ties are kept).  Null and empty texts have no
    words and fail.  Repeated rows stay; empty tables give no rows.
    """
    names = [r[0] for r in RULES]
    judged = cut_lineage(counts(docs, id_col=id_col, text_col=text_col).select("*", *[vote(r) for r in RULES]))
    patterns = judged.groupBy(*[f"v_{x}" for x in names]).agg(F.count("*").alias("n")).coalesce(1)
    share, accuracy = estimate(patterns, names)
    odds = log_odds(share, accuracy)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumns({"base_failed": failed, "quality": 1 / (1 + F.exp(-odds)), "kept": ~failed & (odds >= -1e-9)})


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def oracle() -> str:
    names = [r[0] for r in RULES]
    odds = " + ".join(["ln(share / (1 - share))", *[f"case v_{x} when 1 then ln(a_{x} / (1 - b_{x})) when -1 then ln((1 - a_{x}) / b_{x}) else 0.0 end" for x in names]])
    cases = ", ".join(f"case when n_words = 0 then -1 when {bad} then -1 when {good} then 1 else 0 end as v_{x}" for x, bad, good in RULES)

    def inside(x: str) -> str:
        return f"least(greatest({x}, {LEAST_P}), {1 - LEAST_P})"

    def rate(x: str, right: int, weight: str, name: str) -> str:
        return inside(f"(sum(case when v_{x} = {right} then n * {weight} else 0.0 end) + 1) / (sum(case when v_{x} <> 0 then n * {weight} else 0.0 end) + 2)") + f" as {name}_{x}"

    step = ", ".join([*[rate(x, 1, "g", "a") for x in names], *[rate(x, -1, "(1 - g)", "b") for x in names]])
    first = ", ".join([*[f"{START[1]}::double as a_{x}" for x in names], *[f"{START[2]}::double as b_{x}" for x in names]])
    params = ", ".join([*[f"a_{x}" for x in names], *[f"b_{x}" for x in names]])
    nw = NOT_WS.replace("\\\\", "\\")
    return f"""
with recursive d as (
  select doc_id, row_number() over () as r, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '{nw}+') as ws from documents
), win as (
  select r, i, count(*) over (partition by r, a, b, c) as k from (
    select r, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select r, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) >= 3) x
  ) y
), rep as (
  select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from win where k > 1) z group by r
), ln as (
  select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from (select r, unnest(string_split(body, chr(10))) as l from d) x where regexp_matches(l, '{nw}') group by r
), f as (
  select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    len(regexp_extract_all(body, '{SYMBOLS}'))::bigint as n_symbols, len(regexp_extract_all(body, '[A-Z]'))::bigint as n_capitals,
    len(regexp_extract_all(body, '!'))::bigint as n_shouts, len(list_distinct(ws))::bigint as n_distinct,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join rep using (r) left join ln using (r)
), v as (select *, {cases} from f),
p as (select {", ".join(f"v_{x}" for x in names)}, count(*) as n from v group by all),
em as (
  select 0 as step, {START[0]}::double as share, {first}
  union all
  select step + 1, {inside("(sum(n * g) + 1) / (sum(n) + 2)")}, {step}
  from (select *, 1 / (1 + exp(-({odds}))) as g from em cross join p where step < {STEPS}) q group by step
), fin as (select share, {params} from em where step = {STEPS})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and ({odds}) >= -1e-9) as kept, round(1 / (1 + exp(-({odds}))), 6) as quality
from v cross join fin
"""
