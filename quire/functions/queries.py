"""Search queries: operators (X20), intent (X21), dates taken out.

Each rule is one pattern, used by the driver for a query and by Spark for a whole query log.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the search operators and the forms of their values.
FORMS = {
    "quoted": '"([^"]+)"',
    "word": r"(\S+)",
    "up to the next operator": r"([^:]+?)(?=\s+\w+:|$)",
    "state": "(read|unread|archived)",
    "day": r"(\d{4}-\d{2}-\d{2})",
}
OPERATORS = {
    "author": ("quoted", "up to the next operator"),
    "tag": ("quoted", "word"),
    "site": ("quoted", "word"),
    "is": ("state",),
    "before": ("day",),
    "after": ("day",),
}
# How questions begin, words of questions, ends of domains.
QUESTIONS = ("how", "what", "why", "which", "when", "where", "who", "explain", "describe", "tell me", "find me", "show me")
QUESTION_WORDS = ("how", "what", "why", "which", "when", "where", "who", "explain", "describe", "find", "show")
DOMAIN_ENDS = ("com", "org", "net", "io", "co", "dev", "substack", "medium", "edu", "gov")

PATTERNS = {name: f"(?i){name}:(?:{'|'.join(FORMS[f] for f in forms)})" for name, forms in OPERATORS.items()}
DATES = r"(?i)\b(after|before):\d{4}-\d{2}-\d{2}"
PHRASE = '"[^"]+"'
DOMAIN = rf"(?i)^[\w.-]+\.({'|'.join(DOMAIN_ENDS)})$"
QUESTION = rf"(?i)^({'|'.join(QUESTIONS)})\b"


def operators_in(query: str) -> dict[str, str]:
    """X20 of one query: the first match of each operator."""
    found = {name: re.search(p, query) for name, p in PATTERNS.items()}
    return {name: next(g for g in m.groups() if g is not None) for name, m in found.items() if m}


def operators(column: Column | str) -> Column:
    """X20 of a column: a struct of strings, null where an operator is absent."""
    c = F.col(column) if isinstance(column, str) else column
    out = []
    for name, forms in OPERATORS.items():
        groups = [F.regexp_extract(c, PATTERNS[name], k) for k in range(1, len(forms) + 1)]
        out.append(F.nullif(F.concat(*groups), F.lit("")).alias(name))
    return F.struct(*out)


def without_dates(query: str | None) -> str:
    """X22 of one query."""
    return re.sub(DATES, "", query or "").strip()


def strip_dates(column: Column | str) -> Column:
    """X22 of a column; only ISO dates that begin at a word border go."""
    return F.regexp_replace(F.regexp_replace(column, DATES, ""), r"^\s+|\s+$", "")


def classify(query: str, authors: set[str] | frozenset[str] = frozenset()) -> tuple[str, dict[str, str]]:
    """X21 of one query: filter, keyword, semantic or hybrid, and what was extracted; ``authors`` in lower case."""
    q = query.strip()
    if meta := operators_in(q):
        return "filter", meta
    if re.search(PHRASE, q):
        return "keyword", {}
    if re.search(DOMAIN, q):
        return "filter", {"site": q.lower()}
    if q.lower() in authors:
        return "filter", {"author": q}
    if q.endswith("?") or re.search(QUESTION, q):
        return "semantic", {}
    words = q.lower().split()
    if len(words) <= 3 and not set(words) & set(QUESTION_WORDS):
        return "keyword", {}
    return "hybrid", {}


def intent(column: Column | str, author_known: Column) -> Column:
    """X21 of a column: struct of the intent and the extracted map (null where nothing was extracted)."""
    q = F.trim(F.col(column) if isinstance(column, str) else column)
    low, found = F.lower(q), operators(q)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    short = (F.size(words) <= 3) & ~F.arrays_overlap(words, F.array(*map(F.lit, QUESTION_WORDS)))
    any_operator = F.coalesce(*[found[n] for n in OPERATORS]).isNotNull()
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, OPERATORS)), F.array(*[found[n] for n in OPERATORS])), lambda k, v: v.isNotNull())
    domain, phrase = q.rlike(DOMAIN), q.rlike(PHRASE)
    kind = F.when(any_operator, "filter").when(phrase, "keyword").when(domain | author_known, "filter").when(q.endswith("?") | q.rlike(QUESTION), "semantic").when(short, "keyword").otherwise("hybrid")
    none = F.lit(None).cast("map<string,string>")
    extracted = F.when(any_operator, pairs).when(phrase, none).when(domain, F.create_map(F.lit("site"), low)).when(author_known, F.create_map(F.lit("author"), q)).otherwise(none)
    return F.struct(kind.alias("intent"), extracted.alias("extracted"))
