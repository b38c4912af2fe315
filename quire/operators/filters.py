"""Filters with parameters: F1, F2, F5, F6, F7, F10, F11, X26."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What error texts of failed items contain, by kind, in the order of precedence.
ISSUES = {
    "unauthorized": ("401", "http 401", "401 client error", "unauthorized", "not authorized", "authorization", "authentication required", "login required", "access denied"),
    "blocked": ("403", "forbidden (403)", "http 403", "403 client error", "blocks bots", "blocked", "bot", "captcha", "cloudflare", "rate limit", "too many requests", "429"),
    "source_access": ("httperror", "client error", "server error", "http ", "status code", "for url"),
    "network": ("timed out", "timeout", "request error", "network", "connection", "dns", "temporary", "unreachable"),
}


def _day(text: str | None) -> date | None:
    try:
        return date.fromisoformat(text) if text else None
    except ValueError:
        return None


def structured(items: DataFrame, *, author: str | None = None, tag: str | None = None, site: str | None = None, state: str | None = None, before: str | None = None, after: str | None = None, limit: int | None = 50) -> DataFrame:
    """F1 (F1a to F1e): items with a title that fulfil all given conditions, newest first, ids break ties.

    author, tag and site are substrings in any case, % and _ in them are wildcards; ``state`` is read, unread (archived
    ones included) or archived; days that are no dates are ignored.
    """
    out = items.where("title <> ''")
    if author:
        out = out.where(F.col("author").ilike(f"%{author}%"))
    if tag:
        out = out.where(F.exists("tags", lambda t: t.ilike(f"%{tag}%")))
    if site:
        out = out.where(F.col("url").ilike(f"%{site}%"))
    if state:
        out = out.where({"read": F.col("is_read"), "unread": ~F.col("is_read"), "archived": F.col("is_archived")}[state.lower()])
    if day := _day(before):
        out = out.where(F.col("created_at") < F.lit(day).cast("timestamp"))
    if day := _day(after):
        out = out.where(F.col("created_at") >= F.lit(day).cast("timestamp"))
    out = out.orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def dated(rows: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """rows of a finished page by day of ``created_at``; without a day nothing is dropped, with one null dates are."""
    out = rows
    if day := _day(after):
        out = out.where(F.col("created_at") >= F.lit(day).cast("timestamp"))
    if day := _day(before):
        out = out.where(F.col("created_at") < F.lit(day).cast("timestamp"))
    return out


def listed(items: DataFrame, *, is_read: bool | None = None, is_archived: bool | None = None, tag: str | None = None, skip: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """A page of the newest items, and one row with their number in all; the tag must be there exactly."""
    out = items
    for column, value in (("is_read", is_read), ("is_archived", is_archived)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    return out.orderBy(F.desc("created_at"), "id").offset(skip).limit(limit), out.agg(F.count("*").alias("total"))


def reading_status() -> Column:
    """archived, read, in_progress or unread; a null position is unread."""
    at = F.coalesce("read_position", F.lit(0.0))
    return F.when(F.col("is_archived"), "archived").when(F.col("is_read") | (at >= 0.9), "read").when(at > 0, "in_progress").otherwise("unread")


def by_status(items: DataFrame, status: str = "all", tags: tuple[str, ...] = ()) -> DataFrame:
    """by reading status (``all``: whatever is not archived), and with at least one of the tags, exactly, if any."""
    out = items.where(reading_status() != "archived" if status == "all" else reading_status() == status)
    return out.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out


def found_records(records: DataFrame, text: str) -> DataFrame:
    """records with the text in artist, title, label, a genre, a style or a tag, in any case."""
    t = text.strip().lower()
    empty = F.array().cast("array<string>")
    fields = F.concat(F.array("artist", "title", "label"), *[F.coalesce(c, empty) for c in ("genres", "styles", "tags")])
    return records.where(F.exists(F.array_compact(fields), lambda v: F.lower(v).contains(t)))


def found_lists(lists: DataFrame, text: str) -> DataFrame:
    """lists with the text in name or description, in any case, the last changed first."""
    t = text.strip().lower()
    return lists.where(F.lower("name").contains(t) | F.coalesce(F.lower("description").contains(t), F.lit(False))).orderBy(F.desc("updated_at"), "id")


def sorted_records(records: DataFrame, by: str = "created_at", descending: bool = True, status: str | None = None) -> DataFrame:
    """records by created_at, year or artist; nulls are last rising and first falling."""
    out = records if status is None else records.where(F.col("status") == status)
    return out.orderBy(F.col(by).desc_nulls_first() if descending else F.col(by).asc_nulls_last(), "id")


def ingest_issue(status: Column | str = "status", error: Column | str = "error") -> Column:
    """why an item failed; ``partial`` for a finished one with an error text; null if nothing is wrong."""
    s = F.col(status) if isinstance(status, str) else status
    e = F.trim(F.lower(F.coalesce(F.col(error) if isinstance(error, str) else error, F.lit(""))))
    kind = None
    for name, words in ISSUES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | e.contains(w)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return F.when(s == "failed", kind.otherwise("unknown")).when((s == "completed") & (e != ""), "partial")


def in_mood(items: DataFrame, mood: str | None) -> DataFrame:
    """quick_read drops over 10 minutes, deep_dive under 10, light over 5,000 words; null and zero values pass."""
    minutes, words = F.coalesce("minutes", F.lit(0)), F.coalesce("word_count", F.lit(0))
    rule = {"quick_read": minutes > 10, "deep_dive": (minutes > 0) & (minutes < 10), "light": words > 5000}.get(mood or "")
    return items if rule is None else items.where(~rule)
