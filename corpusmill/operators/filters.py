"""Row predicates. Each returns a condition that is never null, so that they combine freely in one filter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def has_repository(repo: str = "github_repo") -> Column:
    return T.strip(F.coalesce(F.col(repo), F.lit(""))) != ""


def not_about(topics: str = "topics", word: str = "Artificial Intelligence") -> Column:
    """No topic contains the word; no topics at all pass."""
    return ~F.coalesce(F.exists(topics, lambda t: F.coalesce(F.contains(t, F.lit(word)), F.lit(False))), F.lit(False))


def topics_of(raw: str = "topics") -> Column:
    """Topics given as a JSON list or as one text."""
    return F.coalesce(F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"}), F.when(F.col(raw).isNotNull(), F.array(raw)))


def without_keyword(*columns: str, word: str = "agent") -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))
    return ~hit


def at_least(column: str, least: int | None) -> Column:
    """Numbers below the least are dropped; what is no whole number is kept."""
    return F.lit(True) if least is None else F.coalesce(F.col(column).try_cast("bigint") >= least, F.lit(True))


def newer_than(column: str, cutoff: dt.datetime | None) -> Column:
    """Strictly newer; what is no time is dropped."""
    return F.lit(True) if cutoff is None else F.coalesce(T.package_time(column) > F.lit(cutoff.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"), F.lit(False))


def no_leak(question: str, *names: str) -> Column:
    """The question mentions none of the names, not even inside a word."""
    hit = F.lit(False)
    for n in names:
        hit = hit | F.contains(question, F.lit(n))
    return ~F.coalesce(hit, F.lit(False))


def has_fields(line: str, *keys: str) -> Column:
    """A JSON text is an object with all the keys, whatever their values."""
    present = F.json_object_keys(line)
    ok = present.isNotNull()
    for k in keys:
        ok = ok & F.array_contains(present, k)
    return F.coalesce(ok, F.lit(False))


def uses_any(used: str) -> Column:
    return F.coalesce(F.size(used) > 0, F.lit(False))


def overlaps(used: str, seeds: str, required: bool = True) -> Column:
    if not required:
        return F.lit(True)
    return F.coalesce(F.size(seeds), F.lit(0)).__le__(0) | F.coalesce(F.arrays_overlap(used, seeds), F.lit(False))


def filter_packages(packages: DataFrame, min_stars=None, min_downloads=None, date_after: str | None = None, date_field: str = "github_created_at") -> DataFrame:
    """Package rows that pass all filters. With the default date field, rows that lack it fall to any cutoff."""
    cutoff = T.parse_cutoff(date_after) if date_after else None
    return packages.where(
        has_repository() & not_about() & without_keyword("name", "summary") & at_least("github_stars", min_stars)
        & at_least("download_count", min_downloads) & newer_than(date_field, cutoff))


def check_few_shots(rows: list) -> list[dict]:
    for i, r in enumerate(rows):
        if not isinstance(r, dict) or any(not isinstance(r.get(k), str) or not r[k].strip() for k in ("task", "solution", "test")):
            raise ValueError(f"few-shot {i} needs texts task, solution and test")
    return rows
