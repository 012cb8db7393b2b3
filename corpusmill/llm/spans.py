"""Spans of pattern matches as columns: native expressions only. Offsets count code points, the end is exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int,found:string>>"


def none() -> Column:
    return F.array().cast(SPANS)


def located(text: Column, kind: str, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern, in order. Matches and the gaps between them come from the
    same engine; their lengths add up to the offsets. The guard is a cheap test that any match needs."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gap"))

    def merge(acc, x):
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["found"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["found"].alias("found"))
        return F.when(x["found"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    every = F.aggregate(both, F.struct(F.lit(0).alias("at"), none().alias("out")), merge, lambda acc: acc["out"])
    ok = text.isNotNull() if guard is None else text.isNotNull() & guard
    return F.when(ok, every).otherwise(none())


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def is_kind(kind: str):
    return lambda x: x["kind"] == kind


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, is_kind(kind))).cast("long")


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total, i):
        d = F.substring(number, i, 1).cast("int") * F.when((F.char_length(number) - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0
