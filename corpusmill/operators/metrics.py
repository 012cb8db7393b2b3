"""Counts and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def usage_counts(samples: DataFrame, used: str = "used_apis") -> DataFrame:
    """(full_name, use_count) over the names that samples use; blank names do not count."""
    each = samples.select(F.explode(used).alias("full_name")).where("full_name IS NOT NULL AND full_name <> ''")
    return each.groupBy("full_name").agg(F.count("*").alias("use_count"))


def accepted_count(samples: DataFrame, question: str = "question") -> int:
    return samples.select(T.normalise_question(question).alias("key")).where("key <> ''").agg(F.count_distinct("key")).first()[0]


def tally(attempts: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, n, c): configured attempts, and passes among the first max(1, k) by attempt number."""
    first = attempts.where(F.col("attempt") <= max(1, k))
    return first.groupBy(*key).agg(F.count_if("passed").alias("c")).withColumn("n", F.lit(k).cast("long"))


def mean_pass_at(tallies: DataFrame, ks: tuple[int, ...] = (1, 3, 5), null_when_undefined: bool = False) -> DataFrame:
    """One row: total items and the mean of pass@k for each k. Undefined values, -1, are averaged in unless made null."""
    return tallies.agg(F.count("*").alias("total"), *(F.avg(T.pass_at_k("n", "c", k, null_when_undefined)).alias(f"pass_at_{k}") for k in ks))


def release_range(projects: DataFrame, key: str = "name") -> DataFrame:
    """(key, first_release_time, last_release_time): over versions, the earliest upload of each."""
    files = projects.select(key, F.explode("releases").alias("version", "files")).select(key, "version", F.explode("files").alias("f"))
    at = F.coalesce("f.upload_time_iso_8601", "f.upload_time")
    version = files.select(key, "version", at.alias("at")).groupBy(key, "version").agg(F.min("at").alias("at"))
    span = version.groupBy(key).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return span.select(key, T.utc_time("lo").alias("first_release_time"), T.utc_time("hi").alias("last_release_time"))


def run_counters(kept: DataFrame, total: int) -> dict:
    row = kept.agg(F.count("*").alias("kept"), F.count_distinct("full_name").alias("names")).first()
    return {"total": total, "kept": row.kept, "unique_names": row.names}
