"""Lookups as joins. Sides are broadcast by Spark's own size estimate, never by hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.sources import io


def one_per_key(df: DataFrame, key: str, ordinal: str, last: bool = False) -> DataFrame:
    """The first row of each key, or the last. Summed up before it moves: no key gathers its rows in one task."""
    best = (F.max_by if last else F.min_by)(F.struct(*(c for c in df.columns if c != key)), F.col(ordinal))
    return df.groupBy(key).agg(best.alias("__row")).select(key, "__row.*").select(*df.columns)


def documented(records: DataFrame, names: DataFrame, library: str) -> DataFrame:
    """Records whose full name is among the names mentioned."""
    named = records.withColumn("full_name", T.filter_name("qualname", "source_file", library))
    return named.join(names, "full_name", "left_semi")


def docs_for(items: DataFrame, key: str, names: str, docs: DataFrame) -> DataFrame:
    """For each item its names in order, each once, with signature and docstring where there is a document.
    docs: (full_name, signature, docstring), unique by full_name."""
    each = items.select(key, F.posexplode(F.array_distinct(names)).alias("pos", "full_name"))
    got = each.join(docs.select("full_name", "signature", "docstring"), "full_name", "left")
    entry = F.struct("pos", "full_name", "signature", "docstring")
    made = got.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("api_docs"))
    return items.join(made, key, "left")


def docs_by_prefix(items: DataFrame, names: str, docs: DataFrame, module: str, key: str = "full_name") -> DataFrame:
    """(name, doc columns): for each distinct name its document, or that of the longest prefix that has one, down to the
    module and one segment."""
    floor = len(module.split(".")) + 1
    one = items.select(F.explode(names).alias("name")).distinct()
    parts = F.split("name", r"\.")
    cut = one.select("name", F.explode(F.when(F.size(parts) >= floor, F.sequence(F.size(parts), F.lit(floor), F.lit(-1))).otherwise(F.array(F.size(parts)))).alias("n"))
    cut = cut.withColumn(key, F.array_join(F.slice(F.split("name", r"\."), 1, F.col("n")), "."))
    hit = cut.join(docs.withColumn("__doc", F.struct(*docs.columns)), key, "left")
    best = hit.groupBy("name").agg(F.max_by("__doc", F.when(F.col("__doc").isNotNull(), F.col("n"))).alias("doc"))
    return best.select("name", *(F.col("doc")[c].alias(c) for c in docs.columns))


def with_counts(docs: DataFrame, counts: DataFrame, key: str = "full_name") -> DataFrame:
    """docs with use_count, 0 where nothing is counted. counts: (key, use_count)."""
    return docs.join(counts, key, "left").withColumn("use_count", F.coalesce("use_count", F.lit(0).cast("long")))


def unseen(rows: DataFrame, seen: DataFrame, text: str = "question", order: str = "task_id") -> DataFrame:
    """Rows whose normalised text is not seen before, nor earlier among the rows. seen: (key)."""
    keyed = rows.withColumn("key", T.normalise_question(text)).where("key <> ''").join(seen, "key", "left_anti")
    return one_per_key(keyed, "key", order)


def spread(df: DataFrame, *keys: str, per: int, most: int = 4096) -> DataFrame:
    """df dealt out by the hash of its keys, about `per` rows a partition, for steps whose work by row says nothing of its
    bytes: a small file is one task to a scan, whatever its rows cost. Few rows stay where they are."""
    parts = min(most, -(-df.count() // per))
    return df.repartition(parts, *keys) if parts > 1 else df


def numbered(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """df with its 1-based place in a total order, counted by ranges: one task sees only its own range. The ranges are
    written once, since two runs of one range shuffle need not cut alike; sizes are a row for each partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = io.written(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"), F.min("__id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = F.broadcast(sizes.select("__part", "first", before.alias("before")))
    return placed.join(sizes, "__part").withColumn(name, F.col("__id") - F.col("first") + F.col("before") + 1).drop("__part", "__id", "first", "before")
