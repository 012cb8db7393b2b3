"""Keep-first deduplication, ordered set operations, and documented names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.lookup import one_per_key


def keep_first(samples: DataFrame, ordinal: str, question: str = "question") -> DataFrame:
    """The first sample of each normalised question; blank questions are gone."""
    keyed = samples.withColumn("key", T.normalise_question(question)).where("key <> ''")
    return one_per_key(keyed, "key", ordinal)


def all_depths(pools: list[DataFrame]) -> DataFrame:
    """The bag union of samples of all depths so far."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merged(existing: DataFrame, new: DataFrame, ordinal: str) -> DataFrame:
    """Existing samples, then new ones, the first of each question."""
    both = existing.withColumn("__source", F.lit(0)).unionByName(new.withColumn("__source", F.lit(1)), allowMissingColumns=True)
    return keep_first(both.withColumn("__order", F.struct("__source", ordinal)), "__order").drop("__source", "__order")


def pair_union(used_a, used_b, seeds_a, seeds_b, fallback: str | None = None) -> Column:
    """Names that two samples use, a's first; if none, their seeds; if none either, the fallback (the library's first name)."""
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    used = F.array_union(empty(used_a), empty(used_b))
    seeds = F.array_union(empty(seeds_a), empty(seeds_b))
    last = F.array() if fallback is None else F.array(F.lit(fallback))
    return F.when(F.size(used) > 0, used).when(F.size(seeds) > 0, seeds).otherwise(last.cast("array<string>"))


def section_names(docs: DataFrame, library: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, full_name) from reference pages: below a line that names a class, `property p` and `m(` name its members.
    The class stays in force to the end of the text, and a line of bases names nothing."""
    lib = library.replace(".", r"\.")
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    heading = F.nullif(F.regexp_extract("line", rf"class\s*{lib}\.([A-Za-z_]\w*)", 1), F.lit(""))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("head", heading).withColumn("cls", F.last("head", ignorenulls=True).over(so_far))
    prop = F.nullif(F.regexp_extract("line", r"^\s*property\s*([A-Za-z_]\w*)", 1), F.lit(""))
    call = F.nullif(F.regexp_extract("line", r"^\s*([A-Za-z_]\w*)\(", 1), F.lit(""))
    member = F.when(~F.trim("line").startswith("Bases"), F.coalesce(prop, call))
    inside = lines.where(F.col("cls").isNotNull())
    own = inside.where(F.col("head").isNotNull()).select(key, F.concat_ws(".", F.lit(library), "head").alias("full_name"))
    return own.union(inside.where(F.col("head").isNull() & member.isNotNull()).select(key, F.concat_ws(".", F.lit(library), "cls", member).alias("full_name")))


def documented_names(docs: DataFrame, library: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(full_name): every name that documents mention or whose section they have."""
    flat = docs.select(F.explode(T.mentions(text, library)).alias("full_name"))
    return flat.union(section_names(docs, library, key, text).select("full_name")).distinct()


def keep_first_records(records: DataFrame, root: str, max_depth: int, ordinal: str = "ordinal") -> DataFrame:
    """Functions and classes below the root, at most max_depth deep, the first of each full name."""
    depth = depth_of("full_name", root)
    kept = records.where(F.col("kind").isin("function", "class") & (depth <= max_depth))
    return one_per_key(kept, "full_name", ordinal)


def depth_of(name: str, root: str) -> Column:
    inside = (F.col(name) == root) | F.col(name).startswith(f"{root}.")
    return F.when(inside, F.size(F.split(name, r"\.")) - len(root.split("."))).otherwise(10**9)


def relative_path(path, root: str) -> Column:
    """The path below the package's folder, or else its last part."""
    flat = F.translate(path, "\\", "/")
    return F.when(flat.startswith(f"{root}/"), F.substring(flat, len(root) + 2, 2147483647)).otherwise(F.element_at(F.split(flat, "/"), -1))
