"""Weighted sampling without replacement as a race: each pair of task and candidate gets an exponential time with the
weight as its rate, and the first k are the sample. Times come from hashes, so a sample does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.lookup import spread
from corpusmill.sources import io


#: Names of one block of a pool, names up to which the blocks go to every executor, and pairs of task and
#: name that one Spark task looks at (a few seconds).
BLOCK = 1024
SENT = 100_000
PAIRS = 1_000_000


def weighted(tasks: DataFrame, pool: DataFrame, task: str, name: str, k: Column | int, weight: Column | None = None, seed: int = 0, purpose: str = "sample", most: int | None = None) -> DataFrame:
    """(task, name, rank): k distinct names for each task, in the order drawn. Weights of 0 or less are drawn, each as
    likely, once no other is left; k of 0 or less draws none; k beyond the pool, or beyond `most`, draws all up to there.
    A task that stands there m times meets each name m times. Every task meets the pool, but no pair is a row: the pool is
    written once, in blocks that are arrays, and a task's row keeps the first k of each block. Tasks are dealt out by how
    many pairs they make, so that neither time nor memory of a Spark task grows with them."""
    k = F.lit(k) if isinstance(k, int) else k
    k = F.least(k, F.lit(2**31 - 1 if most is None else most)).cast("int")
    names = pool.select(F.col(name).alias("name"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w"))
    names = io.written(names, "pool")
    size = names.count()
    blocks = -(-size // BLOCK)
    place = F.pmod(F.xxhash64("name"), F.lit(max(1, blocks)))
    arrays = names.groupBy(place.alias("__block")).agg(F.collect_list(F.struct("name", "w")).alias("__pool")).select("__pool")

    asked = tasks.select(F.col(task).alias("__task"), k.alias("__k")).where("__k > 0")
    asked = spread(asked, "__task", per=max(1, PAIRS // max(1, size))).groupBy("__task", "__k").agg(F.count("*").cast("int").alias("__m"))
    need = F.ceil(F.col("__k") / F.col("__m")).cast("int")

    def entry(x):
        weighs = F.coalesce(x["w"] > 0, F.lit(False))
        key = T.race(T.uniform(seed, purpose, F.col("__task"), x["name"]), F.when(weighs, x["w"]).otherwise(1.0))
        return F.struct((~weighs).alias("late"), key.alias("key"), x["name"].alias("name"))

    first = F.slice(F.array_sort(F.transform("__pool", entry)), F.lit(1), need)
    drawn = asked.crossJoin(arrays.hint("broadcast" if size <= SENT else "shuffle_replicate_nl")).select("__task", "__k", "__m", F.posexplode(first).alias("__at", "__x"))
    if blocks > 1:
        order = Window.partitionBy("__task", "__k").orderBy("__x")
        drawn = drawn.withColumn("__at", F.row_number().over(order) - 1).where(F.col("__at") < need)
    start = F.col("__at").cast("long") * F.col("__m")
    ranks = F.sequence((start + 1).cast("int"), F.least(F.col("__k"), start + F.col("__m")).cast("int"))
    return drawn.select(F.col("__task").alias(task), F.col("__x.name").alias(name), F.explode(ranks).alias("rank"))


def seed_apis(tasks: DataFrame, docs: DataFrame, counts: DataFrame, k: Column | int, alpha: float = 0.7, biased: bool = True, seed: int = 0, task: str = "task_id", name: str = "full_name", most: int | None = None) -> DataFrame:
    """Names for each task, rare ones likelier, on a snapshot of the counts."""
    from corpusmill.operators.lookup import with_counts

    pool = with_counts(docs.select(name), counts, name)
    return weighted(tasks, pool, task, name, k, T.rarity("use_count", alpha) if biased else None, seed, "seeds", most)


def counted_at_draw(drawn: DataFrame, counts: DataFrame, name: str = "full_name") -> DataFrame:
    """Counts as they are if a draw counts as a use."""
    new = drawn.groupBy(name).agg(F.count("*").alias("use_count"))
    return counts.select(name, "use_count").unionAll(new.select(name, "use_count")).groupBy(name).agg(F.sum("use_count").alias("use_count"))


def example_weights(examples: DataFrame, counts: DataFrame, key: str, alpha: float) -> DataFrame:
    """(key, weight): the mean rarity of the names that an example uses, else of its seeds; 1 if it has none."""
    names = F.array_distinct(F.when(F.size("used_apis") > 0, F.col("used_apis")).otherwise(F.col("seed_apis")))
    each = examples.select(key, F.explode(names).alias("full_name")).join(counts, "full_name", "left")
    mean = each.groupBy(key).agg(F.avg(T.rarity("use_count", alpha)).alias("w"))
    return examples.select(key).join(mean, key, "left").select(key, F.coalesce("w", F.lit(1.0)).alias("weight"))


def pairs(tasks: DataFrame, weights: DataFrame, key: str, seed: int = 0, biased: bool = True, task: str = "task_id") -> DataFrame:
    """(task, a, b): two distinct examples for each task."""
    two = weighted(tasks, weights, task, key, 2, F.col("weight") if biased else None, seed, "pair")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col(key)))
    return two.groupBy(task).agg(at(1).alias("a"), at(2).alias("b")).where(F.col("b").isNotNull())


def k_choice(choices: list[int], task: str = "task_id", seed: int = 0) -> Column:
    """One of the choices for each task."""
    u = T.uniform(seed, "k", F.col(task))
    return F.element_at(F.array(*map(F.lit, choices)), (F.floor(u * len(choices)) + 1).cast("int"))


def one_accepted(candidates: DataFrame, task: str = "task_id", seed: int = 0) -> DataFrame:
    """One of each task's accepted candidates, each as likely; the order that they came in does not matter."""
    key = F.struct(T.uniform(seed, "choose", F.col(task), F.col("candidate_id")), F.col("candidate_id"))
    best = candidates.where("ok").groupBy(task).agg(F.min_by(F.struct(*(c for c in candidates.columns if c != task)), key).alias("x"))
    return best.select(task, "x.*")


def task_seed(seed: int, task: str = "task_id") -> Column:
    return F.floor(T.uniform(seed, "task", F.col(task)) * (2**31 - 1)).cast("long")
