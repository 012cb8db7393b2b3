"""The streaming form of the loop's state: questions arrive, and the first of each is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import text as T
from corpusmill.operators import lookup


def first_of_each(stream: DataFrame, question: str, at: str, out: str, checkpoint: str, order: str) -> StreamingQuery:
    """Append to `out` the questions whose key is not there yet, the first by `order` of each batch. The table is the
    state: a batch that is run again finds its own rows and adds nothing twice."""
    schema = stream.withColumn("key", F.lit("")).schema

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows.limit(0).withColumn("key", F.lit("")).withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(out)
        seen = spark.read.schema(schema).parquet(out).select("key").distinct()
        new = lookup.unseen(rows, seen, question, order).withColumn("batch", F.lit(number).cast("long"))
        new.select(*rows.columns, "key", "batch").write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_stream(stream: DataFrame, at: str, used: str = "used_apis", late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Counts of names by time window, with late rows up to a bound."""
    each = stream.withWatermark(at, late).select(at, F.explode(used).alias("full_name"))
    return each.groupBy(F.window(at, every), "full_name").agg(F.count("*").alias("use_count"))


def keyed(stream: DataFrame, question: str) -> DataFrame:
    return stream.withColumn("key", T.normalise_question(question)).where("key <> ''")
