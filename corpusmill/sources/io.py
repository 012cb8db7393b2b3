"""Scans and sinks. Scans name their schema; strict ones fail on a bad line, lenient ones drop and count it."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill import schemas
from corpusmill.functions import text as T

_BAD = "__bad_line"
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose driver and executors
    are one process, gets a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="checkpoints"))
    return _LOCAL[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, with no lineage behind it."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; a line that is no such record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, ordinal): non-blank lines; ordinals rise along each file and from file to file."""
    text = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return text.where(T.strip("line") != "").select("line", F.struct("path", "block", "id").alias("ordinal"))


def strict_with_place(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """As strict, with ordinal; the error names the file and the line."""
    schema = schemas.struct(schema)
    with_bad = StructType([*schema.fields]).add(_BAD, "string")
    got = lines(spark, path).withColumn("r", F.from_json("line", with_bad, {"columnNameOfCorruptRecord": _BAD}))
    bad = F.concat(F.col("ordinal.path"), F.lit(": bad line: "), F.substring("line", 1, 200))
    checked = F.when(F.col(f"r.{_BAD}").isNull(), F.col("ordinal")).otherwise(F.raise_error(bad).cast("struct<path: string, block: bigint, id: bigint>"))
    return got.select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields), checked.alias("ordinal"))


def lenient(spark: SparkSession, path: str, schema: str | StructType, bad: Observation | None = None) -> DataFrame:
    """As lines, parsed; what is no JSON object is dropped, and counted if an observation is given. A missing file is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.struct(schema)).withColumn("ordinal", F.lit(None).cast("struct<path: string, block: bigint, id: bigint>"))
    schema = schemas.struct(schema)
    with_bad = StructType([*schema.fields]).add(_BAD, "string")
    got = lines(spark, path).withColumn("r", F.from_json("line", with_bad, {"columnNameOfCorruptRecord": _BAD}))
    is_bad = F.col(f"r.{_BAD}").isNotNull() | ~F.trim("line").startswith("{")
    if bad is not None:
        got = got.observe(bad, F.count_if(is_bad).alias("bad_lines"))
    return got.where(~is_bad).select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields), "ordinal")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files; bytes that are no UTF-8 are left out."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\ufffd", "").alias("text"))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(full_name): distinct lines, without blanks and comments."""
    got = spark.read.text(path).select(T.strip("value").alias("full_name"))
    return got.where((F.col("full_name") != "") & ~F.col("full_name").startswith("#")).distinct()


def by_suffix(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines for .jsonl, else one JSON list."""
    return strict(spark, path, schema) if path.endswith(".jsonl") else spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(order).limit(n)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", order: str | None = None, single: bool = False) -> None:
    """JSON lines with nulls and all characters as they are. In order: files follow it, each sorted."""
    if order is not None:
        df = (df.coalesce(1).sortWithinPartitions(order) if single else df.repartitionByRange(order).sortWithinPartitions(order))
    elif single:
        df = df.coalesce(1)
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_names(df: DataFrame, path: str, name: str = "full_name") -> None:
    df.select(name).distinct().orderBy(name).write.mode("overwrite").text(path)


def write_report(row: dict, path: str) -> None:
    Path(path).write_text(json.dumps(row, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
