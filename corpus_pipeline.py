"""The corpus pipeline: each stage takes what the stage before it kept, and its decisions take effect.

Language identification drops documents whose language it rejects; near-duplicates keep one document of each component;
decontamination drops documents that hold a benchmark window; personal data is replaced by its kind in brackets; what is
left is encoded as sampled segmentations. All stages but the last return the columns of `documents`.

Cases: documents with null or empty text are rejected by the first stage; rows without doc_id leave with the second, which
also makes rows that repeat a doc_id one (the first by text, then the other columns); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import common, decontamination, langid, near_dups, pieces, pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    dictionaries = langid.fit(docs.where(~common.held_out()))
    return langid.predict(docs, dictionaries).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS).where(F.col("doc_id").isNotNull())
    found = near_dups.near_duplicates(docs)
    docs = docs.join(found.where(F.col("doc_id") == F.col("component_id")).select("doc_id"), "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), "lang", "source", "n_chars")
    return docs.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    items = common.table(spark, sf_dir, "benchmark").select("item_id", "text")
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("row_key"), "text")
    bad = decontamination.report(rows, items).where("contaminated").select("row_key").distinct()
    key = F.struct("doc_id", F.xxhash64("text").alias("h"))
    return docs.join(decontamination.sized(bad), key == F.col("row_key"), "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = pii.select(docs, pii.fit(docs))
    clean = found.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.sample(docs)


STAGES = [
    ("language id", language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", redact),
    ("sentencepiece", encode),
]

#: Classifier, boosted trees and sampling have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stash(docs, name.replace(" ", "_"))
    return docs
