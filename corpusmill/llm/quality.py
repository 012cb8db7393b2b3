"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A token is a run of word bytes or a run of ASCII punctuation, lower-cased (A-Z); features are hashed one- and two-token
grams and the bias, each valued by its share of the text's grams; a score is one sparse dot product.

Cases: null and empty texts score the bias; labels that are null or belong to no document are not learned from; a
document labelled twice with different labels counts twice; with no labels every score is 0.5; repeated rows are each
scored; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common
from corpusmill.llm.linear import Ftrl, sigmoids

#: Features, labelled rows that are learned from at most (those with the smallest hash of the id, about), passes over them.
BITS, TRAIN_ROWS, EPOCHS = 18, 6000, 3
SCALE = 8.0
THRESHOLD = 0.7


def grams(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of every gram, in row order; feature 0 is the bias, which is not among them."""
    data = common.LOWER[data]
    start, end, row = common.runs(data, offs, common.BY_KIND)
    h = common.Hashes(data).of(start, end)
    with np.errstate(over="ignore"):
        pair = common.mixed(h[:-1] * np.uint64(3) + h[1:] * np.uint64(7))
    same = row[:-1] == row[1:]
    feat, rows = np.concatenate([h, pair[same]]), np.concatenate([row, row[:-1][same]])
    order = np.argsort(rows, kind="stable")
    return (feat[order] % np.uint64((1 << bits) - 1) + np.uint64(1)).astype(np.int64), rows[order]


def margins(data: np.ndarray, offs: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    feat, row = grams(data, offs, bits)
    n = np.bincount(row, minlength=len(offs) - 1)
    return weights[0] + SCALE * np.bincount(row, weights[feat], minlength=len(offs) - 1) / np.sqrt(np.maximum(n, 1)) / np.sqrt(np.maximum(n, 16))


def train(texts: list[str], labels: list[int]) -> np.ndarray:
    rows = []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        feat, _ = grams(raw, np.array([0, len(raw)]))
        idx, count = np.unique(feat, return_counts=True)
        n = len(feat)
        rows.append((np.concatenate([[0], idx]), np.concatenate([[1.0], SCALE * count / math.sqrt(max(n, 1)) / math.sqrt(max(n, 16))])))
    model = Ftrl(1 << BITS, alpha=0.5, l1=0.02, l2=0.5)
    return model.fit(rows, labels, EPOCHS).weights()


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS) -> list:
    """(text, label) of about `most` labelled rows outside the held-out quarter: those with the smallest hash of the id,
    in hash order. Only the chosen ids are broadcast: bounded by `most`."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    n, span = rows.count(), 1 << 40
    if not n:
        return []
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < min(span, math.ceil(span * most / n)))
    got = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "label", F.xxhash64("doc_id").alias("h")).collect()
    return sorted(got, key=lambda r: (r.h, r.text or "", r.label))[: int(1.2 * most)]


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """(doc_id, score) of every row; the weights go out with the task, 2**BITS numbers."""
    packed = weights.astype(np.float32)

    def work(batches):
        w = packed.astype(np.float64)
        for batch in batches:
            out = [sigmoids(margins(data, offs, w)) for _, _, offs, data in common.steps(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", name])

    return common.in_arrow(docs.select("doc_id", "text"), work, f"doc_id long, {name} double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = sample(docs, common.table(spark, sf_dir, "labels"), "quality")
    weights = train([r.text for r in got], [r.label for r in got]) if got else np.zeros(1 << BITS)
    return score(docs, weights).select(
        "doc_id", common.held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
