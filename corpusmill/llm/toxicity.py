"""Toxicity by a classifier chain.

Categories are predicted one after the other, each by a linear model over hashed features and the probabilities of the
categories before it; while training, those probabilities are out of fold, so that a later model learns from what an
earlier one says of texts it has not seen: a fold's models, their choice of features and their marks come from the other
folds alone. The labels hold one mark, `toxic`, so the two categories before it in the chain are derived from it, by how a
toxic text offends: by whole words that only toxic texts use (`insult`) or by word stems that only they use (`coined`).
Features are the distinct lower-cased words of the whole text and their first 4 and 5 bytes.

Cases: null and empty texts score by the biases alone; with no labels every score is 0; labels as in the quality
classifier; repeated rows are each scored; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common, quality
from corpusmill.llm.linear import Ftrl, sigmoids

BITS, TRAIN_ROWS, EPOCHS, FOLDS = 20, 6000, 2, 3
CHAIN = ("insult", "coined", "toxic")
THRESHOLD = 0.5
#: A cue is a feature that occurs in this many toxic texts at least, and in at most this share as many clean ones.
CUE_TEXTS, CUE_CLEAN = 8, 0.02
#: A feature is weighed if it occurs in this many toxic texts at least, this many times as often as by chance.
TELLING_TEXTS, TELLING_SHARE = 3, 3.0
WORDS = common.class_table(c0=bytes(c for c in range(128) if not chr(c).isalnum()))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row, kind) of every word (kind 0) and stem (1); feature numbers from len(CHAIN) + 1 on."""
    data = common.LOWER[data]
    start, end, row = common.runs(data, offs, WORDS)
    hashes, first = common.Hashes(data), len(CHAIN) + 1
    parts = [(hashes.of(start, end), row, 0)]
    for k in (4, 5):
        long = end - start > k
        parts.append((common.mixed(hashes.of(start[long], start[long] + k) + np.uint64(k)), row[long], 1))
    feat = np.concatenate([h for h, _, _ in parts]) % np.uint64((1 << BITS) - first) + np.uint64(first)
    return feat.astype(np.int64), np.concatenate([r for _, r, _ in parts]), np.concatenate([np.full(len(r), k, np.int8) for _, r, k in parts])


def _told(rows: list[np.ndarray], kinds: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """What some labelled texts tell: the features that are weighed, and the texts' mark for each category."""
    bad, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for feat, y in zip(rows, toxic, strict=True):
        (bad if y else good)[feat] += 1
    cue = (bad >= CUE_TEXTS) & (good * max(toxic.sum(), 1) <= CUE_CLEAN * bad * max((1 - toxic).sum(), 1))
    by_kind = [np.array([y and bool((cue[f] & (k == kind)).any()) for f, k, y in zip(rows, kinds, toxic, strict=True)], float) for kind in (0, 1)]
    # only telling features are weighed: noise from words that few texts have would drown them
    base = max(toxic.sum(), 1) / max(len(toxic), 1)
    telling = (bad >= TELLING_TEXTS) & (bad >= TELLING_SHARE * base * (bad + good))
    return telling, dict(zip(CHAIN, [*by_kind, toxic], strict=True))


def _fitted(rows: list[np.ndarray], earlier: np.ndarray, telling: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of one model; 0 for every feature that is not telling."""
    lead, used = np.arange(earlier.shape[1] + 1), [f[telling[f]] for f in rows]
    made = [(np.concatenate([lead, f]), np.concatenate([[1.0], e, np.ones(len(f))])) for f, e in zip(used, earlier, strict=True)]
    return Ftrl(1 << BITS, alpha=0.3, l1=1.0, l2=0.1).fit(made, y, EPOCHS).weights()


def train(texts: list[str], toxic: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each category its non-zero (features, weights); feature 0 is the bias, 1.. are earlier probabilities."""
    toxic = np.array(toxic, float)
    rows, kinds = [], []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        feat, _, kind = features(raw, np.array([0, len(raw)]))
        feat, at = np.unique(feat, return_index=True)
        rows.append(feat)
        kinds.append(kind[at])
    fold = np.arange(len(rows)) % FOLDS
    parts = [*(np.flatnonzero(fold != part) for part in range(FOLDS)), np.arange(len(rows))]
    # marks and features of a fold's models come from the texts that these models learn from, and from no other
    known = [_told([rows[i] for i in ids], [kinds[i] for i in ids], toxic[ids]) for ids in parts]
    earlier, chain = np.zeros((len(rows), 0)), []
    for name in CHAIN:
        k = earlier.shape[1]
        fitted = [_fitted([rows[i] for i in ids], earlier[ids], telling, marks[name]) for ids, (telling, marks) in zip(parts, known, strict=True)]
        unseen = [fitted[fold[i]][0] + fitted[fold[i]][1 : k + 1] @ earlier[i] + fitted[fold[i]][f].sum() for i, f in enumerate(rows)]
        w = fitted[-1]
        chain.append((np.flatnonzero(w), w[np.flatnonzero(w)]))
        earlier = np.column_stack([earlier, sigmoids(np.array(unseen))])
    return chain


def probabilities(data: np.ndarray, offs: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """One row of probabilities for each text, one column for each category of the chain."""
    feat, row, _ = features(data, offs)
    used = np.any([t[feat] != 0 for t in tables], axis=0) if len(feat) else np.zeros(0, bool)
    pairs = np.unique(row[used] * (1 << BITS) + feat[used])
    row, feat = pairs >> BITS, pairs & ((1 << BITS) - 1)
    out = np.zeros((len(offs) - 1, len(tables)))
    for k, t in enumerate(tables):
        m = t[0] + np.bincount(row, t[feat], minlength=len(offs) - 1) + out[:, :k] @ t[1 : k + 1]
        out[:, k] = sigmoids(m)
    return out


def score(docs: DataFrame, chain) -> DataFrame:
    """(doc_id, a column for each category); the models go out with the task, 2**BITS numbers each at most."""
    names = [f"p_{c}" for c in CHAIN]

    def work(batches):
        tables = []
        for idx, w in chain:
            tables.append(np.zeros(1 << BITS))
            tables[-1][idx] = w
        for batch in batches:
            out = [probabilities(data, offs, tables) for _, _, offs, data in common.steps(batch.column("text"))] if tables else [np.zeros((len(batch), len(CHAIN)))]
            out = np.concatenate(out) if out else np.zeros((0, len(CHAIN)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(out[:, k])) for k in range(len(CHAIN)))], names=["doc_id", *names])

    return common.in_arrow(docs.select("doc_id", "text"), work, ", ".join(["doc_id long", *(f"{n} double" for n in names)]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, the chain's probabilities, score (that of `toxic`) and predicted (1 if it is THRESHOLD or more)."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality.sample(docs, common.table(spark, sf_dir, "labels"), "toxic", TRAIN_ROWS)
    chain = train([r.text for r in got], [r.label for r in got]) if got else []
    return score(docs, chain).select(
        "doc_id", common.held_out().alias("held_out"), "p_insult", "p_coined", F.col("p_toxic").alias("score"),
        F.when(F.col("p_toxic") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
