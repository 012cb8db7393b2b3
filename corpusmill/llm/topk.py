"""Exact top-k by inner product with a pivot table.

Vectors become whole numbers floor(256 x). The inner product is (|q|^2 + |x|^2 - |q - x|^2) / 2, and for any pivot p,
|q - x| >= | |q - p| - |x - p| |. The table holds every vector's distances to many pivots; for a query, the largest of
these lower bounds gives an upper bound of the score, and candidates are evaluated in the order of their bounds until
the next bound is below the k-th score found: the answer is exact whatever the pivots.

Vectors are packed into blocks, and each block of queries meets each block of vectors once, in a task of its own.

Cases: vectors that are null, empty or hold a null or a component that is not finite take no part; vectors meet only
those of their length; rows that repeat a vec_id count as one, with the least vector; null ids take no part; scores
beyond a long are cut to it; ties go to the smaller vec_id; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import common

K, QUERY_EVERY = 5, 50
#: Pivots, the rows that they are picked from, and the rows of a block.
PIVOTS, PIVOT_ROWS, BLOCK = 24, 512, 2048
#: Candidates evaluated before the bound is looked at again.
CHUNK = 256
_BLOCK = "dim int, ids binary, data binary, to_pivots binary"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): vectors times 256, as doubles, still to be floored."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(key, column).where(F.col(column).isNotNull() & (F.size(column) > 0) & finite)
    v = F.transform(column, lambda x: x.cast("double") * 256)
    return common.one_per_id(rows, key, column).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def pick_pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length of vector: PIVOTS vectors, each as far as can be from those before it, of the PIVOT_ROWS rows with the
    smallest hash of the id."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).collect()
    out = {}
    for dim in sorted({len(r.v) for r in some}):
        x = np.floor(np.array([r.v for r in some if len(r.v) == dim]))
        at, far = [0], np.linalg.norm(x - x[0], axis=1)
        while len(at) < min(PIVOTS, len(x)):
            at.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(x - x[at[-1]], axis=1))
        out[dim] = x[at]
    return out


def to_pivots(x: np.ndarray, pivots: dict[int, np.ndarray]) -> np.ndarray:
    p = pivots.get(x.shape[1])
    if p is None:
        p = np.zeros((1, x.shape[1]))
    return np.stack([np.linalg.norm(x - q, axis=1) for q in p], axis=1)


def packed(rows: DataFrame, pivots: dict[int, np.ndarray], blocks: int) -> DataFrame:
    """rows dealt out evenly and packed, with the pivot table."""

    def work(batches):
        held: dict[int, list] = {}

        def block(dim, part):
            x = np.floor(np.array([v for _, v in part], np.float64).reshape(len(part), dim))
            ids = np.array([i for i, _ in part], np.int64)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([x.tobytes()], pa.binary()), "to_pivots": pa.array([to_pivots(x, pivots).tobytes()], pa.binary())})

        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                part = held.setdefault(len(v), [])
                part.append((i, v))
                if len(part) == BLOCK:
                    yield block(len(v), held.pop(len(v)))
        for dim, part in sorted(held.items()):
            yield block(dim, part)

    return rows.repartition(blocks).mapInArrow(work, _BLOCK)


def scores(x: np.ndarray, q: np.ndarray, exact: bool) -> list[int] | np.ndarray:
    if exact:
        return (x @ q).astype(np.int64)
    most = (1 << 63) - 1
    return np.array([max(-most - 1, min(most, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in x], np.int64)


def search(q_ids, q, q_table, ids, x, table, k: int = K) -> list[tuple[int, int, int]]:
    """(query, id, score): the k best of the block for each query."""
    out = []
    exact = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * x.shape[1] < 2**53
    norms = (x * x).sum(axis=1)
    for a in range(0, len(q), 64):
        part, t = q[a : a + 64], q_table[a : a + 64]
        low = np.zeros((len(part), len(x)))
        for p in range(table.shape[1]):
            np.maximum(low, np.abs(t[:, p, None] - table[None, :, p]), out=low)
        size = (part * part).sum(axis=1)[:, None] + norms
        bound = (size - low * low) / 2 + size * 1e-9 + 1
        for i, v in enumerate(part):
            best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
            order = np.argsort(-bound[i], kind="stable")
            for c in range(0, len(order), CHUNK):
                if len(best_s) == k and bound[i][order[c]] < best_s[-1]:
                    break
                at = order[c : c + CHUNK]
                at = at[ids[at] != q_ids[a + i]]
                s, n = np.concatenate([best_s, scores(x[at], v, exact)]), np.concatenate([best_i, ids[at]])
                top = np.lexsort((n, -s if exact else [-int(z) for z in s]))[:k]
                best_s, best_i = s[top], n[top]
            out += [(int(q_ids[a + i]), int(n), int(s)) for n, s in zip(best_i, best_s, strict=True)]
    return out


def top_k(vectors: DataFrame, is_query, key: str = "vec_id", column: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query (a condition on `id`) holds, its k best rows."""
    rows = usable(vectors, key, column)
    n, n_queries = rows.count(), rows.where(is_query).count()
    pivots = pick_pivots(rows)
    blocks = max(1, math.ceil(n / BLOCK))
    cand = packed(rows, pivots, blocks).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(blocks)))
    query = packed(rows.where(is_query), pivots, max(1, math.ceil(n_queries / BLOCK)))
    query = query.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("to_pivots").alias("q_pivots"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("q_lane"))
    pairs = cand.join(query.hint("shuffle_hash"), (F.col("lane") == F.col("q_lane")) & (F.col("dim") == F.col("q_dim")))

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                f = lambda b, kind=np.float64: np.frombuffer(b, kind)
                q_ids, ids = f(r["q_ids"], np.int64), f(r["ids"], np.int64)
                got = search(q_ids, f(r["q_data"]).reshape(-1, dim), f(r["q_pivots"]).reshape(len(q_ids), -1), ids, f(r["data"]).reshape(-1, dim), f(r["to_pivots"]).reshape(len(ids), -1), k)
                a, b, c = zip(*got, strict=True) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["query_id", "vec_id", "score"])

    found = pairs.select("dim", "ids", "data", "to_pivots", "q_ids", "q_data", "q_pivots").mapInArrow(work, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_EVERY == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
