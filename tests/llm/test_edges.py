"""Nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from corpusmill.llm.queries import QUERIES
from tests.llm import brute

LONG = "word " * 30_000 + "a" * 50_000 + " x@y.zz 10.0.0.1 token=abcdefgh"
ROWS = [
    (1, "The cat sat on the mat and then it slept all day long in the sun", "en", "s", 5),
    (2, None, None, None, None), (3, "", "en", None, 0), (4, "   \n\t ", "de", "s", 3), (5, "12345 !!!", "en", "s", 9),
    (6, LONG, "en", "s", 1), (7, LONG, "en", "t", 1), (7, LONG, "en", "t", 1), (8, "Der Hund schlief den ganzen Tag in der Sonne und war froh", "de", None, 2),
    (9, "é😀" * 300 + " AKIA" + "A" * 16, "fr", "u", 1), (None, "no id token=abcdefgh", "en", "u", 1),
]
EXTRA = "label bigint, row bigint, n bigint, h bigint, key string, doc string, token string, base string, spans string, score string, rank string, ids string, held_out string, items string, words string"


def write(spark, at, rows):
    extra = [c.strip().split() for c in EXTRA.split(",")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d.select("*", *(F.lit(None).cast(t).alias(n) for n, t in extra)).write.parquet(f"{at}/documents.parquet")
    few = rows[:0] if not rows else [(1, 1, 0), (3, 0, 1), (8, None, None), (None, 1, 1), (6, 0, 1), (6, 1, 0)]
    spark.createDataFrame(few, "doc_id bigint, quality int, toxic int").select("*", F.lit("x").alias("text"), F.lit("x").alias("label")).write.parquet(f"{at}/labels.parquet")
    items = [(1, "slept all day"), (2, None), (3, ""), (None, "the cat"), (4, "the cat sat on the mat and then it slept all day"), (4, "word"), (5, "word")] if rows else []
    spark.createDataFrame(items, "item_id bigint, text string").select("*", F.lit("x").alias("words"), F.lit(1).alias("doc_id")).write.parquet(f"{at}/benchmark.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [0.5, -0.1]), (50, [0.5, -0.1]), (1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5, -0.1]), (7, [1.0]), (6, [0.5, -0.1]), (None, [1.0, 1.0])] if rows else []
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").select("*", F.lit(1).alias("id"), F.lit(1).alias("score")).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edge"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", ["op1_language_id", "op4_quality", "op5_decontamination", "op6_toxicity", "op7_pii", "op8_secrets"])
def test_each_row_is_answered(spark, edge, name):
    rows = QUERIES[name](spark, edge).collect()
    assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS)
    seven = [tuple(r) for r in rows if r.doc_id == 7]
    assert seven[0] == seven[1]


def test_language(spark, edge):
    rows = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, edge).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (2, 3, 4, 5)) and rows[8].lang_pred in ("en", "de", "fr")


def test_spans(spark, edge):
    for name, plain in (("op7_pii", brute.pii), ("op8_secrets", brute.secrets)):
        for r in QUERIES[name](spark, edge).collect():
            text = next(t for i, t, *_ in ROWS if i == r.doc_id)
            assert r.base_sha256 == brute.sha(brute.written(plain(text)))


def test_decontamination(spark, edge):
    items = [(1, "slept all day"), (2, None), (3, ""), (4, "the cat sat on the mat and then it slept all day"), (4, "word"), (5, "word")]
    want = brute.contamination([r[:2] for r in ROWS], items)
    assert sorted(map(repr, (tuple(r) for r in QUERIES["op5_decontamination"](spark, edge).collect()))) == sorted(map(repr, want))


def test_pairs(spark, edge):
    docs = {r[0]: r[1] for r in ROWS if r[0] is not None}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op9_near_dups"](spark, edge).collect()}
    assert got == brute.near(docs.items())
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_suffix_dedup"](spark, edge).collect()}
    assert got == brute.repeats(list(docs.items()))


def test_vectors(spark, edge):
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in QUERIES["op10_topk"](spark, edge).collect())
    s = 128 * 128 + 26 * 26
    assert rows == [(0, 1, 6, s), (0, 2, 50, s), (50, 1, 0, s), (50, 2, 6, s)]


def test_segmentations(spark, edge):
    rows = QUERIES["op2_sentencepiece"](spark, edge).collect()
    assert all(r.round_trip for r in rows)
    for i in (2, 3):
        assert [(r["rank"], r.n_pieces, r.inclusion) for r in rows if r.doc_id == i] == [(1, 0, 1.0)]
    assert sum(r.doc_id == 7 for r in rows) == 4 and len({r.ids_sha256 for r in rows if r.doc_id == 7}) == 2
