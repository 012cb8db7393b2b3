"""The stages one by one against what they are to keep."""

import pytest

import corpus_pipeline
from corpusmill.llm import common
from tests.compare import SF
from tests.llm import brute
from tests.llm.test_edges import ROWS, write


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = common.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = common.stash(stage(spark, docs, SF), "step")
        out.append((docs, made))
        docs = made
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == list(corpus_pipeline.COLUMNS) and after.count() <= before.count()


def test_language_keeps_clean_documents(steps):
    before, after = steps[0]
    assert after.count() > 0.97 * before.count()


def test_near_duplicates(steps):
    before, after = steps[1]
    want = {i for i, (_, c) in brute.near(pairs(before)).items() if i == c}
    assert {i for i, _ in pairs(after)} == want


def test_decontamination(spark, steps):
    before, after = steps[2]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    assert sorted(i for i, _ in pairs(after)) == sorted(r[0] for r in brute.contamination(pairs(before), items) if not r[-1])


def test_redaction(steps):
    before, after = steps[3]
    texts = dict(pairs(after))
    for i, text in pairs(before):
        for kind, a, b in brute.pii(text):
            assert text[a:b] not in texts[i] and f"[{kind.upper()}]" in texts[i]
        assert brute.pii(text) or "[" in texts[i] or texts[i] == text


def test_encoding(steps):
    before, after = steps[4]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i, _ in pairs(before)}
    assert after.where("NOT round_trip").count() == 0


def test_edges(spark, tmp_path):
    for at, rows in (("some", ROWS), ("none", [])):
        got = corpus_pipeline.run(spark, write(spark, tmp_path / at, rows)).collect()
        assert all(r.doc_id is not None and r.round_trip for r in got)
