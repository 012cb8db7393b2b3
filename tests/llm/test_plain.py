"""Classifiers and ownership against plain versions on small inputs."""

import random

import numpy as np
import pytest

from corpusmill.llm import common, quality, secret_scan, toxicity
from tests.llm import brute


def arrays(texts):
    import pyarrow as pa

    offs, data = common.texts_of(pa.array(texts))
    return data, offs


def made(seed, n=150, share=0.4):
    """Texts of which some have words that mark them; many are alike, so that scores tie."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        bad = rng.random() < share
        words = rng.choices("alpha beta gamma delta epsilon zeta".split(), k=rng.randrange(1, 7)) + ["scoundrel", "vilexyz", "scounder"][: rng.randrange(1, 4)] * bad
        rng.shuffle(words)
        out.append((" ".join(words) + rng.choice(["", "!", " ..", "\n"]), int(bad != (rng.random() < 0.05))))
    return [t for t, _ in out], [y for _, y in out]


def test_quality_equals_plain_ftrl():
    texts, labels = made(1)
    plain = brute.Ftrl(0.5, 0.02, 0.5).fit([brute.quality_features(t) for t in texts], labels, quality.EPOCHS)
    more = [*texts[:40], "", "beta!! unseen words"]
    scores = quality.sigmoids(quality.margins(*arrays(more), quality.train(texts, labels)))
    assert scores.tolist() == pytest.approx([plain.score(brute.quality_features(t)) for t in more], abs=1e-9)


def test_toxicity_equals_plain_chain():
    texts, labels = made(2, 400, 0.15)
    chain, tables = brute.toxic_chain(texts, labels), []
    for idx, w in toxicity.train(texts, labels):
        tables.append(np.zeros(1 << toxicity.BITS))
        tables[-1][idx] = w
    more = [*texts[:40], "", "beta!! unseen words"]
    out = toxicity.probabilities(*arrays(more), tables)
    assert out.ravel().tolist() == pytest.approx([p for t in more for p in brute.toxic_scores(t, chain)], abs=1e-9)
    assert len(set(np.round(out[:, 2], 6))) > 2


def test_ownership_equals_plain_count(spark):
    keys = ["9233A8ECF7C5B09FE5949719B6B82BC4", "ghp_" + "aB3" * 12, "eyJhbGciOi.eyJzdWIi1.abcdefgh", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, 'token="hunter22"', "secret: 9233A8ECF7C5B09FE5949719B6B82BC4"]
    rng, rows = random.Random(4), []
    for i in range(80):
        # the first keys of the list go to few owners
        owner = rng.choice(["o1", "o2", "o3", "o4", None])
        held = [k for j, k in enumerate([*keys, *(f"{n:032X}A" for n in range(3))]) if rng.random() < 0.25 and (j % 2 or owner in ("o1", None))]
        rows.append((i, None if i == 7 else " é ".join(["x", *held, "y"]), owner, rng.choice(["r1", "r2", None])))
    rows.append((80, keys[0] + " " + "0" * 40 + " " + "F" * 40, "o1", "r9"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string")
    out = secret_scan.scan(df, repository="repo").collect()
    got = {r.doc_id: ([(s.kind, s.start, s.end) for s in r.spans], r.n_live, r.n_copied, r.n_repositories) for r in out}
    want = {i: tuple(x) for i, *x in brute.owned_secrets(rows, secret_scan.FURTHER, secret_scan.COPIED_OWNERS)}
    assert got == want
    assert any(k == "upper" for spans, *_ in got.values() for k, _, _ in spans) and sum(r.n_copied for r in out)
