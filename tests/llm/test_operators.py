"""Each query against a plain version or held-out labels on the small tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common, decontamination, langid, near_dups, pieces, pii, secret_scan, suffix_dedup, topk
from corpusmill.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import SF, assert_same
from tests.llm import brute

SF2 = "/root/testdata/sf0.01"


def table(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return [(r[0], r[1]) for r in table("documents")]


def got(spark, name, sf=SF):
    return QUERIES[name](spark, sf).collect()


def test_language(spark):
    truth = {r[0]: r[2] for r in table("documents", SF2)}
    rows = [r for r in got(spark, "op1_language_id", SF2) if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_and_toxicity(spark):
    labels = {r[0]: r[1:] for r in table("labels", SF2)}
    rows = [r for r in got(spark, "op4_quality", SF2) if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id][0] for r in rows]) > 0.85
    rows = [r for r in got(spark, "op6_toxicity", SF2) if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in rows]) > 0.9


def test_suffix_dedup(spark, docs):
    want = brute.repeats(docs)
    assert {r.doc_id: tuple(r)[1:] for r in got(spark, "op3_suffix_dedup")} == want


def test_previous_factors():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 60):
        text = bytes(rng.integers(97, 99, n).astype(np.uint8))
        want = [max((next((k for k in range(n - i + 1) if i + k == n or text[i + k] != text[j + k]), 0) for j in range(i)), default=0) for i in range(n)]
        assert suffix_dedup.previous_factors(text).tolist() == want


def test_decontamination(spark, docs):
    want = brute.contamination(docs, [r[:2] for r in table("benchmark")])
    assert sorted(tuple(r) for r in got(spark, "op5_decontamination")) == sorted(want)


def test_joins_that_are_not_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 3)
    items = table("benchmark")[:3]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    out = decontamination.report(d, spark.createDataFrame(items, "item_id bigint, text string"))
    want = {r[0]: r[2] for r in brute.contamination(docs, [r[:2] for r in items])}
    assert {r.doc_id: r.n_hit for r in out.collect()} == want


def test_near_terms(spark):
    d = spark.createDataFrame([(1, "x rare one y two z"), (2, "rare y y y y y y y one two")], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, "Rare two one")], "item_id bigint, text string")
    assert decontamination.near(decontamination.tokens(d), items, 4).select("item_id").count() == 1


def test_pii(spark, docs):
    rows = {r.doc_id: r for r in got(spark, "op7_pii")}
    for i, text in docs:
        base = brute.pii(text)
        assert rows[i].base_sha256 == brute.sha(brute.written(base))
        assert set(brute.written(base).split(",")) <= set(rows[i].spans.split(","))
        assert rows[i].n_card == sum(k == "card" for k, _, _ in base)


@pytest.mark.parametrize("text", ["a.b_c@d.e_f@g.h", "+1 555 1234567 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "é😀 x@y.z ++12345678901234567890", "a@b", "01.002.3.255"])
def test_pii_corner_cases(spark, text):
    out = pii.with_candidates(spark.createDataFrame([(text,)], "text string")).first()
    assert [(s.kind, s.start, s.end) for s in out.base] == brute.pii(text)


@pytest.mark.parametrize("text, found", [
    ("write jane.doe (at) example.com. Please", "jane.doe (at) example.com"), ("or jane [at] example.org now", "jane [at] example.org"),
    ("jane(at)mail.example.co.uk", "jane(at)mail.example.co.uk"), ("to jane.doe at example.com", "jane.doe at example.com"), ("jane at example dot com", "jane at example dot com"),
    ("jane (at) example. com", "jane (at) example. com"), ("we met at noon. We left", None), ("look at example.com", None)])
def test_loose_addresses(spark, text, found):
    t, x = F.col("text"), F.col("x")
    out = pii.with_candidates(spark.createDataFrame([(text,)], "text string")).select("text", F.explode("more").alias("x"))
    assert [r.found for r in out.where(pii._mark(t, x) == 1).select("x.found").collect()] == ([found] if found else [])
    assert found or not out.count()


def test_trees_read_the_features_they_were_fitted_to(spark):
    cards = ["4111111111111111" if i % 2 else "4111111111111112" for i in range(400)]
    df = spark.createDataFrame([(i, f"no {c} x (at) y.zz") for i, c in enumerate(cards)], "doc_id bigint, text string")
    out = pii.select(df, pii.fit(df)).select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == "card")).alias("n")).collect()
    assert all(r.n == r.doc_id % 2 for r in out)


def test_trees_give_the_same_sums_as_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (500, len(pii.FEATURES))).astype(float)
    model = pii.Boosted(x, ((x[:, 0] > 4) ^ (x[:, 5] > x[:, 9])).astype(float))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:200])], ["i", *pii.FEATURES])
    out = {r.i: r.m for r in df.select("i", model.column({k: F.col(k) for k in pii.FEATURES}).alias("m")).collect()}
    assert [out[i] for i in range(200)] == pytest.approx(model.margins(x[:200]).tolist())
    assert not {"cue", "checksum", "octets", "domain"} & set(pii.FEATURES)


def test_few_candidates_prove_no_precision():
    assert pii.lower_bound(np.array([3.0]), np.array([3.0]))[0] < 0.5 and pii.lower_bound(np.array([4000.0]), np.array([4000.0]))[0] > 0.99


@pytest.mark.parametrize("dense", [0, 300])
def test_loose_spans_do_not_hang_on_the_sample(spark, dense):
    loose = ["tel 555 123 4567 now", "jane.doe [at] example dot org"]
    rows = [(i, t) for i, t in enumerate(loose + ["nothing here"] * 50 + ["mail a@b.cc, not 300.1.1.1 or 555 123 4567"] * dense)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = pii.fit(df)
    assert (model is None) == (dense == 0)
    out = {r.doc_id: r.spans for r in pii.select(df, model).where("doc_id < 3").collect()}
    assert [[s.found for s in out[i]] for i in range(3)] == [["555 123 4567"], ["jane.doe [at] example dot org"], []]


def test_fitting_sample_holds_sparse_candidates(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE_CANDIDATES", 400)
    monkeypatch.setattr(pii, "SAMPLE_DOCS", 400, raising=False)
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "x@y.zz 300.1.1.1").otherwise("none").alias("text"))
    assert pii.fit(df) is not None


def test_all_candidates_are_fitted_to(spark):
    # 2,000 addresses among 60,000 candidates: about 500 held out, enough to prove a precision of 0.99; a third of them are not
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 30 == 0, "x@y.zz").otherwise("300.1.1.1").alias("text"))
    assert "email" in pii.fit(df)[1]


def test_table_and_rows_give_the_same_trees(spark):
    texts = F.array(*map(F.lit, ["mail a.b@c.dd, +1 555 123 4567", "no 4111 1111 1111 1112 or 555 123 4567", "tel 555 123 4567, 300.1.1.1", "[4111111111111111] and 1.2.3.4"]))
    df = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("w"), F.col("id").cast("int") % 7), F.lit(" "), F.get(texts, (F.col("id") % 4).cast("int"))).alias("text"))
    rows = pii.counted(df).collect()
    assert sum(r.n for r in rows) == pii.with_candidates(df).agg(F.sum(F.size("base") + F.size("more"))).first()[0]
    own = [r for r in rows if not r.held]
    x, y, n = np.array([r[3:-1] for r in own], float), np.array([r.y for r in own], float), np.array([r.n for r in own])
    model, thresholds = pii.fit(df)
    each = pii.Boosted(np.repeat(x, n, 0), np.repeat(y, n))
    assert model.trees == each.trees == pii.Boosted(x, y, n=n).trees and model.bias == each.bias
    for kind in pii.KINDS:
        held = sorted(((float(m), r.y) for r in rows if r.held and r.kind == kind for m in model.margins(np.array([r[3:-1]], float)) for _ in range(r.n)), reverse=True)
        good = [m for m in {m for m, _ in held} if pii.lower_bound(np.array([sum(y for v, y in held if v >= m)]), np.array([sum(v >= m for v, _ in held)]))[0] >= pii.MIN_PRECISION]
        assert thresholds.get(kind) == min(good, default=None)


def test_redaction(spark):
    df = spark.createDataFrame([("é x@y.z, 1.2.3.4!",), ("none",), (None,)], "text string")
    out = pii.select(df, None).select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [r.t for r in out] == ["é [EMAIL], [IP]!", "none", None]


def test_secrets(spark, docs):
    rows = {r.doc_id: r for r in got(spark, "op8_secrets")}
    for i, text in docs:
        base = brute.secrets(text)
        assert rows[i].base_sha256 == brute.sha(brute.written(base)) and rows[i].n_hex == sum(k == "hex" for k, _, _ in base)


@pytest.mark.parametrize("form", ["{h}\n{b}\n{e}", "key = '{h}\\n{b}\\n{e}'", "{h}\r\n{b}", "{h}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n{b}\n{e} end"])
def test_private_keys_are_owned_by_their_bodies(spark, form):
    text = lambda k: "a " + form.format(h="-----BEGIN RSA PRIVATE KEY-----", b=f"MIIE{k * 60}\n{k * 20}==", e="-----END RSA PRIVATE KEY-----")
    rows = [(i, text(k), f"s{i}") for i, k in enumerate("xyz")] + [(3 + i, text("w").replace("\n", "\n  " * i or "\n"), f"s{i}") for i in range(3)]
    out = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    for i, t, _ in rows[:3]:
        (x,) = out[i].spans
        assert (x.kind, x.start) == ("private", t.index("-----BEGIN")) and "==" in x.found and (out[i].n_live, out[i].n_copied) == (1, 0)
        assert "END" not in t or x.found.endswith("-----END RSA PRIVATE KEY-----")
    assert all((out[i].spans, out[i].n_live, out[i].n_copied) == ([], 0, 1) for i in (3, 4, 5))


def test_near_duplicates(spark, docs):
    want = brute.near(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got(spark, "op9_near_dups")} == want


def test_near_duplicates_around_the_threshold(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    docs = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for k in rng.choice(120, rng.integers(1, 9), replace=False):
            w[k] = f"x{i}.{k}"
        docs.append((i, " ".join(w)))
    found = near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute.near(docs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)]
    out = {r.node: r.label for r in near_dups.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[103] == 100


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_topk_is_exact_beyond_doubles(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**40), 3.0], [1.0, 1.0]])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("id") == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank)] == [(1, min(2**96 + 2 * 2**16, 2**63 - 1)), (3, 2**48 * 2**8 + 2**16)]


def ways(v, text):
    """Probabilities of all segmentations."""
    table, out = {b: i for i, b in enumerate(v.bytes_of) if len(b) and i > 258}, {}

    def go(at, ids, w):
        if at == len(text):
            out[tuple(ids)] = w
        for n in range(1, len(text) - at + 1):
            i = table.get(text[at : at + n])
            if i is not None:
                go(at + n, [*ids, i], w * v.weight[i])
        if text[at : at + 1] and text[at : at + 1] not in table:
            i = int(v.byte_id[text[at]])
            go(at + 1, [*ids, i], w * v.weight[i])

    go(0, [], 1.0)
    total = sum(out.values())
    return {s: w / total for s, w in out.items()}


def segmentations(*args):
    for rank, rows, bounds, ids, log_prob, inclusion, same in pieces.sample_step(*args):
        for i, row in enumerate(rows.tolist()):
            yield rank, row, ids[bounds[i] : bounds[i + 1]].tolist(), log_prob[i], inclusion[i], same[i]


def test_sampled_segmentations():
    v, n = pieces.vocabulary(), 4000
    want = ways(v, b" ab\nthe")
    offs, data = common.texts_of(pa.array(["ab\nthe"] * n))
    rows = {}
    for rank, row, ids, log_prob, inclusion, same in segmentations(np.arange(n), offs, data, v, 3):
        assert same and log_prob == pytest.approx(np.log(want[tuple(ids)]))
        rows.setdefault(row, []).append((tuple(ids), inclusion))
    top = sorted(want, key=want.get)[-3:]
    for s in top:
        second = sum(want[a] * want[s] / (1 - want[a]) for a in want if a != s)
        assert np.mean([r[1][0] == s for r in rows.values()]) == pytest.approx(second, abs=0.03)
        assert sum(1 / p for r in rows.values() for x, p in r if x == s) / n == pytest.approx(1, abs=0.08)
    assert all(len({s for s, _ in r}) == 3 for r in rows.values())


def check_exact(text, k=3, n=20):
    v = pieces.vocabulary()
    want = ways(v, b" " + text.encode())
    offs, data = common.texts_of(pa.array([text] * n))
    found = set()
    for _, _, ids, log_prob, inclusion, same in segmentations(np.arange(n), offs, data, v, k):
        assert same and log_prob == pytest.approx(np.log(want[tuple(ids)]))
        found.add(tuple(ids))
    return want, found, v


@pytest.mark.parametrize("text", ["x;\r\n}\r", "/**\r\n", "a\tb\r\r\n\x01"])
def test_pieces_with_control_characters(text):
    want, found, v = check_exact(text, n=300)
    assert any(len(v.bytes_of[i]) > 1 and b"\r" in v.bytes_of[i] for ids in found for i in ids)


def test_stretches_beyond_a_unit_stay_whole(monkeypatch):
    monkeypatch.setattr(pieces, "UNIT", 4)
    check_exact("theninging\u4e2d\u6587", n=100)


@pytest.mark.parametrize("text", ["https://example.org/" + "thenationalinformation" * 40, "\u4e2d\u6587\u5b57" * 60, "a" * 3000 + " b", "\ufb4f\u0e01\u0e32" * 50])
def test_long_stretches_are_normalised_over_all_ways(text):
    v, raw = pieces.vocabulary(), b" " + text.encode()
    table = {b: i for i, b in enumerate(v.bytes_of) if len(b) and i > 258}
    most, total = max(map(len, table)), [0.0] * (len(raw) + 1)
    for at in range(len(raw) - 1, -1, -1):
        ids = [(n, table[raw[at : at + n]]) for n in range(1, min(most, len(raw) - at) + 1) if raw[at : at + n] in table]
        if not any(n == len(raw[at:].decode("utf-8", "ignore")[:1].encode()) and (raw[at] & 0xC0) != 0x80 for n, _ in ids):
            ids.append((1, int(v.byte_id[raw[at]])))
        total[at] = np.logaddexp.reduce([np.log(v.weight[i]) + total[at + n] for n, i in ids])
    offs, data = common.texts_of(pa.array([text] * 3))
    for _, _, ids, log_prob, _, same in segmentations(np.arange(3), offs, data, v, 2):
        assert same and log_prob == pytest.approx(np.log(v.weight[ids]).sum() - total[0], abs=1e-6)


def test_round_trip(spark, docs):
    rows = pieces.sample(spark.createDataFrame(docs, "doc_id bigint, text string"), k=2).collect()
    texts = dict(docs)
    assert all(r.round_trip and pieces.decode(r.ids) == (texts[r.doc_id] or "") for r in rows)
    again = pieces.sample(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), k=2).collect()
    assert {(r.doc_id, r["rank"], r.ids_sha256) for r in rows} == {(r.doc_id, r["rank"], r.ids_sha256) for r in again}


def test_decoded_column(spark):
    rows = spark.createDataFrame([(1, "caf\u00e9 the"), (2, ""), (3, None)], "doc_id bigint, text string")
    out = pieces.sample(rows, k=1).select("doc_id", pieces.decoded("ids").alias("t")).collect()
    assert {r.doc_id: r.t for r in out} == {1: "caf\u00e9 the", 2: "", 3: ""}


def test_units_seen_before_give_the_same_draws(monkeypatch):
    v = pieces.vocabulary()
    units = pieces.Units(v)
    texts = ["the cat sat", "a dog\u4e2d\u6587 the cat", "sat on the mat " * 9]
    for part in (texts, texts[::-1], texts):
        offs, data = common.texts_of(pa.array(part))
        fresh = list(segmentations(np.arange(3), offs, data, v, 4))
        assert list(segmentations(np.arange(3), offs, data, v, 4, 1, units)) == fresh
        monkeypatch.setattr(pieces, "KEPT_BYTES", 8)


def test_units_met_often_stay_in_the_lattice(monkeypatch):
    v, built = pieces.vocabulary(), []
    lattice = pieces.Lattice
    monkeypatch.setattr(pieces, "Lattice", lambda text, size, v: built.append(text.tobytes()) or lattice(text, size, v))
    monkeypatch.setattr(pieces, "KEPT_BYTES", 200)
    units = pieces.Units(v)
    for i in range(12):
        text = "cat mat " * 9 + " ".join(f"{chr(97 + i)}{chr(97 + j)}xq" for j in range(8))
        offs, data = common.texts_of(pa.array([text]))
        fresh = list(segmentations(np.arange(1), offs, data, v, 3))
        built.clear()
        assert list(segmentations(np.arange(1), offs, data, v, 3, 1, units)) == fresh
        assert built and (i == 0 or b" mat" not in b"".join(built))
    assert units.nodes < 300


def test_edges_of_a_node_run_from_the_longest():
    v, text = pieces.vocabulary(), " thenational\u4e2d\r\n".encode()
    table = {b: i for i, b in enumerate(v.bytes_of) if len(b) and i > 258}
    t = pieces.Lattice(np.frombuffer(text, np.uint8), np.array([len(text)]), v)
    for at in range(len(text)):
        want = [table[text[at:end]] for end in range(len(text), at, -1) if text[at:end] in table]
        found = t.id[t.first[at] : t.first[at + 1]].tolist()
        assert found == want or (found[len(want) :] == [v.byte_id[text[at]]] and found[: len(want)] == want)
        assert not found or t.p[t.first[at] : t.first[at + 1]].sum() == pytest.approx(1)


def test_pieces_that_share_a_slot_are_found():
    v = pieces.vocabulary()
    assert v.shared.sum() > 1 and (v.find(v.hashes) == v.ids).all()
    assert (v.find(v.hashes + np.uint64(1 << 40)) == -1).all()


def test_language_rejects_what_says_nothing():
    coders = langid.encoders({"a": b"the cat and the dog " * 9, "b": b"der hund und die katze " * 9})
    assert langid.identify("the dog and the cat", coders)[0] == "a"
    for text in ("123 !?", "\u00bd", "\u00b2 \u2167?", "", None):
        assert langid.identify(text, coders) == ("und", 0.0, True, 0.0)
    assert langid.folded("Caf\u00e9 x\u00b2, caf\u00e9 9") == "caf\u00e9 x caf\u00e9".encode()
    assert langid.identify("zzz qqq", langid.encoders({"b": b"abcdefgh", "a": b"abcdefgh"}))[0::2] == ("a", True)


def test_language_plain(spark, docs):
    import zstandard

    rows = spark.read.parquet(f"{SF}/documents.parquet").where(~common.held_out())
    dictionaries = langid.fit(rows)
    assert set(dictionaries) == {r.lang for r in rows.where("lang IS NOT NULL").select("lang").distinct().collect()}
    coding = zstandard.ZstdCompressionParameters(**langid.CODING)
    found = {r.doc_id: r.lang_pred for r in got(spark, "op1_language_id")}
    for i, text in docs:
        words = ["".join(c for c in w if c.isalpha()) for w in langid._WORD.findall((text or "").lower())]
        raw, best = " ".join(w for w in words if w).encode(), (1 << 60, "und")
        for name in sorted(dictionaries) if raw else ():
            coder = zstandard.ZstdCompressor(compression_params=coding, dict_data=zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            best = min(best, (sum(len(coder.compress(langid.CARRIER + raw[k : k + langid.PIECE_BYTES])) for k in range(0, len(raw), langid.PIECE_BYTES)), name))
        assert found[i] == best[1]
