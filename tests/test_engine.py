"""Scans, sinks, joins, sampling, reflection, package mining, evaluation, loops and streams on small inputs."""

import hashlib
import json

import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import text as T
from corpusmill.operators import dedup, filters, lookup, metrics, packages, sampling
from corpusmill.plans import catalogue, stage_queries  # noqa: F401  registers its queries
from corpusmill.plans.evaluate import EvaluationConfig, Evaluator
from corpusmill.plans.external import ChatClient, LocalRunner, mapped
from corpusmill.plans.loop import FusionLoop, LoopOptions, SynthesisLoop, SynthesisSpec, fuse_depths
from corpusmill.sources import io, live
from corpusmill.streaming import arrivals
from tests.compare import SF, assert_same

LINES = "a bigint, b string"


def test_scans(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1, "b": "é"}\n\n{"a": 2}\n', encoding="utf-8")
    bad.write_text('{"a": 1}\n[{"a": 7}, {"a": 8}]\n{"a": 3, "b"', encoding="utf-8")
    assert [r.a for r in io.strict(spark, str(good), LINES).orderBy("a").collect()] == [1, 2]
    seen = Observation()
    assert [r.a for r in io.lenient(spark, str(bad), LINES, seen).collect()] == [1]
    assert seen.get["bad_lines"] == 2
    assert io.lenient(spark, str(tmp_path / "none"), LINES).count() == 0
    assert [r.a for r in io.strict_with_place(spark, str(good), LINES).orderBy("ordinal").collect()] == [1, 2]
    with pytest.raises(Exception, match="bad line"):
        io.strict_with_place(spark, str(bad), LINES).collect()
    with pytest.raises(Exception):  # noqa: B017
        io.strict(spark, str(bad), LINES).collect()


def test_texts_and_names(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"caf\xc3\xa9\xff ok\n\nmore")
    (tmp_path / "n.txt").write_text("# c\n\n lib.a \nlib.a\nlib.b\n")
    assert io.documents(spark, str(tmp_path / "t.txt")).first().text == "café ok\n\nmore"
    assert sorted(r[0] for r in io.names(spark, str(tmp_path / "n.txt")).collect()) == ["lib.a", "lib.b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], LINES)
    io.write_jsonl(df, str(tmp_path / "o"), order="a", single=True)
    text = next((tmp_path / "o").glob("part-*")).read_text(encoding="utf-8").splitlines()
    assert text == ['{"a":1,"b":"é"}', '{"a":2,"b":null}']
    io.write_names(spark.createDataFrame([("b",), ("a",), ("b",)], "full_name string"), str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).count() == 2
    io.write_report({"total": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"total": 1}


def test_sampling(spark):
    tasks = spark.range(3000).select(F.col("id").alias("task_id"))
    pool = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "name string, w double")
    got = sampling.weighted(tasks, pool, "task_id", "name", 5, F.col("w")).toPandas()
    assert set(got.groupby("task_id").size()) == {3} and set(got[got.name == "c"]["rank"]) == {3}
    assert "c" not in set(sampling.weighted(tasks, pool, "task_id", "name", F.lit(2), F.col("w"), most=2).toPandas().name)
    assert (got[got["rank"] == 1].name == "b").mean() == pytest.approx(0.75, abs=0.03)
    zero = pool.withColumn("w", F.lit(0.0))
    assert set(sampling.weighted(tasks.limit(5), zero, "task_id", "name", 2, F.col("w")).groupBy("task_id").count().toPandas()["count"]) == {2}
    assert sampling.weighted(tasks, pool, "task_id", "name", 0).count() == 0


@pytest.mark.parametrize("block, sent", [(1024, 100_000), (2, 100_000), (2, 0)])
def test_no_pair_of_task_and_name_is_a_row(spark, monkeypatch, block, sent):
    """Draws as by a sort of all pairs, also for tasks that repeat, in blocks and with few pairs a Spark task."""
    for at, value in (("BLOCK", block), ("SENT", sent), ("PAIRS", 40)):
        monkeypatch.setattr(sampling, at, value, raising=False)
    asked = [(i, i % 4) for i in range(30)] + [(7, 3), (7, 3), (11, 3), (40, 9)]
    tasks = spark.createDataFrame(asked, "task_id long, k long").coalesce(1)
    pool = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("d", None), ("e", 0.5)], "name string, w double")
    got = sampling.weighted(tasks, pool, "task_id", "name", F.col("k"), F.col("w"), 5, "p", most=4)
    pairs = tasks.crossJoin(pool).withColumn("late", ~F.coalesce(F.col("w") > 0, F.lit(False)))
    key = T.race(T.uniform(5, "p", F.col("task_id"), F.col("name")), F.when(~F.col("late"), F.col("w")).otherwise(1.0))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("late", key, "name"))
    want = pairs.withColumn("rank", rank).where("rank <= least(k, 4)").select("task_id", "name", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema == want.schema
    assert not sent or got.select(F.spark_partition_id()).distinct().count() > 1
    assert block == 2 or "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_seed_apis_sorts_no_pairs(spark):
    got = catalogue.QUERIES["seed_apis"](spark, SF)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastNestedLoopJoin" in plan


@pytest.mark.parametrize("name", ["used_apis", "target_functions", "validated_code", "parsed_replies", "stripped_docstrings", "wrapped_docs", "docs_as_json", "parsed_objects"])
def test_rows_are_dealt_out_to_python(spark, monkeypatch, name):
    monkeypatch.setattr(catalogue, "PARSED", 20, raising=False)
    got = catalogue.QUERIES[name](spark, SF)
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    if name == "used_apis":
        assert_same(got, catalogue.ORACLE_SQL[name])


def test_one_per_key_and_prefixes(spark):
    df = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 5, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in lookup.one_per_key(df, "k", "o").collect()} == {("x", "a"), ("y", None)}
    assert {(r.k, r.v) for r in lookup.one_per_key(df, "k", "o", last=True).collect()} == {("x", "b"), ("y", None)}
    docs = spark.createDataFrame([("lib.a.b", 1), ("lib.a", 2)], "full_name string, d int")
    items = spark.createDataFrame([(["lib.a.b", "lib.a.b.c.d", "lib.a.z", "lib.q", "lib"],)], "names array<string>")
    got = {r.name: r.d for r in lookup.docs_by_prefix(items, "names", docs, "lib").collect()}
    assert got == {"lib.a.b": 1, "lib.a.b.c.d": 1, "lib.a.z": 2, "lib.q": None, "lib": None}


def test_reflection(spark):
    spark.dataSource.register(live.ApiSource)
    got = spark.read.format("python_api").option("packages", "json").option("max_depth", 2).load()
    names = {r.full_name for r in got.collect()}
    assert {"json.loads", "json.JSONDecoder", "json.JSONDecoder.decode"} <= names and not any("__" in n for n in names)
    kept = dedup.keep_first_records(got.where("full_name = 'json.loads'"), "json", 3)
    assert kept.first().signature.startswith("(s") and '"""' not in kept.first().code


def _index(url):
    name = url.rsplit("/", 1)[-1]
    if url.startswith("s:"):
        return json.dumps({"stargazers_count": 7}) if name == "r" else None
    if name == "gone":
        raise OSError(name)
    project = {"info": {"name": name, "classifiers": ["Topic :: X", "Other"], "project_urls": {"h": "https://github.com/o/r"}, "home_page": ""}, "releases": {"1": [{"upload_time": "2024-01-02T00:00:00"}, {"upload_time_iso_8601": "2024-01-01T00:00:00Z"}], "2": []}}
    return json.dumps(project)


def test_crawl_and_filter(spark):
    listing = spark.createDataFrame([("t", [("p", 1), ("gone", 2), ("", 3), ("late", 4)])], schemas.TOP_PACKAGES)
    names = packages.top_names(listing, 3)
    assert {r.name for r in names.collect()} == {"p", "gone"}
    got = packages.crawl(names, _index, "i:/{name}", "s:/{repo}").collect()
    assert len(got) == 1 and got[0].github_repo == "o/r" and got[0].github_stars == 7
    assert (got[0].first_release_time, got[0].topics) == ("2024-01-01 00:00:00", ["Topic :: X"])
    with pytest.raises(ValueError):
        filters.check_few_shots([{"task": "x", "solution": " ", "test": "t"}])


class Script:
    """Answers from the call's key."""

    def __init__(self, module="lib"):
        self.module = module

    def complete(self, messages, n=1, key="", **options):
        kind, task, *rest = key.split("/")
        if kind == "q":
            if rest == ["0"] and int(task) % 3 == 0:
                return ["no json"]
            return [json.dumps({"question": f"Do task {int(task) // 2}"})]
        if kind == "a":
            bad = int(task) % 5 == 4 or rest == ["0", "0"]
            code = "import math as m\ndef f(x):\n    return m.sqrt(x)\n"
            return [json.dumps({"answer": code, "test": "assert f(4) == " + ("3" if bad else "2")})]
        return [f"{'```'}python\ndef f(x):\n    return x + {1 if int(messages[-1]['content'][-5:-4] == '1') or i % 2 else 0}\n{'```'}" for i in range(n)]


def _loop(spark, out, cls=SynthesisLoop, **more):
    shot = {"task": "t", "solution": "s", "test": "u"}
    spec = SynthesisSpec("o", "q", "a", module_name="math", module_alias="m", few_shot_pool=[shot, shot], num_few_shots_q=1, num_few_shots_a=1)
    docs = spark.createDataFrame([("math.sqrt", "(x)", "root"), ("math.sin", "(x)", "")], "full_name string, signature string, docstring string")
    options = LoopOptions(k=[2], candidates=2, answer_tries=2, question_tries=2, round_tasks=6, max_rounds=6, check_leak=False)
    return cls(spark, spec, docs, str(out), Script(), LocalRunner(10), options=options, **more)


def test_loop_resumes_and_fuses(spark, tmp_path):
    loop = _loop(spark, tmp_path / "D1")
    assert loop.run(3) == 3
    got = loop.accepted()
    assert len({r.question for r in got.collect()}) == 3
    assert got.select(F.explode("used_apis")).distinct().first()[0] == "math.sqrt"
    failures = spark.read.json(str(tmp_path / "D1/failures"))
    assert {r.stage for r in failures.select("stage").distinct().collect()} <= {"question", "answer"}
    (tmp_path / "D1/accepted/torn.json").write_text('{"question": "torn')
    again = _loop(spark, tmp_path / "D1")
    assert again.run(4) == 4
    make = lambda d, pool, out: _loop(spark, out, FusionLoop, pool=pool, depth=d)
    done = fuse_depths(make, again.accepted().drop("ordinal", "key"), str(tmp_path), 2, 2, 1)
    deep = spark.read.json(f"{done[0]}/accepted")
    assert deep.count() == 1 and deep.first().meta.fusion_d == 2 and len(deep.first().meta.fusion_sources) == 2
    with pytest.raises(ValueError):
        fuse_depths(make, again.accepted(), str(tmp_path / "x"), 4, 4, 1)


class Noting(Script):
    """Asks one question until told that it is known; notes the answers' prompts."""

    def __init__(self, at):
        super().__init__()
        self.at = at

    def complete(self, messages, n=1, key="", **options):
        kind, task, *rest = key.split("/")
        if kind == "q":
            return [json.dumps({"question": f"Other {task}" if "is known" in messages[-1]["content"] else "Same"})]
        with open(f"{self.at}/{key.replace('/', '-')}", "w") as f:
            f.write(messages[1]["content"])
        return [json.dumps({"answer": "import math as m\ndef f(x):\n    return m.sqrt(x)\n", "test": "assert f(4) == 2"})]


def test_known_questions_are_asked_again_and_candidates_have_their_own_shots(spark, tmp_path):
    (tmp_path / "said").mkdir()
    loop = _loop(spark, tmp_path / "D1")
    loop.client = Noting(str(tmp_path / "said"))
    loop.spec.few_shot_pool[:] = [{"task": f"t{i}", "solution": "s", "test": "u"} for i in range(50)]
    assert loop.round(0, 6, 6, loop.accepted()) == 6
    assert sorted(r.question for r in loop.accepted().collect()) == [f"Other {i}" for i in range(1, 6)] + ["Same"]
    said = [[(tmp_path / f"said/a-{t}-{c}-0").read_text() for c in range(2)] for t in range(6)]
    assert any(a != b for a, b in said)


def test_loop_stops_between_rounds(spark, tmp_path):
    assert _loop(spark, tmp_path, stop=lambda: True).run(3) == 0


@pytest.mark.parametrize("both", [False, True])
def test_fusion_needs_both_sources(spark, tmp_path, both):
    rows = [(q, f"import math as m\ndef f(x):\n    return m.{a}(x)\n", "assert True", [f"math.{a}"], [f"math.{a}"]) for q, a in (("A", "sqrt"), ("B", "sin"))]
    pool = spark.createDataFrame(rows, "question string, answer string, test string, used_apis array<string>, seed_apis array<string>")
    loop = _loop(spark, tmp_path, FusionLoop, pool=pool, depth=2, require_both_sources=both)
    assert (loop.round(0, 4, 4, loop.accepted(), 2) == 0) == both


def test_evaluation(spark):
    items = [{"task": "t", "prompt": "import lib as l\ndef f(x):\n    pass", "test": "assert f(1) == 2", "api_list": ["lib.a", "lib.none"]}, {"task": "t", "prompt": "x"}]
    bench = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items, 1)], "idx bigint, line string")
    docs = spark.createDataFrame([("lib.a", "(x)", "d", 1), ("lib.a", "(y)", "e", 2)], "full_name string, signature string, docstring string, ordinal int")
    ev = Evaluator(EvaluationConfig(k=3), Script(), LocalRunner(10))
    prompts = ev.prompts(bench, docs)
    row = prompts.first()
    assert prompts.count() == 1 and "lib.a(x)" in row.api_block and "lib.none" in row.api_block and "as l." in row.model_user_prompt
    done, means = ev.run(ev.generate(prompts))
    assert done.count() == 3 and means.first().total == 1 and means.first().pass_at_3 in (0.0, 1.0)


def test_runner_and_client():
    run = LocalRunner(1).run
    assert run("print(1)") == (True, "1\n") and not run("1/0")[0] and "timeout" in run("import time; time.sleep(9)")[1]
    with pytest.raises(Exception):  # noqa: B017
        ChatClient("http://127.0.0.1:9", "m", timeout=1).complete([])


def test_calls_are_rows(spark):
    got = mapped(spark.range(3), "x bigint", lambda row: [{"x": row["id"]}] * int(row["id"]), ["x"])
    assert got.count() == 3


def test_streams(spark, tmp_path):
    schema = "id bigint, question string, at timestamp, used_apis array<string>"
    for i, rows in enumerate([[(1, "A  b"), (2, "c")], [(3, "a b"), (4, "A b"), (5, "d")]]):
        spark.createDataFrame([(*r, None, ["x"]) for r in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    arrivals.first_of_each(stream, "question", "at", str(tmp_path / "out"), str(tmp_path / "cp"), "id").awaitTermination(60)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A b", "a b", "c", "d"]
    assert "window" in arrivals.usage_stream(stream, "at").columns and "key" in arrivals.keyed(stream, "question").columns


def test_arrivals_are_written_as_they_are_scanned(spark, tmp_path, monkeypatch):
    """No task gathers a batch: each scan task leaves files of its own, and three batches take them all."""
    rows = [(i if i % 9 else None, None if i % 11 == 0 else f"text  {i % 50}", "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(stage_queries, "_folder", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = catalogue.QUERIES["streamed_questions"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got.collect())) == sorted((hashlib.md5(f"text {i}".encode()).hexdigest(), 1) for i in range(50))
    assert len(list((tmp_path / "stream/in").glob("*.parquet"))) >= 8
    assert {r.batch for r in spark.read.parquet(str(tmp_path / "stream/out")).collect()} <= {0, 1, 2}


def test_tally_counts_first_attempts(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True)], "idx int, attempt int, passed boolean")
    assert metrics.tally(df, ["idx"], 2).first().c == 1


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_numbers_reach_all_rows(spark, parts):
    wide = spark.range(5000).select(F.col("id"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 30).alias("text")).repartition(parts)
    got = lookup.numbered(wide, [F.desc("id")]).select("id", "ordinal").collect()
    assert sorted((r.id, r.ordinal) for r in got) == [(i, 5000 - i) for i in range(5000)]
