"""Queries for scans, sinks, reflection, package mining, evaluation and the loops, with DuckDB SQL for their rows. What they
read they write before, from the given tables, into the shared folder; models and indexes are scripts that answer by the
key of a call, and answers run in local interpreters. Registered with the catalogue's queries on import."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import code as C
from corpusmill.functions import rules
from corpusmill.functions import text as T
from corpusmill.operators import dedup, lookup, packages
from corpusmill.plans import external
from corpusmill.plans.catalogue import _NORM, FENCE, Tables, _parts, _records, query
from corpusmill.plans.evaluate import EvaluationConfig, Evaluator
from corpusmill.plans.external import LocalRunner
from corpusmill.plans.loop import FusionLoop, LoopOptions, SynthesisLoop, SynthesisSpec, fuse_depths
from corpusmill.sources import io, live
from corpusmill.streaming import arrivals


def _folder(spark: SparkSession, name: str) -> str:
    return f"{io.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- scans and sinks


@query("SELECT p_partkey, p_name, NULL::VARCHAR AS note FROM part")
def strict_scan(spark, sf_dir):
    p, at = Tables(spark, sf_dir).part.select("p_partkey", "p_name", F.lit(None).cast("string").alias("note")), _folder(spark, "strict")
    io.write_jsonl(p, at)
    return io.strict(spark, at, p.schema)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def placed_scan(spark, sf_dir):
    """Lines written in order, and their places when read."""
    p, at = Tables(spark, sf_dir).part.select("p_partkey", "p_name"), _folder(spark, "placed")
    io.write_jsonl(p.repartition(5), at, order="p_partkey")
    return lookup.numbered(io.strict_with_place(spark, at, p.schema), ["ordinal"], "place").select("p_partkey", "place")


def _torn(spark, sf_dir) -> str:
    """A folder of lines: records, torn ones, lists, blanks."""
    d, at, m = Tables(spark, sf_dir).documents, _folder(spark, "torn"), F.col("doc_id") % 4
    whole = F.to_json(F.struct("doc_id", "lang"))
    line = F.when(m == 0, whole).when(m == 1, F.concat(F.lit('{"doc_id": '), "doc_id")).when(m == 2, F.concat(F.lit("["), whole, F.lit("]"))).otherwise("  ")
    d.select(line.alias("value")).write.text(at)
    return at


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 0")
def lenient_scan(spark, sf_dir):
    return io.lenient(spark, _torn(spark, sf_dir), "doc_id bigint, lang string").select("doc_id", "lang")


@query("SELECT count_if(doc_id % 4 = 0) AS kept, count_if(doc_id % 4 IN (1, 2)) AS bad_lines FROM documents")
def lenient_counts(spark, sf_dir):
    seen = Observation()
    kept = io.lenient(spark, _torn(spark, sf_dir), "doc_id bigint, lang string", seen).count()
    return spark.createDataFrame([(kept, seen.get["bad_lines"])], "kept bigint, bad_lines bigint")


@query("SELECT n_nationkey::BIGINT AS k, n_name || chr(10) || 'café' || chr(10) AS text FROM nation")
def text_documents(spark, sf_dir):
    at = _folder(spark, "texts")
    Tables(spark, sf_dir).nation.select("n_nationkey", F.concat("n_name", F.lit("\ncafé")).alias("value")).write.partitionBy("n_nationkey").text(at)
    return io.documents(spark, at).select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("bigint").alias("k"), "text")


@query("SELECT DISTINCT p_name AS full_name FROM part")
def name_list(spark, sf_dir):
    at = _folder(spark, "names")
    line = F.explode(F.array(F.concat(F.lit(" "), "p_name", F.lit("\t")), F.concat(F.lit(" # "), "p_name"), F.lit(" ")))
    Tables(spark, sf_dir).part.select(line.alias("value")).write.text(at)
    return io.names(spark, at)


@query("SELECT full_name, row_number() OVER (ORDER BY full_name) AS place FROM (SELECT DISTINCT p_name AS full_name FROM part)")
def sorted_names(spark, sf_dir):
    at = _folder(spark, "sorted")
    io.write_names(Tables(spark, sf_dir).part, at, "p_name")
    return lookup.numbered(io.lines(spark, at), ["ordinal"], "place").select(F.col("line").alias("full_name"), "place")


@query("SELECT n_nationkey, n_name, form FROM nation, (VALUES ('lines'), ('list')) v(form)")
def scan_by_suffix(spark, sf_dir):
    n, at = Tables(spark, sf_dir).nation.select("n_nationkey", "n_name"), _folder(spark, "suffix")
    io.write_jsonl(n, f"{at}.jsonl")
    n.agg(F.to_json(F.collect_list(F.struct(*n.columns))).alias("value")).write.text(f"{at}.json")
    read = lambda end, form: io.by_suffix(spark, f"{at}.{end}", n.schema).withColumn("form", F.lit(form))
    return read("jsonl", "lines").unionAll(read("json", "list"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def first_rows(spark, sf_dir):
    return io.head(Tables(spark, sf_dir).part.select("p_partkey", "p_name"), 100, "p_partkey")


@query("""SELECT '{"p_partkey":' || p_partkey || ',"p_type":"' || p_type || 'é","none":null}' AS line FROM part""")
def written_lines(spark, sf_dir):
    """The bytes of lines, after one write that replaces and one that appends."""
    p, at = Tables(spark, sf_dir).part.select("p_partkey", F.concat("p_type", F.lit("é")).alias("p_type"), F.lit(None).cast("string").alias("none")), _folder(spark, "written")
    io.write_jsonl(p, at)
    io.write_jsonl(p.where("p_partkey % 2 = 0"), at, "overwrite", single=True)
    io.write_jsonl(p.where("p_partkey % 2 <> 0"), at, "append")
    return spark.read.text(at).select(F.col("value").alias("line"))


@query("""SELECT * FROM (VALUES ('merged', '{"a": {"x": 1, "y": [3]}, "b": 1, "c": 2}'), ('list', '["a", "b", "c"]'), ('k', '[3, 1]'), ('prefixes', '["x", "ml"]'),
('module prefixes', '["ml", "mylib"]'), ('slots', '["u", "u", "v", "v", "w"]'), ('few slots', '["u", "v"]')) v(what, got)""")
def configuration(spark, sf_dir):
    got = {
        "merged": rules.merged({"a": {"x": 1, "y": [1, 2]}, "b": 1}, {"a": {"y": [3]}, "c": 2}), "list": rules.list_argument(["a, b", '["c", "a"]']),
        "k": rules.k_values("3,1,3"), "prefixes": rules.call_prefixes("my.lib", "ml", ["x"]), "module prefixes": rules.call_prefixes("mylib", "ml"),
        "slots": rules.slots(["u", "v", "w"], 5), "few slots": rules.slots(["u", "v", "w"], 2)}
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in got.items()], "what string, got string")


@query("SELECT n_name AS question, n_regionkey AS region, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_name, NULL, 'deep' FROM region UNION ALL SELECT n_name, n_regionkey, NULL FROM nation")
def depth_union(spark, sf_dir):
    t = Tables(spark, sf_dir)
    first = t.nation.select(F.col("n_name").alias("question"), F.col("n_regionkey").alias("region"))
    return dedup.all_depths([first, t.region.select(F.col("r_name").alias("question"), F.lit("deep").alias("note")), first])


# ---------------------------------------------------------------- reflection and package mining


@query("""SELECT 'json.' || n AS full_name, CASE WHEN n LIKE 'JSON%' AND n NOT LIKE '%.%' THEN 'class' ELSE 'function' END AS kind, n AS qualname, split_part(n, '.', -1) AS name,
CASE WHEN n LIKE 'JSONDecode%' THEN 'decoder.py' WHEN n LIKE 'JSONEncoder%' THEN 'encoder.py' ELSE '__init__.py' END AS source_file
FROM (SELECT unnest(['dump', 'dumps', 'load', 'loads', 'JSONDecoder', 'JSONDecoder.decode', 'JSONDecoder.raw_decode', 'JSONDecodeError', 'JSONEncoder', 'JSONEncoder.default', 'JSONEncoder.encode', 'JSONEncoder.iterencode']) AS n)""")
def api_reflection(spark, sf_dir):
    """Public names of a package of the standard library, but for those that its error inherits."""
    spark.dataSource.register(live.ApiSource)
    got = spark.read.format("python_api").option("packages", "json").option("max_depth", 2).load()
    return got.where("full_name NOT LIKE 'json.JSONDecodeError.%'").select("full_name", "kind", "qualname", "name", "source_file")


def index_reply(url: str) -> str | None:
    """Scripted package index and star counts: the last digit of a name says what is amiss with it."""
    name = url.rsplit("/", 1)[-1]
    if url.startswith("stars:"):
        return "gone" if name.endswith("7") else json.dumps({"stargazers_count": int(name[1:])})
    if name.endswith("8"):
        raise OSError(name)
    home = "https://example.org/" if name.endswith("6") else f"https://github.com/o/{name}"
    releases = {"1": [{"upload_time": "2024-02-02T00:00:00"}], "2": [{"upload_time_iso_8601": "2024-01-01T00:00:00Z"}], "3": []}
    return json.dumps({"info": {"name": name, "summary": f"about {name}", "version": "2", "classifiers": ["Topic :: X", "License :: Y"], "project_urls": {"home": home}, "home_page": ""}, "releases": releases})


@query("""SELECT 'n' || k AS name, 'about n' || k AS summary, '2' AS latest_version, 'Topic :: X' AS topics, CASE WHEN k % 10 <> 6 THEN 'o/n' || k END AS github_repo,
CASE WHEN k % 10 NOT IN (6, 7) THEN k::BIGINT END AS github_stars, '2024-01-01 00:00:00' AS first_release_time, '2024-02-02 00:00:00' AS last_release_time
FROM (SELECT n_nationkey AS k FROM nation) WHERE k < 20 AND k % 10 < 8""")
def package_crawl(spark, sf_dir):
    k = F.col("n_nationkey")
    row = F.struct(F.when(k % 10 != 9, F.concat(F.lit("n"), k)).alias("project"), k.cast("bigint").alias("download_count"))
    listed = Tables(spark, sf_dir).nation.agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("r")))).alias("l"))
    listing = listed.select(F.lit("today").alias("last_update"), F.transform("l", lambda x: x["r"]).alias("rows"))
    got = packages.crawl(packages.top_names(listing, 20), index_reply, "index:/{name}", "stars:{repo}")
    return got.select("name", "summary", "latest_version", F.array_join("topics", ",").alias("topics"), "github_repo", "github_stars", "first_release_time", "last_release_time")


# ---------------------------------------------------------------- prompts and evaluation

_NL = "chr(10)"
_F3 = FENCE


@query(f"""SELECT p_partkey, md5('{{"task":"' || p_name || '"}}' || {_NL} || '{{"task":"second"}}') AS lines,
md5('Task: ' || p_name || {_NL} || '{_F3}python' || {_NL} || p_type || {_NL} || '{_F3}' || {_NL} || '{_F3}python' || {_NL} || p_brand || {_NL} || '{_F3}' || {_NL} || {_NL}
    || 'Task: second' || {_NL} || '{_F3}python' || {_NL} || 's' || {_NL} || '{_F3}' || {_NL} || '{_F3}python' || {_NL} || 't' || {_NL} || '{_F3}') AS blocks FROM part""")
def few_shots(spark, sf_dir):
    shot = lambda a, b, c: F.struct(a.alias("task"), b.alias("solution"), c.alias("test"))
    e = F.array(shot(F.col("p_name"), F.concat(F.lit(f"{FENCE}python\n"), "p_type", F.lit(f"\n{FENCE}")), F.col("p_brand")), shot(F.lit("second"), F.lit("s"), F.lit("t")))
    return Tables(spark, sf_dir).part.select("p_partkey", F.md5(external.example_lines(e)).alias("lines"), F.md5(external.example_blocks(e)).alias("blocks"))


@query(f"""SELECT p_partkey, '[' || {_NL} || '  {{' || {_NL} || '    "full_name": "' || p_name || 'é",' || {_NL} || '    "signature": null' || {_NL} || '  }}' || {_NL} || ']' AS docs FROM part""")
def docs_as_json(spark, sf_dir):
    doc = F.struct(F.concat("p_name", F.lit("é")).alias("full_name"), F.lit(None).cast("string").alias("signature"))
    return _parts(Tables(spark, sf_dir)).select("p_partkey", C.pretty(F.to_json(F.array(doc), {"ignoreNullFields": "false"})).alias("docs"))


@query(f"""SELECT item_id AS idx, 'f' || item_id AS target_function, md5('Use lib as l.' || {_NL} || 'Relevant API:' || {_NL} || '- lib.none' || {_NL} || {_NL} || text || {_NL} || {_NL} || '{_F3}python' || {_NL}
|| 'import lib as l' || {_NL} || 'def f' || item_id || '(x):' || {_NL} || '    pass' || {_NL} || '{_F3}') AS h, item_id % 2147483647 AS item_seed FROM benchmark WHERE text IS NOT NULL AND item_id % 5 <> 0""")
def evaluation_prompts(spark, sf_dir):
    """Items without a text or a function have no prompt."""
    t, i = Tables(spark, sf_dir), F.col("item_id").cast("string")
    prompt = F.when(F.col("item_id") % 5 != 0, F.concat(F.lit("import lib as l\ndef f"), i, F.lit("(x):\n    pass"))).otherwise("import lib as l")
    line = F.to_json(F.struct(F.col("text").alias("task"), prompt.alias("prompt"), F.lit("assert f(1)").alias("test"), F.array(F.lit("lib.none")).alias("api_list")))
    got = Evaluator(EvaluationConfig()).prompts(t.benchmark.select(F.col("item_id").alias("idx"), line.alias("line")), _records(t))
    return got.select("idx", "target_function", F.md5("model_user_prompt").alias("h"), "item_seed")


class EvaluationScript:
    """Items 0 modulo 3 are always solved, 1 only by the last attempt, 2 never; calls for items 6 modulo 7 fail."""

    def complete(self, messages, n=1, key="", **options):
        idx = int(key.split("/")[1])
        if idx % 7 == 6:
            raise OSError(key)
        good = lambda i: idx % 3 == 0 or (idx % 3 == 1 and i == n)
        return [f"So:\n{FENCE}python\ndef f(x):\n    return x + {int(good(i))}\n{FENCE}" for i in range(1, n + 1)]


def _evaluated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = Tables(spark, sf_dir).nation
    line = F.to_json(F.struct(F.col("n_name").alias("task"), F.lit("import lib as l\ndef f(x):\n    pass").alias("prompt"), F.lit("assert f(1) == 2").alias("test")))
    ev = Evaluator(EvaluationConfig(k=3), EvaluationScript(), LocalRunner(20))
    prompts = ev.prompts(n.select(F.col("n_nationkey").cast("bigint").alias("idx"), line.alias("line")), _records(Tables(spark, sf_dir)))
    return ev.run(io.written(ev.generate(prompts), "generations"))


@query("SELECT n_nationkey::BIGINT AS idx, i AS attempt, n_nationkey % 3 = 0 OR (n_nationkey % 3 = 1 AND i = 3) AS passed FROM nation, range(1, 4) r(i) WHERE n_nationkey % 7 <> 6")
def evaluation_attempts(spark, sf_dir):
    return _evaluated(spark, sf_dir)[0].select("idx", "attempt", "passed")


@query("""WITH c AS (SELECT CASE WHEN n_nationkey % 7 = 6 THEN 0 WHEN n_nationkey % 3 = 0 THEN 3 WHEN n_nationkey % 3 = 1 THEN 1 ELSE 0 END AS c FROM nation)
SELECT count(*) AS total, round(avg(c / 3.0), 10) AS pass_at_1, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 10) AS pass_at_3 FROM c""")
def evaluation_means(spark, sf_dir):
    return _evaluated(spark, sf_dir)[1].select("total", *(F.round(f"pass_at_{k}", 10).alias(f"pass_at_{k}") for k in (1, 3)))


# ---------------------------------------------------------------- loops and streams


class LoopScript:
    """Answers by task: every third one starts without JSON; neighbours ask the same question until told that it is known;
    first answers hold no code; tests of tasks 3 modulo 4 fail; the judge rejects tasks 2 modulo 5."""

    def complete(self, messages, n=1, key="", **options):
        kind, task, *rest = key.split("/")
        t = int(task)
        if kind == "q":
            known = "is known" in messages[-1]["content"]
            return ["no json"] if rest == ["0"] and t % 3 == 0 else [json.dumps({"question": f"Other {t}" if known else f"Task {t // 2}"})]
        if kind == "a":
            code = {"answer": "import math as m\ndef f(x):\n    return m.sqrt(x)\n", "test": f"assert f(4) == {3 if t % 4 == 3 else 2}"}
            return ["no code"] if rest[-1] == "0" else [json.dumps(code)]
        return [json.dumps({"label": int(t % 5 != 2), "reason": "no"})]


def _scripted(spark, out: str, cls=SynthesisLoop, **more):
    shot = {"task": "t", "solution": "s", "test": "u"}
    spec = SynthesisSpec("o", "q", "a", module_name="math", module_alias="m", few_shot_pool=[shot, shot], num_few_shots_q=1, num_few_shots_a=1)
    docs = spark.createDataFrame([("math.sqrt", "(x)", "root"), ("math.sin", "(x)", "")], "full_name string, signature string, docstring string")
    options = LoopOptions(k=[2], candidates=1, question_tries=3, answer_tries=2, round_tasks=8, max_rounds=1, check_judge=True)
    return cls(spark, spec, docs, out, LoopScript(), LocalRunner(20), options=options, **more)


@query("""WITH t AS (SELECT t, t // 8 AS round, CASE WHEN t % 2 = 0 THEN 'Task ' || t // 2 ELSE 'Other ' || t END AS question, t % 4 = 3 AS failing, t % 5 = 2 AS rejected FROM range(16) r(t))
SELECT 'accepted' AS kind, t::VARCHAR AS question_id, question, 2::BIGINT AS attempts, 'math.sqrt' AS detail FROM t WHERE NOT failing AND NOT rejected QUALIFY row_number() OVER (PARTITION BY round ORDER BY t) <= 3
UNION ALL SELECT 'answer', t::VARCHAR, question, NULL, CASE WHEN failing THEN 'the test failed' ELSE 'rejected: no' END FROM t WHERE failing OR rejected""")
def synthesis_loop(spark, sf_dir):
    """Two runs of a round each, the second from the first one's output; samples and failures."""
    at = _folder(spark, "loop")
    _scripted(spark, at).run(3)
    again = _scripted(spark, at)
    again.run(6)
    good = again.accepted().select(F.lit("accepted").alias("kind"), "meta.question_id", "question", "meta.attempts", F.array_join("used_apis", ",").alias("detail"))
    bad = io.strict(spark, f"{at}/failures", schemas.FAILURES)
    return good.unionAll(bad.select("stage", "question_id", "question", F.lit(None).cast("bigint"), F.when(F.col("error").startswith("the test failed"), "the test failed").otherwise(F.col("error"))))


@query("""SELECT d::BIGINT AS depth, question_id, question, CASE WHEN d = 2 THEN list_aggregate(list_sort([sha256('A'), sha256('B')]), 'string_agg', ',') END AS sources, 2 AS n_sources
FROM range(2, 4) r(d), (VALUES ('0', 'Task 0'), ('1', 'Other 1')) v(question_id, question)""")
def fusion_depths(spark, sf_dir):
    """Depths 2 and 3 over a first pool of which two samples are usable, one by what its code uses."""
    code = "import math as m\ndef f(x):\n    return m.sqrt(x)\n"
    rows = [("A", code, "assert f(4)", ["math.sqrt"], []), (" B ", code, "assert f(4)", [], []), ("C", code, " ", ["math.sqrt"], []), ("D", "def f(x):\n    return x\n", "assert f(4)", [], [])]
    pool = spark.createDataFrame(rows, "question string, answer string, test string, used_apis array<string>, seed_apis array<string>")
    made = fuse_depths(lambda d, pool, out: _scripted(spark, out, FusionLoop, pool=pool, depth=d), pool, _folder(spark, "fusion"), 2, 3, 2)
    meta = "question string, meta struct<question_id: string, fusion_d: bigint, fusion_sources: array<string>>"
    got = dedup.all_depths([io.strict(spark, f"{at}/accepted", meta) for at in made])
    sources = F.when(F.col("meta.fusion_d") == 2, F.array_join(F.array_sort("meta.fusion_sources"), ","))
    return got.select(F.col("meta.fusion_d").alias("depth"), "meta.question_id", "question", sources.alias("sources"), F.size(F.array_distinct("meta.fusion_sources")).alias("n_sources"))


@query(f"SELECT md5(k) AS h, count(*) AS n FROM (SELECT DISTINCT {_NORM} AS k FROM documents) WHERE k <> '' GROUP BY 1")
def streamed_questions(spark, sf_dir):
    """Documents as arrivals in three batches, each of as many files as its size needs: each question once, whatever batch
    it came in. Files are as the scan's tasks leave them, cut at a third of all rows, so that no text is shuffled to them."""
    at = _folder(spark, "stream")
    d = Tables(spark, sf_dir).documents.select("doc_id", F.col("text").alias("question"), F.lit("now").alias("at"))
    d.write.option("maxRecordsPerFile", max(1, -(-d.count() // 3))).parquet(f"{at}/in")
    files = len(spark.read.schema(d.schema).parquet(f"{at}/in").inputFiles())
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(f"{at}/in")
    arrivals.first_of_each(stream, "question", "at", f"{at}/out", f"{at}/progress", "doc_id").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy(F.md5("key").alias("h")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, l_returnflag AS full_name, count(*) AS use_count FROM lineitem GROUP BY ALL")
def windowed_uses(spark, sf_dir):
    l = Tables(spark, sf_dir).lineitem.select(F.col("l_shipdate").cast("timestamp").alias("at"), F.array("l_returnflag").alias("used_apis"))
    got = arrivals.usage_stream(l, "at", every="1 day")
    return got.select(F.col("window.start").alias("day"), "full_name", "use_count")
