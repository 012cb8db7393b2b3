"""The generate-validate-accept loop, in rounds, and fusion of accepted samples to deeper ones.

A round plans a bounded number of tasks from a snapshot of what is accepted, runs them, and appends the accepted samples;
the output table is the only state, so a run resumes from it. A question is taken if no accepted one has its key and no
earlier task of the round does; its key is free again if none of its candidates is accepted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import code as C
from corpusmill.functions import rules
from corpusmill.functions import text as T
from corpusmill.operators import dedup, lookup, metrics, sampling
from corpusmill.plans import external
from corpusmill.sources import io


@dataclass
class SynthesisSpec:
    library_overview: str
    question_instructions: str
    answer_instructions: str
    judge_instructions: str = ""
    module_name: str = "mylib"
    module_alias: str = "ml"
    required_import: str = ""
    module_call_prefixes: list = field(default_factory=list)
    few_shot_pool: list = field(default_factory=list)
    num_few_shots_q: int = 2
    num_few_shots_a: int = 2
    min_asserts: int = 1
    seed_overlap_required: bool = True
    max_top_level_functions: int = 1
    system_message: str = "You write programming tasks."
    judge_system_message: str = "You judge programming tasks."

    def __post_init__(self):
        from corpusmill.operators.filters import check_few_shots

        self.required_import = self.required_import or f"import {self.module_name} as {self.module_alias}"
        self.module_call_prefixes = rules.call_prefixes(self.module_name, self.module_alias, self.module_call_prefixes)
        check_few_shots(self.few_shot_pool)
        if len(self.few_shot_pool) < max(self.num_few_shots_q, self.num_few_shots_a):
            raise ValueError("the few-shot pool is smaller than the number of shots")
        if self.min_asserts < 0 or not 1 <= self.max_top_level_functions <= 4 or not self.required_import.strip():
            raise ValueError("min_asserts, max_top_level_functions or required_import out of range")


@dataclass
class LoopOptions:
    k: list = field(default_factory=lambda: [1, 2, 3])
    alpha: float = 0.7
    biased: bool = True
    candidates: int = 5
    question_tries: int = 5
    answer_tries: int = 10
    check_leak: bool = True
    check_run: bool = True
    check_overlap: bool = True
    check_judge: bool = False
    round_tasks: int = 32
    max_rounds: int = 100
    seed: int = 0


_QUESTION = "question string, q_error string, q_output string, q_tries bigint"
_CANDIDATE = "candidate_id bigint, ok boolean, answer string, test string, fn_name string, used_apis array<string>, error string, attempts bigint, output_tail string, judge_label bigint, judge_reason string"
_RECORD = "question string, answer string, messages array<struct<role: string, content: string>>, test string, seed_apis array<string>, used_apis array<string>, judge struct<label: bigint, reason: string, model: string>, meta struct<question_id: string, candidate_id: bigint, attempts: bigint, k_sampled: bigint, fn_name: string, fusion_d: bigint, fusion_sources: array<string>>"


def ask(row: dict, client, spec: SynthesisSpec, options: LoopOptions, system: str, user: str) -> dict:
    """Question chain of a task: tries with the last error as feedback; a known question (`rejected`, after `tried` tries)
    is such an error."""
    messages, error, text = [{"role": "system", "content": system}, {"role": "user", "content": user}], "", ""
    tried = int(row.get("tried") or 0)
    if tried:
        error = "the question is known"
        messages += [{"role": "assistant", "content": row["rejected"]}, {"role": "user", "content": f"That was rejected: {error}. Try again."}]
    for attempt in range(tried, options.question_tries):
        try:
            text = client.complete(messages, 1, f"q/{row['task_id']}/{attempt}")[0]
        except Exception as e:  # noqa: BLE001  a failed call is an error like any other
            error = str(e)
            continue
        got = C.json_object(text)
        question = str((got or {}).get("question") or "").strip()
        if not question:
            error = "no JSON object with a question"
        elif options.check_leak and any(n in question for n in (spec.module_name, spec.module_alias)):
            error = "the question names the library"
        else:
            return {"question": question, "q_error": None, "q_output": text[-2000:], "q_tries": attempt + 1}
        messages += [{"role": "assistant", "content": text}, {"role": "user", "content": f"That was rejected: {error}. Try again."}]
    return {"question": None, "q_error": error, "q_output": text[-2000:], "q_tries": options.question_tries}


def answer(row: dict, candidate: int, client, judge, runner, spec: SynthesisSpec, options: LoopOptions, user: str) -> dict:
    """Candidate chain: parse, check, names, overlap, run, judge; tries with the last error as feedback."""
    out = {"candidate_id": candidate, "ok": False, "answer": None, "test": None, "fn_name": None, "used_apis": [], "error": "", "attempts": 0, "output_tail": "", "judge_label": None, "judge_reason": None}
    messages = [{"role": "system", "content": spec.system_message}, {"role": "user", "content": user}]
    seeds = list(row["seed_apis"] if row["seed_apis"] is not None else [])
    must = row.get("must")
    for attempt in range(options.answer_tries):
        out["attempts"], text = attempt + 1, ""
        try:
            text = client.complete(messages, 1, f"a/{row['task_id']}/{candidate}/{attempt}")[0]
            code, test, error = C.answer_and_test(text, spec.required_import, spec.min_asserts, spec.max_top_level_functions)
            name = ""
            if not error:
                _, name, error = C.checked(code, test, row["question"], spec.required_import, spec.min_asserts, spec.max_top_level_functions)
            used = C.used_names(code, spec.module_call_prefixes, spec.module_name) if not error else []
            if not error and not used:
                error = "the answer uses no API"
            if not error and any(len(m) and not set(used) & set(m) for m in (must if must is not None else [])):
                error = "the answer does not use both sources"
            if not error and options.check_overlap and spec.seed_overlap_required and seeds and not set(used) & set(seeds):
                error = "the answer uses none of the seed APIs"
            if not error and options.check_run:
                ok, said = runner.run(f"{code}\n\n{test}\n")
                out["output_tail"] = said[-2000:]
                error = "" if ok else f"the test failed: {said[-500:]}"
            if not error and options.check_judge:
                got = C.json_object(judge.complete([{"role": "system", "content": spec.judge_system_message}, {"role": "user", "content": f"{spec.judge_instructions}\n{row['question']}\n{code}\n{test}"}], 1, f"j/{row['task_id']}/{candidate}/{attempt}")[0]) or {}
                out["judge_label"], out["judge_reason"] = int(got.get("label", 0)), str(got.get("reason", "")).replace("\n", " ")
                error = "" if out["judge_label"] == 1 else f"rejected: {out['judge_reason']}"
        except Exception as e:  # noqa: BLE001  a failed call is an error like any other
            error = str(e)
        out["error"] = error
        if not error:
            return {**out, "ok": True, "answer": code, "test": test, "fn_name": name, "used_apis": used}
        out["output_tail"] = out["output_tail"] or text[-2000:]
        messages += [{"role": "assistant", "content": text}, {"role": "user", "content": f"That was rejected: {error}. Write exactly one corrected answer and test."}]
    return out


class SynthesisLoop:
    def __init__(self, spark: SparkSession, spec: SynthesisSpec, docs: DataFrame, out: str, client, runner=None, judge=None, options: LoopOptions | None = None, stop: Callable[[], bool] | None = None):
        """docs: (full_name, signature, docstring), unique. out: folder of the accepted samples and of the failures. stop:
        asked before each round whether to end."""
        self.stop = stop or (lambda: False)
        self.spark, self.spec, self.docs, self.out = spark, spec, docs, out
        self.client, self.runner, self.judge, self.options = client, runner, judge or client, options or LoopOptions()

    def accepted(self) -> DataFrame:
        got = io.lenient(self.spark, f"{self.out}/accepted", _RECORD)
        return dedup.keep_first(got, "ordinal")

    def tasks(self, first: int, n: int, accepted: DataFrame) -> DataFrame:
        """(task_id, k, seed_apis, context) of a round, on a snapshot of the accepted samples."""
        o = self.options
        tasks = self.spark.range(first, first + n).select(F.col("id").alias("task_id")).withColumn("k", sampling.k_choice(o.k, seed=o.seed))
        drawn = sampling.seed_apis(tasks, self.docs, metrics.usage_counts(accepted), F.col("k"), o.alpha, o.biased, o.seed, most=max(o.k))
        seeds = drawn.join(self.docs, "full_name").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "full_name", "signature", "docstring"))).alias("s"))
        return tasks.join(seeds, "task_id").select("task_id", "k", F.transform("s", lambda x: x["full_name"]).alias("seed_apis"), F.to_json("s", {"ignoreNullFields": "false"}).alias("context"), F.array().cast("array<string>").alias("sources"))

    def shots(self, tasks: DataFrame, m: int, purpose: str, key: str = "task_id") -> DataFrame:
        if not m:
            return tasks.withColumn(purpose, F.lit(""))
        pool = self.spark.createDataFrame([(i, s["task"], s["solution"], s["test"]) for i, s in enumerate(self.spec.few_shot_pool)], "shot int, task string, solution string, test string")
        drawn = sampling.weighted(tasks, pool, key, "shot", m, seed=self.options.seed, purpose=purpose).join(pool, "shot")
        shots = drawn.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "task", "solution", "test"))).alias("e"))
        text = external.example_lines(F.col("e")) if purpose == "shots_q" else external.example_blocks(F.col("e"))
        return tasks.join(shots.select(key, text.alias(purpose)), key)

    def answer_shots(self, tasks: DataFrame) -> DataFrame:
        """tasks with `shots_a`: the examples of each candidate, drawn for it."""
        n = self.options.candidates
        slots = tasks.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("candidate")).withColumn("slot", F.col("task_id") * n + F.col("candidate"))
        drawn = self.shots(slots, self.spec.num_few_shots_a, "shots_a", "slot")
        each = drawn.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("candidate", "shots_a"))).alias("e"))
        return tasks.join(each.select("task_id", F.transform("e", lambda x: x["shots_a"]).alias("shots_a")), "task_id")

    def questions(self, tasks: DataFrame, accepted: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
        """(all tasks as last asked, those with a new question). Tasks with a known one are asked again, in passes, while
        they have tries left."""
        spec, o, client = self.spec, self.options, self.client
        known = accepted.select(T.normalise_question("question").alias("key")).distinct()
        todo, asked, taken = tasks.withColumn("rejected", F.lit(None).cast("string")).withColumn("tried", F.lit(0).cast("long")), None, None
        for k in range(max(1, o.question_tries)):
            got = external.mapped(todo, _QUESTION, lambda row: ask(row, client, spec, o, spec.system_message, row["user"]), ["question", "q_error", "q_output", "q_tries"])
            got.drop("rejected", "tried").write.mode("overwrite").parquet(f"{at}/asked/{k}")
            got = self.spark.read.parquet(f"{at}/asked/{k}")
            lookup.unseen(got.where("question IS NOT NULL"), known).select(got.columns).write.mode("overwrite").parquet(f"{at}/taken/{k}")
            fresh = self.spark.read.parquet(f"{at}/taken/{k}")
            taken = fresh if taken is None else taken.unionByName(fresh)
            again = got.where((F.col("question").isNotNull()) & (F.col("q_tries") < o.question_tries)).join(fresh.select("task_id"), "task_id", "left_anti")
            done = got.join(again.select("task_id"), "task_id", "left_anti")
            asked = done if asked is None else asked.unionByName(done)
            if not again.limit(1).count():
                break
            known = known.unionAll(fresh.select(T.normalise_question("question").alias("key")))
            todo = again.select(*tasks.columns, F.col("q_output").alias("rejected"), F.col("q_tries").alias("tried"))
        return asked, taken

    def round(self, first: int, n: int, left: int, accepted: DataFrame, depth: int = 1) -> int:
        """Run one round of n tasks and append at most `left` samples; returns how many."""
        spec, o, client, judge, runner = self.spec, self.options, self.client, self.judge, self.runner
        tasks = self.answer_shots(self.shots(self.tasks(first, n, accepted), spec.num_few_shots_q, "shots_q"))
        user = external.prompt("{o}\n\n{i}\n\nExamples:\n{s}\n\nAPIs:\n{c}", o=F.lit(spec.library_overview), i=F.lit(spec.question_instructions), s=F.col("shots_q"), c=F.col("context"))
        at = f"{self.out}/rounds/{depth}-{first}"
        asked, taken = self.questions(tasks.withColumn("user", user), accepted, at)
        prompt = lambda shots: external.prompt("{o}\n\n{i}\n\nExamples:\n{s}\n\nAPIs:\n{c}\n\nTask:\n{q}", o=F.lit(spec.library_overview), i=F.lit(spec.answer_instructions), s=shots, c=F.col("context"), q=F.col("question"))
        each = lambda row: [answer(row, i, client, judge, runner, spec, o, row["users"][i]) for i in range(o.candidates)]
        names = [p.split()[0] for p in _CANDIDATE.split(", ")]
        external.mapped(taken.withColumn("users", F.transform("shots_a", prompt)), _CANDIDATE, each, names).write.mode("overwrite").parquet(f"{at}/candidates")
        candidates = self.spark.read.parquet(f"{at}/candidates")
        chosen = sampling.one_accepted(candidates, seed=o.seed).orderBy("task_id").limit(left)
        self.record(chosen, depth).write.mode("append").option("ignoreNullFields", "false").json(f"{self.out}/accepted")
        self.failures(asked, candidates, taken, depth).write.mode("append").option("ignoreNullFields", "false").json(f"{self.out}/failures")
        return chosen.count()

    def record(self, chosen: DataFrame, depth: int) -> DataFrame:
        fenced = F.concat(F.lit(f"{T.FENCE}python\n"), "answer", F.lit(f"\n{T.FENCE}"))
        messages = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), fenced.alias("content")))
        judge = F.when(F.col("judge_label").isNotNull(), F.struct(F.col("judge_label").alias("label"), F.col("judge_reason").alias("reason"), F.lit("judge").alias("model")))
        meta = F.struct(F.col("task_id").cast("string").alias("question_id"), "candidate_id", "attempts", F.col("k").cast("long").alias("k_sampled"), "fn_name", F.lit(depth).cast("long").alias("fusion_d"), F.col("sources").alias("fusion_sources"))
        return chosen.select("question", "answer", T.sanitise_messages(messages).alias("messages"), "test", "seed_apis", "used_apis", judge.alias("judge"), meta.alias("meta"))

    def failures(self, asked: DataFrame, candidates: DataFrame, taken: DataFrame, depth: int) -> DataFrame:
        common = [F.lit(depth).cast("long").alias("d"), "question", "seed_apis", F.col("k").cast("long").alias("k_sampled")]
        no_question = asked.join(taken.select("task_id"), "task_id", "left_anti").select(F.lit("question").alias("stage"), F.col("task_id").cast("string").alias("question_id"), *common, F.lit(None).cast("long").alias("candidate_id"), F.coalesce("q_error", F.lit("the question is known")).alias("error"), F.col("q_output").alias("last_model_output_tail"))
        lost = candidates.groupBy("task_id").agg(F.max("ok").alias("any")).where("NOT any").select("task_id")
        no_answer = candidates.join(lost, "task_id", "left_semi").select(F.lit("answer").alias("stage"), F.col("task_id").cast("string").alias("question_id"), *common, "candidate_id", "error", F.col("output_tail").alias("last_model_output_tail"))
        return no_question.unionByName(no_answer)

    def run(self, n: int) -> int:
        """Rounds until n samples are accepted in all, earlier runs included; returns how many there are."""
        have, first = None, 0
        for _ in range(self.options.max_rounds):
            accepted = self.accepted()
            have = accepted.count()
            if have >= n or self.stop():
                break
            first = max(first, self.next_task())
            self.round(first, self.options.round_tasks, n - have, accepted)
        return self.accepted().count()

    def next_task(self) -> int:
        """One past the largest task that any run has planned: ids never repeat."""
        ids = []
        for name in ("accepted", "failures"):
            got = io.lenient(self.spark, f"{self.out}/{name}", "question_id string, meta struct<question_id: string>")
            ids.append(got.agg(F.max(F.coalesce("question_id", "meta.question_id").try_cast("bigint"))).first()[0])
        return max((i for i in ids if i is not None), default=-1) + 1


class FusionLoop(SynthesisLoop):
    """Depth d pairs samples of all lower depths. Each depth is written before the next reads it."""

    def __init__(self, *args, pool: DataFrame, depth: int, require_both_sources: bool = False, **kwargs):
        super().__init__(*args, **kwargs)
        self.depth, self.require_both_sources = depth, require_both_sources
        #: What a pair without any name is asked about: the library's first name.
        self.fallback = self.docs.agg(F.min("full_name")).first()[0]
        module, prefixes = self.spec.module_name, self.spec.module_call_prefixes
        names = T.canonical_list("used_apis", prefixes, module)
        usable = pool.where("trim(coalesce(question, '')) <> '' AND trim(coalesce(answer, '')) <> '' AND trim(coalesce(test, '')) <> ''")
        own = C.used_apis(F.col("answer"), prefixes, module)
        self.pool = usable.withColumn("used_apis", F.when(F.size(F.coalesce("used_apis", F.array().cast("array<string>"))) > 0, names).otherwise(own)).where("size(used_apis) > 0").withColumn("example", F.sha2(T.normalise_question("question"), 256))

    def tasks(self, first: int, n: int, accepted: DataFrame) -> DataFrame:
        o, pool = self.options, self.pool
        counts = metrics.usage_counts(pool.select("used_apis").unionAll(accepted.select("used_apis")))
        tasks = self.spark.range(first, first + n).select(F.col("id").alias("task_id"))
        pairs = sampling.pairs(tasks, sampling.example_weights(pool, counts, "example", o.alpha), "example", o.seed, o.biased)
        side = lambda s: pool.select(F.col("example").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("question", "answer", "test", "used_apis", "seed_apis")))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        names = dedup.pair_union(F.col("a_used_apis"), F.col("b_used_apis"), F.col("a_seed_apis"), F.col("b_seed_apis"), self.fallback)
        told = rules.template("Example A:\n{aq}\n{aa}\n{at}\n\nExample B:\n{bq}\n{ba}\n{bt}", {"aq": F.col("a_question"), "aa": F.col("a_answer"), "at": F.col("a_test"), "bq": F.col("b_question"), "ba": F.col("b_answer"), "bt": F.col("b_test")})
        must = F.array("a_used_apis", "b_used_apis") if self.require_both_sources else F.array().cast("array<array<string>>")
        return both.select("task_id", F.size(names).alias("k"), names.alias("seed_apis"), told.alias("context"), F.array("a", "b").alias("sources"), must.alias("must"))

    def run(self, n: int) -> int:
        if self.pool.limit(2).count() < 2:
            raise ValueError("fusion needs two usable samples")
        for _ in range(self.options.max_rounds):
            accepted = self.accepted()
            have = accepted.count()
            if have >= n or self.stop():
                break
            self.round(self.next_task(), self.options.round_tasks, n - have, accepted, self.depth)
        return self.accepted().count()


def fuse_depths(make, first_pool: DataFrame, folder: str, start: int, most: int, n: int) -> list[str]:
    """Depths start..most in turn. make(depth, pool, out) gives the loop of a depth; lower depths must exist."""
    pools, done = [first_pool], []
    spark = first_pool.sparkSession
    for d in range(2, start):
        at = f"{folder}/D{d}/accepted"
        if not io._exists(spark, at):
            raise ValueError(f"depth {d} is missing")
        pools.append(spark.read.schema(_RECORD).json(at))
    for d in range(start, most + 1):
        out = f"{folder}/D{d}"
        loop = make(d, dedup.all_depths(pools), out)
        loop.run(n)
        pools.append(loop.accepted().drop("ordinal", "key"))
        done.append(out)
    return done
