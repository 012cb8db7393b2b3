"""Benchmark items to generations, and generations to pass@k."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import code as C
from corpusmill.functions import text as T
from corpusmill.operators import filters, lookup, metrics
from corpusmill.plans import external


@dataclass
class EvaluationConfig:
    library: str = "lib"
    alias: str = "lib"
    system_prompt: str = "Complete the function."
    usage: str = "Use {library} as {alias}."
    max_doc_chars: int = 4096
    titles: dict = field(default_factory=lambda: {"gold": "Relevant API:", "none": "Retrieved API:"})
    preamble: str = ""
    k: int = 10
    max_new_tokens: int = 1024
    temperature: float = 0.5
    top_p: float = 0.95
    seed: int = 0


class Evaluator:
    def __init__(self, config: EvaluationConfig, client=None, runner=None):
        self.config, self.client, self.runner = config, client, runner

    def prompts(self, benchmark: DataFrame, docs: DataFrame, mode: str = "gold") -> DataFrame:
        """One prompt for each usable item. benchmark: (idx, line) with a JSON object in each line; idx from 1.
        Mode gold gives the documents of api_list, or else of seed_apis; mode none those of the retrieved names."""
        from corpusmill import schemas

        cfg = self.config
        items = benchmark.where(filters.has_fields("line", "task", "prompt", "test")).select("idx", F.from_json("line", schemas.BENCHMARK).alias("b")).select("idx", "b.*")
        items = items.withColumn("target_function", C.target_function(F.coalesce("prompt", F.lit("")), F.col("entry_point"))).where("target_function IS NOT NULL")
        empty = F.array().cast("array<string>")
        gold = F.when(F.size(F.coalesce("api_list", empty)) > 0, F.col("api_list")).otherwise(F.coalesce("seed_apis", empty))
        items = items.withColumn("names", gold if mode == "gold" else F.coalesce("retrive_api", empty)).withColumn("mode", F.lit(mode))
        with_docs = lookup.docs_for(items, "idx", "names", lookup.one_per_key(docs, "full_name", "ordinal"))
        block = external.api_block(F.coalesce("api_docs", F.array().cast(with_docs.schema["api_docs"].dataType)), cfg.max_doc_chars, cfg.titles[mode])
        alias = T.import_alias("prompt", cfg.library, cfg.alias)
        user = external.prompt("{usage}\n{block}\n{task}\n\n" + f"{T.FENCE}python\n" + "{prompt}\n" + T.FENCE, usage=external.prompt(cfg.usage, library=F.lit(cfg.library), alias=alias), block=block, task=F.col("task"), prompt=F.col("prompt"))
        return with_docs.select("idx", "mode", "task", "target_function", F.col("prompt").alias("prompt_prefix"), "test", gold.alias("gold_api_list"), "seed_apis", F.col("names").alias("retrieved_api_names"), block.alias("api_block"), user.alias("model_user_prompt"), T.item_seed(cfg.seed, F.col("idx")).alias("item_seed"))

    def generate(self, prompts: DataFrame) -> DataFrame:
        """prompts with attempts: array of (attempt, raw_answer). Write the result before it is evaluated."""
        cfg, client = self.config, self.client

        def each(row):
            messages = [{"role": "system", "content": cfg.system_prompt}, {"role": "user", "content": row["model_user_prompt"]}]
            try:
                got = client.complete(messages, cfg.k, f"{row['mode']}/{row['idx']}", max_tokens=cfg.max_new_tokens, temperature=cfg.temperature, top_p=cfg.top_p, seed=row["item_seed"])
            except Exception as e:  # noqa: BLE001  a failed call is a row without attempts
                return {"attempts": [], "error": str(e)}
            return {"attempts": [{"attempt": i, "raw_answer": t} for i, t in enumerate(got, 1)], "error": None}

        return external.mapped(prompts, "attempts array<struct<attempt: bigint, raw_answer: string>>, error string", each, ["attempts", "error"])

    def attempts(self, generations: DataFrame) -> DataFrame:
        """(idx, mode, test, attempt, code) of the first max(1, k) attempts."""
        first = F.slice("attempts", 1, max(1, self.config.k))
        return generations.select("idx", "mode", "test", F.explode(first).alias("a")).select("idx", "mode", "test", "a.attempt", T.longest_block("a.raw_answer").alias("code"))

    def run(self, generations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(results by attempt, one row of means). Items without attempts count with none passed."""
        done = external.evaluated(self.attempts(generations), self.runner, self.config.preamble)
        tallies = metrics.tally(done, ["idx", "mode"], self.config.k)
        every = generations.select("idx", "mode").join(tallies, ["idx", "mode"], "left").select("idx", "mode", F.coalesce("c", F.lit(0)).alias("c"), F.lit(self.config.k).cast("long").alias("n"))
        return done, metrics.mean_pass_at(every)
