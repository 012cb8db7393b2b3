"""Command line: python -m corpusmill extract-api | filter-api | filter-packages | crawl | synthesize | fuse | evaluate | query."""

from __future__ import annotations

import argparse
import json
from contextlib import nullcontext
from dataclasses import asdict, fields
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import rules
from corpusmill.functions import text as T
from corpusmill.operators import dedup, filters, lookup, metrics, packages
from corpusmill.plans import catalogue, stage_queries  # noqa: F401  registers its queries
from corpusmill.plans.evaluate import EvaluationConfig, Evaluator
from corpusmill.plans.external import ChatClient, ContainerRunner, LocalRunner
from corpusmill.plans.loop import FusionLoop, LoopOptions, SynthesisLoop, SynthesisSpec, fuse_depths
from corpusmill.plans.serving import Server
from corpusmill.sources import io, live

DOCS = "full_name string, signature string, docstring string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract-api", help="functions and classes of installed packages")
    x.add_argument("--packages", required=True, help="comma-separated")
    x.add_argument("--out", required=True)
    x.add_argument("--max-depth", type=int, default=3)
    x.add_argument("--private", action="store_true")
    x = sub.add_parser("filter-api", help="records whose names a document or a list has")
    x.add_argument("--records", required=True)
    x.add_argument("--library", required=True)
    x.add_argument("--document")
    x.add_argument("--names")
    x.add_argument("--out", required=True)
    x.add_argument("--names-out")
    x = sub.add_parser("filter-packages", help="package records that pass all filters")
    x.add_argument("--input", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--min-stars", type=int)
    x.add_argument("--min-downloads", type=int)
    x.add_argument("--date-after")
    x.add_argument("--date-field", default="github_created_at")
    x = sub.add_parser("crawl", help="records of the first packages of a top list")
    x.add_argument("--listing", required=True, help="JSON file or URL")
    x.add_argument("--limit", type=int, default=50)
    x.add_argument("--index-url", required=True, help="template with {name}")
    x.add_argument("--stars-url", required=True, help="template with {repo}")
    x.add_argument("--token")
    x.add_argument("--out", required=True)
    for name, told in (("synthesize", "accepted samples of depth 1"), ("fuse", "deeper samples from pairs of accepted ones")):
        x = sub.add_parser(name, help=told)
        x.add_argument("--spec", required=True, help="JSON object of a specification; x_file keys name files beside it")
        x.add_argument("--docs", required=True, help="API records, JSON lines")
        x.add_argument("--options", help="JSON object of loop options")
        x.add_argument("--samples", type=int, default=6000 if name == "synthesize" else 2000)
        x.add_argument("--out", required=True)
        _endpoints(x)
        if name == "fuse":
            x.add_argument("--pool", required=True, help="accepted samples of depth 1")
            x.add_argument("--start-depth", type=int, default=2)
            x.add_argument("--max-depth", type=int, default=3)
            x.add_argument("--require-both-sources", action="store_true")
    x = sub.add_parser("evaluate", help="generations for benchmark items and their pass@k")
    x.add_argument("--benchmark", required=True, help="JSON lines")
    x.add_argument("--docs", required=True, help="API records, JSON lines")
    x.add_argument("--config", help="JSON object merged over the defaults")
    x.add_argument("--mode", choices=["gold", "none", "both"], default="gold", help="both: none, then gold, each in a folder of its own")
    x.add_argument("--serve", help="command of a model server to start at --url and to end after the run")
    x.add_argument("--model-dir", help="folder of the served model, checked before the start")
    x.add_argument("--dump-config", help="write the effective configuration there and stop")
    x.add_argument("--out", required=True)
    _endpoints(x)
    x = sub.add_parser("query", help="one query of the catalogue")
    x.add_argument("name", choices=sorted(catalogue.QUERIES))
    x.add_argument("--sf-dir", required=True)
    x.add_argument("--out", required=True)
    return p


def _endpoints(x: argparse.ArgumentParser) -> None:
    x.add_argument("--url", required=True)
    x.add_argument("--model", required=True)
    x.add_argument("--judge-model")
    x.add_argument("--token")
    x.add_argument("--image", help="run code in containers of this image, not in local interpreters")
    x.add_argument("--run-timeout", type=float, default=20.0)


def _runner(a):
    return ContainerRunner(a.image, a.run_timeout) if a.image else LocalRunner(a.run_timeout)


def _config(cls, path: str | None, with_files: bool = False):
    """A dataclass whose defaults the JSON object of a file replaces key by key; unknown keys are an error."""
    own = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    own = rules.with_files(own, str(Path(path).parent)) if with_files else own
    own = {k: v for k, v in own.items() if not (with_files and k.endswith("_file"))}
    unknown = set(own) - {f.name for f in fields(cls)}
    if unknown:
        raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
    return cls(**own) if with_files else cls(**rules.merged(asdict(cls()), own))


def _loop_parts(spark: SparkSession, a) -> tuple:
    docs = lookup.one_per_key(io.lenient(spark, a.docs, DOCS).where("full_name IS NOT NULL"), "full_name", "ordinal").drop("ordinal")
    judge = ChatClient(a.url, a.judge_model, token=a.token) if a.judge_model else None
    return _config(SynthesisSpec, a.spec, with_files=True), docs, ChatClient(a.url, a.model, token=a.token), judge, _config(LoopOptions, a.options)


def crawl(spark: SparkSession, a) -> dict:
    text = live.HttpFetch()(a.listing) if "://" in a.listing else Path(a.listing).read_text(encoding="utf-8")
    listing = spark.createDataFrame([(text,)], "line string").select(F.from_json("line", schemas.TOP_PACKAGES).alias("l")).select("l.*")
    got = packages.crawl(packages.top_names(listing, a.limit), live.HttpFetch(), a.index_url, a.stars_url, live.HttpFetch(token=a.token))
    io.write_jsonl(got, a.out, "overwrite", order="ordinal")
    return {"packages": spark.read.text(a.out).count()}


def synthesize(spark: SparkSession, a) -> dict:
    spec, docs, client, judge, options = _loop_parts(spark, a)
    return {"accepted": SynthesisLoop(spark, spec, docs, a.out, client, _runner(a), judge, options).run(a.samples)}


def fuse(spark: SparkSession, a) -> dict:
    spec, docs, client, judge, options = _loop_parts(spark, a)
    pool = io.strict(spark, a.pool, schemas.SAMPLES).select("question", "answer", "test", "used_apis", "seed_apis")
    make = lambda d, pool, out: FusionLoop(spark, spec, docs, out, client, _runner(a), judge, options, pool=pool, depth=d, require_both_sources=a.require_both_sources)
    return {"depths": fuse_depths(make, pool, a.out, a.start_depth, a.max_depth, a.samples)}


def evaluate(spark: SparkSession, a) -> dict:
    config = _config(EvaluationConfig, a.config)
    if a.dump_config:
        io.write_report(asdict(config), a.dump_config)
        return {"config": a.dump_config}
    with Server(a.serve, a.url, a.model_dir) if a.serve else nullcontext():
        if a.mode != "both":
            return _evaluate(spark, a, config, a.mode, a.out)
        return {mode: _evaluate(spark, a, config, mode, f"{a.out}/{mode}") for mode in ("none", "gold")}


def _evaluate(spark: SparkSession, a, config: EvaluationConfig, mode: str, out: str) -> dict:
    items = lookup.numbered(io.lines(spark, a.benchmark), ["ordinal"], "idx").select("idx", "line")
    ev = Evaluator(config, ChatClient(a.url, a.model, token=a.token), _runner(a))
    io.write_jsonl(ev.generate(ev.prompts(items, io.lenient(spark, a.docs, DOCS), mode)), f"{out}/generations", "overwrite", order="idx")
    done, means = ev.run(io.strict(spark, f"{out}/generations", schemas.GENERATIONS))
    io.write_jsonl(done, f"{out}/attempts", "overwrite", order="idx")
    row = means.first().asDict()
    io.write_report(row, f"{out}/report.json")
    return row


def extract_api(spark: SparkSession, a) -> dict:
    spark.dataSource.register(live.ApiSource)
    got = spark.read.format("python_api").option("packages", a.packages).option("max_depth", a.max_depth).option("private", str(a.private).lower()).load()
    got.write.mode("overwrite").option("ignoreNullFields", "false").json(a.out)
    return {"records": spark.read.schema(live.SCHEMA).json(a.out).count()}


def filter_api(spark: SparkSession, a) -> dict:
    if a.names:
        names = io.names(spark, a.names)
    else:
        names = dedup.documented_names(io.documents(spark, a.document).withColumnRenamed("path", "doc_id"), a.library)
    records = io.strict(spark, a.records, schemas.API_DOCS).drop("full_name")
    kept = lookup.documented(records, names, a.library)
    kept.write.mode("overwrite").option("ignoreNullFields", "false").json(a.out)
    kept = spark.read.schema(schemas.API_DOCS).json(a.out)
    if a.names_out:
        io.write_names(kept, a.names_out)
    return metrics.run_counters(kept, records.count())


def filter_packages(spark: SparkSession, a) -> dict:
    rows = io.lenient(spark, a.input, schemas.PACKAGES)
    kept = filters.filter_packages(rows, a.min_stars, a.min_downloads, a.date_after, a.date_field)
    io.write_jsonl(kept, a.out, "overwrite", order="ordinal")
    return {"kept": spark.read.schema(schemas.PACKAGES).json(a.out).count()}


def run_query(spark: SparkSession, a) -> dict:
    catalogue.QUERIES[a.name](spark, a.sf_dir).write.mode("overwrite").parquet(a.out)
    return {"rows": spark.read.parquet(a.out).agg(F.count("*")).first()[0]}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(args)
    if getattr(a, "date_after", None):
        T.parse_cutoff(a.date_after)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = {"extract-api": extract_api, "filter-api": filter_api, "filter-packages": filter_packages, "crawl": crawl, "synthesize": synthesize, "fuse": fuse, "evaluate": evaluate, "query": run_query}[a.command](spark, a)
    print(out)
    return out


if __name__ == "__main__":
    main()
