"""Schemas of the record types, as DDL. Reads name one of these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType


def struct(schema: str | StructType) -> StructType:
    """Needs a session, as parsing DDL does."""
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


API_DOCS = "source_file string, qualname string, name string, lineno bigint, end_lineno bigint, signature string, docstring string, code string, full_name string, path string, description string, implementation string"
PACKAGES = "name string, summary string, latest_version string, first_release_time string, last_release_time string, topics array<string>, github_repo string, github_stars string, download_count string, github_created_at string"
TOP_PACKAGES = "last_update string, rows array<struct<project: string, download_count: bigint>>"
PROJECT = (
    "info struct<name: string, summary: string, version: string, classifiers: array<string>, project_urls: map<string, string>, home_page: string>, "
    "releases map<string, array<struct<upload_time_iso_8601: string, upload_time: string>>>")  # fmt: skip
FEW_SHOTS = "task string, solution string, test string"
MESSAGES = "array<struct<role: string, content: string>>"
SOURCES = "array<struct<label: string, question_id: string, question: string, source_path: string, used_apis: array<string>>>"
SAMPLES = (
    f"question string, answer string, messages {MESSAGES}, test string, seed_apis array<string>, used_apis array<string>, "
    "judge struct<label: bigint, reason: string, model: string>, "
    "meta struct<question_id: string, candidate_id: bigint, attempts: bigint, generator_model: string, judge_model: string, k: bigint, k_sampled: bigint, "
    "fn_name: string, source_question_file: string, loop_attempt: bigint, fusion_d: bigint, seed_api_strategy: string, fusion_overlap_required: boolean, "
    f"fusion_sources: {SOURCES}, biased_api_sampling: boolean, tail_alpha: double, question_workers: bigint>")  # fmt: skip
FAILURES = "stage string, question_id string, d bigint, question string, seed_apis array<string>, k_sampled bigint, candidate_id bigint, error string, last_model_output_tail string"
BENCHMARK = "task string, prompt string, test string, api_list array<string>, seed_apis array<string>, entry_point string, retrive_api array<string>"
GENERATIONS = (
    "idx bigint, mode string, task string, target_function string, prompt_prefix string, test string, gold_api_list array<string>, seed_apis array<string>, "
    "retrieved_api_names array<string>, api_block string, model_user_prompt string, "
    "gen_params struct<base_url: string, model: string, k: bigint, max_new_tokens: bigint, temperature: double, top_p: double, seed: bigint, item_seed: bigint>, "
    "attempts array<struct<attempt: bigint, raw_answer: string>>")  # fmt: skip
