"""Stages that call a model or run code. Clients and runners are injected; calls run in the tasks. A call is named by a
key, so that a client can answer a repeated task from its own cache; failures are rows, never exceptions."""

from __future__ import annotations

import json
import os
import random
import signal
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import rules
from corpusmill.functions import text as T


class ModelClient(Protocol):
    def complete(self, messages: list[dict], n: int, key: str, **options) -> list[str]: ...


class ChatClient:
    """An HTTP chat-completions client. With fewer choices than asked, the last one is repeated."""

    def __init__(self, url: str, model: str, timeout: float = 120.0, token: str | None = None, pause: float = 0.0):
        self.url, self.model, self.timeout, self.token, self.pause = url.rstrip("/"), model, timeout, token, pause

    def complete(self, messages, n=1, key="", **options):
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        if self.pause:
            time.sleep(random.uniform(0, self.pause))
        body = json.dumps({"model": self.model, "messages": messages, "n": n, **{k: v for k, v in options.items() if v is not None}}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urlopen(Request(f"{self.url}/v1/chat/completions", body, headers), timeout=self.timeout) as reply:
                got = [c["message"]["content"] or "" for c in json.load(reply)["choices"]]
        except HTTPError as e:
            raise RuntimeError(f"HTTP {e.code}: {e.read()[:500]!r}") from e
        return (got + got[-1:] * n)[:n]


class LocalRunner:
    """Runs code in a fresh interpreter with limits: empty environment, own folder and process group. It is no sandbox."""

    def __init__(self, timeout: float = 20.0, memory_mb: int = 2048, env: dict | None = None):
        self.timeout, self.memory_mb, self.env = timeout, memory_mb, env or {}

    def run(self, code: str) -> tuple[bool, str]:
        def limits():
            import resource

            resource.setrlimit(resource.RLIMIT_AS, (self.memory_mb << 20,) * 2)
            resource.setrlimit(resource.RLIMIT_CPU, (int(self.timeout) + 1,) * 2)

        with tempfile.TemporaryDirectory() as at:
            p = subprocess.Popen([sys.executable, "-I", "-"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, cwd=at, env={"PATH": os.defpath, **self.env}, start_new_session=True, preexec_fn=limits, text=True, errors="replace")
            try:
                out, _ = p.communicate(code, timeout=self.timeout)
            except subprocess.TimeoutExpired:
                os.killpg(p.pid, signal.SIGKILL)
                p.communicate()
                return False, f"timeout after {self.timeout:g} s"
        return p.returncode == 0, out


class ContainerRunner(LocalRunner):
    """The same in a container without network and with bounds on memory and cores. env is that of the container program."""

    def __init__(self, image: str, timeout: float = 20.0, memory: str = "2g", cpus: str = "2", program: str = "docker", env: dict | None = None):
        super().__init__(timeout, env=env)
        self.command = [program, "run", "--rm", "-i", "--network", "none", "--memory", memory, "--cpus", cpus, image, "python", "-"]

    def run(self, code: str) -> tuple[bool, str]:
        try:
            p = subprocess.run(self.command, input=code, capture_output=True, text=True, timeout=self.timeout, errors="replace", env={**self.env, **os.environ})
        except (subprocess.TimeoutExpired, OSError) as e:
            return False, str(e)
        return p.returncode == 0, p.stdout + p.stderr


def mapped(df: DataFrame, schema: str, each: Callable[[dict], dict | list[dict]], out: list[str]) -> DataFrame:
    """each(row) -> row or rows, in the tasks, with df's columns first."""
    kept = df.columns

    def work(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                got = each(row)
                rows += [{**{k: row[k] for k in kept}, **g} for g in (got if isinstance(got, list) else [got])]
            yield pd.DataFrame(rows, columns=[*kept, *out])

    return df.mapInPandas(work, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), schema]))


def evaluated(attempts: DataFrame, runner, preamble: str = "", code: str = "code", test: str = "test") -> DataFrame:
    """attempts with passed and info: preamble, code and test run together."""

    def each(row):
        ok, out = runner.run(f"{preamble}\n{row[code] or ''}\n\n{row[test]}\n")
        return {"passed": ok, "info": "passed" if ok else out[-2000:]}

    return mapped(attempts, "passed boolean, info string", each, ["passed", "info"])


# ---------------------------------------------------------------- prompts


def example_lines(examples: Column) -> Column:
    """Few-shots for questions: one JSON object a line."""
    return F.array_join(F.transform(examples, lambda e: F.to_json(F.struct(e["task"].alias("task")))), "\n")


def example_blocks(examples: Column) -> Column:
    """Few-shots for answers: solution and test in fences."""
    fence = lambda c: F.concat(F.lit(f"{T.FENCE}python\n"), T.strip_fence(c), F.lit(f"\n{T.FENCE}"))
    return F.array_join(F.transform(examples, lambda e: F.concat(F.lit("Task: "), e["task"], F.lit("\n"), fence(e["solution"]), F.lit("\n"), fence(e["test"]))), "\n\n")


def prompt(text: str, **values: Column) -> Column:
    return rules.template(text, values)


def api_block(docs: Column, most: int, title: str) -> Column:
    """A title and for each name its signature and cut documentation, or the name alone."""
    one = lambda d: F.concat(F.lit("- "), d["full_name"], F.coalesce(d["signature"], F.lit("")), F.when(F.coalesce(d["docstring"], F.lit("")) != "", F.concat(F.lit("\n# "), T.cut_doc(d["docstring"], most))).otherwise(""))
    return F.concat(F.lit(f"{title}\n"), F.array_join(F.transform(docs, one), "\n"), F.lit("\n"))
