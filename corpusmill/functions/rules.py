"""Rule-driven names, templates and configuration. Templates are split once on the driver and planned as concat."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONDITIONS = {
    "source_file_endswith": lambda f, q, n, v: f.endswith(v),
    "source_file_contains": lambda f, q, n, v: F.contains(f, F.lit(v)),
    "qualname_startswith": lambda f, q, n, v: q.startswith(v),
    "qualname_contains": lambda f, q, n, v: F.contains(q, F.lit(v)),
    "qualname_regex": lambda f, q, n, v: q.rlike(v),
    "name_regex": lambda f, q, n, v: n.rlike(v),
}


def template(text: str, values: Mapping[str, Column], missing_as_empty: bool = False) -> Column:
    """{key} of a known key is replaced, once; other braces stay, or with missing_as_empty become nothing."""
    parts = []
    for piece in re.split(r"(\{[A-Za-z_]\w*\})", text):
        key = piece[1:-1]
        if piece.startswith("{") and piece.endswith("}") and key in values:
            parts.append(F.coalesce(values[key].cast("string"), F.lit("")))
        elif not (missing_as_empty and re.fullmatch(r"\{[A-Za-z_]\w*\}", piece)):
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def full_name(rules: list[dict], source_file: Column, qualname: Column, name: Column) -> Column:
    """The first rule whose conditions all hold and whose template gives some text. `always` adds no condition, whatever
    its value; a condition that is not known is an error."""
    f, q, n = (F.coalesce(c, F.lit("")) for c in (source_file, qualname, name))
    values = {"source_file": f, "qualname": q, "name": n}
    out = []
    for rule in rules:
        ok = F.lit(True)
        for key, value in (rule.get("when") or {}).items():
            if key == "always":
                continue
            if key not in _CONDITIONS:
                raise ValueError(f"unknown condition {key!r}")
            ok = ok & _CONDITIONS[key](f, q, n, value)
        made = template(rule.get("template", ""), values, missing_as_empty=True)
        out.append(F.when(ok, F.nullif(F.trim(made), F.lit(""))))
    return F.coalesce(*out, F.lit("")) if out else F.lit("")


def merged(base: dict, over: dict) -> dict:
    """Objects are merged key by key, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str, defaults: dict) -> dict:
    own = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(own, dict):
        raise ValueError(f"{path}: the top level is no object")
    return merged(defaults, own)


def with_files(spec: dict, folder: str) -> dict:
    """`x_file` keys stand for the text of a file beside the spec, unless `x` is given too."""
    out = dict(spec)
    for key, value in spec.items():
        if key.endswith("_file") and isinstance(value, str) and key != "api_docs_file" and not spec.get(key[:-5]):
            at = Path(folder, value)
            text = at.read_text(encoding="utf-8")
            out[key[:-5]] = [json.loads(x) for x in text.splitlines() if x.strip()] if at.suffix == ".jsonl" else json.loads(text) if at.suffix == ".json" else text
    return out


def list_argument(value, kind=str) -> list:
    """A scalar, comma-separated text, a JSON list, or several of these; first seen stay."""
    out: list = []
    for v in value if isinstance(value, (list, tuple)) else [value]:
        text = str(v).strip()
        items = json.loads(text) if text.startswith("[") else text.split(",")
        out += [kind(str(x).strip()) for x in items if str(x).strip()]
    return list(dict.fromkeys(out))


def k_values(value) -> list[int]:
    out = list_argument(value, int)
    if not out or min(out) <= 0:
        raise ValueError("k must be positive")
    return out


def call_prefixes(module: str, alias: str, given: list[str] | None = None) -> list[str]:
    """Prefixes that calls of the library start with: the alias first, the module last if it is one identifier."""
    out = [*(given or []), alias, *([module] if module.isidentifier() else [])]
    return list(dict.fromkeys(p for p in out if p))


def slots(urls: list[str], n: int) -> list[str]:
    """Endpoints spread over n slots; the first ones get what is left over; too many endpoints are cut."""
    each, rest = divmod(n, len(urls[:n]) or 1)
    return [u for i, u in enumerate(urls[:n]) for _ in range(each + (i < rest))]
