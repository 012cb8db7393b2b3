"""Functions over source code and model output. They parse Python, so they run as Arrow-batched pandas UDFs; each has a
plain function beside it. None raises: what cannot be parsed comes back as an error text or an empty value."""

from __future__ import annotations

import ast
import io
import json
import re
import textwrap
import tokenize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a fenced block, and as the fence around a whole answer.
_BLOCK = re.compile(r"```(?:\s*(?:python|py))?\s*([\s\S]*?)```", re.I)
_FIRST = re.compile(r"^\s*```(?:json|python)?\s*([\s\S]*?)\s*```\s*$", re.M)


def _parsed(code: str):
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _dotted(node) -> list[str] | None:
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return [node.id, *reversed(names)] if names and isinstance(node, ast.Name) else None


def used_names(code: str, prefixes: list[str], module: str) -> list[str]:
    """Library names that code uses, under the module's name, each with its base, by place of first use. Calls and
    launches (a call of a subscript) come first and name themselves before their base; other attributes after it."""
    tree = _parsed(code)
    if tree is None:
        return []
    place = {}

    def note(node, target, base_first):
        names = _dotted(target)
        if names and names[0] in prefixes:
            for depth in sorted((2, len(names)), reverse=not base_first):
                place.setdefault(".".join([module, *names[1:depth]]), (node.lineno, node.col_offset))

    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.Call, ast.Attribute))]
    for n in nodes:
        if isinstance(n, ast.Call):
            note(n, n.func.value if isinstance(n.func, ast.Subscript) else n.func, False)
    for n in nodes:
        if isinstance(n, ast.Attribute):
            note(n, n, True)
    return [name for name, _ in sorted(place.items(), key=lambda x: x[1])]


def functions_of(code: str) -> list[str] | None:
    tree = _parsed(code)
    return None if tree is None else [n.name for n in tree.body if isinstance(n, ast.FunctionDef)]


def target_of(prompt: str) -> str | None:
    """The one top-level function of a starter; None if there is not exactly one."""
    names = functions_of(prompt)
    return names[0] if names and len(names) == 1 else None


def checked(answer: str, test: str, question: str, required_import: str, min_asserts: int = 1, max_functions: int = 1) -> tuple[bool, str, str]:
    """(ok, function tested, error) of a generated answer and its test."""
    names = functions_of(answer)
    if names is None:
        return False, "", "the answer does not parse"
    if not 1 <= len(names) <= max_functions:
        return False, "", f"the answer has {len(names)} top-level functions"
    name = names[-1]
    if required_import and required_import not in answer:
        return False, name, "the required import is missing"
    if f"{name}(" not in test and f"{name}[" not in test:
        return False, name, "the test does not call the function"
    if "print" not in (question or "") and len(re.findall(r"(?m)^\s*assert\s+", test)) < min_asserts:
        return False, name, "too few asserts"
    if _parsed(f"{answer}\n\n{test}") is None:
        return False, name, "answer and test together do not parse"
    return True, name, ""


def _unfenced(text: str) -> str:
    text = text.strip()
    m = _FIRST.search(text)
    return (m.group(1) if m else text).strip()


def json_object(text: str) -> dict | None:
    """The object that a text is, or the first balanced one in it."""
    text = _unfenced(text or "")
    try:
        got = json.loads(text)
        return got if isinstance(got, dict) else None
    except ValueError:
        pass
    start = text.find("{")
    depth, quoted, i = 0, False, start
    while 0 <= i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        else:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                try:
                    got = json.loads(text[start : i + 1])
                except ValueError:
                    return None
                return got if isinstance(got, dict) else None
        i += 1
    return None


def pair_of(got: dict) -> tuple[str, str] | None:
    """Answer and test of a parsed reply, each ended by one line feed: arrays of lines, or values that may be fenced."""
    if "answer_lines" in got and "test_lines" in got:
        both = got["answer_lines"], got["test_lines"]
        if not all(isinstance(x, list) and all(isinstance(line, str) for line in x) for x in both):
            return None
        return tuple("\n".join(x).rstrip() + "\n" for x in both)
    if "answer" in got and "test" in got:
        return _unfenced(str(got["answer"])) + "\n", _unfenced(str(got["test"])) + "\n"
    return None


def answer_and_test(text: str, required_import: str, min_asserts: int = 1, max_functions: int = 1) -> tuple[str, str, str]:
    """(answer, test, error) of a reply: JSON, else two blocks that check out, where answers are those with the import if
    any has it, else the first two blocks, else, if it speaks of both, what stands around the first line that opens with
    "test"."""
    text = text or ""
    got = json_object(text)
    pair = pair_of(got) if got else None
    if pair:
        return *pair, ""
    blocks = [b.strip() + "\n" for b in _BLOCK.findall(text)]
    for answer in [b for b in blocks if required_import in b] or blocks if len(blocks) > 1 else ():
        for test in blocks:
            if test is not answer and checked(answer, test, "", required_import, min_asserts, max_functions)[0]:
                return answer, test, ""
    if len(blocks) > 1:
        return blocks[0], blocks[1], ""
    lines, low = text.splitlines(), text.lower()
    opens = next((i for i, line in enumerate(lines) if line.strip().lower().startswith("test")), 0)
    if opens and "answer" in low:
        return "\n".join(lines[:opens]).strip() + "\n", "\n".join(lines[opens + 1 :]).strip() + "\n", ""
    return "", "", "no answer and test found"


def without_docstring(code: str, module: bool = False) -> str:
    """Code without the string that opens its first block (module: its first string). Indented code, as methods are,
    opens with the indent itself and keeps its docstring."""
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return code
    skip = {tokenize.NL, tokenize.NEWLINE, tokenize.COMMENT, tokenize.ENCODING}
    inside = module
    for t in tokens:
        if not inside:
            inside = t.type == tokenize.INDENT
        elif t.type == tokenize.STRING:
            lines = code.splitlines(keepends=True)
            (a, _), (b, _) = t.start, t.end
            return "".join([*lines[: a - 1], *lines[b:]])
        elif t.type not in skip:
            break
    return code


def wrapped(text: str, width: int = 90) -> str:
    """Lines of at most `width`, each a comment."""
    return "\n".join(textwrap.wrap(text or "", width, initial_indent="# ", subsequent_indent="# "))


# ---------------------------------------------------------------- as columns


def used_apis(code, prefixes: list[str], module: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: used_names(c, prefixes, module))

    return run(code)


def target_function(prompt, entry_point=None) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(target_of)

    return F.coalesce(F.nullif(F.trim(entry_point), F.lit("")), run(prompt)) if entry_point is not None else run(prompt)


def validate(answer, test, question, required_import: str, min_asserts: int = 1, max_functions: int = 1) -> Column:
    @F.pandas_udf("ok boolean, fn_name string, error string")
    def run(a: pd.Series, t: pd.Series, q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([checked(x or "", y or "", z or "", required_import, min_asserts, max_functions) for x, y, z in zip(a, t, q, strict=True)], columns=["ok", "fn_name", "error"])

    return run(answer, test, question)


def parse_reply(text, required_import: str, min_asserts: int = 1, max_functions: int = 1) -> Column:
    @F.pandas_udf("answer string, test string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([answer_and_test(x, required_import, min_asserts, max_functions) for x in s], columns=["answer", "test", "error"])

    return run(text)


def parse_object(text) -> Column:
    """A JSON object in a text, as compact JSON; null if there is none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        made = s.map(json_object)
        return made.map(lambda g: None if g is None else json.dumps(g, ensure_ascii=False, separators=(",", ":"), sort_keys=True))

    return run(text)


def strip_docstring(code, module: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: without_docstring(c or "", module))

    return run(code)


def wrap_comment(text, width: int = 90) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: wrapped(t, width))

    return run(text)


def pretty(objects) -> Column:
    """A JSON text with an indent of two."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=2))

    return run(objects)
