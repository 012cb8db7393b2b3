"""Python data sources: the API of installed packages by reflection, and package indexes over an injected fetcher."""

from __future__ import annotations

import importlib
import inspect
import os
import pkgutil
import types
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions.code import without_docstring

SCHEMA = "full_name string, kind string, source_file string, qualname string, name string, lineno bigint, end_lineno bigint, signature string, docstring string, code string, ordinal bigint"


def kind_of(x) -> str:
    x = unwrapped(x)
    if inspect.ismodule(x):
        return "module"
    if inspect.isclass(x):
        return "class"
    callables = (types.FunctionType, types.BuiltinFunctionType, types.MethodDescriptorType, types.WrapperDescriptorType, types.MethodWrapperType, types.ClassMethodDescriptorType)
    return "function" if isinstance(x, callables) else "other"


def unwrapped(x):
    return x.__func__ if isinstance(x, (staticmethod, classmethod)) else x


def member_names(module, private: bool = False) -> list[str]:
    """Names that a module offers: __all__ if it is a list of texts, else dir(); none that starts with two underscores."""
    listed = getattr(module, "__all__", None)
    given = listed if isinstance(listed, (list, tuple)) and all(isinstance(n, str) for n in listed) else dir(module)
    return [n for n in dict.fromkeys(given) if not n.startswith("__") and (private or not n.startswith("_"))]


def members(x, private: bool = False) -> Iterator[tuple[str, object]]:
    if inspect.isclass(x):
        for n, v in inspect.getmembers_static(x):
            if not n.startswith("__") and (private or not n.startswith("_")):
                yield n, v
        return
    for n in member_names(x, private):
        try:
            yield n, getattr(x, n)
        except Exception:  # noqa: BLE001  a lazy attribute of a foreign package may raise anything
            continue


def record(full_name: str, root: str, x, folder: str, ordinal: int) -> tuple:
    kind, x = kind_of(x), unwrapped(x)
    best = lambda f, empty: _or(f, empty)
    lines, start = best(lambda: inspect.getsourcelines(x), ([], None))
    path = best(lambda: inspect.getsourcefile(x) or "", "")
    if path:
        path = os.path.relpath(path, folder) if path.startswith(folder + os.sep) else os.path.basename(path)
    code = "".join(lines)
    qualname = full_name[len(root) + 1 :]
    end = start + len(lines) - 1 if start is not None else None
    return (full_name, kind, path, qualname, full_name.rsplit(".", 1)[-1], start, end, best(lambda: str(inspect.signature(x)), ""), inspect.getdoc(x) or "", without_docstring(code) if code else "", ordinal)


def _or(f, empty):
    try:
        return f()
    except Exception:  # noqa: BLE001  reflection of compiled code fails in many ways
        return empty


def walk(root: str, max_depth: int = 3, private: bool = False) -> Iterator[tuple]:
    """Functions and classes below a package, depth first, each full name once."""
    package = importlib.import_module(root)
    folder = os.path.dirname(inspect.getsourcefile(package) or "")
    seen_names, seen_objects, ordinal = set(), {id(package)}, 0
    for found in pkgutil.iter_modules(getattr(package, "__path__", [])):
        if private or not found.name.startswith("_"):
            _or(lambda n=found.name: importlib.import_module(f"{root}.{n}"), None)
    stack = [(root, package, 0)]
    while stack:
        name, holder, depth = stack.pop()
        inner = []
        for n, v in members(holder, private):
            full, kind = f"{name}.{n}", kind_of(v)
            if kind == "module" and not (v.__name__ == root or v.__name__.startswith(f"{root}.")):
                continue
            if kind in ("function", "class") and depth + 1 <= max_depth and full not in seen_names:
                seen_names.add(full)
                yield record(full, root, v, folder, ordinal)
                ordinal += 1
            if kind in ("module", "class") and depth + 1 < max_depth and id(unwrapped(v)) not in seen_objects:
                seen_objects.add(id(unwrapped(v)))
                inner.append((full, unwrapped(v), depth + 1))
        stack += reversed(inner)


class _Package(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _ApiReader(DataSourceReader):
    def __init__(self, options):
        self.packages = [p for p in options.get("packages", "").split(",") if p]
        self.max_depth, self.private = int(options.get("max_depth", 3)), options.get("private", "false") == "true"

    def partitions(self):
        return [_Package(p) for p in self.packages]

    def read(self, partition):
        yield from walk(partition.name, self.max_depth, self.private)


class ApiSource(DataSource):
    """spark.read.format("python_api").option("packages", "json,math").load(): a partition for each package."""

    @classmethod
    def name(cls):
        return "python_api"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _ApiReader(self.options)


# ---------------------------------------------------------------- package indexes


def fetched(requests, fetch, column: str = "url", out: str = "body"):
    """requests with the text that fetch(url) gives, null where it fails. fetch is a picklable callable; calls run in the
    tasks, once each per attempt of a task. Offline, pass one that reads fixtures."""

    def work(batches):
        for pdf in batches:
            yield pdf.assign(**{out: [_or(lambda u=u: fetch(u), None) for u in pdf[column]]})

    schema = ", ".join(f"`{n}` {t}" for n, t in [*requests.dtypes, (out, "string")])
    return requests.mapInPandas(work, schema)


class HttpFetch:
    """GET with a timeout; a bearer token if one is given."""

    def __init__(self, timeout: float = 20.0, token: str | None = None):
        self.timeout, self.token = timeout, token

    def __call__(self, url: str) -> str:
        from urllib.request import Request, urlopen

        headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        with urlopen(Request(url, headers=headers), timeout=self.timeout) as reply:
            return reply.read().decode("utf-8")
