"""Scalar functions over strings, times, URLs and numbers. Column in, Column out; all of them run in the JVM."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every code point that the usual notion of white space in Unicode text covers.
SPACE = r"[\s\x1c-\x1f]"
_SPACES = rf"(?U){SPACE}+"
#: Ranges of CJK ideographs, their marks, and full-width forms; kana stay.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{F900}-\x{FAFF}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFEF}\x{20000}-\x{2EBEF}]"
FENCE = "```"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(_c(x), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def rstrip(x) -> Column:
    return F.regexp_replace(_c(x), rf"(?U){SPACE}+\z", "")


def normalise_question(x) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), _SPACES, " "))


def strip_cjk(x) -> Column:
    return F.regexp_replace(_c(x), CJK, "")


def sanitise_messages(messages) -> Column:
    return F.transform(_c(messages), lambda m: F.struct(m["role"].alias("role"), strip_cjk(F.coalesce(m["content"], F.lit(""))).alias("content")))


def strip_fence(x) -> Column:
    """The contents of the first fence that starts a line and whose end ends one, white space around them aside, tagged
    json, python or not at all; else the trimmed text."""
    pattern = rf"(?Umd)^{SPACE}*{FENCE}(?:json|python)?{SPACE}*([\s\S]*?){SPACE}*{FENCE}{SPACE}*$"
    x = strip(x)
    return F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1))).otherwise(x)


def code_blocks(x) -> Column:
    """Contents of all fences, tagged python, py or anything that then stays in the text."""
    found = F.regexp_extract_all(_c(x), F.lit(rf"(?i){FENCE}(?:\s*(?:python|py))?\s*([\s\S]*?){FENCE}"), F.lit(1))
    return F.transform(found, strip)


def longest_block(x) -> Column:
    """Between consecutive fences the longest text, the first of equals; with one fence what follows; with none all."""
    newlines = lambda s: F.regexp_replace(s, r"^\n+|\n+\z", "")
    parts = F.split(F.regexp_replace(_c(x), rf"(?i){FENCE}\s*python[ \t]*", FENCE), FENCE, -1)
    inner = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), newlines), lambda s: s != "")
    longest = F.aggregate(inner, F.lit(""), lambda a, s: F.when(F.char_length(s) > F.char_length(a), s).otherwise(a))
    return F.when(F.size(parts) == 1, _c(x)).when(F.size(inner) > 0, longest).otherwise(newlines(F.element_at(parts, -1)))


def count_asserts(x) -> Column:
    return F.regexp_count(_c(x), F.lit(r"(?m)^\s*assert\s+")).cast("long")


def mentions(x, library: str) -> Column:
    """All dotted names below the library that a text mentions, with repeats."""
    return F.regexp_extract_all(_c(x), F.lit(rf"(?U)\b{re.escape(library)}(?:\.[A-Za-z_]\w*)+\b"), F.lit(0))


def filter_name(qualname, source_file, library: str) -> Column:
    """The full name under which documents mention a record."""
    q, f = _c(qualname), _c(source_file)
    ext = F.coalesce(f.endswith("extensions.py"), F.lit(False))
    return F.when(q.startswith(f"{library}.") | (q == library), q).when(ext, F.concat(F.lit(f"{library}.extensions."), q)).otherwise(F.concat(F.lit(f"{library}."), q))


def doc_name(qualname, name) -> Column:
    """qualname, or else name; an error if both are blank."""
    some = lambda x: F.nullif(strip(_c(x)), F.lit(""))
    return F.coalesce(some(qualname), some(name), F.raise_error(F.lit("an API record has neither qualname nor name")).cast("string"))


def canonical(x, prefixes: list[str], module: str) -> Column:
    """The longest known prefix of a dotted name becomes the module's name."""
    x, out = _c(x), None
    for p in sorted(set(prefixes), key=lambda p: (-len(p), p)):
        hit = (x == p) | x.startswith(f"{p}.")
        new = F.concat(F.lit(module), F.substring(x, len(p) + 1, 2147483647))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return x if out is None else out.otherwise(x)


def canonical_list(names, prefixes: list[str], module: str, with_base: bool = True) -> Column:
    """Names in canonical form, each followed by its base (module and first segment) if it is deeper; first seen stay."""
    depth = len(module.split(".")) + 1

    def forms(n):
        n = canonical(n, prefixes, module)
        base = F.array_join(F.slice(F.split(n, r"\."), 1, depth), ".")
        deep = n.startswith(f"{module}.") & (F.size(F.split(n, r"\.")) > depth)
        return F.when(deep, F.array(n, base)).otherwise(F.array(n)) if with_base else F.array(n)

    names = F.filter(F.coalesce(_c(names), F.array().cast("array<string>")), lambda n: n.isNotNull() & (strip(n) != ""))
    return F.array_distinct(F.flatten(F.transform(names, lambda n: forms(strip(n)))))


def cut_doc(x, most: int) -> Column:
    """White space collapsed; at most `most` characters, then an ellipsis."""
    one = normalise_question(x)
    return F.when(F.char_length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most)), F.lit(" ..."))).otherwise(one)


def import_alias(x, library: str, default: str) -> Column:
    """The alias that a text imports the library, or else one of its submodules, by."""
    lib = re.escape(library)
    plain, sub = rf"(?m)^\s*import\s+{lib}\s+as\s+(\w+)", rf"(?m)^\s*import\s+{lib}\.[\w.]+\s+as\s+(\w+)"
    got = lambda p: F.nullif(F.regexp_extract(F.coalesce(_c(x), F.lit("")), p, 1), F.lit(""))
    return F.coalesce(got(plain), got(sub), F.lit(default))


def tail(x, most: int = 2000) -> Column:
    return F.right(_c(x), F.lit(most))


# ---------------------------------------------------------------- times


def utc_time(x) -> Column:
    """An ISO time as UTC `yyyy-MM-dd HH:mm:ss`; null if blank; the text as it is if it is no such time."""
    t = strip(x)
    looks = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|z|[+-]\d{2}:?\d{2})?)?$")
    made = F.when(looks, F.date_format(F.try_to_timestamp(F.regexp_replace(t, "z$", "Z")), "yyyy-MM-dd HH:mm:ss"))
    return F.when(t == "", None).otherwise(F.coalesce(made, _c(x)))


def package_time(x) -> Column:
    return F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd HH:mm:ss"))


def parse_cutoff(text: str) -> dt.datetime:
    """A date, a date and time, or digits: YYYYMMDD, YYYYMM, YYMM (of this century)."""
    text = text.strip()
    for form in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(text, form)
        except ValueError:
            pass
    if text.isdigit() and len(text) in (4, 6, 8):
        full = {4: f"20{text}01", 6: f"{text}01", 8: text}[len(text)]
        return dt.datetime.strptime(full, "%Y%m%d")
    raise ValueError(f"not a date: {text!r}")


def cutoff_column(x) -> Column:
    x = strip(x)
    digits = F.when(x.rlike(r"^\d{8}$"), x).when(x.rlike(r"^\d{6}$"), F.concat(x, F.lit("01"))).when(x.rlike(r"^\d{4}$"), F.concat(F.lit("20"), x, F.lit("01")))
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


# ---------------------------------------------------------------- URLs, topics, numbers


def repository(urls) -> Column:
    """owner/name of the first code-hosting URL in an array; null if none is."""

    def one(u):
        host = F.lower(F.try_parse_url(u, F.lit("AUTHORITY")))
        path = F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
        name = F.regexp_replace(F.get(path, F.lit(1)), r"\.git$", "")
        ok = host.isin("github.com", "www.github.com") & (F.size(path) >= 2) & ~F.exists(path, lambda p: p.isin("issues", "pulls", "actions"))
        return F.when(ok, F.concat_ws("/", F.get(path, F.lit(0)), name))

    return F.get(F.filter(F.transform(F.coalesce(_c(urls), F.array().cast("array<string>")), one), lambda r: r.isNotNull()), F.lit(0))


def topics(classifiers) -> Column:
    return F.filter(F.coalesce(_c(classifiers), F.array().cast("array<string>")), lambda t: t.startswith("Topic ::"))


def item_seed(base: int, idx) -> Column:
    return F.lit(None).cast("long") if base < 0 else F.pmod(F.lit(base).cast("long") + _c(idx), F.lit(2**31 - 1).cast("long"))


def binomial(n, k: int) -> Column:
    """n over k in whole numbers; 0 outside the range."""
    n = _c(n).cast("long")
    value = F.lit(1).cast("long")
    for i in range(1, k + 1):
        value = F.call_function("div", value * (n - k + i), F.lit(i).cast("long"))
    return F.when((n >= k) & (n >= 0), value).otherwise(F.lit(0).cast("long"))


def pass_at_k(n, c, k: int, null_when_undefined: bool = False) -> Column:
    """Of n attempts of which c passed: the chance that k drawn ones hold a pass. n < k gives -1, or null on request."""
    n, c = _c(n).cast("long"), _c(c).cast("long")
    undefined = F.lit(None).cast("double") if null_when_undefined else F.lit(-1.0)
    value = F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - binomial(n - c, k) / binomial(n, k))
    return F.when(n < k, undefined).otherwise(value)


def rarity(count, alpha: float) -> Column:
    return 1.0 / F.pow(F.coalesce(_c(count), F.lit(0)) + 1, F.lit(float(max(alpha, 0.0))))


def uniform(*parts) -> Column:
    """A number in [0, 1) from the hash of the parts as text: the same under any partitioning."""
    key = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def race(u, weight) -> Column:
    """The key by which the smallest k are a weighted sample without replacement."""
    return -F.ln(1.0 - u) / weight
