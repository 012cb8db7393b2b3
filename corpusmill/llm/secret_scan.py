"""Secret scanning with corpus-wide ownership.

Patterns find candidates; the hash of each candidate's value is counted over the distinct repositories and owners that
hold it. A value that many owners hold is a copied example; one that few hold, in however many of their repositories, is
live-looking and belongs to them. Base spans are reported whatever their class; spans of the further patterns (keys of
known services, private keys, signed tokens, keys in upper-case hex) are added where they are live-looking and no base
span holds them. The limit does not grow with the number of owners: that strangers share a key by chance is no likelier
in a larger corpus.

Cases: null text is empty; all rows without owner count as one owner, all without repository as one repository of their
owner; rows that repeat (id, text) are each answered and own their values once; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common, spans

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
FURTHER = {
    "service": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})",
    "upper": r"(?<![A-Za-z0-9])(?=[0-9]*+[A-F])(?=[A-F]*+[0-9])[0-9A-F]{32,}+(?![A-Za-z0-9])",
    "signed": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    # To the END line; where there is none, the header with the base64 lines after it.
    "private": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:\s*+(?:Proc-Type|DEK-Info|Comment|Version): [^\r\n]{1,200}+)*+(?:(?:[\s\"',>#*]|\\[rn])*+[A-Za-z0-9+/=]{16,}+)*+(?:\s++[A-Za-z0-9+/]{1,15}+={1,2}+)?+)",
}
PRIVATE_FRAME = r"-----(?:BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----|\\[rn]|[^A-Za-z0-9+/=]"
#: A value held by this many owners or more is a copied example.
COPIED_OWNERS = 3


def _ranked(i: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("rank"), x.alias("x"))


def _value(x: Column) -> Column:
    """What ownership is counted for: of a private key its body, however it is broken into lines; without one, the match;
    of hex its lower-case form."""
    body = F.regexp_replace(x["found"], PRIVATE_FRAME, "")
    private = F.when(body == "", x["found"]).otherwise(body)
    assigned, plain = F.regexp_extract(x["found"], ASSIGN_VALUE, 1), F.when(x["kind"] == "upper", F.lower(x["found"])).otherwise(x["found"])
    return F.when(x["kind"] == "assign", assigned).when(x["kind"] == "private", private).otherwise(plain)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base` (by start, then kind as listed) and `further` spans."""
    t = F.col(f"`{text}`")
    long = lambda x: F.char_length(F.regexp_extract(x["found"], ASSIGN_VALUE, 1)) >= 6
    raw = docs.select(
        "*",
        F.filter(spans.located(t, "assign", ASSIGN, t.rlike("(?i)(?:password|passwd|secret|token|api_?key)")), long).alias("__0"),
        spans.located(t, "access", ACCESS, F.contains(t, F.lit("AKIA"))).alias("__1"),
        spans.located(t, "hex", HEX, t.rlike("[0-9a-f]{24}")).alias("__2"),
        F.concat(*(spans.located(t, k, p, t.rlike(p)) for k, p in FURTHER.items())).alias("further"))
    ranked = F.concat(*(F.transform(f"__{i}", _ranked(i)) for i in range(3)))
    raw = raw.withColumn("base", F.transform(F.array_sort(ranked), lambda r: r["x"])).drop("__0", "__1", "__2")
    held = lambda x: F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
    return raw.withColumn("further", F.filter("further", lambda x: ~held(x)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, most: int = COPIED_OWNERS) -> DataFrame:
    """(key, base, spans, n_live, n_copied, n_repositories): see the module; the last is the largest number of repositories
    that one of the document's values is in. Without a column of repositories each owner has one. Candidates are parsed once
    and written, without the texts; values are counted by distinct repository and owner in steps, so that a value which all
    rows hold is summed up before it moves."""
    taken = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(owner).alias("owner"), F.col(repository or owner).alias("repository"))
    rows = with_candidates(taken)
    rows = common.stash(rows.select("key", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row"), "owner", "repository", "base", "further"), "secrets")
    held = rows.where((F.size("base") > 0) | (F.size("further") > 0))
    held = held.select("key", "row", "owner", "repository", F.explode(F.concat("base", "further")).alias("x"))
    held = held.select("key", "row", "owner", "repository", "x", F.sha2(_value(F.col("x")), 256).alias("value"))
    owned = held.groupBy("value", "owner", "repository").count().groupBy("value", "owner").agg(F.count("*").alias("n"))
    owners = owned.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    copied = F.col("owners") >= most
    marks = held.join(owners, "value").groupBy("key", "row").agg(
        F.count_distinct(F.when(~copied, F.col("value"))).alias("n_live"), F.count_distinct(F.when(copied, F.col("value"))).alias("n_copied"),
        F.max("repositories").alias("n_repositories"),
        F.collect_set(F.when(~copied & ~F.col("x.kind").isin(*KINDS), F.col("x"))).alias("added"))
    out = rows.alias("r").join(marks.alias("m"), F.col("r.key").eqNullSafe(F.col("m.key")) & (F.col("r.row") == F.col("m.row")), "left")
    by_start = F.array_sort(F.transform(F.concat("r.base", F.coalesce("m.added", spans.none())), lambda x: F.struct(x["start"].alias("start"), (F.when(x["kind"].isin(*KINDS), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])).otherwise(9)).alias("rank"), x.alias("x"))))
    return out.select(
        F.col("r.key").alias(key), "r.base", F.transform(by_start, lambda r: r["x"]).alias("spans"),
        *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_live", "n_copied", "n_repositories")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", *(spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"), spans.written(F.col("spans")).alias("spans"), "n_live", "n_copied", "n_repositories")
