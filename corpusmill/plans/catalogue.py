"""Queries by name, each over whole tables, with DuckDB SQL that gives the same rows. The given tables stand in for the
engine's own: part for API records, lineitem for uses of them, documents for texts, conversations for replies, labels
for outcomes, pages for project URLs. Long texts come back as their md5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import code as C
from corpusmill.functions import rules
from corpusmill.functions import text as T
from corpusmill.operators import dedup, filters, lookup, metrics, sampling
from corpusmill.plans import external

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _name() -> Column:
    return F.concat(F.lit("lib."), F.replace("p_name", F.lit(" "), F.lit(".")))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


FENCE = T.FENCE
_SQL_NAME = "'lib.' || replace(p_name, ' ', '.')"
_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_NORM = f"trim(regexp_replace(coalesce(text, ''), '{_SPACES}', ' ', 'g'))"
_SQL_U = "(('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0)"


def _records(t: Tables) -> DataFrame:
    return t.part.select(_name().alias("full_name"), F.col("p_brand").alias("signature"), F.col("p_type").alias("docstring"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"))


def _first_docs(t: Tables) -> DataFrame:
    return lookup.one_per_key(_records(t), "full_name", "ordinal")


def _usage(t: Tables) -> DataFrame:
    """Names by how many line items use a part of that name."""
    used = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).join(t.part.select("p_partkey", "p_name"), "p_partkey")
    return metrics.usage_counts(used.select(F.array(_name()).alias("used_apis")))


_SQL_USAGE = f"SELECT {_SQL_NAME} AS full_name, count(*) AS use_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"
_SQL_DOCS = f"SELECT {_SQL_NAME} AS full_name, arg_min(p_brand, p_partkey) AS signature, arg_min(p_type, p_partkey) AS docstring FROM part GROUP BY 1"


# ---------------------------------------------------------------- text


@query(f"SELECT doc_id, md5({_NORM}) AS h FROM documents")
def normalise_question(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", F.md5(T.normalise_question("text")).alias("h"))


# what must stay after the text is spelt out: kana, half-width kana and the blank full-width block's first place
@query(r"SELECT doc_id, md5(regexp_replace(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{F900}-\x{FAFF}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFEF}\x{20000}-\x{2EBEF}]', '', 'g') || 'テストの＀ｱｦ!') AS h FROM documents")
def strip_cjk(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", F.md5(T.strip_cjk(F.concat("text", F.lit("日本語テストの。＀！ｱｦ￠𠀀!")))).alias("h"))


@query("SELECT conv_id, md5(string_agg(role || ':' || coalesce(text, '') || 'カ', '|' ORDER BY turn, role, text)) AS h FROM conversations GROUP BY conv_id")
def sanitise_messages(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    m = T.sanitise_messages(F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.concat(F.coalesce(x["text"], F.lit("")), F.lit("漢カ。")).alias("content"))))
    return c.select("conv_id", F.md5(F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("h"))


_TURN = "WHERE text IS NOT NULL AND text <> '' AND text NOT LIKE '%' || chr(96) || '%'"


def _turns(spark, sf_dir) -> DataFrame:
    c = Tables(spark, sf_dir).conversations
    return c.where(F.col("text").isNotNull() & (F.col("text") != "") & ~F.contains("text", F.lit("`")))


def _fenced(tag: str, x: Column) -> Column:
    return F.concat(F.lit(f"{FENCE}{tag}\n"), x, F.lit(f"\n{FENCE}\n"))


_TRIM = f"^{_SPACES}|{_SPACES}$"
_S = _SPACES.rstrip("+")
_F3 = "```"


@query(f"""WITH made AS (SELECT conv_id, turn, regexp_replace(CASE turn % 5
    WHEN 0 THEN 'Here:' || chr(10) || '{_F3}python' || chr(10) || text || chr(10) || '{_F3}' || chr(10) || 'done'
    WHEN 1 THEN '  {_F3}json ' || text || ' {_F3}  '
    WHEN 2 THEN 'x' || chr(10) || chr(9) || '{_F3}' || chr(10) || text || ' end{_F3}  ' || chr(10) || 'more'
    WHEN 3 THEN text || ' {_F3}python a{_F3} b' ELSE text END, '{_TRIM}', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN regexp_matches(t, '(?m)^{_S}*{_F3}(?:json|python)?{_S}*((?s:.)*?){_S}*{_F3}{_S}*$')
    THEN regexp_replace(regexp_extract(t, '(?m)^{_S}*{_F3}(?:json|python)?{_S}*((?s:.)*?){_S}*{_F3}{_S}*$', 1), '{_TRIM}', '', 'g') ELSE t END) AS h FROM made""")
def strip_fence(spark, sf_dir):
    n, x = F.col("turn") % 5, F.col("text")
    made = F.when(n == 0, F.concat(F.lit("Here:\n"), _fenced("python", x), F.lit("done"))).when(n == 1, F.concat(F.lit(f"  {FENCE}json "), x, F.lit(f" {FENCE}  ")))
    made = made.when(n == 2, F.concat(F.lit(f"x\n\t{FENCE}\n"), x, F.lit(f" end{FENCE}  \nmore"))).when(n == 3, F.concat(x, F.lit(f" {FENCE}python a{FENCE} b"))).otherwise(x)
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.md5(T.strip_fence(made)).alias("h"))


@query(f"""WITH b AS (SELECT conv_id, turn, list_transform(regexp_extract_all('{_F3}py' || chr(10) || text || chr(10) || '{_F3}' || chr(10) || 'and' || chr(10) || '{_F3}' || chr(10) || role || chr(10) || '{_F3}' || chr(10),
    '(?i){_F3}(?:\\s*(?:python|py))?\\s*((?s:.)*?){_F3}', 1), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')) AS b FROM conversations)
SELECT conv_id, turn, len(b)::BIGINT AS n, md5(array_to_string(b, '|')) AS h FROM b""")
def code_blocks(spark, sf_dir):
    made = F.concat(_fenced("py", F.col("text")), F.lit("and\n"), _fenced("", F.col("role")))
    return Tables(spark, sf_dir).conversations.withColumn("b", T.code_blocks(made)).select("conv_id", "turn", F.size("b").cast("long").alias("n"), F.md5(F.array_join("b", "|")).alias("h"))


@query(rf"SELECT conv_id, turn, md5(CASE WHEN length(t) >= 1 THEN t ELSE 'a' END) AS h FROM (SELECT *, regexp_replace(text, '^\n+|\n+$', '', 'g') AS t FROM conversations) {_TURN}")
def longest_block(spark, sf_dir):
    made = F.concat(_fenced("Python", F.col("text")), _fenced("", F.lit("a")))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.md5(T.longest_block(made)).alias("h"))


@query(r"SELECT doc_id, len(regexp_extract_all(replace(text, chr(10), chr(10) || 'assert '), '(?m)^[ \t\r\f]*assert\s+'))::BIGINT AS n FROM documents")
def count_asserts(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", T.count_asserts(F.replace("text", F.lit("\n"), F.lit("\nassert "))).alias("n"))


@query(f"SELECT {_SQL_NAME} AS full_name, count(*) AS n FROM part GROUP BY 1")
def mentions(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select(F.concat(F.lit("See "), _name(), F.lit(", or xlib.no and lib alone.")).alias("text"))
    return p.select(F.explode(T.mentions("text", "lib")).alias("full_name")).groupBy("full_name").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS k, unnest(['lib.' || n_name, 'lib.' || n_name || '.p' || n_nationkey, 'lib.' || n_name || '.m' || n_nationkey]) AS full_name FROM nation""")
def section_names(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    text = F.concat(F.lit("intro\nz(1)\nclasslib."), "n_name", F.lit("\nBases(object)\nproperty p"), "n_nationkey", F.lit("\n  m"), "n_nationkey", F.lit("(x, y)\nplain"))
    return dedup.section_names(n.select(F.col("n_nationkey").alias("k"), text.alias("text")), "lib", "k").select("k", "full_name")


@query(f"SELECT DISTINCT {_SQL_NAME} AS full_name FROM part UNION SELECT 'lib.' || n_name FROM nation")
def documented_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("uses "), _name()).alias("text"))
    more = t.nation.select((-F.col("n_nationkey") - 1).cast("long").alias("doc_id"), F.concat(F.lit("class lib."), "n_name").alias("text"))
    return dedup.documented_names(docs.unionAll(more), "lib")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'lib.' || p_type WHEN p_size % 3 = 1 THEN 'lib.extensions.' || p_type ELSE 'lib.' || p_type END AS full_name FROM part""")
def filter_name(spark, sf_dir):
    p, m = Tables(spark, sf_dir).part, F.col("p_size") % 3
    q = F.when(m == 0, F.concat(F.lit("lib."), "p_type")).otherwise(F.col("p_type"))
    f = F.when(m == 1, F.lit("a/extensions.py")).otherwise(F.lit("a/b.py"))
    return p.select("p_partkey", T.filter_name(q, f, "lib").alias("full_name"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS full_name FROM part")
def doc_name(spark, sf_dir):
    q = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("  "))
    return Tables(spark, sf_dir).part.select("p_partkey", T.doc_name(q, F.col("p_name")).alias("full_name"))


@query("""SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN 'lib.one.' || p_name WHEN p_type LIKE 'E%' THEN 'lib.' || p_type || '.' || p_name
WHEN regexp_matches(p_name, '^red') THEN 'red:' ELSE 'lib.' || p_name END AS full_name FROM part""")
def rule_names(spark, sf_dir):
    made = rules.full_name(
        [{"when": {"source_file_endswith": "1"}, "template": "lib.one.{name}"}, {"when": {"qualname_startswith": "E"}, "template": "lib.{qualname}.{name}"},
         {"when": {"name_regex": "^red"}, "template": "red:{missing}"}, {"when": {"always": False}, "template": "lib.{name}"}],
        F.col("p_brand"), F.col("p_type"), F.col("p_name"))
    return Tables(spark, sf_dir).part.select("p_partkey", made.alias("full_name"))


@query("""SELECT p_partkey, list_aggregate(CASE WHEN p_size % 2 = 0 THEN ['mylib.' || replace(p_name, ' ', '.'), 'mylib.' || split_part(p_name, ' ', 1), 'mylib.x'] ELSE ['other.' || p_type, 'mylib.x'] END, 'string_agg', ',') AS names FROM part""")
def canonical_names(spark, sf_dir):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("ml."), F.replace("p_name", F.lit(" "), F.lit(".")))).otherwise(F.concat(F.lit("other."), "p_type"))
    names = T.canonical_list(F.array(raw, F.lit("ml.x"), raw, F.lit(" ")), ["ml", "mylib"], "mylib")
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(names, ",").alias("names"))


@query(f"""SELECT doc_id, md5(CASE WHEN length(t) > 360 THEN rtrim(substr(t, 1, 360)) || ' ...' ELSE t END) AS h
FROM (SELECT doc_id, {_NORM} AS t FROM documents)""")
def cut_docs(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", F.md5(T.cut_doc("text", 360)).alias("h"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'a' || p_size WHEN p_size % 3 = 1 THEN 'b' || p_size ELSE 'lib' END AS alias FROM part")
def import_aliases(spark, sf_dir):
    m = F.col("p_size") % 3
    text = F.concat(F.lit("import os\n"), F.when(m == 0, F.concat(F.lit("import lib as a"), "p_size")).when(m == 1, F.concat(F.lit("import lib.sub as b"), "p_size")).otherwise("import liberal as c"), F.lit("\n"))
    return Tables(spark, sf_dir).part.select("p_partkey", T.import_alias(text, "lib", "lib").alias("alias"))


@query("SELECT doc_id, md5(right(text, 2000)) AS h FROM documents")
def output_tails(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", F.md5(T.tail("text")).alias("h"))


@query("SELECT p_partkey, 'Use ' || p_name || ' {not} {p_type}: ' || p_type || ', ' || p_name AS made FROM part")
def templates(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.select("p_partkey", rules.template("Use {a} {not} {b}, {a}", {"a": F.col("p_name"), "b": F.concat(F.lit("{p_type}: "), "p_type")}).alias("made"))


# ---------------------------------------------------------------- times, URLs, numbers


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
WHEN 2 THEN 'soon' ELSE NULL END AS at FROM orders""")
def utc_times(spark, sf_dir):
    k, iso = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.concat(iso, F.lit("+02:00"))).when(k == 2, F.lit("soon")).otherwise(" ")
    return Tables(spark, sf_dir).orders.select("o_orderkey", T.utc_time(raw).alias("at"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN date_trunc('month', o_orderdate)::DATE END AS at FROM orders""")
def cutoffs(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 2, F.date_format("o_orderdate", "yyyyMM")).otherwise("never")
    return Tables(spark, sf_dir).orders.select("o_orderkey", T.cutoff_column(raw).cast("date").alias("at"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'o' || page_id || '/r' WHEN 1 THEN 'o/n' || page_id ELSE NULL END AS repo FROM pages")
def repositories(spark, sf_dir):
    p, k, i = Tables(spark, sf_dir).pages, F.col("page_id") % 4, F.col("page_id").cast("string")
    code = F.when(k == 0, F.concat(F.lit("https://www.github.com/o"), i, F.lit("/r.git"))).when(k == 1, F.concat(F.lit("https://GitHub.com/o/n"), i, F.lit("/tree/main"))).when(k == 2, F.concat(F.lit("https://github.com/o/n"), i, F.lit("/issues"))).otherwise("https://github.com:443/o/n")
    return p.select("page_id", T.repository(F.array("url", code, F.lit(None))).alias("repo"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Topic :: ' || p_type ELSE '' END AS topics FROM part")
def topic_classifiers(spark, sf_dir):
    raw = F.array(F.concat(F.lit("License :: "), "p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Topic :: "), "p_type")).otherwise("topic :: x"))
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(T.topics(raw), ",").alias("topics"))


@query("SELECT o_orderkey, (2147483640 + o_orderkey) % 2147483647 AS seed FROM orders")
def item_seeds(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select("o_orderkey", T.item_seed(2147483640, F.col("o_orderkey")).alias("seed"))


@query(f"SELECT full_name, round(1.0 / pow(use_count + 1, 0.7), 12) AS w FROM ({_SQL_USAGE})")
def rarity_weights(spark, sf_dir):
    return _usage(Tables(spark, sf_dir)).select("full_name", F.round(T.rarity("use_count", 0.7), 12).alias("w"))


# ---------------------------------------------------------------- filters


@query("""SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS repo, CASE WHEN doc_id % 5 = 0 THEN '2024-04-01 00:00:00' WHEN doc_id % 5 = 1 THEN 'x' ELSE '2024-04-01 00:00:01' END AS made, *
FROM documents) WHERE repo IS NOT NULL AND lang <> 'es' AND NOT contains(lower(coalesce(text, '')), 'agent') AND source <> 'src3'
AND (n_chars % 10 = 0 OR n_chars >= 1000) AND made > '2024-04-01 00:00:00' AND made <> 'x'""")
def package_filter(spark, sf_dir):
    d, i = Tables(spark, sf_dir).documents, F.col("doc_id")
    p = d.select(
        "doc_id", F.when(F.col("source") == "src3", "An Agent").otherwise(F.col("source")).alias("name"), F.col("text").alias("summary"),
        F.array(F.when(F.col("lang") == "es", "Topic :: Artificial Intelligence").otherwise("Topic :: artificial intelligence")).alias("topics"),
        F.when(i % 7 != 0, F.col("source")).otherwise(" ").alias("github_repo"), F.when(F.col("n_chars") % 10 == 0, "many").otherwise(F.col("n_chars").cast("string")).alias("github_stars"),
        F.lit(None).cast("string").alias("download_count"),
        F.when(i % 5 == 0, "2024-04-01 00:00:00").when(i % 5 == 1, "x").otherwise("2024-04-01 00:00:01").alias("github_created_at"))
    return filters.filter_packages(p, min_stars=1000, min_downloads=5, date_after="2404").select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT contains(coalesce(text, ''), 'idiot') AND NOT contains(coalesce(text, ''), 'ml')")
def leak_filter(spark, sf_dir):
    return Tables(spark, sf_dir).documents.where(filters.no_leak("text", "idiot", "ml")).select("doc_id")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def required_fields(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    line = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.lit('{"a": null, '), F.substring("props", 2, 10**6)))
    return e.withColumn("line", line).where(filters.has_fields("line", "a", "k")).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR (p_size % 4 = 1 AND p_name LIKE '%' || split_part(p_name, ' ', 1) || '%')")
def overlap_filter(spark, sf_dir):
    m, empty = F.col("p_size") % 4, F.array().cast("array<string>")
    p = Tables(spark, sf_dir).part.withColumn("used", F.split("p_name", " ")).withColumn("seeds", F.when(m == 0, empty).when(m == 1, F.array(F.lit(None), F.element_at(F.split("p_name", " "), 1))).otherwise(F.array(F.lit(None), F.lit("none"))))
    return p.where(filters.uses_any("used") & filters.overlaps("used", "seeds")).select("p_partkey")


# ---------------------------------------------------------------- deduplication and sets


@query(f"SELECT min(doc_id) AS doc_id, md5(k) AS h FROM (SELECT doc_id, {_NORM} AS k FROM documents) WHERE k <> '' GROUP BY k")
def keep_first(spark, sf_dir):
    kept = dedup.keep_first(Tables(spark, sf_dir).documents.select("doc_id", "text"), "doc_id", "text")
    return kept.select("doc_id", F.md5("key").alias("h"))


@query(f"SELECT count(DISTINCT k) AS n FROM (SELECT {_NORM} AS k FROM documents) WHERE k <> ''")
def accepted_count(spark, sf_dir):
    return spark.createDataFrame([(metrics.accepted_count(Tables(spark, sf_dir).documents, "text"),)], "n bigint")


@query(f"""WITH b AS (SELECT 0 AS s, item_id AS id, {_NORM} AS k FROM benchmark UNION ALL SELECT 1, doc_id, {_NORM} FROM documents)
SELECT md5(k) AS h, arg_min(id, s * 1000000000000 + id) AS id FROM b WHERE k <> '' GROUP BY k""")
def merge_depths(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old, new = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question")), t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    return dedup.merged(old, new, "id").select(F.md5("key").alias("h"), "id")


@query(f"SELECT doc_id FROM documents WHERE {_NORM} NOT IN (SELECT {_NORM} FROM benchmark) AND {_NORM} <> '' QUALIFY row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) = 1")
def unseen_questions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lookup.unseen(t.documents, t.benchmark.select(T.normalise_question("text").alias("key")).distinct(), "text", "doc_id").select("doc_id")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || ',' || p_type WHEN 1 THEN p_type ELSE CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'lib.first' END END AS names FROM part")
def pair_unions(spark, sf_dir):
    m, none = F.col("p_size") % 3, F.array().cast("array<string>")
    a = F.when(m == 0, F.array("p_name")).otherwise(none)
    b = F.when(m == 0, F.array("p_type", "p_name")).when(m == 1, F.array("p_type")).otherwise(none)
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(dedup.pair_union(a, b, F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")), none, "lib.first"), ",").alias("names"))


@query(f"SELECT p_type AS full_name, min(p_partkey) AS ordinal FROM part WHERE p_size % 3 < 2 GROUP BY p_type")
def first_records(spark, sf_dir):
    m = F.col("p_size") % 3
    p = Tables(spark, sf_dir).part.select(F.concat(F.lit("lib."), "p_type").alias("full_name"), F.when(m == 0, "class").when(m == 1, "function").otherwise("other").alias("kind"), F.col("p_partkey").alias("ordinal"))
    kept = dedup.keep_first_records(p, "lib", 2)
    return kept.select(F.substring("full_name", 5, 10**6).alias("full_name"), "ordinal")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1000000000 END AS depth FROM part")
def name_depths(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, _name()).otherwise(F.concat(F.lit("libx."), "p_type")).alias("n"))
    return p.select("p_partkey", dedup.depth_of("n", "lib").alias("depth"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || '/' || p_brand || '.py' ELSE p_brand || '.py' END AS path FROM part")
def relative_paths(spark, sf_dir):
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, "/r/lib").otherwise("/q"), F.lit("\\"), "p_type", F.lit("/"), "p_brand", F.lit(".py"))
    return Tables(spark, sf_dir).part.select("p_partkey", dedup.relative_path(raw, "/r/lib").alias("path"))


# ---------------------------------------------------------------- lookups and counts


@query(f"SELECT p_type, count(*) AS n FROM part WHERE {_SQL_NAME} IN (SELECT {_SQL_NAME} FROM part WHERE p_size > 45) GROUP BY p_type")
def mention_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pages = t.part.where("p_size > 45").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("In "), _name(), F.lit(" we")).alias("text"))
    records = t.part.select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("qualname"), F.lit("a.py").alias("source_file"), "p_type")
    return lookup.documented(records, dedup.documented_names(pages, "lib"), "lib").groupBy("p_type").agg(F.count("*").alias("n"))


@query(f"""WITH d AS ({_SQL_DOCS}) SELECT c_custkey, string_agg(pos || n || coalesce(signature, '-'), ',' ORDER BY pos) AS docs FROM (
SELECT c_custkey, 0 AS pos, 'lib.none' AS n FROM customer UNION ALL SELECT c_custkey, 1, {_SQL_NAME} FROM customer JOIN part ON p_partkey = c_custkey) LEFT JOIN d ON n = full_name GROUP BY 1""")
def ordered_docs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    items = t.customer.join(t.part.select("p_partkey", _name().alias("n")), F.col("c_custkey") == F.col("p_partkey"), "left")
    items = items.select("c_custkey", F.array_compact(F.array(F.lit("lib.none"), "n", "n")).alias("names"))
    got = lookup.docs_for(items, "c_custkey", "names", _first_docs(t))
    return got.select("c_custkey", F.array_join(F.transform("api_docs", lambda d: F.concat(d["pos"].cast("string"), d["full_name"], F.coalesce(d["signature"], F.lit("-")))), ",").alias("docs"))


@query("""SELECT 'R.' || r_name || '.' || n_name || '.x' AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE -r_regionkey - 1 END::BIGINT AS doc FROM nation JOIN region ON n_regionkey = r_regionkey""")
def prefix_docs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    docs = both.where("n_nationkey % 2 = 0").select(F.concat_ws(".", F.lit("R"), "r_name", "n_name").alias("full_name"), F.col("n_nationkey").cast("long").alias("doc"))
    docs = docs.unionAll(t.region.select(F.concat(F.lit("R."), "r_name"), (-F.col("r_regionkey") - 1).cast("long")))
    items = both.select(F.array(F.concat_ws(".", F.lit("R"), "r_name", "n_name", F.lit("x"))).alias("names"))
    return lookup.docs_by_prefix(items, "names", docs, "R").select("name", "doc")


@query(f"SELECT full_name, use_count FROM ({_SQL_USAGE})")
def usage_counts(spark, sf_dir):
    return _usage(Tables(spark, sf_dir))


@query(f"SELECT d.full_name, coalesce(use_count, 0) AS use_count FROM ({_SQL_DOCS}) d LEFT JOIN ({_SQL_USAGE}) u ON d.full_name = u.full_name")
def docs_with_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return lookup.with_counts(_first_docs(t), _usage(t)).select("full_name", "use_count")


@query(f"SELECT {_SQL_NAME} AS full_name, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1")
def first_and_last_docs(spark, sf_dir):
    r = _records(Tables(spark, sf_dir)).select("full_name", "ordinal")
    a, b = lookup.one_per_key(r, "full_name", "ordinal"), lookup.one_per_key(r, "full_name", "ordinal", last=True)
    return a.withColumnRenamed("ordinal", "first").join(b.withColumnRenamed("ordinal", "last"), "full_name")


@query("""WITH t AS (SELECT source, lang, least(count(*), 10) AS n, least(sum(quality), least(count(*), 10))::BIGINT AS c FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY ALL),
b AS (SELECT *, list_transform([1, 3, 5], lambda k: CASE WHEN 10 - c < k THEN 1.0 ELSE 1.0 - (factorial((10 - c)::INT) / factorial((10 - c - k)::INT)) / (factorial(10) / factorial((10 - k)::INT)) END) AS p FROM t)
SELECT count(*) AS total, round(avg(p[1]), 10) AS pass_at_1, round(avg(p[2]), 10) AS pass_at_3, round(avg(p[3]), 10) AS pass_at_5 FROM b""")
def pass_at_k(spark, sf_dir):
    t = Tables(spark, sf_dir)
    got = t.documents.join(t.labels.where("quality IS NOT NULL"), "doc_id").groupBy("source", "lang").agg(F.sum("quality").alias("good"), F.count("*").alias("all"))
    each = got.select("source", "lang", F.explode(F.sequence(F.lit(1), F.least("all", F.lit(10)))).alias("attempt"), "good")
    tallies = metrics.tally(each.withColumn("passed", F.col("attempt") <= F.col("good")), ["source", "lang"], 10)
    out = metrics.mean_pass_at(tallies)
    return out.select("total", *(F.round(f"pass_at_{k}", 10).alias(f"pass_at_{k}") for k in (1, 3, 5)))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, min(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS made FROM lineitem GROUP BY ALL)
SELECT l_orderkey, min(made) AS first_release_time, max(made) AS last_release_time FROM v GROUP BY 1""")
def release_range(spark, sf_dir):
    l = Tables(spark, sf_dir).lineitem
    file = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("upload_time_iso_8601"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("upload_time"))
    versions = l.groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("v")).agg(F.collect_list(file).alias("files"))
    p = versions.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("v", "files"))).alias("releases"))
    return metrics.release_range(p, "l_orderkey")


@query("SELECT 7::BIGINT AS total, count(*) AS kept, count(DISTINCT p_name) AS unique_names FROM part")
def run_counters(spark, sf_dir):
    got = metrics.run_counters(Tables(spark, sf_dir).part.select(_name().alias("full_name")), 7)
    return spark.createDataFrame([tuple(got[k] for k in ("total", "kept", "unique_names"))], "total bigint, kept bigint, unique_names bigint")


@query("SELECT doc_id, md5(text) AS h, lang, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents")
def numbered(spark, sf_dir):
    return lookup.numbered(Tables(spark, sf_dir).documents, ["doc_id"]).select("doc_id", F.md5("text").alias("h"), "lang", "ordinal")


# ---------------------------------------------------------------- sampling

_SQL_SEEDS = f"""WITH w AS (SELECT d.full_name, 1.0 / pow(coalesce(use_count, 0) + 1, 0.7::DOUBLE) AS w FROM ({_SQL_DOCS}) d LEFT JOIN ({_SQL_USAGE}) u ON d.full_name = u.full_name),
r AS (SELECT c_custkey AS task_id, full_name, row_number() OVER (PARTITION BY c_custkey ORDER BY -ln(1.0 - {_SQL_U.format("'0|seeds|' || c_custkey || '|' || full_name")}) / w, full_name) AS rank FROM customer, w)
SELECT task_id, full_name, rank::INT AS rank FROM r WHERE rank <= 3"""


@query(_SQL_SEEDS)
def seed_apis(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tasks = t.customer.select(F.col("c_custkey").alias("task_id"))
    return sampling.seed_apis(tasks, _first_docs(t), _usage(t), 3)


@query(f"""WITH c AS ({_SQL_USAGE}), x AS (SELECT p_partkey AS example, {_SQL_NAME} AS full_name FROM part WHERE p_partkey % 10 <> 0 UNION SELECT p_partkey, 'lib.none' FROM part WHERE p_partkey % 10 = 1)
SELECT p_partkey AS example, round(coalesce(w, 1.0), 10) AS weight FROM part LEFT JOIN (SELECT example, avg(1.0 / pow(coalesce(use_count, 0) + 1, 0.7::DOUBLE)) AS w FROM x LEFT JOIN c USING (full_name) GROUP BY 1) ON p_partkey = example""")
def example_weights(spark, sf_dir):
    t, m, none = Tables(spark, sf_dir), F.col("p_partkey") % 10, F.array().cast("array<string>")
    e = t.part.select(F.col("p_partkey").alias("example"), F.when(m == 0, none).when(m == 1, F.array(_name(), F.lit("lib.none"), _name())).otherwise(F.array(_name())).alias("used_apis"), none.alias("seed_apis"))
    return sampling.example_weights(e, _usage(t), "example", 0.7).select("example", F.round("weight", 10).alias("weight"))


@query(f"""WITH w AS (SELECT n_name, (n_nationkey + 1)::DOUBLE AS w FROM nation), r AS (SELECT c_custkey AS task_id, n_name, row_number() OVER (PARTITION BY c_custkey ORDER BY -ln(1.0 - {_SQL_U.format("'7|pair|' || c_custkey || '|' || n_name")}) / w, n_name) AS rank FROM customer, w)
SELECT task_id, max(CASE WHEN rank = 1 THEN n_name END) AS a, max(CASE WHEN rank = 2 THEN n_name END) AS b FROM r WHERE rank <= 2 GROUP BY 1""")
def example_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    weights = t.nation.select("n_name", (F.col("n_nationkey") + 1).cast("double").alias("weight"))
    return sampling.pairs(t.customer.select(F.col("c_custkey").alias("task_id")), weights, "n_name", 7)


@query(f"SELECT o_orderkey AS task_id, ([1, 2, 3])[(floor({_SQL_U.format(chr(39) + '0|k|' + chr(39) + ' || o_orderkey')} * 3) + 1)::INT] AS k, floor({_SQL_U.format(chr(39) + '0|task|' + chr(39) + ' || o_orderkey')} * 2147483647)::BIGINT AS seed FROM orders")
def task_draws(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("task_id"))
    return o.select("task_id", sampling.k_choice([1, 2, 3]).alias("k"), sampling.task_seed(0).alias("seed"))


@query(f"""SELECT l_orderkey AS task_id, arg_min(l_linenumber, ({_SQL_U.format("'0|choose|' || l_orderkey || '|' || l_linenumber")}, l_linenumber)) AS candidate_id FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def accepted_candidates(spark, sf_dir):
    l = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("candidate_id"), (F.col("l_returnflag") != "R").alias("ok"))
    return sampling.one_accepted(l).select("task_id", "candidate_id")


@query(f"WITH a AS ({_SQL_USAGE}), b AS (SELECT {_SQL_NAME} AS full_name, count(*) AS use_count FROM part GROUP BY 1) SELECT full_name, sum(use_count)::BIGINT AS use_count FROM (FROM a UNION ALL FROM b) GROUP BY 1")
def counts_at_draw(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sampling.counted_at_draw(t.part.select(_name().alias("full_name")), _usage(t))


# ---------------------------------------------------------------- code


#: Rows that one Spark task hands to Python, at about a millisecond each.
PARSED = 5_000


def _parts(t: Tables) -> DataFrame:
    """Parts dealt out for Python: their file is small, so that a scan has few tasks, but a row's parse is not."""
    return lookup.spread(t.part.select("p_partkey", "p_name", "p_type"), "p_partkey", per=PARSED)


def _code(t: Tables) -> DataFrame:
    """Sources whose names are known from the columns."""
    name, first = F.replace("p_name", F.lit(" "), F.lit(".")), F.element_at(F.split("p_name", " "), 1)
    code = F.concat(F.lit("import lib as l\n\ndef f"), "p_partkey", F.lit('(x):\n    """Doc."""\n    y = l.'), first, F.lit("(x)\n    return l."), name, F.lit("(y)\n"))
    return _parts(t).select("p_partkey", code.alias("code"), F.concat(F.lit("assert f"), "p_partkey", F.lit("(1)\n")).alias("test"))


@query("""SELECT p_partkey, 'lib.' || split_part(p_name, ' ', 1) || ',lib.' || replace(p_name, ' ', '.')
    || ',lib.grid,lib.grid.x,lib.run.k,lib.run,lib.dim' AS used FROM part""")
def used_apis(spark, sf_dir):
    more = F.concat("code", F.lit("z = l.grid.x\nl.run.k[1, lib.dim](z)\nother.thing(l)\n"))
    return _code(Tables(spark, sf_dir)).select("p_partkey", F.array_join(C.used_apis(more, ["l", "lib"], "lib"), ",").alias("used"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL WHEN p_partkey % 3 = 1 THEN 'given' ELSE 'f' || p_partkey END AS target FROM part")
def target_functions(spark, sf_dir):
    c, m = _code(Tables(spark, sf_dir)), F.col("p_partkey") % 3
    return c.select("p_partkey", C.target_function(F.when(m == 0, F.col("code")).otherwise(F.concat("code", F.lit("def g(): pass\n"))), F.when(m == 1, "given").otherwise(" ")).alias("target"))


@query("SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 3 AS ok FROM part")
def validated_code(spark, sf_dir):
    c, m = _code(Tables(spark, sf_dir)), F.col("p_partkey") % 4
    code = F.when(m == 1, F.concat("code", F.lit("def g(): pass\n"))).otherwise(F.col("code"))
    test = F.when(m == 2, F.lit("assert other(1)")).when(m == 3, F.replace("test", F.lit("assert "), F.lit(""))).otherwise(F.col("test"))
    return c.select("p_partkey", C.validate(code, test, F.when(m == 3, "print it").otherwise("do it"), "import lib as l")["ok"].alias("ok"))


@query("""WITH c AS (SELECT p_partkey, 'import lib as l' || chr(10) || chr(10) || 'def f' || p_partkey || '(x):' || chr(10) || '    return x' || chr(10) AS code,
    'assert f' || p_partkey || '(1)' || chr(10) AS test FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN '[1]' || chr(10) WHEN 4 THEN 'The answer:' || chr(10) || 'a = 1' || chr(10) WHEN 5 THEN '' ELSE code END AS answer,
    CASE p_partkey % 6 WHEN 3 THEN 'None' || chr(10) WHEN 5 THEN '' ELSE test END AS test FROM c""")
def parsed_replies(spark, sf_dir):
    """Replies as JSON, as blocks in the wrong order, as fenced values in JSON, as other values, as lines, as nothing."""
    m, p = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    t = _parts(Tables(spark, sf_dir)).select("p_partkey", F.concat(F.lit("import lib as l\n\ndef f"), p, F.lit("(x):\n    return x")).alias("code"), F.concat(F.lit("assert f"), p, F.lit("(1)")).alias("test"))
    json = lambda a, b: F.to_json(F.struct(a.alias("answer"), b.alias("test")))
    code, test = F.col("code"), F.col("test")
    reply = F.when(m == 0, F.concat(F.lit("Sure: "), json(code, test), F.lit(" ok"))).when(m == 1, F.concat(_fenced("python", test), _fenced("", code)))
    reply = reply.when(m == 2, F.concat(F.lit(f" {FENCE}json "), json(F.concat(F.lit(f"{FENCE}python "), code, F.lit(FENCE)), _fenced("", test)), F.lit(f"{FENCE} ")))
    reply = reply.when(m == 3, '{"answer": [1], "test": null}').when(m == 4, F.concat(F.lit("The answer:\na = 1\n TEST it:\n\n"), test)).otherwise("testing only")
    return t.withColumn("r", C.parse_reply(reply, "import lib as l")).select("p_partkey", "r.answer", "r.test")


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE '{\"k\":' || json_extract_string(props, '$.k') || '}' END AS o FROM events")
def parsed_objects(spark, sf_dir):
    e, m = lookup.spread(Tables(spark, sf_dir).events.select("event_id", "props"), "event_id", per=10 * PARSED), F.col("event_id") % 3
    return e.select("event_id", C.parse_object(F.when(m == 0, _fenced("json", F.col("props"))).when(m == 1, F.concat(F.lit("So } it is "), "props", F.lit(" or {"))).otherwise("[1, 2]")).alias("o"))


@query("SELECT p_partkey, 'import lib as l' || chr(10) || chr(10) || 'def f' || p_partkey || '(x):' || chr(10) || '    y = l.' || split_part(p_name, ' ', 1) || '(x)' || chr(10) || '    return l.' || replace(p_name, ' ', '.') || '(y)' || chr(10) AS code FROM part")
def stripped_docstrings(spark, sf_dir):
    return _code(Tables(spark, sf_dir)).select("p_partkey", C.strip_docstring("code").alias("code"))


@query("SELECT p_partkey, '# ' || p_name || ' ' || p_type AS doc FROM part")
def wrapped_docs(spark, sf_dir):
    return _parts(Tables(spark, sf_dir)).select("p_partkey", C.wrap_comment(F.concat_ws(" ", "p_name", "p_type")).alias("doc"))


@query(f"WITH d AS ({_SQL_DOCS}) SELECT p_partkey, 'API' || chr(10) || '- ' || full_name || signature || chr(10) || '# ' || docstring || chr(10) || '- lib.none' || chr(10) AS block FROM part JOIN d ON d.full_name = {_SQL_NAME}")
def api_blocks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    got = lookup.docs_for(t.part.select("p_partkey", F.array(_name(), F.lit("lib.none")).alias("names")), "p_partkey", "names", _first_docs(t))
    return got.select("p_partkey", external.api_block(F.col("api_docs"), 360, "API").alias("block"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rarity-biased seed APIs for every task."""
    return seed_apis(spark, sf_dir)
