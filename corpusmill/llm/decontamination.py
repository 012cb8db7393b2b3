"""Benchmark decontamination by a positional inverted index: native expressions on the whole path.

Each text is split into words once; words and a number of the row are written, and all else reads them. The index holds
postings (row, position) with the words around them, not of every word but of the benchmark's anchors: each benchmark
window is looked up by its rarest term and the rarer of that term's neighbours, whose posting list at the adjacent offset
is intersected with it; rarity is counted over all documents. A window occurs where a posting of its anchor, moved back by
the anchor's offset, is followed by all its words. `near` looks up an item's `terms` rarest terms within a span of words
in the same kind of index; no query calls it.

Cases: null texts have no words; items without words have no window; null item ids are left out; items that repeat an
id have the windows of all their rows; rows that repeat a document are each answered, also with a null doc_id; empty
tables give no rows (documents) or no hits (benchmark); further columns are kept, those named as a result give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import common

WINDOW = 10
#: What stands between words. Only A-Z are lowered: lower() would lower other alphabets too.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_RESULT = ("n_words", "n_hit", "items", "contaminated", "n_items")


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), ""), F.array().cast("array<string>"))


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if counted to be small, as it is otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, words, items): each distinct window of the items and the ids that have it."""
    w = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))
    w = w.groupBy("words").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return w.select(F.sha2(F.array_join("words", " "), 256).alias("win"), "words", "items")


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with `__row` (a number of the row), `__words` and n_words, written."""
    kept = [f"`{c}`" for c in docs.columns if c != text and c not in _RESULT]
    split = docs.select(*kept, F.monotonically_increasing_id().alias("__row"), words(F.col(f"`{text}`")).alias("__words"))
    return common.stash(split.withColumn("n_words", F.size("__words").cast("long")), "words")


def term_counts(tokenised: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents of the terms given; summed up before they move."""
    every = tokenised.select(F.explode("__words").alias("term"))
    return every.join(sized(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def anchored(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """wins with the anchor: `first` and `second` (its rarest term and the rarer neighbour, in text order; a window of one
    term has no second) and `shift` (its offset). Windows with a term that no document has are gone."""
    each = wins.select("win", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))
    each = each.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("win").orderBy("at")
    pair = each.select("win", "at", "term", "n", "size", F.lead("term").over(order).alias("after"), F.lead("n").over(order).alias("m"), F.min("n").over(Window.partitionBy("win")).alias("least"))
    pair = pair.where((F.col("least") > 0) & ((F.col("size") == 1) | F.col("after").isNotNull()))
    cost = F.struct(F.least("n", F.coalesce("m", "n")).alias("a"), F.greatest("n", F.coalesce("m", "n")).alias("b"), F.col("at").alias("c"))
    best = pair.groupBy("win").agg(F.min_by(F.struct("term", "after", F.col("at").alias("shift")), cost).alias("x"))
    return wins.join(best.select("win", F.col("x.term").alias("first"), F.col("x.after").alias("second"), "x.shift"), "win")


def postings(tokenised: DataFrame, keys: DataFrame, reach: int) -> DataFrame:
    """The index: for each place of a key (row, at, first, second, near, before): the position from 0, the key, which is
    two terms side by side, or one where `second` is null, the words from `reach` before to `reach` after it, and how many
    of these stand before it."""
    each = tokenised.select("__words", F.col("__row").alias("row"), F.posexplode("__words").alias("at", "first"))
    before = F.least("at", F.lit(reach))
    near = F.slice("__words", F.col("at") - before + 1, before + 1 + reach)
    keys = keys.select("first", "second").distinct()
    two = each.withColumn("second", F.get("__words", F.col("at") + 1)).join(sized(keys.where("second IS NOT NULL")), ["first", "second"], "left_semi")
    one, alone = each.withColumn("second", F.lit(None).cast("string")), keys.where("second IS NULL").select("first")
    found = two if alone.isEmpty() else two.unionByName(one.join(sized(alone), "first", "left_semi"))
    return common.stash(found.select("row", "at", "first", "second", near.alias("near"), before.alias("before")), "postings")


def phrase_matches(tokenised: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(row, start, size, items) of every occurrence of a window, start counting words from 0."""
    wins = common.stash(windows(items, size), "windows")
    counts = common.stash(term_counts(tokenised, wins.select(F.explode("words").alias("term")).distinct()), "terms")
    table = common.stash(anchored(wins, counts), "anchors")
    index = postings(tokenised, table, size - 1).alias("i")
    match = index.join(sized(table).alias("t"), (F.col("i.first") == F.col("t.first")) & F.col("i.second").eqNullSafe(F.col("t.second")))
    start, skip = F.col("at") - F.col("shift"), F.col("before") - F.col("shift")
    fits = (skip >= 0) & (F.slice("near", F.greatest(skip, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    return match.where(fits).select("row", start.alias("start"), F.size("words").alias("size"), "items")


def near(tokenised: DataFrame, items: DataFrame, span: int, terms: int = 3) -> DataFrame:
    """Proximity: (item_id, row, at) where a document has the item's rarest term at word `at` and its next rarest terms,
    `terms` in all, within `span` words of it."""
    each = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    counts = term_counts(tokenised, each.select("term").distinct())
    rare = each.join(counts, "term").groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, terms).alias("t"))
    rare = common.stash(rare.select("item_id", F.transform("t", lambda x: x["term"]).alias("t")).select("*", F.element_at("t", 1).alias("key")), "rare")
    found = postings(tokenised, rare.select(F.col("key").alias("first"), F.lit(None).cast("string").alias("second")), span)
    match = found.join(sized(rare), F.col("first") == F.col("key"))
    return match.where(F.size(F.array_except("t", "near")) == 0).select("item_id", "row", "at")


def report(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: its columns but the text, n_words, n_hit, n_items, items (sorted) and contaminated."""
    tokenised = tokens(docs, text)
    matches = phrase_matches(tokenised, items)

    def cover(acc, x):
        end = x["start"] + x["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"))

    covered = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "size"))), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda acc: acc["n"])
    hit = matches.groupBy("row").agg(covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    rows = tokenised.drop("__words")
    out = rows.join(hit.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")
    return out.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>")),
        "contaminated": F.coalesce("n_hit", F.lit(0)) > 0}).withColumn("n_items", F.size("items").cast("long"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = report(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
