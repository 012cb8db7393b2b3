"""Personal data: base patterns, and boosted trees over further candidates. Native expressions on the whole path.

Generators propose spans with high recall, overlapping ones too: what the base patterns match, valid or not, and looser
forms (numbers grouped like phone numbers without a country code, addresses spelt with "at" and "dot", long grouped
numbers). Features tell a candidate's format and what stands around it. Boosted trees of depth two, fitted to the
candidates of all documents, score them; they are planned as CASE expressions. Equal candidates are counted, and the counts
stay a table: of each step of the fit the driver sees sums by feature and bin. No spans are labelled: the marks
learned from are rules, the base rules' verdicts, and for loose forms a domain or a cue before the number. What the rules
look at is not among the trees' features. For each kind the threshold is the lowest score at which the held-out candidates
of that kind surely keep MIN_PRECISION (lower bound of the share, so that few candidates prove nothing). Base spans and
marked candidates stay whatever their score; where a kind has no such threshold, the marks decide alone.

Cases: null text is empty and has no span; empty tables give no rows; ties cannot arise, since spans are told apart by
kind and place; repeated rows are each answered; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common, spans

KINDS = ("email", "ip", "card", "phone")
#: As the contract has them, written so that no position is scanned twice: a local part or number starts where its run
#: of characters starts (or where the match before ended), and runs are taken whole.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
AT = r"(?:\(at\)|\[at\]| at )\s?"
#: A plain dot joins two labels, or stands apart from both; with a space on one side it ends a sentence, unless a common
#: top-level domain follows.
DOT = r"(?: ?(?:\(dot\)|\[dot\]| dot ) ?|\.| \. | ?\. ?(?=(?:com|net|org|edu|gov|info|io)(?![a-z0-9-])))"
LOOSE_EMAIL = rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{2,64}}+ ?{AT}[a-z0-9-]{{2,63}}+(?:{DOT}[a-z0-9-]{{2,63}}+)++"
#: What every match of LOOSE_EMAIL holds.
AT_AND_DOT = rf"(?i){AT}[a-z0-9-]{{2,63}}+{DOT}[a-z0-9-]{{2}}"
LOOSE_PHONE = r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])"
LOOSE_CARD = r"(?<![0-9.-])[0-9]{4}(?:[ ._-][0-9]{4}){3}(?![0-9.-])"
#: No bound: the trees are fitted to all candidates. The name stays for the test that sets it; nothing reads it.
SAMPLE_CANDIDATES = None
#: A document in so many, by the hash of its key, is held out for the thresholds; the trees are fitted to the others.
FOLDS = 4
#: Features are cut at so many quantiles at most. Gradients are summed in whole parts of 1 / UNIT and leaves are multiples
#: of 1 / STEP, so sums are exact: the order of rows does not matter, and scores are few.
CUTS, UNIT, STEP = 16, 1 << 20, 1 << 10
#: Standard errors that the held-out precision must stay above the least.
TREES, RATE, MIN_PRECISION, ERRORS = 20, 0.5, 0.99, 2.0
CONTEXT = 24
FEATURES = (
    "n_digits", "n_chars", "n_letters", "n_dots", "n_dashes", "n_spaces", "plus", "at", "joined_left", "joined_right",
    "spread", "repeats", "spelt", "local", "colon", "bracket", "left_digits", "left_letters",
)


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(x["found"], r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.char_length(spans.digits(x["found"]))
    if kind == "card":
        return F.when(n.between(13, 19), spans.luhn(spans.digits(x["found"]))).otherwise(False)
    return n.between(9, 15)


def _mark(text: Column, x: Column) -> Column:
    """What the trees learn from: a loose address needs a domain, a number without country code a cue before it."""
    f = _features(text, x)
    loose = F.when(x["kind"] == "email", f["domain"] == 1).when(x["kind"] == "phone", _valid("phone", x) & (f["cue"] == 1))
    return loose.when(x["kind"] == "card", _valid("card", x)).otherwise(False).cast("int")


def _raw(text: Column) -> dict[str, Column]:
    return {
        "email": spans.located(text, "email", EMAIL, F.contains(text, F.lit("@"))),
        "ip": spans.located(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": spans.located(text, "card", CARD, text.rlike("(?:[0-9][ -]?){12}[0-9]")),
        "phone": spans.located(text, "phone", PHONE, text.rlike(r"\+[0-9]")),
    }


def _loose(text: Column) -> Column:
    return F.concat(
        spans.located(text, "email", LOOSE_EMAIL, text.rlike(AT_AND_DOT)),
        spans.located(text, "phone", LOOSE_PHONE, text.rlike(r"[0-9][ .-][0-9]{3,4}[ .-][0-9]{3}") | text.rlike(r"[0-9]\)[ .-][0-9]{3}")),
        spans.located(text, "card", LOOSE_CARD, text.rlike(r"[0-9]{4}[ ._-][0-9]{4}[ ._-][0-9]{4}")),
    )


def _prose(text: Column, x: Column) -> Column:
    """A bare "at" before a plain domain, without a mark in its local part or a cue before it: "look at example.org"."""
    f = _features(text, x)
    return (x["kind"] == "email") & (f["spelt"] + f["local"] + f["cue"] == 0)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `base` (valid base spans by kind, then start) and `more` (the candidates that touch none of them)."""
    t = F.col(f"`{text}`")
    out = docs.select("*", *(c.alias(f"__raw_{k}") for k, c in _raw(t).items()), _loose(t).alias("__loose"))
    base = F.concat(*(F.filter(f"__raw_{k}", partial(_valid, k)) for k in KINDS))
    out = out.select("*", base.alias("base"), F.concat(*(F.col(f"__raw_{k}") for k in KINDS)).alias("__raw"))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.filter(F.array_distinct(F.concat("__raw", F.filter("__loose", lambda x: ~_prose(t, x)))), apart)
    return out.select(*(c for c in docs.columns if c not in ("base", "more")), "base", more.alias("more"))


def _features(text: Column, x: Column) -> dict[str, Column]:
    found, n = x["found"], F.char_length(x["found"])
    left = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
    right = F.substring(text, x["end"] + 1, 1)
    count = lambda cls: n - F.char_length(F.regexp_replace(found, cls, ""))
    d = spans.digits(found)
    return {
        "n_digits": F.char_length(d), "n_chars": n, "n_letters": count("[A-Za-z]"), "n_dots": count(r"\."), "n_dashes": count("-"), "n_spaces": count(" "),
        "plus": found.startswith("+").cast("int"), "at": F.contains(found, F.lit("@")).cast("int"),
        "joined_left": left.rlike(r"[A-Za-z0-9_/=]$").cast("int"), "joined_right": right.rlike("[A-Za-z0-9_/=]").cast("int"),
        "cue": left.rlike(r"(?i)(phone|tel|call|mobile|mail|contact|card|visa|account|\bip\b|address)").cast("int"),
        "checksum": F.when(F.char_length(d) >= 13, spans.luhn(d)).otherwise(False).cast("int"),
        "octets": F.when(found.rlike(r"^[0-9.]+$"), _valid("ip", x)).otherwise(False).cast("int"),
        "domain": found.rlike(r"(?i)(\.| dot |[(\[]dot[)\]]) ?[a-z]{2,6}$").cast("int"),
        "spelt": found.rlike(r"(?i)[(\[](at|dot)[)\]]| dot ").cast("int"), "local": found.rlike(r"^[A-Za-z0-9]+[0-9._%+-]").cast("int"),
        "colon": left.rlike(r"[:=#]\s*$").cast("int"), "bracket": left.rlike(r"[(\[<\"']$").cast("int"),
        "left_digits": F.char_length(F.regexp_replace(left, "[^0-9]", "")), "left_letters": F.char_length(F.regexp_replace(left, "[^A-Za-z]", "")),
        "spread": F.size(F.array_distinct(F.split(d, ""))), "repeats": d.rlike(r"([0-9])\1{4}").cast("int"),
    }


def quantiles(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distinct ones of CUTS quantiles of values, of which each occurs n times."""
    order = np.argsort(values)
    until = np.cumsum(n[order])
    ranks = np.floor(np.linspace(0, 1, CUTS + 1)[:-1] * (until[-1] - 1))
    return np.unique(values[order][np.searchsorted(until, ranks, "right")])


def best_split(sums: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int, np.ndarray]:
    """(feature, cut, sums of gradient and curvature on either side) of the split that gains most; sums by feature and bin."""
    best, whole = (-1.0, 0, 0, np.zeros((2, 2))), sums[0].sum(0)
    for j, ts in enumerate(cuts):
        below = np.cumsum(sums[j], 0)
        for k in range(len(ts)):
            sides = np.array([below[k], whole - below[k]]) / UNIT
            gain = float((sides[:, 0] ** 2 / (sides[:, 1] + 1)).sum())
            if gain > best[0] + 1e-9:
                best = (gain, j, k, sides)
    return best[1:]


class Boosted:
    """Logistic gradient boosting with trees of depth two over small integers, cut into bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, n: np.ndarray | None = None):
        """Fitted to rows in memory, of which each counts n times."""
        n = np.ones(len(y), np.int64) if n is None else n
        self._start([quantiles(c, n) for c in x.T], float((n * y).sum() / n.sum()))
        bins = self.bins(x)

        def sums(j: int, k: int) -> np.ndarray:
            q = 1 / (1 + np.exp(-self._of_bins(bins)))
            out = np.zeros((2, x.shape[1], CUTS + 1, 2), np.int64)
            for at, v in enumerate((y - q, q * (1 - q))):
                for f in range(x.shape[1]):
                    np.add.at(out[:, f, :, at], ((bins[:, j] > k).astype(int), bins[:, f]), np.rint(v * UNIT).astype(np.int64) * n)
            return out

        self._grow(sums, trees, rate)

    @classmethod
    def of_table(cls, cuts: list[np.ndarray], share: float, binned: DataFrame, trees: int = TREES, rate: float = RATE) -> Boosted:
        """Fitted to a table of y, bins x and counts n; a step sends the driver sums by side, feature and bin."""
        self = cls.__new__(cls)
        self._start(cuts, share)

        def sums(j: int, k: int) -> np.ndarray:
            q = 1 / (1 + F.exp(-self.of_bins(F.col("x"))))
            side = F.transform(F.array(F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"))), lambda s: (F.get("x", s["j"]) > s["k"]).cast("int"))[0]
            whole = lambda v: F.rint(v * UNIT).cast("long") * F.col("n")
            rows = binned.select(side.alias("side"), whole(F.col("y") - q).alias("g"), whole(q * (1 - q)).alias("h"), F.posexplode("x").alias("f", "b"))
            out = np.zeros((2, len(cuts), CUTS + 1, 2), np.int64)
            for r in rows.groupBy("side", "f", "b").agg(F.sum("g"), F.sum("h")).collect():
                out[r[0], r[1], r[2]] = r[3:]
            return out

        self._grow(sums, trees, rate)
        return self

    def _start(self, cuts: list[np.ndarray], share: float) -> None:
        p = min(max(share, 1e-3), 1 - 1e-3)
        self.bias, self.cuts, self.trees = round(math.log(p / (1 - p)) * STEP) / STEP, cuts, []

    def _grow(self, sums, trees: int, rate: float) -> None:
        """sums(j, k): gradient and curvature of the rows up to cut k of feature j and of those beyond, by feature and bin."""
        leaf = lambda s: round(rate * float(s[0] / (s[1] + 1)) * STEP) / STEP
        for _ in range(trees):
            j, k, _ = best_split(sums(0, CUTS)[0], self.cuts)
            tree = [j, k]
            for side in sums(j, k):
                jj, kk, parts = best_split(side, self.cuts)
                tree.append((jj, kk, leaf(parts[0]), leaf(parts[1])))
            self.trees.append(tree)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The number of cuts below each value."""
        return np.stack([np.searchsorted(c, v) for c, v in zip(self.cuts, x.T)], 1)

    def _of_bins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, k, lo, hi in self.trees:
            for at, (jj, kk, a, b) in ((x[:, j] <= k, lo), (x[:, j] > k, hi)):
                out += at * np.where(x[:, jj] <= kk, a, b)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self._of_bins(self.bins(x))

    def of_bins(self, x: Column) -> Column:
        """The same sum from an array of bins. The trees are data of the expression: its code is the same for any trees."""
        if not self.trees:
            return F.lit(self.bias)
        half = lambda s: F.struct(F.lit(s[0]).alias("j"), F.lit(s[1]).alias("k"), F.lit(s[2]).alias("a"), F.lit(s[3]).alias("b"))
        trees = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"), half(lo).alias("lo"), half(hi).alias("hi")) for j, k, lo, hi in self.trees))
        part = lambda s: F.when(F.get(x, s["j"]) <= s["k"], s["a"]).otherwise(s["b"])
        return F.aggregate(trees, F.lit(self.bias), lambda m, t: m + F.when(F.get(x, t["j"]) <= t["k"], part(t["lo"])).otherwise(part(t["hi"])))

    def column(self, f: dict[str, Column]) -> Column:
        """The same sum from the features."""
        out = F.lit(self.bias)
        below = lambda j, k: f[FEATURES[j]] <= float(self.cuts[j][k])
        part = lambda jj, kk, a, b: F.when(below(jj, kk), a).otherwise(b)
        for j, k, lo, hi in self.trees:
            out = out + F.when(below(j, k), part(*lo)).otherwise(part(*hi))
        return out


def lower_bound(good: np.ndarray, n: np.ndarray, errors: float = ERRORS) -> np.ndarray:
    """The least share that good of n leave likely (Wilson's interval)."""
    p, z = good / n, errors * errors
    return (p + z / (2 * n) - errors * np.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The candidates of all documents: `held` (a held-out document), `kind`, mark `y`, FEATURES, and how many are alike (`n`)."""
    docs = docs.select(F.col(text).alias("text"), (F.pmod(F.xxhash64(key), F.lit(FOLDS)) == FOLDS - 1).alias("held"))
    rows = with_candidates(docs).select(
        "text", "held", F.explode(F.concat(F.transform("base", lambda x: F.struct(F.lit(1).alias("y"), x.alias("x"))), F.transform("more", lambda x: F.struct(_mark(F.col("text"), x).alias("y"), x.alias("x"))))).alias("c"))
    f = _features(F.col("text"), F.col("c.x"))
    rows = rows.select("held", F.col("c.x.kind").alias("kind"), "c.y", *(f[k].alias(k) for k in FEATURES))
    return rows.groupBy("held", "kind", "y", *FEATURES).agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[Boosted, dict[str, float]] | None:
    """Trees and a threshold for each kind that has one, from all candidates: the trees from those of the documents that
    are not held out, the thresholds from those of the others. None where all marks are alike, or all documents with
    candidates are held out."""
    rows = common.stash(counted(docs, text, key), "pii_candidates")
    n = {(r[0], r[1]): r[2] for r in rows.groupBy("held", "y").agg(F.sum("n")).collect()}
    own = n.get((False, 0), 0) + n.get((False, 1), 0)
    if not own or len({y for _, y in n}) < 2:
        return None
    values = rows.where("not held").select("n", F.posexplode(F.array(*(F.col(k).cast("long") for k in FEATURES))).alias("f", "v"))
    seen = np.array(values.groupBy("f", "v").agg(F.sum("n")).collect(), np.int64)
    cuts = [quantiles(*seen[seen[:, 0] == j, 1:].T) for j in range(len(FEATURES))]

    def bin_of(k: str, ts: np.ndarray) -> Column:
        out = F
        for b, t in enumerate(ts):
            out = out.when(F.col(k) <= int(t), b)
        return out.otherwise(len(ts))

    binned = rows.select("held", "kind", "y", F.array(*(bin_of(k, ts) for k, ts in zip(FEATURES, cuts))).alias("x"), "n")
    binned = common.stash(binned.groupBy("held", "kind", "y", "x").agg(F.sum("n").alias("n")), "pii_bins")
    model = Boosted.of_table(cuts, n.get((False, 1), 0) / own, binned.where("not held"))
    scores = binned.where("held").groupBy("kind", model.of_bins(F.col("x")).alias("m")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("good"))
    thresholds, scores = {}, sorted(scores.collect(), key=lambda r: -r.m)
    for kind in KINDS:
        m, n_to, good = np.array([(r.m, r.n, r.good) for r in scores if r.kind == kind], float).reshape(-1, 3).T
        precise = lower_bound(np.cumsum(good), np.cumsum(n_to)) >= MIN_PRECISION
        if precise.any():
            thresholds[kind] = float(m[np.flatnonzero(precise)[-1]])
    return model, thresholds


def select(docs: DataFrame, model: tuple[Boosted, dict[str, float]] | None, text: str = "text") -> DataFrame:
    """docs with `base` and `spans` (base and selected spans, by kind as listed, then start). Candidates that the rules mark
    are selected with any model or none, the others where the trees say so."""
    out = with_candidates(docs, text)
    t = F.col(f"`{text}`")
    taken = F.transform("more", lambda x: F.struct(x.alias("x"), _mark(t, x).alias("y"), F.struct(*(v.alias(k) for k, v in _features(t, x).items())).alias("f")))
    out = out.withColumn("__scored", taken)

    def scored(c: Column) -> Column:
        if not model or not model[1]:
            return F.lit(False)
        least = F.create_map(*(F.lit(v) for kind in model[1].items() for v in kind))[c["x"]["kind"]]
        return F.coalesce(model[0].column({k: c["f"][k] for k in FEATURES}) >= least, F.lit(False))

    chosen = F.transform(F.filter("__scored", lambda c: (c["y"] == 1) | scored(c)), lambda c: c["x"])
    out = out.withColumn("__all", F.concat("base", chosen))
    by_kind = [F.array_sort(F.filter("__all", spans.is_kind(k))) for k in KINDS]
    return out.withColumn("spans", F.concat(*by_kind)).drop("more", "__scored", "__all")


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first, and of
    those the longest, is named, and what the others cover beyond it goes too."""
    order = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))

    def merge(acc, x):
        end = -x["back"]
        before = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        new = F.concat(acc["out"], before, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(x["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), merge, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, 2147483647)))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = select(docs, fit(docs))
    return out.select(
        "doc_id", *(spans.count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"), spans.written(F.col("spans")).alias("spans"))
