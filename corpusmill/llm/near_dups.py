"""Near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct SHINGLE-word shingles; documents are linked at a Jaccard similarity of SIMILARITY
percent. Each distinct set has a MinHash signature of COORDINATES values, and is posted under each (coordinate, value)
pair. Two linked sets agree in MATCHES coordinates but for a chance under 1e-9, so they share a posting even where each
set is posted only under its COORDINATES - MATCHES + 1 rarest values (prefix); values that one set alone has are skipped,
and so are lists whose members already hang together. Sets that meet are compared by their whole signatures, collisions
counted; those that collide MATCHES times or more are confirmed on the full sets.

Postings are not joined with themselves. Links only have to hold components together, so lists are worked off in steps:

1. STARS times, each list names its most central member, the one whose values most sets have, and every member not yet
   known to hang together with it is compared with it: a row for each posting at most. Then components are joined, lists
   of one component are done, and the named members, which have met their whole lists, leave them.
2. What is left are mostly copies just under the threshold, which must be held against all members of their lists. Each
   list belongs to the component that most of its members are of, and its members meet in that component's room, each
   once, whatever the number of lists that led there. A room's members are dealt into blocks by hash, and a block of those
   that are not yet of the component (guests) meets every block of the room in one row of a join: two blocks are in
   memory, no pair is a row, and members of one component are not compared with each other.

Cases: null texts, and texts without words, have an empty set, link with nothing and are kept; rows that repeat a doc_id
count as one document with the least text; rows without doc_id are left out; empty tables give no rows; further columns
are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common
from corpusmill.llm.decontamination import sized

SHINGLE, SIMILARITY = 5, 75
COORDINATES, MATCHES = 64, 26
#: Rounds in which each list names one member; sets and shingles of a room's block, on the mean; columns of a product.
STARS, BLOCK, BLOCK_SHINGLES, WIDE = 2, 64, 1 << 20, 1 << 16
#: Ids of eight bytes that may be broadcast.
BROADCAST_IDS = 1_000_000
_ODD = common.mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = common.mixed(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))
_PLACES = common.mixed(np.arange(2001, SHINGLE + 2001, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct shingles of each row, by row, then hash."""
    data = common.LOWER[data]
    start, end, row = common.runs(data, offs, common.BY_SPACE)
    word = common.Hashes(data).of(start, end)
    n = len(offs) - 1
    with np.errstate(over="ignore"):
        total = np.zeros(max(len(word) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            total += word[k : len(word) - SHINGLE + 1 + k] * _PLACES[k] if len(total) else np.uint64(0)
        whole = row[: len(total)] == row[SHINGLE - 1 :] if len(total) else np.zeros(0, bool)
        count = np.bincount(row, minlength=n)
        few = (count[row] < SHINGLE) if len(row) else np.zeros(0, bool)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        place = np.arange(len(row)) - first[row] if len(row) else np.zeros(0, np.int64)
        short = np.zeros(n, np.uint64)
        np.add.at(short, row[few], word[few] * _PLACES[place[few]])
        few_rows = np.flatnonzero((count > 0) & (count < SHINGLE))
        short = short[few_rows] + count[few_rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = common.mixed(np.concatenate([total[whole], short]))
    r = np.concatenate([row[: len(total)][whole], few_rows]) if len(row) else np.zeros(0, np.int64)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of COORDINATES tokens for each set; sets are not empty, the k-th begins at first[k]."""
    tokens = np.zeros((len(first), COORDINATES), np.int64)
    with np.errstate(over="ignore"):
        for c in range(COORDINATES if len(first) else 0):
            low = np.minimum.reduceat(common.mixed(h + _ADD[c]) if c % 8 == 0 else (h + _ADD[c]) * _ODD[c], first)
            tokens[:, c] = common.mixed(low + _ADD[c]).view(np.int64)
    return tokens


def _signed(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, offs, data in common.steps(batch.column("text")):
            h, row = shingles(data, offs)
            n = np.bincount(row, minlength=b - a)
            some = np.flatnonzero(n)
            first = np.concatenate([[0], np.cumsum(n)])[some]
            sums = np.zeros((2, b - a), np.uint64)
            if len(some):
                with np.errstate(over="ignore"):
                    for k in range(2):
                        sums[k, some] = np.add.reduceat(common.mixed(h * np.uint64(2 * k + 3)), first)
            sig_offs = np.zeros(b - a + 1, np.int32)
            np.cumsum((n > 0) * COORDINATES, out=sig_offs[1:])
            sig = pa.ListArray.from_arrays(pa.array(sig_offs), pa.array(signatures(h, first).reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), sig], names=["doc_id", "n", "f", "g", "sig"])


def _bodies(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for a, b, offs, data in common.steps(batch.column("text")):
            h, row = shingles(data, offs)
            first = np.searchsorted(row, np.arange(b - a + 1))
            n = np.diff(first)
            some = np.flatnonzero(n)
            sig = pa.ListArray.from_arrays(pa.array((np.arange(len(some) + 1) * COORDINATES).astype(np.int32)), pa.array(signatures(h, first[some]).reshape(-1)))
            sets = pa.ListArray.from_arrays(pa.array(np.append(first[some], len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(some)), pa.array(n[some].astype(np.int64)), sig, sets], names=["doc", "n", "sig", "set"])


def _postings(reps: DataFrame) -> DataFrame:
    """(token, doc, n, central, label): each representative under its rarest values, of those that another one has too.
    central is large for sets whose values many others have."""
    every = reps.select("doc", "n", F.explode("sig").alias("token"))
    shared = common.stash(every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "tokens")
    held = every.join(shared, "token").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    central = F.aggregate("t", F.lit(0).cast("long"), lambda total, x: total + (F.log2(x["df"]) * 64).cast("long"))
    taken = F.slice("t", 1, F.greatest(F.size("t") - (MATCHES - 1), F.lit(0)))
    return held.select(F.explode(F.transform(taken, lambda x: x["token"])).alias("token"), "doc", "n", central.alias("central"), F.col("doc").alias("label"))


def _close(n: str, m: str):
    return 100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def _star(held: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of labels found through the lists' most central members, and the postings that are left."""
    named = F.max_by(F.struct("doc", "label", "n"), F.struct("central", -F.col("doc")))
    lists = held.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), named.alias("p")).where("lo < hi")
    lists = lists.select("token", F.col("p.doc").alias("p"), F.col("p.label").alias("lp"), F.col("p.n").alias("np"))
    live = common.stash(held.join(lists, "token"), "postings")
    pairs = live.where((F.col("label") != F.col("lp")) & _close("n", "np")).select("p", "doc", "lp", "label").distinct()
    side = lambda s: bodies.select(F.col("doc").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "sig", "set")))
    both = pairs.join(side("doc"), "doc").join(side("p"), "p")
    collisions = F.size(F.filter(F.zip_with("sig_doc", "sig_p", lambda x, y: x == y), lambda z: z))
    common_ = F.size(F.array_intersect("set_doc", "set_p"))
    linked = F.when(collisions >= MATCHES, 100 * common_ >= SIMILARITY * (F.col("n_doc") + F.col("n_p") - common_))
    links = both.where(linked).select(F.col("lp").alias("u"), F.col("label").alias("v"))
    return common.stash(links.distinct(), "links"), live.where("doc <> p").select(held.columns)


def _relabelled(held: DataFrame, links: DataFrame) -> DataFrame:
    to = components(links, "u", "v").toDF("node", "to")
    return held.join(to, held.label == to.node, "left").select("token", "doc", "n", "central", F.coalesce("to", "label").alias("label"))


def _block(column, i: int):
    """(label, n, signatures, set of each shingle, shingles) of one packed block."""
    label, sig, sets = column[i].values.flatten()
    n = np.diff(np.asarray(sets.offsets))
    return np.asarray(label), n, np.asarray(sig.flatten()).reshape(-1, COORDINATES), np.repeat(np.arange(len(n)), n), np.asarray(sets.flatten())


def common_counts(rows_a, a, n_a: int, rows_b, b, n_b: int) -> np.ndarray:
    """How many shingles each set of one block has in common with each of the other."""
    every, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b = at[: len(a)], at[len(a) :]
    inside = np.zeros((2, len(every)), bool)
    inside[0, at_a] = True
    inside[1, at_b] = True
    shared = inside.all(axis=0)
    place = np.cumsum(shared) - 1
    keep_a, keep_b = shared[at_a], shared[at_b]
    rows_a, at_a, rows_b, at_b = rows_a[keep_a], place[at_a[keep_a]], rows_b[keep_b], place[at_b[keep_b]]
    out = np.zeros((n_a, n_b), np.int64)
    for c in range(0, int(shared.sum()), WIDE):
        x, y = np.zeros((n_a, WIDE), np.float32), np.zeros((n_b, WIDE), np.float32)
        for m, rows, at in ((x, rows_a, at_a), (y, rows_b, at_b)):
            here = (at >= c) & (at < c + WIDE)
            m[rows[here], at[here] - c] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _compared(batches):
    """Label pairs that a link joins, of the sets of two blocks."""
    for batch in batches:
        found = [np.zeros((0, 2), np.int64)]
        for i in range(batch.num_rows):
            la, na, sa, rows_a, a = _block(batch.column("guests"), i)
            lb, nb, sb, rows_b, b = _block(batch.column("others"), i)
            small, large = np.minimum.outer(na, nb), np.maximum.outer(na, nb)
            may = (la[:, None] != lb[None]) & (100 * small >= SIMILARITY * large)
            collisions = np.zeros(may.shape, np.int16)
            for c in range(COORDINATES if may.any() else 0):
                collisions += sa[:, None, c] == sb[None, :, c]
            may &= collisions >= MATCHES
            x, y = may.any(axis=1), may.any(axis=0)
            if not x.any():
                continue
            keep_a, keep_b = x[rows_a], y[rows_b]
            n = common_counts(rows_a[keep_a], a[keep_a], len(na), rows_b[keep_b], b[keep_b], len(nb))
            p, q = np.nonzero(may & (100 * n >= SIMILARITY * (na[:, None] + nb[None] - n)))
            found.append(np.unique(np.stack([la[p], lb[q]], axis=1), axis=0))
        found = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["u", "v"])


def _rooms(held: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links (u, v) of labels between all sets that share a list of several labels."""
    by_label = held.groupBy("token", "label").agg(F.count("*").alias("members"))
    rooms = by_label.groupBy("token").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("members", -F.col("label"))).alias("room")).where("labels > 1")
    inside = common.stash(held.join(rooms, "token").select("room", "doc", "label", "n").distinct().withColumn("home", F.col("label") == F.col("room")), "members")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    sizes = inside.groupBy("room", "home").agg(blocks.alias("blocks"))
    dealt = inside.join(sizes, ["room", "home"]).select("room", "home", F.pmod(F.xxhash64("doc"), "blocks").alias("block"), "doc", "label")
    packed = dealt.join(bodies.drop("n"), "doc").groupBy("room", "home", "block").agg(F.collect_list(F.struct("label", "sig", "set")).alias("sets"))
    packed = common.stash(packed, "blocks")
    guests = packed.where(~F.col("home")).select("room", F.col("block").alias("first"), F.col("sets").alias("guests"))
    units = guests.join(packed.withColumnRenamed("sets", "others"), "room").where(F.col("home") | (F.col("first") <= F.col("block")))
    return common.stash(common.in_arrow(units.select("guests", "others"), _compared, "u long, v long").distinct(), "links")


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) of links that hold the components together. reps: (doc, n, sig) of distinct sets; docs: (doc_id, text)."""
    held = common.stash(_postings(reps), "postings")
    ids = held.select(F.col("doc").alias("doc_id")).distinct()
    some = docs.join(sized(ids, BROADCAST_IDS), "doc_id", "left_semi").select("doc_id", "text")
    bodies = common.stash(common.in_arrow(some, _bodies, "doc long, n long, sig array<long>, set array<long>"), "bodies")
    found = []
    for _ in range(STARS):
        new, held = _star(held, bodies)
        held = common.stash(_relabelled(held, new), "postings")
        found.append(new)
    found.append(_rooms(held, bodies))
    return reduce(DataFrame.unionAll, found)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that can be reached, for each node of an edge. Labels spread to neighbours and
    then jump to their label's label, until nothing changes."""
    both = common.stash(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionAll(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = common.stash(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = common.stash(both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("low")), "near")
        spread = common.stash(labels.join(near, labels.node == near.u).select("node", "label", F.least("label", "low").alias("new")), "spread")
        at = spread.select(F.col("node").alias("of"), F.col("new").alias("next"))
        nexts = common.stash(spread.join(at, spread.new == at.of, "left").select("node", "label", F.least("new", F.coalesce("next", "new")).alias("new")), "labels")
        labels = nexts.select("node", F.col("new").alias("label"))
        if nexts.where("new <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): class_id is the smallest document with the same set."""
    docs = common.one_per_id(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = common.stash(common.in_arrow(docs, _signed, "doc_id long, n long, f long, g long, sig array<long>"), "signed")
    some = signed.where("n > 0")
    reps = some.groupBy("n", "f", "g").agg(F.min("doc_id").alias("doc"))
    reps = common.stash(reps, "classes")
    full = common.stash(reps.join(signed.select("doc_id", "sig"), F.col("doc") == F.col("doc_id")).select("doc", "n", "sig"), "reps")
    labels = components(links(full, docs), "u", "v")
    classes = common.stash(reps.join(labels, F.col("doc") == F.col("node"), "left").select("n", "f", "g", "doc", F.coalesce("label", "doc").alias("component")), "classes")
    out = some.select("doc_id", "n", "f", "g").join(classes, ["n", "f", "g"]).select("doc_id", "n", "doc", "component")
    out = out.unionAll(signed.where("n = 0").select("doc_id", "n", "doc_id", "doc_id"))
    return out.toDF("doc_id", "n_shingles", "class_id", "component_id")


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
