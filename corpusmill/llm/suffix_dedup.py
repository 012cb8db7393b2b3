"""Removal of repeated passages by longest previous factors.

A byte goes if it lies in a string of WIDTH bytes that also starts earlier (in a document with a smaller id, or further
left in the same). In suffix order, suffixes that share their first WIDTH bytes stand together; of these, the nearest
one before and the nearest one after in that order with a smaller text position (previous and next smaller position)
give the earlier match. A suffix's longest previous factor reaches WIDTH if either lies in its own run, and then its
first WIDTH bytes go; the earliest of each run stays.

The suffix order of a corpus is dealt out so that suffixes which share WIDTH bytes meet:

1. Each text is cut into segments of neighbouring windows that have the same anchor, the gram of GRAM bytes with the
   smallest hash in the window. Equal windows have equal anchors. Each task first compares its own segments.
2. Segments meet by anchor. Of equal segments the earliest stays. A segment whose anchor no other content shares is done;
   the others, mostly around edits and the ends of passages, are kept on.
3. Their suffixes are sorted and compared within a task, by their bytes; what is earliest there goes on by a fingerprint
   of 128 bits of its WIDTH bytes, and the same comparison over all tasks decides.

An anchor that a large share of documents hold does not gather in one task: a task sends on one row for equal segments,
and where it holds several contents of an anchor, it deals them out by content and sends one row to tell the others.

Cases: null text is empty; texts shorter than WIDTH lose nothing; rows that repeat a doc_id count as one document with
the least text; rows without doc_id are left out; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

WIDTH, GRAM = 100, 40
#: Rows that a task holds before it compares and sends them on: segments, and windows of WIDTH bytes.
HELD_SEGMENTS, HELD_WINDOWS = 1 << 20, 1 << 17
_PLACE = 24
#: Longer texts are cut into sections that overlap by WIDTH - 1 bytes.
SECTION = 1 << 23
FIRST, TELLS, GONE, KEPT_ON = 0, 1, 2, 3
_ROW = "kind int, part long, anchor long, content long, doc_id long, at long, n long"


# ---------------------------------------------------------------- suffix order


def smaller_neighbours(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest place before and after it with a smaller text position; -1 if none."""

    def nearest(pos):
        at = np.arange(len(pos)) - 1
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            open_ = open_[pos[at[open_]] > pos[open_]]
            at[open_] = at[at[open_]]
            open_ = open_[at[open_] >= 0]
        return at

    before = nearest(pos)
    after = nearest(pos[::-1])[::-1]
    return before, np.where(after >= 0, len(pos) - 1 - after, -1)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in lexicographic order, by prefix doubling."""
    rank, k, n = data.astype(np.int64) + 1, 1, len(data)
    while True:
        key = rank * (rank.max(initial=0) + 1)
        key[: max(n - k, 0)] += rank[k:]
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]])[:n])
        if n == 0 or new.max() == n:
            return order
        rank, k = new, 2 * k


def previous_factors(data: bytes) -> np.ndarray:
    """The longest-previous-factor array of one text: how many bytes from each place also start further left."""
    raw = np.frombuffer(data, np.uint8)
    order = suffix_array(raw)
    before, after = smaller_neighbours(order)
    out = np.zeros(len(raw), np.int64)
    for i, start in enumerate(order):
        for j in (before[i], after[i]):
            if j >= 0:
                a, b = raw[start:], raw[order[j] :]
                n = min(len(a), len(b))
                differ = np.flatnonzero(a[:n] != b[:n])
                out[start] = max(out[start], differ[0] if len(differ) else n)
    return out


def repeats(run: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """In suffix order: whether a previous factor of full width exists, that is, a smaller neighbour in the same run."""
    before, after = smaller_neighbours(pos)
    return ((before >= 0) & (run[before] == run)) | ((after >= 0) & (run[after] == run))


# ---------------------------------------------------------------- segments


def segments(data: np.ndarray, offs: np.ndarray):
    """(row, start in the row, windows, anchor, content) of every segment of the rows' texts."""
    h = common.Hashes(data)
    n = len(data)
    if n < WIDTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = h.of(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    low = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    span, have = WIDTH - GRAM + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: have - span], low[span - have :])
    ok = np.zeros(len(low) + 1, np.int32)
    first, last = offs[:-1], offs[1:] - WIDTH + 1
    some = last > first
    np.add.at(ok, first[some], 1)
    np.add.at(ok, last[some], -1)
    starts = np.flatnonzero(np.cumsum(ok[:-1]))
    place = (low[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    row = np.searchsorted(offs, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(starts)))
    a = starts[at]
    return row[at], a - offs[row[at]], count, grams[place[at]].view(np.int64), h.of(a, a + count - 1 + WIDTH).view(np.int64)


def compared(anchor, content, doc, at, n):
    """Order rows by (anchor, content, doc, at). Returns the order, which of the ordered rows repeat an earlier one, and
    which have an anchor of several contents."""
    order = np.lexsort((at, doc, content, anchor))
    a, c = anchor[order], content[order]
    same_a = np.concatenate([[False], a[1:] == a[:-1]])[: len(a)]
    same = same_a & np.concatenate([[False], c[1:] == c[:-1]])[: len(a)]
    group = np.cumsum(~same_a) - 1
    kinds = np.bincount(group, ~same) if len(a) else np.zeros(0)
    return order, same, kinds[group] > 1


def ranges(doc, at, n):
    """Windows (doc, at .. at + n - 1) as merged byte ranges (doc, start, length)."""
    order = np.lexsort((at, doc))
    doc, a, e = doc[order], at[order], at[order] + n[order] - 1 + WIDTH
    if not len(doc):
        return doc, a, e
    big = int(e.max()) + 1
    key = np.unique(doc, return_inverse=True)[1].astype(np.int64) * big
    reach = np.maximum.accumulate(key + e)
    new = np.ones(len(doc), bool)
    new[1:] = (key + a)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    end = reach[np.append(first[1:], len(doc)) - 1] - key[first]
    return doc[first], a[first], end - a[first]


def _batches(kind, part, anchor, content, doc, at, n, names=None, size=1 << 16):
    names = names or ("kind", "part", "anchor", "content", "doc_id", "at", "n")
    kind = np.full(len(part), kind, np.int32)
    for i in range(0, len(part), size):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i : i + size])) for c in (kind, part, anchor, content, doc, at, n)], names=list(names))


def _cut(batches):
    """Segments of one task, compared with each other a bounded number at a time."""
    held, size = [], 0

    def sent():
        doc, at, n, anchor, content = (np.concatenate(c) for c in zip(*held, strict=True))
        order, same, several = compared(anchor, content, doc, at, n)
        doc, at, n, anchor, content = (c[order] for c in (doc, at, n, anchor, content))
        d, a, e = ranges(doc[same], at[same], n[same])
        zero = np.zeros(len(d), np.int64)
        yield from _batches(GONE, common.mixed(d.view(np.uint64)).view(np.int64), zero, zero, d, a, e)
        one = ~same
        part = np.where(several, content, anchor)
        for some, kind in ((one & ~several, FIRST), (one & several, KEPT_ON)):
            yield from _batches(kind, part[some], anchor[some], content[some], doc[some], at[some], n[some])
        tells = one & several & np.concatenate([[True], anchor[1:] != anchor[:-1]])
        yield from _batches(TELLS, anchor[tells], anchor[tells], content[tells], doc[tells], at[tells], n[tells])

    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        for a, b, offs, data in common.steps(batch.column("text")):
            for start in range(0, max(1, len(data) - WIDTH + 1), SECTION):
                if b > a + 1:
                    row, at, n, anchor, content = segments(data, offs)
                else:
                    piece = data[start : start + SECTION + WIDTH - 1]
                    row, at, n, anchor, content = segments(piece, np.array([0, len(piece)]))
                held.append((ids[a:b][row], at + (start if b == a + 1 else 0), n, anchor, content))
                size += len(row)
                if size >= HELD_SEGMENTS:
                    yield from sent()
                    held, size = [], 0
                if b > a + 1:
                    break
    if size:
        yield from sent()


def _meet(batches):
    """Segments that met by anchor (or content): the ranges that are gone, and the segments that are kept on."""
    held = [[np.asarray(c) for c in b.columns] for b in batches]
    if not held:
        return
    kind, part, anchor, content, doc, at, n = (np.concatenate(c) for c in zip(*held, strict=True))
    del held
    past = kind == GONE
    yield from _batches(GONE, part[past], anchor[past], content[past], doc[past], at[past], n[past])
    rest = ~past
    kind, anchor, content, doc, at, n = (c[rest] for c in (kind, anchor, content, doc, at, n))
    real = kind != TELLS
    told = np.unique(anchor[~real])
    kind, anchor, content, doc, at, n = (c[real] for c in (kind, anchor, content, doc, at, n))
    order, same, several = compared(anchor, content, doc, at, n)
    kind, anchor, content, doc, at, n = (c[order] for c in (kind, anchor, content, doc, at, n))
    d, a, e = ranges(doc[same], at[same], n[same])
    zero = np.zeros(len(d), np.int64)
    yield from _batches(GONE, zero, zero, zero, d, a, e)
    on = ~same & (several | (kind == KEPT_ON) | np.isin(anchor, told))
    yield from _batches(KEPT_ON, anchor[on], anchor[on], content[on], doc[on], at[on], n[on])


# ---------------------------------------------------------------- windows


def _windows(batches):
    """Windows of the segments kept on, compared by their bytes within the task; the earliest go on by fingerprint."""
    held, size = [], 0

    def sent():
        doc = np.concatenate([d for d, _, _ in held])
        at = np.concatenate([a for _, a, _ in held])
        text = np.concatenate([w for _, _, w in held])
        order = np.argsort(text.view(f"S{WIDTH}").ravel(), kind="stable")
        text = text[order]
        run = np.cumsum(np.concatenate([[True], (text[1:] != text[:-1]).any(axis=1)]))
        pos = np.empty(len(order), np.int64)
        pos[np.lexsort((at, doc))] = np.arange(len(order))
        gone = repeats(run, pos[order])
        one = np.flatnonzero(~gone)
        gone = order[gone]
        d, a, e = ranges(doc[gone], at[gone], np.ones(len(gone), np.int64))
        zero = np.zeros(len(d), np.int64)
        yield from _batches(GONE, common.mixed(d.view(np.uint64)).view(np.int64), zero, zero, d, a, e)
        words = np.ascontiguousarray(text[one]).reshape(-1)
        h = common.Hashes(words)
        starts = np.arange(len(one)) * WIDTH
        one_hash = h.of(starts, starts + WIDTH)
        other = np.zeros(len(one), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, WIDTH, 25):
                other = common.mixed(other * np.uint64(0x9E3779B97F4A7C15) + h.of(starts + k, starts + k + 25))
        keep = order[one]
        yield from _batches(FIRST, one_hash.view(np.int64), one_hash.view(np.int64), other.view(np.int64), doc[keep], at[keep], np.ones(len(one), np.int64))

    for batch in batches:
        ids = np.asarray(batch.column("doc_id"))
        offs, data = common.texts_of(batch.column("text"))
        for i, segs in enumerate(batch.column("segments").to_pylist()):
            raw = data[offs[i] : offs[i + 1]]
            if len(raw) < WIDTH:
                continue
            view = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)
            for s in segs:
                held.append((np.full(s["n"], ids[i]), np.arange(s["at"], s["at"] + s["n"]), view[s["at"] : s["at"] + s["n"]]))
                size += s["n"]
                if size >= HELD_WINDOWS:
                    yield from sent()
                    held, size = [], 0
    if size:
        yield from sent()


def _decide(batches):
    """Windows that met by fingerprint: ranges of those that are not the earliest of their run."""
    held = [[np.asarray(c) for c in b.columns] for b in batches]
    if not held:
        return
    kind, part, one, other, doc, at, n = (np.concatenate(c) for c in zip(*held, strict=True))
    past = kind == GONE
    yield from _batches(GONE, part[past], one[past], other[past], doc[past], at[past], n[past])
    one, other, doc, at = (c[~past] for c in (one, other, doc, at))
    order = np.lexsort((at, doc, other, one))
    run = np.cumsum(np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (other[order][1:] != other[order][:-1])]))[: len(order)]
    pos = np.empty(len(order), np.int64)
    pos[np.lexsort((at, doc))] = np.arange(len(order))
    gone = order[repeats(run, pos[order])]
    d, a, e = ranges(doc[gone], at[gone], np.ones(len(gone), np.int64))
    zero = np.zeros(len(d), np.int64)
    yield from _batches(GONE, zero, zero, zero, d, a, e)


# ---------------------------------------------------------------- the operator


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, ranges) with ranges an array of (at, n): bytes to remove, which may overlap. docs: unique (doc_id, text)."""
    cut = common.in_arrow(docs, _cut, _ROW).repartition("part").mapInArrow(_meet, _ROW)
    met = common.stash(cut.select("kind", "doc_id", "at", "n"), "segments")
    on = met.where(F.col("kind") == KEPT_ON).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("segments"))
    text = docs.join(on, "doc_id").select("doc_id", "text", "segments")
    late = common.in_arrow(text, _windows, _ROW).repartition("part").mapInArrow(_decide, _ROW)
    gone = met.where(F.col("kind") == GONE).select("doc_id", "at", "n").unionAll(late.select("doc_id", "at", "n"))
    return gone.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))


def _kept(data: bytes, found) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    out, at, removed, runs, end = [], 0, 0, 0, -1
    for a, n in sorted((r["at"], r["n"]) for r in found or ()):
        e = min(a + n, len(data))
        if a > end:
            runs += 1
        if e > at:
            a = max(a, at)
            out.append(data[at:a])
            removed += e - a
            at = e
        end = max(end, e)
    out.append(data[at:])
    return b"".join(out), removed, runs


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans): what is left of each document."""
    docs = common.one_per_id(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    both = docs.join(removed_ranges(docs), "doc_id", "left").select("doc_id", "text", "ranges")

    def work(batches):
        for batch in batches:
            offs, data = common.texts_of(batch.column("text"))
            raw = data.tobytes()
            got = [_kept(raw[offs[i] : offs[i + 1]], r) for i, r in enumerate(batch.column("ranges").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([g[0] for g in got], pa.binary()), pa.array(np.diff(offs)), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return common.in_arrow(both, work, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
