"""Language identification by compression.

Each language has a raw-content zstandard dictionary: text of that language. A text is encoded, piece by piece, with
every dictionary, and the language whose dictionary gives the smallest total wins. Where the margin to the second is
narrow, the text is rejected. What is encoded is the whole text in lower case, its letters only and a space between
words: capitals, digits and marks say nothing about a language but cost bytes.

Cases: null text and text without a letter give ``und`` with score 0 and are rejected; ties go to the language that
sorts first and are rejected; repeated rows are each answered; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

#: Rows of a language that are sampled for its dictionary, and bytes of a dictionary.
SAMPLE_ROWS, DICTIONARY_BYTES = 200, 64 * 1024
#: A piece is short against the dictionary, so that the dictionary and not the piece's own text is what helps.
PIECE_BYTES = 2048
#: Put before each piece: with it even a few words are encoded rather than stored as they are.
CARRIER = bytes(64)
CODING = {"window_log": 18, "hash_log": 15, "chain_log": 15, "search_log": 3, "min_match": 4, "target_length": 32, "strategy": zstandard.STRATEGY_GREEDY,
          "write_content_size": False, "write_checksum": False, "write_dict_id": False}
#: Rejected if the best saves less than this share of what the second best needs.
MIN_MARGIN = 0.01
_WORD = re.compile(r"[^\W\d_]+")
_SCHEMA = "lang_pred string, score double, rejected boolean, margin double"


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> dict[str, bytes]:
    """Dictionaries by language from rows (lang, text), a bounded sample: about SAMPLE_ROWS rows of each language, those
    with the smallest hash of the key, their whole texts in hash order until a dictionary holds DICTIONARY_BYTES. All else
    is counted over all rows."""
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    span, wanted = 1 << 40, F.lit(False)
    for name, n in sorted(counts.items()):
        part = min(span, math.ceil(span * SAMPLE_ROWS / n))
        wanted = F.when(F.col("lang") == name, F.pmod("h", F.lit(span)) < part).otherwise(wanted)
    sample = rows.where(wanted).select("lang", "h", F.substring("text", 1, DICTIONARY_BYTES).alias("text")).collect()
    out = {}
    for name in sorted(counts):
        seen, kept, size = set(), [], 0
        for r in sorted((r for r in sample if r.lang == name), key=lambda r: (r.h, r.text)):
            piece = folded(r.text)
            if piece and piece not in seen and size < DICTIONARY_BYTES:
                seen.add(piece)
                kept.append(piece)
                size += len(piece)
        if size >= 8:
            out[name] = b" ".join(reversed(kept))[-DICTIONARY_BYTES:]
    return out


def encoders(dictionaries: dict[str, bytes]):
    out, coding = [], zstandard.ZstdCompressionParameters(**CODING)
    for name, content in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=coding)
        out.append((name, zstandard.ZstdCompressor(compression_params=coding, dict_data=d)))
    return out


def folded(text: str) -> bytes:
    """Words in lower case; numerals that are no digits, such as fractions, match the pattern but are no letters."""
    words = _WORD.findall(text.lower())
    return " ".join(filter(None, (w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words))).encode("utf-8", "surrogatepass")


def identify(text: str | None, coders, min_margin: float = MIN_MARGIN) -> tuple[str, float, bool, float]:
    """(language, score, rejected, margin) of one whole text."""
    raw = folded(text) if text else b""
    if not raw or not coders:
        return "und", 0.0, True, 0.0
    pieces = [CARRIER + raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
    sizes = []
    for name, coder in coders:
        compress = coder.compress
        sizes.append((sum(len(compress(p)) for p in pieces), name))
    sizes.sort()
    best, name = sizes[0]
    odds = sum(2.0 ** -min(1000.0, (size - best) * 8 / 4) for size, _ in sizes)
    margin = (sizes[1][0] - best) / sizes[1][0] if len(sizes) > 1 else 1.0
    return name, 1.0 / odds, margin < min_margin, margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score, rejected and margin. The dictionaries go out with the task: at most DICTIONARY_BYTES
    for each language."""
    names = ("lang_pred", "score", "rejected", "margin")
    docs = docs.drop(*names)
    schema = ", ".join([*(f"`{n.replace('`', '``')}` {t}" for n, t in docs.dtypes), _SCHEMA])

    def work(batches):
        coders = encoders(dictionaries)
        for batch in batches:
            found = [identify(t.as_py(), coders, min_margin) for t in batch.column(text)]
            cols = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*batch.schema.names, *names])

    return common.in_arrow(docs, work, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = fit(docs.where(~common.held_out()))
    found = predict(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", "rejected", "margin")
