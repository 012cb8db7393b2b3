"""Shared pieces: table reading, shared scratch tables, byte-level tokens and hashes over Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is one step of its own.
STEP_BYTES = 1 << 19
HELD_OUT_REMAINDER = 2
BATCH_BYTES = 4 << 20
_LOCAL: list[str] = []
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose driver and executors
    are one process, gets a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="checkpoints"))
    return _LOCAL[0]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(_drop, spark, at)
    return spark.read.schema(df.schema).parquet(at)


def _drop(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_arrow(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow in batches of at most BATCH_BYTES, where the session has not set a bound of its own: a batch is held
    several times, in the JVM and in Python, and Spark's bound would let it grow to 64 MB. Workers outlive their tasks;
    what a task has freed goes back to the system at its end."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        _trim()

    conf = df.sparkSession.conf
    if conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def one_per_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with each key once and no null key. Rows that repeat a key count as one, with the least non-null
    value. The regrouping is planned only if the table does repeat a key, which a count by key finds."""
    df = df.select(key, value).where(F.col(key).isNotNull())
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        df = df.groupBy(key).agg(F.min(value).alias(value))
    return df


# ---------------------------------------------------------------- Arrow batches as byte arrays


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, data


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes): consecutive rows of at most `most` bytes, or one row."""
    offs, data = texts_of(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, offs[a : b + 1] - offs[a], data[offs[a] : offs[b]]
        a = b


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 8)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        _POWERS[base] = have
    return have[:n]


class Hashes:
    """Hash of any stretch of some bytes in constant time: a polynomial modulo 2**64 over random byte values, mixed."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.n = len(data)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * powers(_INVERSE, self.n + 1)[start])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes of one non-zero class; runs do not cross rows."""
    kind = classes[data]
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offs] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offs, start, "right") - 1


def class_table(**bytes_of: bytes) -> np.ndarray:
    """Bytes named get the class of their name c<n>; the others get class 1."""
    t = np.ones(256, np.uint8)
    for name, members in bytes_of.items():
        t[list(members)] = int(name[1:])
    return t


#: White space splits words: space and 9 to 13.
BY_SPACE = class_table(c0=b" \t\n\x0b\x0c\r")
#: The same, and runs of ASCII punctuation are tokens of their own.
BY_KIND = class_table(c0=b" \t\n\x0b\x0c\r", c2=bytes(c for c in range(33, 127) if not chr(c).isalnum()))
