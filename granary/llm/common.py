"""Helpers shared by the corpus operators.

Two kinds live here: Spark helpers (tables written to the shared folder,
sizing from whole-table sums) and numpy helpers that split the bytes of an
Arrow string column into words and hash runs of words.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  All bytes
of a multi-byte UTF-8 character lie outside that set, so splitting bytes and
splitting code points give the same words.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same class in Java and Python regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: The six characters of SPACES, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ONE = np.uint64(1)


# --------------------------------------------------------------------- Spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which every executor sees.

    Only a local session without one (tests, a single machine) gets a temporary
    folder; on a cluster that is an error, since executors could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    _MADE.append(f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}")
    return _MADE[-1]


#: Folders handed out in this process and not released yet.
_MADE: list[str] = []


def mark() -> int:
    """A point from which release() counts."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate tables written since a mark, for when all results that read them have been written themselves."""
    for path in [p for p in _MADE[since:] if p not in keep]:
        removed(spark, path)
    _MADE[since:] = [p for p in _MADE[since:] if p in keep]


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    at = at or shared_dir(spark)
    df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(df: DataFrame, col: str) -> int:
    """Bytes of a text column over all rows; sizes the partitions of a job."""
    return df.agg(F.sum(F.octet_length(F.col(col))).alias("n")).first()["n"] or 0


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def words_col(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != F.lit(""))


def kept_columns(df: DataFrame, used: list[str], made: list[str]) -> list[str]:
    """Columns passed through: all but the operator's input; a name that the operator makes itself wins over an input column of that name (case-insensitively, as Spark resolves names)."""
    taken = {c.lower() for c in [*used, *made]}
    return [c for c in df.columns if c.lower() not in taken]


# --------------------------------------------------------------------- bytes


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse: a large_string array over valid UTF-8."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    data = np.ascontiguousarray(data, np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and each document's first word (n + 1 entries)."""
    word = ~_IS_SPACE[data]
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(word) + 1, dtype=bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    finish = word.copy()
    finish[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), so that every bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


class RunHash:
    """Hashes of runs of a sequence, modulo 2**64, from prefix sums.

    With prefix sums P of x[j] * base**j, (P[b] - P[a]) * base**-a is the same
    wherever the run x[a:b] stands.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.zeros(0, np.uint64)

    def _ready(self, n: int) -> None:
        if len(self._up) < n:
            self._up, self._down = _powers(self.base, n), _powers(self.inverse, n)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        self._ready(len(x) + 1)
        p = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self._up[: len(x)], dtype=np.uint64, out=p[1:])
        return p

    def runs(self, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (p[b] - p[a]) * self._down[a]

    def windows(self, p: np.ndarray, width: int) -> np.ndarray:
        """Of every width consecutive elements."""
        n = len(p) - width
        return (p[width:] - p[:n]) * self._down[:n] if n > 0 else np.zeros(0, np.uint64)


#: Odd multipliers: two independent hashes of bytes, two of words.
_BYTES = (RunHash(0x9E3779B97F4A7C15), RunHash(0xD6E8FEB86659FD93))
_WORDS = (RunHash(0xA0761D6478BD642F), RunHash(0xE7037ED1A0B428DB))


#: Bytes hashed at once: the working arrays of a task stay small for texts of any length.
_PART = 1 << 20


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes (words or lines, ascending); which is 0 or 1."""
    h, out, i = _BYTES[which], np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _PART, side="right")))
        p = h.prefix(data[at : ends[j - 1]].astype(np.uint64) + _ONE)
        out[i:j] = mixed(h.runs(p, starts[i:j] - at, ends[i:j] - at) + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every width consecutive words, over document borders too."""
    h = _WORDS[which]
    return mixed(h.windows(h.prefix(words), width))


def within_documents(first: np.ndarray, width: int) -> np.ndarray:
    """True for each start of width consecutive words that lie in one document."""
    n = int(first[-1]) if len(first) else 0
    ok = np.zeros(n + 1, np.int32)
    last = np.maximum(first[1:] - width + 1, first[:-1])
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, last, -1)
    return np.cumsum(ok[:-1]) > 0


def row_slices(column: pa.Array, most: int = 1 << 22):
    """Row ranges of at most about most bytes, so that a batch of long texts takes little memory; a longer text stands alone."""
    _, offsets = string_buffer(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b
