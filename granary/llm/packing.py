"""Operator 3: packing into sequences by the online sum-of-squares rule.

Each document's ids end with the separator id.  Every full window of 1,024 ids
becomes a sequence at once; what is left over is placed, document by document,
into a partly filled sequence as it comes.  The rule takes the fill level that makes the
sum over levels of (number of open sequences at that level) squared smallest
afterwards; an array over levels holds the counts.  Only (id, length, checksums)
rows are dealt out to packers, never ids; each packer gets a fixed number of
documents, so its memory does not grow with the corpus.

Ids are those of the tokenizers library, added tokens such as <|endoftext|> included;
tiktoken computes them, part by part for very long texts.  Documents are numbered as
they come and dealt out by number, so that equal rows, however many, spread over all
packers.  A packer reads its documents sorted by what is left over, longest first (then
by number), and places each once, as it comes, without looking ahead: at sf0.1 that
leaves 0.5 % of padding, the order of the table 1.8 %.  Null or empty text has the separator id alone; repeated rows are packed
each; an empty table gives no pieces; other columns are not passed through, so their
names cannot clash.  Sequence numbers are packer * 2**32 + a running number.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_slices, table, written
from .tokens import JSON, ids_of, vocabulary

WINDOW, SEPARATOR = 1024, 0
#: Documents a packer; the padding of the rule grows with their square root only.
PACKER_ROWS = 32_768


class SumOfSquares:
    """Open sequences by fill level, placed by the sum-of-squares rule."""

    def __init__(self, window: int):
        self.window, self.count, self.open = window, np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)]
        self.sequences = 0

    def new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of size < window."""
        w, n = self.window, self.count
        change = 1 - 2 * n[1 : w - size + 1]
        change[: w - 1 - size] += 2 * n[1 + size : w] + 1
        change[n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        if best < 0 or change[best] > 2 * n[size] + 1:
            level, seq = 0, self.new()
        else:
            level = best + 1
            seq = self.open[level].pop()
            n[level] -= 1
        if level + size < w:
            n[level + size] += 1
            self.open[level + size].append(seq)
        return seq, level


def measured_batches(batches, path: str, window: int, separator: int):
    """(id, text) -> (id, n, sums): ids with the separator, and the CRC-32 of each window of them."""
    encode = ids_of(path, added_tokens=True)
    for batch in batches:
        for a, b in row_slices(batch.column(1)):
            part = batch.slice(a, b - a)
            counts, sums = [], []
            for text in part.column(1).to_pylist():
                ids = memoryview(np.append(encode(text or ""), np.uint32(separator)).tobytes())
                counts.append(len(ids) // 4)
                sums.append([zlib.crc32(ids[i : i + 4 * window]) for i in range(0, len(ids), 4 * window)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["id", "n", "sums"])


def _packer(window: int):
    def pack(group: pa.Table) -> pa.Table:
        n = group.column("n")
        group = group.append_column("left", pc.subtract(n, pc.multiply(pc.divide(n, window), window)))
        group = group.sort_by([("left", "descending"), ("at", "ascending")])
        rows = zip(group.column("id").to_pylist(), group.column("n").to_pylist(), group.column("sums").to_pylist(), strict=True)
        shard = group.column("packer")[0].as_py() << 32
        sos, out = SumOfSquares(window), []
        for id_, n, sums in rows:
            for k, crc in enumerate(sums):
                size = min(window, n - k * window)
                seq, at = (sos.new(), 0) if size == window else sos.place(size)
                out.append((id_, k * window, size, crc, n, shard + seq, at))
        names = ["id", "start", "length", "crc", "tokens", "sequence", "offset"]
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(columns[0], group.schema.field("id").type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names)

    return pack


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, separator: int = SEPARATOR, packer_rows: int = PACKER_ROWS) -> DataFrame:
    """(id, start, length, crc, tokens, sequence, offset): one row per piece."""
    path = path or vocabulary(JSON)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    measured = written(rows.mapInArrow(lambda it: measured_batches(it, path, window, separator), f"id {kind}, n long, sums array<long>"))
    packers = max(1, -(-measured.count() // packer_rows))
    dealt = measured.withColumn("at", F.monotonically_increasing_id()).withColumn("packer", F.pmod(F.xxhash64("at"), F.lit(packers)).cast("long"))
    return dealt.groupBy("packer").applyInArrow(_packer(window), f"id {kind}, start long, length long, crc long, tokens long, sequence long, offset long")


def pieces_of(docs: DataFrame) -> DataFrame:
    """The pieces of documents under the names of the contract."""
    out = packed(docs)
    return out.select(
        F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset"
    )


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_of(table(spark, sf_dir, "documents"))
