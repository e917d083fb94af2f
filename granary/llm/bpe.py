"""Operator 10: byte-level BPE encoding and decoding with overlapping chunks.

Texts of at most ``CHUNK`` characters are encoded where they lie.  A longer
text is dealt out in chunks that overlap by ``OVERLAP`` characters:

1. each chunk is pre-tokenised by itself, wherever it lies;
2. neighbours are stitched at the first pre-token boundary that both see in
   their overlap.  The pattern looks only forward, so from a common boundary on
   both scans agree; boundaries close to a chunk's end, where it cannot look
   ahead, do not count, nor do those behind white space, where a piece by itself would
   be matched otherwise;
3. the pieces between stitches are encoded, again wherever they lie, and their
   ids put together in order.

Where an overlap has no common boundary (one pre-token longer than it), the text is
read on from the last common boundary, in one task, until a boundary of a later
chunk's scan is met again; from there on that chunk's scan holds.  So a long
pre-token costs its own length and at most a chunk more, and the ids are those of
the whole text in any case.  Decoding puts the bytes of the ids end to end.

Pre-tokens of any length (a run of millions of spaces, say) are merged by
themselves.  Null text counts as empty and has no ids; repeated rows are encoded
each; an empty table gives an empty result; other columns are not passed through,
so their names cannot clash.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_slices, table, written
from .tokens import PATTERN, RANKS, cuts_behind, ids_of, token_bytes, vocabulary

CHUNK, OVERLAP = 32_768, 1_024
#: Characters at a chunk's end that its own scan cannot be sure of.
MARGIN = 8
_BATCH = 1 << 22


def encode_batches(batches, path: str, text_at: int):
    """Arrow batches with a text column -> the other columns and ids (little-endian unsigned 32-bit)."""
    encode = ids_of(path)
    for batch in batches:
        for a, b in row_slices(batch.column(text_at), _BATCH):
            part = batch.slice(a, b - a)
            ids = [encode(t or "").tobytes() for t in part.column(text_at).to_pylist()]
            columns = [c for i, c in enumerate(part.columns) if i != text_at]
            names = [c for i, c in enumerate(part.schema.names) if i != text_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=[*names, "ids"])


def decode_batches(batches, path: str):
    """Adds decoded (binary) to batches whose last column is ids; null ids decode to nothing."""
    data, at = token_bytes(path)
    for batch in batches:
        ids_col = batch.column(batch.num_columns - 1)
        out = []
        for x in ids_col:
            ids = np.frombuffer(x.as_py() or b"", np.uint32)
            lens = (at[1:] - at[:-1])[ids]
            ends = np.cumsum(lens)
            out.append(data[np.arange(int(lens.sum())) + np.repeat(at[ids] - (ends - lens), lens)].tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])


def chunks_of(batches, chunk: int, overlap: int):
    """(uid, id, text) -> (uid, id, i, more, text): each text's chunks, with the overlap behind them; more unless a chunk reaches the text's end."""
    for batch in batches:
        for row in range(batch.num_rows):
            text, own = batch.column(2)[row].as_py(), batch.slice(row, 1)
            starts = range(0, max(1, len(text)), chunk)
            for a in range(0, len(starts), 64):
                part = starts[a : a + 64]
                ids = [c.take(pa.array([0] * len(part))) for c in own.columns[:2]]
                columns = [pa.array([x // chunk for x in part], pa.int32()), pa.array([x + chunk + overlap < len(text) for x in part]), pa.array([text[x : x + chunk + overlap] for x in part], pa.string())]
                yield pa.RecordBatch.from_arrays([*ids, *columns], names=["uid", "id", "i", "more", "text"])


def scan_chunks(batches, pattern: str, chunk: int, overlap: int):
    """(uid, id, i, more, text) -> the same with head and tail: boundaries (from the text's start) in the chunk's first overlap and behind its own part."""
    find = regex.compile(pattern).finditer
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            text, base = r["text"], r["i"] * chunk
            ends = [m.end() for m in find(text) if cuts_behind(text, m.end())]
            sure = len(text) - MARGIN if r["more"] else len(text) - 1
            r["head"] = [base + e for e in ends if e < overlap and e <= sure]
            r["tail"] = [base + e for e in ends if chunk <= e <= sure]
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema.append(pa.field("head", pa.list_(pa.int64()))).append(pa.field("tail", pa.list_(pa.int64()))))


def pieces(docs: DataFrame, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, text) -> (uid, id, piece, text): texts that can be encoded each by itself."""
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "id", "text")
    cut = rows.mapInArrow(functools.partial(chunks_of, chunk=chunk, overlap=overlap), f"uid long, id {kind}, i int, more boolean, text string")
    cut = cut.repartition("uid", "i")
    schema = f"uid long, id {kind}, i int, more boolean, text string, head array<long>, tail array<long>"
    seen = written(cut.mapInArrow(functools.partial(scan_chunks, pattern=pattern, chunk=chunk, overlap=overlap), schema))  # both branches below see the same numbers
    w = Window.partitionBy("uid").orderBy("i")
    base = F.col("i") * F.lit(chunk).cast("long")
    common = F.array_min(F.array_intersect("head", F.col("before")))
    joined = (
        seen.withColumn("before", F.lag("tail").over(w))
        .withColumn("at", F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(common))
        .withColumn("broken", F.max(F.col("at").isNull()).over(Window.partitionBy("uid")))
    )
    whole = joined.filter("NOT broken").withColumn("end", F.lead("at").over(w))
    own = F.substring(F.col("text"), (F.col("at") - base + 1).cast("int"), F.coalesce((F.col("end") - F.col("at")).cast("int"), F.length("text")))
    found = whole.select("uid", "id", F.col("i").cast("long").alias("piece"), own.alias("text"))
    read_on = joined.filter("broken").select("uid", "id", "i", "text", "head", "tail").groupBy("uid").applyInArrow(_resynchronised(pattern, chunk), f"uid long, id {kind}, piece long, text string")
    return found.union(read_on)


def _resynchronised(pattern: str, chunk: int):
    """The pieces of one text with an overlap that has no common boundary."""

    def read(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        parts = group.column("text").to_pylist()
        text = "".join([p[:chunk] for p in parts[:-1]] + parts[-1:])
        cuts = boundaries(text, group.column("head").to_pylist(), group.column("tail").to_pylist(), pattern, chunk)
        n = len(cuts)
        pieces = pa.array([text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)], pa.string())
        first = lambda c: group.column(c).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        return pa.table({"uid": first("uid"), "id": first("id"), "piece": pa.array(range(n), pa.int64()), "text": pieces})

    return read


def boundaries(text: str, heads: list[list[int]], tails: list[list[int]], pattern: str, chunk: int) -> list[int]:
    """Boundaries of the whole text to cut it at: common ones of neighbour scans where these are known to agree with the whole text's scan."""
    cuts, sure, reader = [0], 0, None  # sure: from here on the last chunk's scan holds; None while reading on
    for i in range(1, len(heads)):
        if sure is not None:
            common = [b for b in set(heads[i]) & set(tails[i - 1]) if b >= sure]
            if common:
                sure = min(common)
                if sure > cuts[-1]:
                    cuts.append(sure)
                continue
            reader, sure = regex.compile(pattern).finditer(text, cuts[-1]), None
        known = set(tails[i])
        for m in reader:
            if m.end() in known:
                cuts.append(m.end())
                sure = m.end()
                break
            if m.end() >= (i + 2) * chunk:
                break
    return cuts


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP, decode: bool = False) -> DataFrame:
    """(id, ids) of every text and, with decode, the bytes that they decode to."""
    path = path or vocabulary(RANKS)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    more = ", decoded binary" if decode else ""

    def short(batches):
        out = encode_batches(batches, path, 1)
        return decode_batches(out, path) if decode else out

    near = rows.filter(F.length("text") <= chunk).mapInArrow(short, f"id {kind}, ids binary{more}")
    parts = pieces(rows.filter(F.length("text") > chunk), pattern, chunk, overlap).repartition("uid", "piece")
    parts = parts.mapInArrow(lambda it: encode_batches(it, path, 3), f"uid long, id {kind}, piece long, ids binary")
    order = F.array_sort(F.collect_list(F.struct("piece", F.hex("ids").alias("x"))))
    far = parts.groupBy("uid", "id").agg(F.unhex(F.array_join(F.transform(order, lambda x: x["x"]), "")).alias("ids")).select("id", "ids")
    if decode:
        far = far.mapInArrow(lambda it: decode_batches(it, path), f"id {kind}, ids binary, decoded binary")
    return near.union(far)


def decoded(tokens: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, ids, decoded): the bytes of the ids end to end."""
    path = path or vocabulary(RANKS)
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: decode_batches(it, path), f"id {kind}, ids binary, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents"), decode=True)
    return out.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
