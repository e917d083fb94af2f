"""Operator 1: substring dedup with a count-min prefilter and an exact second pass.

A window is ``WINDOW`` consecutive words of one document.  Every word covered by
a window whose word sequence starts anywhere else too, in the same document or
another, is removed; all copies go, and windows are judged on the input.

Documents are dealt once, by row number, into blocks of a few MB of text and written, so
that repeated rows, however many, spread over all blocks; each step below is one call a
block or a shard, so nothing gathers the copies of a passage in one task.

1. *Sketch.*  A window is counted under its anchor: of the 18 runs of 18 words in
   it, the leftmost with the smallest hash.  Equal windows have equal anchors at
   equal offsets, so a window stands at least as often as it is counted, and there are
   about a tenth as many anchors.  Each block makes its own count-min sketch of two
   rows, in pieces of cells: the numbers of the cells that are not zero, and a mark
   where the count is two or more.
2. *Merge.*  A shard adds the blocks' sketches up over its piece of cells and tells each
   block which of its cells reach two.  A block takes the smaller estimate of the two
   rows.  Estimates are never too low, so no repeated window is lost.  Shards grow in
   number with the corpus; no sketch is broadcast or collected.
3. *Exact.*  Blocks hash the windows that the sketch leaves (128 bits of all their
   words), send each distinct hash once with a mark if it occurred twice in the
   block, and shards group them exactly and answer a bit each.
4. *Cut.*  Blocks mark the words under repeated windows and join what is left.

A passage counts once a block in every step, with a mark, however often it stands
there; so a hot one is a few bytes a block.  Words are hashed part by part, which
bounds a task's memory by its block, or by a very long text.  Null text has no words; repeated rows
repeat each other's windows; an empty table gives an empty result.  Of columns
that pass through, one with the name of a result column gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    kept_columns,
    mixed,
    string_array,
    string_buffer,
    table,
    text_bytes,
    window_hashes,
    within_documents,
    word_hashes,
    word_spans,
    written,
)

WINDOW = 35
_REPLY = "block long, kind int, shard long, bits binary"


MB = 1 << 20
#: Bytes of text in a block, and anchors in a shard: (least, most).
BLOCK_BYTES, SHARD_ANCHORS = (4 * MB, 16 * MB), (1 << 18, 1 << 22)


class Plan:
    """Sizes of a run, from the bytes of text alone."""

    def __init__(self, n_bytes: int, window: int, block_bytes: tuple[int, int] = BLOCK_BYTES, shard_anchors: tuple[int, int] = SHARD_ANCHORS):
        self.window, self.gram = window, (window + 1) // 2
        self.blocks = max(1, -(-n_bytes // min(max(n_bytes // 4096, block_bytes[0]), block_bytes[1])))
        anchors = n_bytes / 6 * 2 / (window - self.gram + 2)
        per_shard = min(max(anchors / 1024, shard_anchors[0]), shard_anchors[1])
        self.shards = max(1, int(-(-anchors // per_shard)))
        self.cells = 1 << int(np.ceil(np.log2(4 * per_shard)))


class Block:
    """The words, anchors and windows of one block of documents, in an order that every step finds again."""

    def __init__(self, group: pa.Table, plan: Plan):
        self.plan = plan
        self.rows = group.sort_by([("id", "ascending"), ("text", "ascending")])
        self.data, self.offsets = string_buffer(self.rows.column("text"))
        self.starts, self.ends, self.first = word_spans(self.data, self.offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.inside = np.flatnonzero(within_documents(self.first, plan.window))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each anchor, its shard, the anchor's number for each window)."""
        w, g = self.plan.window, self.plan.gram
        if not len(self.inside):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none
        grams = window_hashes(self.hashes, g)
        views = np.lib.stride_tricks.sliding_window_view(grams, w - g + 1)
        at = np.empty(len(self.inside), np.int64)
        for i in range(0, len(at), 1 << 18):
            at[i : i + (1 << 18)] = views[self.inside[i : i + (1 << 18)]].argmin(axis=1)
        at += self.inside
        used = np.zeros(len(grams), dtype=bool)
        used[at] = True
        number = np.cumsum(used) - 1
        hashes = grams[used]
        return hashes, ((hashes >> np.uint64(8)) % np.uint64(self.plan.shards)).astype(np.int64), number[at]

    def candidates(self, sketch_bits: dict[int, bytes]) -> tuple[np.ndarray, ...]:
        """Windows that the sketch leaves: (word number, group of each; hash 1, hash 2, shard and mark of each group)."""
        hashes, shard, number = self.anchors()
        repeated = np.zeros(len(hashes), dtype=bool)
        for s, mine in _by_shard(shard, self.plan.shards):
            bits = np.unpackbits(np.frombuffer(sketch_bits[s], np.uint8)).astype(bool)
            at, enough = 0, True
            for row in _cells(hashes[mine], self.plan.cells):
                cells, where = np.unique(row, return_inverse=True)
                enough = enough & bits[at + where]
                at += len(cells)
            repeated[mine] = enough
        at = self.inside[repeated[number]] if len(number) else self.inside
        h1 = window_hashes(self.hashes, self.plan.window)[at]
        h2 = window_hashes(word_hashes(self.data, self.starts, self.ends, 1), self.plan.window, 1)[at]
        order = np.lexsort((h2, h1))
        at, h1, h2 = at[order], h1[order], h2[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        group = np.cumsum(head) - 1
        many = np.bincount(group, minlength=int(head.sum())) > 1 if len(at) else np.zeros(0, dtype=bool)
        return at, group, h1[head], h2[head], (h1[head] % np.uint64(self.plan.shards)).astype(np.int64), many


def _by_shard(shard: np.ndarray, shards: int):
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), order[bounds[s] : bounds[s + 1]]


def _cells(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    m, mask = mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(cells - 1)
    return m & mask, (m >> np.uint64(32)) & mask


def _sketch(group: pa.Table, plan: Plan) -> pa.Table:
    """A block's sketch: for each piece of cells, those of both rows that are not zero (4 bytes each, ascending) and the marks of those at two or more."""
    block = group.column("block")[0].as_py()
    hashes, shard, _ = Block(group, plan).anchors()
    out = []
    for s, mine in _by_shard(shard, plan.shards):
        rows = [np.unique(row, return_counts=True) for row in _cells(hashes[mine], plan.cells)]
        marks = np.packbits(np.concatenate([n > 1 for _, n in rows]))
        out.append((s, block, len(rows[0][0]), np.concatenate([c for c, _ in rows]).astype("<u4").tobytes(), marks.tobytes()))
    types = {"shard": pa.int64(), "block": pa.int64(), "first": pa.int64(), "cells": pa.binary(), "marks": pa.binary()}
    return pa.table({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(types.items())})


def _answer(blocks: list[int], kind: int, shard: int, bits: list[np.ndarray]) -> pa.Table:
    n = len(blocks)
    packed = [np.packbits(b).tobytes() for b in bits]
    return pa.table({"block": pa.array(blocks, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int64()), "bits": pa.array(packed, pa.binary())})


def _merge(group: pa.Table, plan: Plan) -> pa.Table:
    """Adds the blocks' sketches of a shard up, to two at most, and tells each block which of its cells reach that."""
    total = np.zeros((2, plan.cells), np.uint8)
    parts = []
    for first, cells, marks in zip(group.column("first").to_pylist(), group.column("cells"), group.column("marks"), strict=True):
        cells = np.frombuffer(cells.as_buffer(), "<u4")
        many = 1 + np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8), count=len(cells))
        parts.append((first, cells))
        for row, part in ((total[0], slice(0, first)), (total[1], slice(first, None))):
            row[cells[part]] = np.minimum(row[cells[part]] + many[part], 2)
    bits = [np.concatenate([total[0][cells[:first]], total[1][cells[first:]]]) > 1 for first, cells in parts]
    return _answer(group.column("block").to_pylist(), 0, group.column("shard")[0].as_py(), bits)


def _replies(right: pa.Table, kind: int) -> dict[int, bytes]:
    return {s: b for k, s, b in zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(), right.column("bits").to_pylist(), strict=True) if k == kind}


def _windows(key, left: pa.Table, right: pa.Table, plan: Plan) -> pa.Table:
    """The distinct windows of a block that the sketch leaves, by shard."""
    shards, hashes, marks = [], [], []
    if left.num_rows:
        _, _, h1, h2, shard, many = Block(left, plan).candidates(_replies(right, 0))
        for s, mine in _by_shard(shard, plan.shards):
            shards.append(s)
            hashes.append(np.concatenate([h1[mine], h2[mine]]).tobytes())
            marks.append(np.packbits(many[mine]).tobytes())
    return pa.table({"shard": pa.array(shards, pa.int64()), "block": pa.array([key[0].as_py()] * len(shards), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "marks": pa.array(marks, pa.binary())})


def _exact(group: pa.Table, plan: Plan) -> pa.Table:
    """Groups the windows of a shard by all 128 bits; repeated are those of two blocks, or marked in one."""
    h1, h2, many, lens = [], [], [], []
    for hashes, marks in zip(group.column("hashes").to_pylist(), group.column("marks").to_pylist(), strict=True):
        both = np.frombuffer(hashes, np.uint64)
        n = len(both) // 2
        h1.append(both[:n])
        h2.append(both[n:])
        many.append(np.unpackbits(np.frombuffer(marks, np.uint8), count=n))
        lens.append(n)
    h1, h2, many = np.concatenate(h1), np.concatenate(h2), np.concatenate(many)
    order = np.lexsort((h2, h1))
    head = np.ones(len(order), dtype=bool)
    head[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group_of = np.cumsum(head) - 1
    total = np.bincount(group_of, weights=1 + many[order])
    flags = np.empty(len(order), dtype=bool)
    flags[order] = total[group_of] >= 2
    return _answer(group.column("block").to_pylist(), 1, group.column("shard")[0].as_py(), np.split(flags, np.cumsum(lens)[:-1]))


def _cut(key, left: pa.Table, right: pa.Table, plan: Plan, keep: list[str], spacing: str) -> pa.Table:
    """Removes the words under repeated windows."""
    block = Block(left, plan)
    at, group, h1, _, shard, _ = block.candidates(_replies(right, 0))
    repeated = np.zeros(len(h1), dtype=bool)
    replies = _replies(right, 1)
    for s, mine in _by_shard(shard, plan.shards):
        repeated[mine] = np.unpackbits(np.frombuffer(replies[s], np.uint8), count=len(mine)).astype(bool)
    n = len(block.starts)
    cover = np.zeros(n + 1, np.int32)
    hit = at[repeated[group]]
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + plan.window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    before = np.concatenate([[0], np.cumsum(gone)])
    n_words = np.diff(block.first)
    n_removed = before[block.first[1:]] - before[block.first[:-1]]
    data, offsets = _kept_text(block, gone, n_removed, spacing)
    columns = {"id": block.rows.column("id"), "text": string_array(data, offsets), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())}
    return pa.table(columns | {c: block.rows.column(c) for c in keep}).cast(pa.schema([pa.field("id", block.rows.schema.field("id").type), pa.field("text", pa.string()), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), *[block.rows.schema.field(c) for c in keep]]))


def _kept_text(block: Block, gone: np.ndarray, n_removed: np.ndarray, spacing: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of what is left.

    "single": the kept words, one space apart.  "source": the document as it was,
    less each removed word and the white space after it.
    """
    step = np.zeros(len(block.data) + 1, np.int8)
    if spacing == "single":
        here = np.flatnonzero(~gone)
        step[block.starts[here]] += 1
        step[block.ends[here]] -= 1
        keep = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        doc = np.searchsorted(block.first, here, side="right") - 1
        more = np.zeros(len(here), dtype=bool)
        more[:-1] = doc[1:] == doc[:-1]
        gap = block.ends[here[more]]
        data = block.data.copy()
        data[gap] = 32
        keep[gap] = True
    else:
        here = np.flatnonzero(gone)
        doc = np.searchsorted(block.first, here, side="right") - 1
        after = np.append(block.starts, len(block.data))[here + 1]
        step[block.starts[here]] += 1
        np.add.at(step, np.minimum(after, block.offsets[doc + 1]), -1)
        keep, data = ~(np.cumsum(step[:-1], dtype=np.int8).astype(bool)), block.data
    at = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], at[block.offsets]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, spacing: str = "single", keep: list[str] | None = None, block_bytes: tuple[int, int] = BLOCK_BYTES, shard_anchors: tuple[int, int] = SHARD_ANCHORS) -> DataFrame:
    """(id_col, text_col, n_words, n_removed, other columns): text_col holds what is left of each text.

    keep names the columns to pass through (default: all that no result column
    replaces).
    """
    made = [id_col, text_col, "n_words", "n_removed"]
    keep = kept_columns(docs, made, []) if keep is None else keep
    plan = Plan(text_bytes(docs, text_col), window, block_bytes, shard_anchors)
    inner = {c: f"keep_{i}" for i, c in enumerate(keep)}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(plan.blocks)).cast("long").alias("block"),
        F.col(id_col).alias("id"),
        text.alias("text"),
        *[F.col(c).alias(n) for c, n in inner.items()],
    )
    dealt = written(dealt)  # rows are dealt by their number, so every step must find the same ones in a block
    sketch = dealt.groupBy("block").applyInArrow(_grouped(_sketch, plan), "shard long, block long, first long, cells binary, marks binary")
    merged = sketch.groupBy("shard").applyInArrow(_grouped(_merge, plan), _REPLY)
    windows = dealt.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(_cogrouped(_windows, plan), "shard long, block long, hashes binary, marks binary")
    exact = windows.groupBy("shard").applyInArrow(_grouped(_exact, plan), _REPLY)
    schema = T.StructType([
        T.StructField("id", dealt.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        *[T.StructField(n, dealt.schema[n].dataType) for n in inner.values()],
    ])
    cut = dealt.groupBy("block").cogroup(merged.union(exact).groupBy("block")).applyInArrow(_cogrouped(_cut, plan, list(inner.values()), spacing), schema)
    return cut.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_removed", *[F.col(n).alias(c) for c, n in inner.items()])


def _grouped(step, plan: Plan):
    def run(group: pa.Table) -> pa.Table:
        return step(group, plan)

    return run


def _cogrouped(step, *args):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return step(key, left, right, *args)

    return run


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
