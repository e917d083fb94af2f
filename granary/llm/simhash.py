"""Operator 6: SimHash near-duplicates by multi-index hashing.

Each text gets a 64-bit SimHash fingerprint over its 3-word shingles.  Equal
fingerprints form one class at once, so a group of exact copies, however large,
is one row from there on.  Distinct fingerprints are cut into two 32-bit
segments.  Two fingerprints at most 2 bits apart have a segment at most 1 bit
apart, so each fingerprint enumerates the ball of radius 1 around each of its
segments (the upper half of its 33 values: of two values one bit apart, the one
without the bit finds the other), fetches the table of fingerprints by segment value and
verifies the complete distance.

A segment value shared by many distinct fingerprints (a large group of near
copies) is not paired out.  There, members are told apart by a second ball in
the other segment and linked to the smallest member at the same key; all that
meet at such a key are within 2 bits of each other, and every pair within 2
bits meets at one.  So the work stays in proportion to the fingerprints and no
link is lost.  Components follow by alternating large-star and small-star
joins over links written to the shared folder.

What is looked up is written first, so that the side with a hot fingerprint or segment
value is a plain shuffle, which adaptive skew joins split.  All joins are merge joins:
their sides grow with the input, and a written table's size on disk (dictionaries, runs)
or before an explode says little of its rows, so a broadcast by estimate would
fill the driver.

Null or empty texts have fingerprint zero and are linked like any other; null
ids are returned, and never name a component unless it has no other id.
Repeated rows share their fingerprint; very long texts are hashed in slices; an empty
table gives an empty result; other columns are not passed through, so their names
cannot clash.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_slices, string_buffer, table, word_spans, written
from .graph import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Distinct fingerprints at one segment value beyond which members are linked by stars.
DENSE = 32
#: Shingles and bytes of text handled at once in a task.
_CHUNK, _SLICE = 1 << 16, 1 << 20


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """SimHash of each document of a string buffer, as uint64."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    # the same words, lower-cased and one space apart
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    lens = ends - starts
    at = np.concatenate([[0], np.cumsum(lens + 1)])[:-1] if len(starts) else starts
    joined = np.full(int(at[-1] + lens[-1]) if len(starts) else 0, 32, np.uint8)
    if len(starts):
        joined[np.arange(int(lens.sum())) + np.repeat(at - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)] = lower[
            np.arange(int(lens.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
        ]
    buffer = joined.tobytes()
    counts = np.zeros((n, 64), np.int64)
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), n_shingles)
    begin = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n_shingles)[:-1]]), n_shingles) + np.arange(len(doc)) if n else doc
    last = np.minimum(begin + width - 1, (first[1:] - 1)[doc]) if n else begin
    a, b = (at[begin], at[last] + lens[last]) if len(begin) else (begin, begin)
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    for i in range(0, len(doc), _CHUNK):
        d = doc[i : i + _CHUNK]
        h = np.fromiter((digest(buffer[x:y]) for x, y in zip(a[i : i + _CHUNK].tolist(), b[i : i + _CHUNK].tolist(), strict=True)), np.uint64, len(d))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        counts[d[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    set_bits = (2 * counts > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel() if n else np.zeros(0, np.uint64)


def _map_fingerprints(batches):
    for batch in batches:
        for a, b in row_slices(batch.column(1), _SLICE):
            part = batch.slice(a, b - a)
            fp = fingerprints(*string_buffer(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per input row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_map_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


_LOW = 0xFFFFFFFF


def _segment(fp: Column, which: Column | int) -> Column:
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(_LOW))
    return F.when(F.lit(which) == 1, high).otherwise(low) if isinstance(which, int) else F.when(which == 1, high).otherwise(low)


def _ball() -> Column:
    """Masks of weight 0 and 1 over 32 bits: the ball of radius 1."""
    return F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)]])


def _key(which: Column, value: Column) -> Column:
    return F.shiftleft(which.cast("long"), 32).bitwiseOR(value)


def links(distinct_fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints that chains of steps of at most RADIUS bits join."""
    side = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = distinct_fps.select("fp", side.alias("s")).select("fp", "s", _segment(F.col("fp"), F.col("s")).alias("v"))
    members = rows.select("fp", "s", _key(F.col("s"), F.col("v")).alias("key"))
    # written, so that a dense key on the other side of a join is a plain shuffle, which Spark splits
    sizes = written(members.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("one")))
    # of two values one bit apart the one without the bit finds the other: half a ball each
    upward = F.filter(_ball(), lambda m: m.bitwiseAND(F.col("v")) == 0)
    probes = rows.select("fp", "s", "v", F.explode(upward).alias("mask")).select("fp", "s", (F.col("mask") != 0).alias("off"), _key(F.col("s"), F.col("v").bitwiseXOR(F.col("mask"))).alias("key"))
    hits = written(probes.join(sizes.hint("merge"), "key").filter("n > 1 OR one <> fp").select("key", "fp", "s", "off", "n"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS
    table_ = members.select("key", F.col("fp").alias("other"))
    sparse = hits.filter(F.col("n") <= dense).join(table_.hint("merge"), "key").filter((F.col("off") | (F.col("other") < F.col("fp"))) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    rest = _segment(F.col("fp"), F.lit(1) - F.col("s"))
    centre = F.explode(F.when(F.col("off"), F.array(rest)).otherwise(F.transform(_ball(), lambda m: m.bitwiseXOR(rest))))
    met = hits.filter(F.col("n") > dense).select("key", "fp", centre.alias("centre"))
    hub = written(met.groupBy("key", "centre").agg(F.min("fp").alias("b"), F.count("*").alias("c")).filter("c > 1"))
    stars = met.join(hub.hint("merge"), ["key", "centre"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return sparse.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id reachable over links of at most RADIUS bits."""
    prints = written(with_fingerprints(docs, id_col, text_col))
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("first")))
    linked = components(links(classes.select("fp")))
    spread = linked.join(classes.withColumnRenamed("fp", "node").hint("merge"), "node")
    lowest = spread.groupBy("root").agg(F.min("first").alias("component"))
    named = linked.join(lowest.hint("merge"), "root").select(F.col("node").alias("fp"), "component")
    by_class = written(classes.join(named.hint("merge"), "fp", "left").select("fp", F.coalesce("component", "first").alias("component")))
    return prints.join(by_class.hint("merge"), "fp").select("id", "fp", "component")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
