"""Suffix arrays over many sequences by distributed prefix doubling (operators 5 and 7).

A sequence is a document's symbols (ids of lines, of tokens); a suffix has the key
(ih, th), two hashes of its document, and its position pos.

``sorted_suffixes`` sorts suffixes by ranges of their first symbols, at most ``WIDTH``:
the doublings from 1 to WIDTH in one sort.  A pass over the sorted rows gives each
suffix its place and its common prefix with the one before.  Ranges are cut by symbols
and place in the corpus, so a line of a third of all documents spreads over many.

``refined`` doubles on from there, for suffixes that are looked at more deeply: those
that share their first WIDTH * 2**k symbols are told apart by the rank of the suffix
that many symbols further on.  Only suffixes whose rank is shared and that are still
looked at go on, so the working set shrinks; it ends when there are none.  Pairs of
ranks are counted before they are shuffled and looked up in written tables, which Spark
broadcasts if they are small and against which it can split a skewed key otherwise.

Running sums are made range by range; what passes the driver is one row a range.
Sequences end in a mark of their own, so equal sequences share their symbols, no more.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

KEY = ["ih", "th", "pos"]
#: Symbols in a sort key, and bytes of a symbol's id.
WIDTH, ID = 8, 16


def keys_of(ids: np.ndarray, at: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Sort keys: the ids (n x 2 unsigned 64-bit) of lens symbols from each of the places at."""
    ends = np.cumsum(lens)
    which = np.arange(int(lens.sum())) + np.repeat(at - (ends - lens), lens)
    offsets = np.concatenate([[0], ends]).astype(np.int32) * ID
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids[which]))])


def _shared(column: pa.Array) -> np.ndarray:
    """Common leading symbols of each key with the one before; 0 for the first."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    words = np.frombuffer(data, np.uint64) if data is not None and len(data) else np.zeros(0, np.uint64)
    at, lens = offsets[:-1] // 8, np.diff(offsets) // ID
    out, on = np.zeros(len(column), np.int64), np.arange(1, len(column))
    for j in range(WIDTH):
        on = on[(lens[on] > j) & (lens[on - 1] > j)]
        a, b = at[on] + 2 * j, at[on - 1] + 2 * j
        on = on[(words[a] == words[b]) & (words[a + 1] == words[b + 1])]
        out[on] += 1
    return out


def _neighbours(batches, key_at: int):
    """Adds at (place in the partition), lcp and after: common prefixes with the rows before and after; of the last row: WIDTH, not known."""
    held, n, lcp = None, 0, np.zeros(0, np.int64)

    def out(rows: pa.RecordBatch, lcp: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(n + np.arange(len(lcp))), pa.array(lcp), pa.array(after)], names=[*rows.schema.names, "at", "lcp", "after"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in KEY])
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
        if not new.all():
            rows = rows.filter(pa.array(new))
        found = _shared(rows.column(key_at))
        if held is not None:
            found[0] = lcp[0]
        if len(found) > 1:
            yield out(rows.slice(0, len(found) - 1), found[:-1], found[1:])
            n += len(found) - 1
        held, lcp = rows.slice(len(found) - 1), found[-1:]
    if held is not None:
        yield out(held, lcp, np.array([WIDTH]))


def _common(a: str, b: str) -> Column:
    """Common leading symbols of two keys."""
    same = lambda j: (F.octet_length(a) >= j * ID) & (F.octet_length(b) >= j * ID) & (F.substring(a, F.lit(1), j * ID) == F.substring(b, F.lit(1), j * ID))
    return F.size(F.filter(F.array(*[F.lit(j) for j in range(1, WIDTH + 1)]), same)).cast("long")


def _upto() -> Window:
    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def sorted_suffixes(suffixes: DataFrame) -> DataFrame:
    """suffixes (KEY, key, ...) with i (place in the sorted order), lcp and after (common prefix with the neighbours, at most WIDTH); repeated rows are one."""
    order = ["key", *KEY]
    ranges = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    made = [T.StructField(c, T.LongType()) for c in ("at", "lcp", "after")]
    ranges = written(ranges.mapInArrow(functools.partial(_neighbours, key_at=ranges.columns.index("key")), T.StructType([*ranges.schema.fields, *made])))
    parts = ranges.groupBy("part").agg(F.count("*").alias("n"), F.min_by("key", "at").alias("head"), F.max_by("key", "at").alias("tail"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(_upto()), F.lit(0))).withColumn("tail", F.lag("tail").over(Window.orderBy("part")))
    parts = parts.select("part", "before", F.coalesce(F.when(F.col("tail").isNotNull(), _common("head", "tail")), F.lit(0)).alias("border"))
    out = ranges.join(F.broadcast(parts), "part")
    return out.select(*suffixes.columns, (F.col("before") + F.col("at")).alias("i"), F.when(F.col("at") == 0, F.col("border")).otherwise(F.col("lcp")).alias("lcp"), "after")


def _summed(batches, at: int):
    total = 0
    for batch in batches:
        weight = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = total + np.cumsum(weight)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - weight)], names=[*batch.schema.names, "start"])
        total = int(ends[-1]) if len(ends) else total


def running(rows: DataFrame, order: list[str], weight: str) -> DataFrame:
    """rows with start: the sum of weight over all rows before, in an order without ties."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ranges.schema.fields, T.StructField("start", T.LongType())])
    ranges = written(ranges.mapInArrow(functools.partial(_summed, at=ranges.columns.index(weight)), schema))
    sums = ranges.groupBy("part").agg(F.sum(weight).alias("all"))
    before = sums.select("part", F.coalesce(F.sum("all").over(_upto()), F.lit(0)).alias("before"))
    return ranges.join(F.broadcast(before), "part").select(*rows.columns, (F.col("start") + F.col("before")).alias("start"))


def intervals(tests: DataFrame) -> DataFrame:
    """tests (depth, i, lcp, ...) with interval: equal for suffixes that share their first depth symbols.

    Such suffixes stand next to each other in the array, and each has a common prefix of
    depth or more with the one before: an interval begins where that is shorter.  Whether
    a suffix is tested at a depth must follow from its first depth symbols.
    """
    marked = tests.withColumn("begins", (F.col("lcp") < F.col("depth")).cast("long"))
    return running(marked, ["depth", "i"], "begins").withColumn("interval", F.col("start") + F.col("begins")).drop("start", "begins", "lcp")


def refined(suffixes: DataFrame) -> DataFrame:
    """(KEY, i, lcp) of suffixes that are looked at more deeply than WIDTH: their order and common prefixes to the depth of the look.

    suffixes: KEY, key, i, lcp from sorted_suffixes, with most (the deepest look at this
    suffix, or null) and need (how many symbols of it lie under deep looks).
    """
    chains = running(suffixes.withColumn("begins", (F.col("lcp") < WIDTH).cast("long")).select(*KEY, "i", "need", "begins"), ["i"], "begins")
    chains = chains.withColumn("chain", F.col("start") + F.col("begins"))
    ranks = written(chains.groupBy("chain").agg(F.min("i").alias("r"), F.count("*").alias("n")))
    first = written(chains.join(ranks, "chain").select(*KEY, "need", "r", "n"))
    # tied: what follows is the end, or tied itself; the suffix shares no more, though its rank may be another's too
    goes_on = (F.col("n") > 1) & ~F.col("tied") & (F.col("need") > F.lit(WIDTH))
    first = first.withColumn("tied", F.lit(False))
    live, fixed, k = first.filter(goes_on).drop("n"), [first.filter(~goes_on).drop("n")], 0
    shared = [live.select(*KEY, F.lit(0).alias("k"), "r")]
    while not live.isEmpty():
        reach = WIDTH << k
        latest = functools.reduce(DataFrame.union, fixed, live)
        ahead = latest.filter(F.col("pos") >= reach).select("ih", "th", (F.col("pos") - reach).alias("pos"), F.col("r").alias("b"), "tied")
        pairs = written(live.select(*KEY, "need", F.col("r").alias("a")).join(ahead, KEY, "left"))
        starts = running(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "n")
        heads = written(starts.groupBy("a").agg(F.min("start").alias("first")))
        named = written(starts.filter("b IS NOT NULL").join(heads, "a").select("a", "b", "n", (F.col("a") + F.col("start") - F.col("first")).alias("r")))
        moved = written(pairs.filter("b IS NOT NULL").join(named, ["a", "b"]).select(*KEY, "need", "r", "n", "tied"))
        ended = pairs.filter("b IS NULL").select(*KEY, "need", F.col("a").alias("r"), F.lit(True).alias("tied"))
        goes_on = (F.col("n") > 1) & ~F.col("tied") & (F.col("need") > F.lit(2 * reach))
        live, k = moved.filter(goes_on).drop("n"), k + 1
        fixed += [ended, moved.filter(~goes_on).drop("n")]
        shared.append(moved.filter("n > 1 AND NOT tied").select(*KEY, F.lit(k).alias("k"), "r"))
    order = functools.reduce(DataFrame.union, fixed, live).select(*KEY, "r")
    ranks = F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"])
    depths = functools.reduce(DataFrame.union, shared).groupBy(*KEY).agg(ranks.alias("rs"))
    depths = written(suffixes.select(*KEY, "key").join(depths, KEY, "left").withColumn("rs", F.coalesce("rs", F.array().cast("array<bigint>"))))
    looked = suffixes.filter(F.col("most") > WIDTH).select(*KEY, "most")
    array = running(looked.join(order, KEY).withColumn("one", F.lit(1)), ["r", *KEY], "one").withColumnRenamed("start", "i")
    array = written(array.select(*KEY, "i", "most"))
    return array.select(*KEY, "i").join(_common_prefixes(array, depths), "i", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))


def _common_prefixes(array: DataFrame, depths: DataFrame) -> DataFrame:
    """(i, lcp): the common prefix of each suffix of the array with the one before, followed to most symbols at least if it goes so far.

    Where ranks at depth WIDTH * 2**c agree, that many symbols do, and the rest is
    compared further on: each step at least halves what can be left.
    """
    names = {"ih": "ih2", "th": "th2", "pos": "pos2"}
    before = array.select((F.col("i") + 1).alias("i"), *[F.col(a).alias(b) for a, b in names.items()])
    left = depths.select(*KEY, F.col("rs").alias("x"), F.col("key").alias("u"))
    right = depths.select(*[F.col(a).alias(b) for a, b in names.items()], F.col("rs").alias("y"), F.col("key").alias("v"))
    open_ = written(array.join(before, "i").withColumn("lcp", F.lit(0).cast("long")))
    found = [open_.select("i", "lcp")]
    while not open_.isEmpty():
        met = open_.join(left, KEY).join(right, [*names.values()])
        agreed = F.size(F.filter(F.zip_with("x", "y", lambda x, y: x == y), lambda same: same))
        met = met.withColumn("c", agreed).withColumn("step", F.when(F.col("c") > 0, F.call_function("shiftleft", F.lit(WIDTH).cast("long"), F.col("c") - 1)).otherwise(_common("u", "v")))
        met = written(met.select("i", "ih", "th", (F.col("pos") + F.col("step")).alias("pos"), "ih2", "th2", (F.col("pos2") + F.col("step")).alias("pos2"), "most", (F.col("lcp") + F.col("step")).alias("lcp"), "c"))
        found.append(met.select("i", "lcp"))
        open_ = met.filter("c > 0 AND lcp < most").drop("c")
    return functools.reduce(DataFrame.union, found).groupBy("i").agg(F.max("lcp").alias("lcp"))
