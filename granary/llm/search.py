"""Operator 2: exact top-k inner-product search over a bit-sliced index.

Each component x is quantised to floor(SCALE * x).  The candidates are dealt out
in blocks; a block's index holds, for every component, one bitmap a bit of the
quantised value (less the smallest value of the table), a bit a row.

A query's score over all rows of a block is a sum of such slices: each set bit of
a weight adds the component's slices, shifted; negative weights add the
complemented slices, and the constants that come with that are taken off at the
end.  Full adders turn three bitmaps of one place into one of that place and one
of the next until each place has one bitmap.  The best k rows are then selected
from the most significant slice downward: rows that lead at some slice are in,
rows that trail are out, and those that are equal in every slice are the boundary,
of which the smallest ids are taken.  Scores are read back from the slices.

A block's index is built once and written as one row of bytes.  Queries go in groups
to all blocks; a block answers k rows a query at most, and the best k of those are the
result.  Blocks and groups grow with the table up to a fixed size, so a task's memory
is bounded, and no vector passes the driver.

Rows whose id or vector is null, or whose vector holds null or non-finite components,
take no part.  Bitmaps are as wide as the table's components need; a component or a
score that does not fit a long raises an error, and no row is left out for its size.
Vectors of different lengths are filled up with zeros.  Every row is a candidate of
its own, repeated rows too, for all queries but itself; rows that share an id are
queries of their own.  Ties go to the smaller id; an empty table gives an empty
result; other columns are not passed through, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE, K, EVERY = 256, 5, 50
BLOCK_ROWS, GROUP_ROWS = (8_192, 131_072), (128, 16_384)
#: Bytes of a block's bitmaps at most.
BLOCK_BYTES = 32 << 20


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """array<bigint>, or null where the vector takes no part."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    whole = F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < float(1 << 62), F.floor(scaled(x)).cast("bigint")).otherwise(F.raise_error(F.lit("a quantised component does not fit a long")).cast("bigint")))
    return F.when(finite, whole)


class Slices:
    """The bit-sliced index of a block: rows in ascending order of id and slices[component, bit, word]."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, slices: np.ndarray, low: int):
        self.ids, self.uids, self.slices, self.low = ids, uids, slices, low
        self.bits, self.words = slices.shape[1:]
        self.place = {u: r for r, u in enumerate(uids.tolist())}
        rows = np.zeros(self.words * 8, np.uint8)
        full = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
        rows[: len(full)] = full
        self.rows = rows.view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, uids: np.ndarray, values: np.ndarray, low: int, bits: int) -> Slices:
        order = np.lexsort((uids, ids))
        raised = values[order].view(np.uint64).T - np.uint64(low % (1 << 64))
        packed = np.zeros((raised.shape[0], bits, max(1, -(-len(ids) // 64)) * 8), np.uint8)
        for b in range(bits):
            plane = np.packbits(((raised >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
            packed[:, b, : plane.shape[1]] = plane
        return cls(ids[order], uids[order], packed.view(np.uint64), low)

    def score(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(a bitmap for each place of the scores, the constant to add to what they say)."""
        size, places = np.abs(query), []
        for j in range(int(size.max(initial=0)).bit_length()):
            weighed = (size >> j) & 1 == 1
            for sign, flip in ((query > 0, False), (query < 0, True)):
                if (mine := np.flatnonzero(weighed & sign)).size:
                    places.append((j, ~self.slices[mine] if flip else self.slices[mine]))
        columns: list[list[np.ndarray]] = []
        for j, planes in places:
            while len(columns) < j + self.bits:
                columns.append([])
            for b in range(self.bits):
                columns[j + b].append(planes[:, b])
        sums, carried, i = [], [], 0
        while i < len(columns) or carried:
            column = np.concatenate([*(columns[i] if i < len(columns) else []), *carried]) if i < len(columns) and columns[i] or carried else np.zeros((1, self.words), np.uint64)
            column, carried = _one_left(column)
            sums.append(column)
            i += 1
        top = (1 << self.bits) - 1
        weight_up, weight_down = sum(size[query > 0].tolist()), sum(size[query < 0].tolist())
        return sums, self.low * (weight_up - weight_down) - top * weight_down

    def best(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, list[int]]:
        """(ids, scores) of the k best rows, without the row own."""
        places, constant = self.score(query)
        tied, sure = self.rows.copy(), np.zeros(self.words, np.uint64)
        if (r := self.place.get(own)) is not None:
            tied[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        need = k
        for plane in reversed(places):
            ahead = tied & plane
            n = int(np.bitwise_count(ahead).sum())
            if n >= need:
                tied = ahead
            else:
                sure |= ahead
                need -= n
                tied &= ~plane
        rows = np.concatenate([_rows(sure), _rows(tied)[:need]])
        scores = [constant] * len(rows)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for i, plane in enumerate(places):
            scores = [s + (b << i) for s, b in zip(scores, ((plane[word] >> bit) & np.uint64(1)).tolist(), strict=True)]
        return self.ids[rows], scores


def _one_left(column: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Full and half adders on the bitmaps of a place until one is left; and the carries to the next place."""
    carried = []
    while len(column) > 2:
        third = len(column) // 3
        a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
        either = a ^ b
        carried.append((a & b) | (either & c))
        column = np.concatenate([either ^ c, column[3 * third :]])
    if len(column) == 2:
        carried.append(column[:1] & column[1:])
        return column[0] ^ column[1], carried
    return column[0], carried


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as rows of dims numbers, filled up with zeros."""
    lists = column.combine_chunks()
    lens = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < lens[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _bytes(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _indexed(low: int, bits: int, dims: int):
    """The rows of a block -> one row: its index."""

    def build(group: pa.Table) -> pa.Table:
        x = Slices.of(group.column("id").to_numpy(), group.column("uid").to_numpy(), _matrix(group.column("x"), dims), low, bits)
        return pa.table([group.column("block").combine_chunks()[:1], *_bytes(x.ids, x.uids, x.slices)], names=["block", "ids", "uids", "slices"])

    return build


def _grouped(dims: int):
    """The queries of a group -> one row."""

    def gather(group: pa.Table) -> pa.Table:
        arrays = _bytes(group.column("id").to_numpy(), group.column("uid").to_numpy(), _matrix(group.column("x"), dims))
        return pa.table([group.column("part").combine_chunks()[:1], *arrays], names=["part", "ids", "uids", "x"])

    return gather


def _answers(k: int, low: int, bits: int, dims: int):
    def search(key: tuple, block: pa.Table, queries: pa.Table) -> pa.Table:
        longs = lambda t, c: np.frombuffer(t.column(c)[0].as_py(), np.int64)
        out: list[list] = [[], [], [], []]
        if block.num_rows and queries.num_rows:
            slices = np.frombuffer(block.column("slices")[0].as_py(), np.uint64).reshape(dims, bits, -1)
            index = Slices(longs(block, "ids"), longs(block, "uids"), slices, low)
            for id_, own, q in zip(longs(queries, "ids").tolist(), longs(queries, "uids").tolist(), longs(queries, "x").reshape(-1, dims), strict=True):
                ids, scores = index.best(q, k, own)
                for column, values in zip(out, ([own] * len(ids), [id_] * len(ids), ids.tolist(), scores), strict=True):
                    column += values
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("q", "query_id", "vec_id", "score"), out, strict=True)})

    return search


def _between(n: int, bounds: tuple[int, int]) -> int:
    return min(max(n, bounds[0]), bounds[1])


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block_rows: tuple[int, int] = BLOCK_ROWS, group_rows: tuple[int, int] = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row where is_query holds."""
    marked = rows.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    marked = written(marked.filter("id IS NOT NULL AND x IS NOT NULL").withColumn("uid", F.monotonically_increasing_id()))
    size = marked.agg(
        F.count("*").alias("n"), F.count_if("q").alias("q"), F.max(F.size("x")).alias("dims"), F.min(F.coalesce(F.array_min("x"), F.lit(0))).alias("low"), F.max(F.coalesce(F.array_max("x"), F.lit(0))).alias("high")
    ).first()
    dims, low, high = max(size["dims"] or 0, 1), min(size["low"] or 0, 0), max(size["high"] or 0, 0)
    bits = max(1, (high - low).bit_length())
    most = max(64, min(block_rows[1], BLOCK_BYTES * 8 // (dims * bits)))
    blocks = max(1, -(-size["n"] // _between(size["n"] // 64, (min(block_rows[0], most), most))))
    groups = max(1, -(-size["q"] // _between(size["q"] // 64, group_rows)))
    part = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = written(marked.select("id", "uid", "x", part(blocks, 1).alias("block")).groupBy("block").applyInArrow(_indexed(low, bits, dims), "block int, ids binary, uids binary, slices binary"))
    queries = marked.filter("q").select("id", "uid", "x", part(groups, 2).alias("part")).groupBy("part").applyInArrow(_grouped(dims), "part int, ids binary, uids binary, x binary")
    pairs = (index.withColumn("part", every(groups)).groupBy("block", "part"), queries.withColumn("block", every(blocks)).groupBy("block", "part"))
    found = pairs[0].cogroup(pairs[1]).applyInArrow(_answers(k, low, bits, dims), "q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP2_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
