"""A Bloom filter of 64-bit keys as one row of longs, tested inside column expressions.

Bits are set by a distributed bit_or, added up before the shuffle, and put into one array,
whose size is fixed by ``MOST_BITS`` however many keys there are: with more keys more tests
succeed in vain, and what passes must be compared exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key, and the least and most bits of a filter (8 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 10, 1 << 26


def _probes(key: Column, bits: Column | int) -> list[Column]:
    """Two bits of a key, from its two halves."""
    mask = F.lit(bits) - 1 if isinstance(bits, int) else bits - 1
    return [key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask)]


def bloom(keys: DataFrame, key: str, most: int = MOST_BITS) -> DataFrame:
    """One row (words array<long>) over the distinct keys."""
    n = keys.agg(F.approx_count_distinct(key).alias("n")).first()["n"]
    bits = LEAST_BITS
    while bits < min(n * BITS_A_KEY, most):
        bits *= 2
    probe = keys.select(F.explode(F.array(*_probes(F.col(key), bits))).alias("p"))
    words = probe.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("m"))
    every = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("m", F.lit(0).cast("long")).alias("m"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda x: x["m"]).alias("words"))


def may_hold(words: Column, key: Column) -> Column:
    """False only for keys that the filter was not made of."""
    bits = F.size(words).cast("long") * 64
    is_set = lambda p: F.getbit(F.get(words, F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
    first, second = _probes(key, bits)
    return is_set(first) & is_set(second)
