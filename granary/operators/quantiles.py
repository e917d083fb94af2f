"""Ranks and interpolated percentiles of groups of any size, by ranges of a sorted order.

The built-in exact percentile keeps a map of all distinct values of a group in one
aggregation buffer, and a ranking window sorts a group in one task.  Here the distinct
values of all groups, with their counts, are sorted by group and value in ranges that Spark
samples: a large group takes as many ranges as it needs, small ones share one.  Counts are
summed up by group and range, those before a range are added up over the ranges of its
group (a row each), and only then ranks are taken inside ranges: all of them (``placed``),
or just in the ranges that hold a wanted rank (``exact_percentiles``).  A range is a task's
work, so more data means more ranges, not larger ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

_C, _R, _BEFORE, _ALL = "c__", "range__", "before__", "all__"


def _ranged(df: DataFrame, keys: list[str], value: str, ranges: int | None) -> tuple[DataFrame, DataFrame]:
    """(the counts of non-null values with their range, the ranges of each group with what is before them and in the group)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(_C))
    order = [*[F.col(k) for k in keys], F.col(value)]
    dealt = counts.repartitionByRange(*([ranges] if ranges else []), *order).withColumn(_R, F.spark_partition_id())
    dealt = written(dealt)
    sums = dealt.groupBy(*keys, _R).agg(F.sum(_C).alias("s"))
    group = Window.partitionBy(*keys)
    own = [F.col(k).alias(f"s__{k}") for k in [*keys, _R]]  # under other names, as both are joined
    return dealt, sums.select(*own, (F.sum("s").over(group.orderBy(_R)) - F.col("s")).alias(_BEFORE), F.sum("s").over(group).alias(_ALL), "s")


def _looked_up(dealt: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """The counts with what is before and in all of their group; equal keys, nulls too."""
    same = F.col(_R) == F.col(f"s__{_R}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"s__{k}"))
    return dealt.join(sums, same).drop(*[f"s__{k}" for k in [*keys, _R]])


def placed(df: DataFrame, keys: list[str], value: str, below: str, here: str, total: str, ranges: int | None = None) -> DataFrame:
    """(keys, value, below, here, total) of each distinct non-null value: rows of its group under it, with it and in all; written, as it is there to be joined."""
    dealt, sums = _ranged(df, keys, value, ranges)
    rows = _looked_up(dealt, sums, keys)
    within = Window.partitionBy(*keys, _R).orderBy(value)
    return written(rows.select(*keys, value, (F.col(_BEFORE) + F.sum(_C).over(within) - F.col(_C)).alias(below), F.col(_C).alias(here), F.col(_ALL).alias(total)))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], n: str = "n", ranges: int | None = None) -> DataFrame:
    """(keys, n, one column a prob): like percentile_cont over the non-null values; groups without any are absent."""
    dealt, sums = _ranged(df, keys, value, ranges)
    ranks = {}
    for name, p in probs.items():
        at = F.lit(p) * (F.col(_ALL) - 1)
        ranks[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    inside = lambda k, a, b: (k >= a) & (k < b)
    wanted = F.lit(False)
    for low, high, _ in ranks.values():
        for k in (low, high):
            wanted = wanted | inside(k, F.col(_BEFORE), F.col(_BEFORE) + F.col("s"))
    hit = sums.filter(wanted)
    rows = _looked_up(dealt, hit, keys).withColumnRenamed(value, "v__")
    upto = F.col(_BEFORE) + F.sum(_C).over(Window.partitionBy(*keys, _R).orderBy("v__"))
    rows = rows.withColumn("to__", upto).withColumn("from__", F.col("to__") - F.col(_C))
    parts = [F.max(_ALL).alias(n)]
    for name, (low, high, _) in ranks.items():
        parts += [F.max(F.when(inside(k, F.col("from__"), F.col("to__")), F.col("v__"))).alias(f"__{name}_{side}") for k, side in ((low, "low"), (high, "high"))]
    found = rows.groupBy(*keys).agg(*parts).withColumn(_ALL, F.col(n))
    shares = {name: F.col(f"__{name}_low") + (F.col(f"__{name}_high") - F.col(f"__{name}_low")) * part for name, (_, _, part) in ranks.items()}
    return found.select(*keys, n, *[c.alias(name) for name, c in shares.items()])
