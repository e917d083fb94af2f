"""Joins on ranges without an equality: intervals that meet, and values within a tolerance.

Both sides are put into bins, so that Spark joins by equality of bins and never by a
nested loop.  A hot bin is split like any hot join key, as both sides are plain shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def meeting(left: DataFrame, right: DataFrame, start: str, end: str, width: int, prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs whose intervals [start, end] (whole numbers) meet, columns under the prefixes.

    An interval is a row in each bin of the given width that it meets; a pair that meets in
    several bins counts in the first of them only.  Null or reversed intervals meet nothing.
    Choose a width of about the usual interval: longer ones take more rows, and wider bins
    more comparisons.
    """
    a, b = prefixes

    def binned(df: DataFrame, p: str) -> DataFrame:
        there = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
        named = _named(there, p).withColumn(f"{p}first__", F.floor(F.col(f"{p}{start}") / width))
        return named.withColumn("bin__", F.explode(F.sequence(F.col(f"{p}first__"), F.floor(F.col(f"{p}{end}") / width))))

    both = binned(left, a).join(binned(right, b), "bin__")
    first = F.col("bin__") == F.greatest(f"{a}first__", f"{b}first__")
    meet = (F.col(f"{a}{start}") <= F.col(f"{b}{end}")) & (F.col(f"{b}{start}") <= F.col(f"{a}{end}"))
    return both.filter(first & meet).drop("bin__", f"{a}first__", f"{b}first__")


def within(left: DataFrame, right: DataFrame, value: str, tolerance: float, condition: Column | None = None, prefixes: tuple[str, str] = ("a_", "b_")) -> DataFrame:
    """Pairs whose values are at most tolerance apart, and that meet a further condition on the prefixed columns.

    The right side is in the bin of its value, the left side in that and the two beside it,
    so each pair is found once.  Null values find nothing.
    """
    a, b = prefixes
    bin_of = lambda c: F.floor(F.col(c) / float(tolerance or 1))
    x = _named(left.filter(F.col(value).isNotNull()), a).withColumn("bin__", F.explode(F.sequence(bin_of(f"{a}{value}") - 1, bin_of(f"{a}{value}") + 1)))
    y = _named(right.filter(F.col(value).isNotNull()), b).withColumn("bin__", bin_of(f"{b}{value}"))
    found = x.join(y, "bin__").filter(F.abs(F.col(f"{a}{value}") - F.col(f"{b}{value}")) <= tolerance).drop("bin__")
    return found if condition is None else found.filter(condition)
