"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, shared_dir, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): one row per node that has a link, root the smallest node it reaches.

    Each round is two aggregations and two joins over links.  Minima are
    pre-aggregated before the shuffle and written, so that the links of a hub are a
    plain shuffle on the other side of the join, which adaptive skew joins split; the
    joins are merge joins, as both sides grow with the input and must not reach the driver.  A
    round's links are written to the shared folder; rounds end when the links stand
    still, which takes about the logarithm of the longest path.
    """
    spark = links.sparkSession
    flat = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    at = shared_dir(spark)
    edges, mark = written(flat, at), None
    while True:
        found = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if found["n"] == 0 or (found["n"], found["h"]) == mark:
            break
        mark, steps = (found["n"], found["h"]), []

        def kept(df: DataFrame, steps: list[str] = steps) -> DataFrame:
            steps.append(shared_dir(spark))
            return written(df, steps[-1])

        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = kept(both.filter("b > a").join(hub.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = small.union(low.select("a", F.col("m").alias("b"))).distinct()
        old, at = [at, *steps], shared_dir(spark)
        edges = written(step, at)
        for path in old:
            removed(spark, path)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
