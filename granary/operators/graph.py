"""Tables written to the shared folder, and connected components of small-diameter link tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder; a local session without one (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    _MADE.append(f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}")
    return _MADE[-1]


#: Folders handed out in this process and not released yet.
_MADE: list[str] = []


def mark() -> int:
    """A point from which release() counts."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that queries have written since a mark, for when their results have been read or written themselves."""
    for at in _MADE[since:]:
        removed(spark, at)
    del _MADE[since:]


def written(df: DataFrame, at: str | None = None, **options: str) -> DataFrame:
    """df written to the shared folder (options as of parquet) and read again: later steps do not recompute it."""
    at = at or shared_dir(df.sparkSession)
    df.write.parquet(at, **options)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def removed(spark: SparkSession, at: str) -> None:
    """Delete a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if at in _MADE:
        _MADE.remove(at)


def exists(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, root): root is the smallest id that id reaches.

    Smallest labels spread over the links and then along labels (a label takes the
    label of its own label), so rounds grow with the logarithm of the longest path.
    Minima are pre-aggregated before each shuffle; every round's labels are written.
    """
    spark = links.sparkSession
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = shared_dir(spark)
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), at)
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        near = labels.join(seen, F.col("id") == F.col("a")).select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        old, at = at, shared_dir(spark)
        step = written(near.join(jump, "root").select("id", "old", F.least("root", "far").alias("root")), at)
        removed(spark, old)
        labels = step.select("id", "root")
        if step.filter("root <> old").isEmpty():
            return labels
