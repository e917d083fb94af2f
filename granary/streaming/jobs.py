"""Structured Streaming jobs: a drain in micro-batches, upserts and daily counts."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from granary.registry import query
from granary.sources.tables import table


class _Ticks(StreamingQueryListener):
    """Counts a query's finished batches, so that it can be stopped between two of them."""

    def __init__(self):
        self.done, self.ended = threading.Event(), threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.done.set()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.done.set()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()
        self.done.set()


def drain(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform=lambda df: df, files_per_batch: int = 24, rows_per_task: int | None = None, deadline: float | None = None) -> bool:
    """Work off all files that are there, files_per_batch at a time, and stop; True if nothing is left.

    With rows_per_task a batch is dealt into tasks of at most that many rows (and one or two
    more), so that what transform does to a task's rows, calls of a service say, is bounded
    however large a file is; as many run at once as there are cores.  With a deadline
    (seconds) the query is stopped behind the first batch that ends after it.  What is done
    is kept in the checkpoint: run again, it goes on where it ended, only new files are
    read, and a batch that was broken off is done again under its own number, replacing
    what it wrote.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def work(batch: DataFrame, number: int) -> None:
        if rows_per_task:
            batch = batch.repartition(max(1, -(-batch.count() // rows_per_task)))
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    ticks, start = _Ticks(), time.monotonic()
    spark.streams.addListener(ticks)
    try:
        running = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        while running.isActive:
            ticks.done.wait(0.2)
            late = deadline is not None and time.monotonic() - start >= deadline
            if ticks.done.is_set() and late and running.isActive:
                running.stop()
                return False
            ticks.done.clear()
        running.awaitTermination()  # raises what has ended it
        return True
    finally:
        spark.streams.removeListener(ticks)


def upsert_stream(stream: DataFrame, keys: list[str], newest: list[str], path: str, checkpoint: str, buckets: int = 64):
    """Upsert each micro-batch into a Parquet table of one writer, bucketed by key: only the buckets that a batch touches are written anew.

    Of the rows of one key the one with the largest newest columns counts, in a batch
    and against the table.  A batch that was broken off and runs again changes nothing
    that it has done already.
    """
    from granary.operators.graph import exists, removed, shared_dir, written

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        at = shared_dir(spark)
        incoming = written(rows, at)
        touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]  # at most buckets numbers
        if touched:
            # only where there is no table yet is this the first batch; one that cannot be read is an error
            current = spark.read.schema(incoming.schema).parquet(path).filter(F.col("bucket").isin(touched)) if exists(spark, path) else incoming.limit(0)
            columns = [c for c in incoming.columns if c not in keys]
            best = F.max_by(F.struct(*columns), F.struct(*newest)).alias("x")
            merged, staging = current.unionByName(incoming).groupBy(*keys).agg(best).select(*keys, "x.*"), shared_dir(spark)
            staged = written(merged, staging)
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
            removed(spark, staging)
        removed(spark, at)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query("q_drain", "SELECT event_id, user_id, event_type, value > 10 AS large FROM events WHERE event_type <> 'error'")
def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in files, worked off in batches of three files: once with a deadline that has passed, so that it stops early, then to the end, and once more for nothing."""
    from granary.operators.graph import shared_dir

    events, (source, sink, mark) = table(spark, sf_dir, "events"), [shared_dir(spark) for _ in range(3)]
    events.repartition(8).write.parquet(source)
    work = lambda df: df.filter("event_type <> 'error'").select("event_id", "user_id", "event_type", (F.col("value") > 10).alias("large"))
    for deadline in (0.0, None, None):
        drain(spark, source, events.schema, sink, mark, work, files_per_batch=3, rows_per_task=10_000, deadline=deadline)
    return spark.read.schema("event_id long, user_id long, event_type string, large boolean").parquet(sink).select("event_id", "user_id", "event_type", "large")


def daily_counts(stream: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "2 days") -> DataFrame:
    """Tumbling days a kind; rows later than the watermark are let go."""
    day = F.window(F.col("at"), "1 day")
    return stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late).groupBy(day.alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), kind, "n")
