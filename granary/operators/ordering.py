"""Places in a total order over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place (from 1) in a total order, sorted by ranges of it.

    A row's place is that in its range plus the rows of all ranges before; the
    ranges' counts, one row a range, are all that is broadcast.
    """
    ranges = rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    ranges = written(ranges.withColumn("in_range_", F.row_number().over(Window.partitionBy("range_").orderBy(*order)).cast("bigint")))
    sizes = ranges.groupBy("range_").agg(F.count("*").alias("n_"))
    before = sizes.select("range_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return ranges.join(F.broadcast(before), "range_").select(*rows.columns, (F.col("before_") + F.col("in_range_")).alias(name))
