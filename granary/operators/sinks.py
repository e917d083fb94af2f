"""Merges for plain Parquet tables: upsert, insert-ignore, update, update-join, slice replacement.

Parquet has no row updates: each function computes the whole new content of the
slice, which the caller writes (one writer a table), see replace_slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.graph import shared_dir
from granary.registry import query
from granary.sources.tables import table


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows win over current ones of the same key."""
    both = current.withColumn("__p", F.lit(1)).unionByName(incoming.withColumn("__p", F.lit(0)))
    rest = [c for c in current.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min(F.struct("__p", *rest)).alias("b"))
    return best.select(*keys, *[F.col("b")[c].alias(c) for c in rest]).select(current.columns)


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is new, after the current ones."""
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti"))


def update_where(current: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    return current.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def update_from(current: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """UPDATE ... FROM (VALUES ...): values by key, else what was there."""
    new = values.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return current.join(new, keys, "left").select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else c for c in current.columns])


def replace_slice(df: DataFrame, path: str, partition: str) -> None:
    """Replace just the partitions that df holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def snapshot(df: DataFrame, path: str, as_of: str) -> None:
    """A snapshot under its day; written again, the day's slice is replaced."""
    replace_slice(df.withColumn("as_of_date", F.lit(as_of)), path, "as_of_date")


_CUR = "SELECT p_partkey, p_name, p_retailprice AS price FROM part WHERE p_size <= 30"
_INC = "SELECT p_partkey, p_name, p_retailprice * 2 AS price FROM part WHERE p_size >= 25"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    return p.filter("p_size <= 30").select("p_partkey", "p_name", F.col("p_retailprice").alias("price")), p.filter("p_size >= 25").select("p_partkey", "p_name", (F.col("p_retailprice") * 2).alias("price"))


@query("q_upsert_merge", f"WITH c AS ({_CUR}), i AS ({_INC}) SELECT * FROM i UNION ALL SELECT * FROM c WHERE p_partkey NOT IN (SELECT p_partkey FROM i)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(*_sides(spark, sf_dir), ["p_partkey"])


@query("q_insert_ignore", f"WITH c AS ({_CUR}), i AS ({_INC}) SELECT * FROM c UNION ALL SELECT * FROM i WHERE p_partkey NOT IN (SELECT p_partkey FROM c)")
def insert_ignore_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_ignore(*_sides(spark, sf_dir), ["p_partkey"])


@query("q_conditional_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_totalprice >= 1000")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update by condition and delete by its opposite."""
    rows = table(spark, sf_dir, "orders").filter("o_totalprice >= 1000")
    return update_where(rows, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000), {"o_orderstatus": F.lit("O")}).select("o_orderkey", "o_orderstatus")


@query("q_join_update", "SELECT s_suppkey, coalesce(n, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_extendedprice) AS n FROM lineitem WHERE l_discount >= 0.1 GROUP BY l_suppkey) ON s_suppkey = l_suppkey")
def join_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").filter("l_discount >= 0.1").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("s_acctbal"))
    return update_from(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), values, ["s_suppkey"], ["s_acctbal"])


@query("q_first_claim", "SELECT user_id, ts::DATE AS day, arg_min(event_id, (ts, event_id)) AS claimed_by, count(*) - 1 AS refused FROM events GROUP BY ALL")
def first_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim of a key wins, whatever order the rows come in."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("claimed_by"), (F.count("*") - 1).alias("refused"))


@query("q_replace_slice", """
SELECT o_orderkey, o_orderstatus, year(o_orderdate)::INTEGER AS year FROM orders WHERE year(o_orderdate) NOT IN (1996, 1997)
UNION ALL SELECT o_orderkey, 'R', year(o_orderdate)::INTEGER FROM orders WHERE year(o_orderdate) IN (1996, 1997) AND o_totalprice > 100000""")
def replace_slice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year; two years are replaced, the second time with the same rows, and the others stay."""
    o, at = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), shared_dir(spark)
    replace_slice(o.select("o_orderkey", "o_orderstatus", "year"), at, "year")
    for _ in range(2):
        replace_slice(o.filter("year IN (1996, 1997) AND o_totalprice > 100000").select("o_orderkey", F.lit("R").alias("o_orderstatus"), "year"), at, "year")
    return spark.read.schema("o_orderkey long, o_orderstatus string, year int").parquet(at)


@query("q_snapshot_series", """
SELECT p_brand, count(*) AS n, max(p_retailprice) AS top, DATE '2026-01-01' AS as_of_date FROM part WHERE p_size <= 20 GROUP BY p_brand
UNION ALL SELECT p_brand, count(*), max(p_retailprice), DATE '2026-01-02' FROM part GROUP BY p_brand""")
def snapshot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series by brand under two days; the second day's first, incomplete snapshot is replaced."""
    series = lambda most: table(spark, sf_dir, "part").filter(F.col("p_size") <= most).groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("top"))
    at = shared_dir(spark)
    for most, day in ((20, "2026-01-01"), (7, "2026-01-02"), (1000, "2026-01-02")):
        snapshot(series(most), at, day)
    return spark.read.schema("p_brand string, n long, top double, as_of_date date").parquet(at)
