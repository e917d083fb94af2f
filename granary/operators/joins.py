"""Joins: equi, lateral, anti, semi, scalar subqueries, matching and alias resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.registry import query, using
from granary.sources.tables import LEDGER, ledger, table


@query("q_inner_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(c, "o_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("q_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted before the join, so a customer's orders are not multiplied through it."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill({"orders": 0})


_LAST = "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def last_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of a customer: max_by is one hash aggregation, no sort."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    return o.select(F.col("o_custkey").alias("c_custkey"), F.col("m.o_orderkey").alias("last_order"), F.col("m.o_orderstatus").alias("last_status"))


@query("q_lateral_top1", f"SELECT c_custkey, o_orderkey AS last_order, coalesce(o_orderstatus, 'sem_pedido') AS last_status FROM customer LEFT JOIN ({_LAST}) ON c_custkey = o_custkey")
def lateral_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEFT JOIN LATERAL ... ORDER BY ... LIMIT 1."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(last_order(spark, sf_dir), "c_custkey", "left").na.fill({"last_status": "sem_pedido"})


@query("q_lateral_inner", f"SELECT c_custkey, o_orderkey AS last_order, o_orderstatus AS last_status FROM customer JOIN ({_LAST}) ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'")
def lateral_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders fall out on purpose."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(last_order(spark, sf_dir).filter("last_status <> 'P'"), "c_custkey")


@query("q_anti_join", "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))  # noqa: E741
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(l, "p_partkey", "left_anti")


@query("q_semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_discount >= 0.1)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey"))  # noqa: E741
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(l, "s_suppkey", "left_semi")


@query("q_scalar_subqueries", """
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pending, (SELECT count(*) FROM customer) AS customers, (SELECT max(o_orderdate)::DATE FROM orders) AS newest,
       (SELECT count(*) FROM events WHERE event_type = 'error') AS errors""")
def scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "customer", "events"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"granary_{name}")
    return spark.sql("""
        SELECT (SELECT count(*) FROM granary_orders) AS orders, (SELECT count(*) FROM granary_orders WHERE o_orderstatus = 'P') AS pending, (SELECT count(*) FROM granary_customer) AS customers,
               (SELECT cast(max(o_orderdate) AS date) FROM granary_orders) AS newest, (SELECT count(*) FROM granary_events WHERE event_type = 'error') AS errors""")


@query("q_embed_struct", "SELECT s_suppkey, n_name || '/' || r_name AS place, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def embed_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent embedded as a struct, read by path."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.struct("n_name", "r_name").alias("nation"))
    return table(spark, sf_dir, "supplier").join(n, "s_nationkey").select("s_suppkey", F.concat("nation.n_name", F.lit("/"), "nation.r_name").alias("place"), "s_acctbal")


@query("q_match_action", """
WITH e AS (SELECT p_name AS key, count(*) AS hits, min(p_partkey) AS entity FROM part WHERE p_size > 10 GROUP BY p_name)
SELECT p_partkey, coalesce(hits, 0) AS hits, CASE WHEN hits IS NULL THEN 'create' WHEN hits = 1 THEN 'confirm' ELSE 'review' END AS action, CASE WHEN hits = 1 THEN entity END AS entity FROM part LEFT JOIN e ON p_name = key WHERE p_size <= 10""")
def match_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit confirms, more go to review, none creates; candidates are counted a key before the join."""
    part = table(spark, sf_dir, "part")
    e = part.filter("p_size > 10").groupBy("p_name").agg(F.count("*").alias("hits"), F.min("p_partkey").alias("entity"))
    rows = part.filter("p_size <= 10").select("p_partkey", "p_name").join(e, "p_name", "left")
    n = F.col("hits")
    return rows.select("p_partkey", F.coalesce(n, F.lit(0)).alias("hits"), F.when(n.isNull(), "create").when(n == 1, "confirm").otherwise("review").alias("action"), F.when(n == 1, F.col("entity")).alias("entity"))


@query("q_idempotent_number", """
WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), k AS (SELECT day, row_number() OVER (ORDER BY day) AS number FROM d WHERE day < DATE '2000-01-01')
SELECT day, coalesce(number, (SELECT max(number) FROM k) + row_number() OVER (PARTITION BY number IS NULL ORDER BY day)) AS number FROM d LEFT JOIN k USING (day)""")
def idempotent_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that have a number keep it; new days go on from the largest.  Days are as many as the calendar has, so one window numbers them."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    known = days.filter("day < DATE '2000-01-01'").withColumn("number", F.row_number().over(Window.orderBy("day")).cast("bigint"))
    fresh = days.join(known, "day", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("day")).cast("bigint"))
    most = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("m"))
    return known.union(fresh.join(F.broadcast(most)).select("day", (F.col("m") + F.col("k")).alias("number")))
