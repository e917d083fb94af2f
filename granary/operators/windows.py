"""Window forms: ranking, threads, current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.registry import query
from granary.sources.tables import table


@query("q_ranking", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS rank FROM orders")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("bigint").alias("rank"))


@query("q_thread_summary", """
SELECT o_custkey AS thread, count(*) AS appearances, min(o_orderdate)::DATE AS first_seen, max(o_orderdate)::DATE AS last_seen, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS verdict_start,
       arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS verdict_end, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)) - arg_min(o_totalprice, (o_orderdate, o_orderkey)), 2) AS jump FROM orders GROUP BY o_custkey""")
def thread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last values by min_by and max_by: one hash aggregation."""
    at = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("thread")).agg(
        F.count("*").alias("appearances"), F.min("o_orderdate").cast("date").alias("first_seen"), F.max("o_orderdate").cast("date").alias("last_seen"),
        F.min_by("o_orderstatus", at).alias("verdict_start"), F.max_by("o_orderstatus", at).alias("verdict_end"), F.round(F.max_by("o_totalprice", at) - F.min_by("o_totalprice", at), 2).alias("jump"),
    )


@query("q_scd_current", "SELECT o_custkey, o_orderkey, o_orderdate::DATE AS valid_from, (lead(o_orderdate) OVER w)::DATE AS valid_to, lead(o_orderkey) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def scd_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version ends where the next begins; the last is current."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("valid_from"), F.lead("o_orderdate").over(w).cast("date").alias("valid_to"), F.lead("o_orderkey").over(w).isNull().alias("is_current"))


@query("q_best_evaluation", """
SELECT c_custkey, event_id, CASE event_type WHEN 'purchase' THEN 'corrobora' WHEN 'signup' THEN 'ajuste' WHEN 'error' THEN 'refuta' ELSE 'nao_verificavel' END AS outcome
FROM customer JOIN events ON user_id = c_custkey
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 3 END, value DESC, event_id) = 1""")
def best_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best outcome of an entity, then the highest confidence: a minimum of structs, pre-aggregated before the join."""
    t = F.col("event_type")
    rank = F.when(t == "purchase", 0).when(t == "signup", 1).when(t == "error", 2).otherwise(3)
    best = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min(F.struct(rank.alias("r"), (-F.col("value")).alias("v"), "event_id")).alias("b"))
    names = F.array(*map(F.lit, ("corrobora", "ajuste", "refuta", "nao_verificavel")))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey").select("c_custkey", "b.event_id", F.element_at(names, F.col("b.r") + 1).alias("outcome"))
