"""Aggregations: filtered, distinct, percentile, panel, pivot and dominant values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.quantiles import exact_percentiles
from granary.registry import query, using
from granary.sources.tables import CALLS, LEDGER, calls, ledger, table


@query("q_route_scoreboard", using({"ledger": LEDGER}, """
SELECT origem, destino, count(*) AS n, min(percentual) AS pct_min, max(percentual) AS pct_max, floor(median(percentual) + 0.5)::BIGINT AS pct_median,
       max(fim) FILTER (WHERE tier = 1) AS dated_until, max(percentual) FILTER (WHERE tier = 1) AS best_confirmed FROM ledger WHERE origem <> destino AND fonte <> 'P' GROUP BY origem, destino"""))
def route_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t1 = F.col("tier") == 1
    rows = ledger(spark, sf_dir).filter("origem <> destino AND fonte <> 'P'")
    return rows.groupBy("origem", "destino").agg(
        F.count("*").alias("n"), F.min("percentual").alias("pct_min"), F.max("percentual").alias("pct_max"), F.floor(F.median("percentual") + 0.5).cast("bigint").alias("pct_median"),
        F.max(F.when(t1, F.col("fim"))).alias("dated_until"), F.max(F.when(t1, F.col("percentual"))).alias("best_confirmed"),
    )


@query("q_program_bank", using({"ledger": LEDGER}, """
SELECT origem AS programa, count(*) AS n, count(*) FILTER (WHERE fim >= DATE '2000-01-01') AS live, count(*) FILTER (WHERE tier = 1 AND percentual >= 8) AS strong, max(fim) FILTER (WHERE tier < 3) AS next_end FROM ledger GROUP BY origem"""))
def program_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy(F.col("origem").alias("programa")).agg(
        F.count("*").alias("n"), F.count_if(F.col("fim") >= F.lit("2000-01-01").cast("date")).alias("live"), F.count_if((F.col("tier") == 1) & (F.col("percentual") >= 8)).alias("strong"), F.max(F.when(F.col("tier") < 3, F.col("fim"))).alias("next_end")
    )


@query("q_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("q_percentile_exact", "SELECT l_returnflag, l_linestatus, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY ALL")
def percentile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six groups over the whole fact table: ranked by ranges, not in one buffer a group."""
    return exact_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p95": 0.95})


@query("q_status_pivot", "SELECT o_orderpriority, unnest(['F', 'O', 'P']) AS status, unnest([count(*) FILTER (WHERE o_orderstatus = 'F'), count(*) FILTER (WHERE o_orderstatus = 'O'), count(*) FILTER (WHERE o_orderstatus = 'P')]) AS n FROM orders GROUP BY o_orderpriority")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of counts a group (an object aggregate), returned entry by entry."""
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    maps = g.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return maps.select("o_orderpriority", F.explode(F.array(*map(F.lit, "FOP"))).alias("status"), "m").select("o_orderpriority", "status", F.coalesce(F.try_element_at("m", F.col("status")), F.lit(0)).alias("n"))


@query("q_llm_cost_panel", using({"calls": CALLS}, """
SELECT dia, estagio, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(custo), 6) AS cost, count(custo) = count(*) AS cost_confirmed, round(quantile_cont(latencia, 0.5), 4) AS p50, round(quantile_cont(latencia, 0.95), 4) AS p95 FROM calls GROUP BY dia, estagio"""))
def llm_cost_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpriced calls leave the cost null, never 0; a cost is confirmed if all calls are priced."""
    rows = calls(spark, sf_dir)
    keys = ["dia", "estagio"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("custo"), 6).alias("cost"), (F.count("custo") == F.count("*")).alias("cost_confirmed"))
    found = exact_percentiles(rows, keys, "latencia", {"p50": 0.5, "p95": 0.95})
    return sums.join(found.select(*keys, F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95")), keys, "left")


@query("q_dedupe_sources", "SELECT o_custkey, o_orderpriority AS fonte, min(o_orderkey) AS first_key, max(o_orderdate)::DATE AS last_seen, count(*) AS n FROM orders GROUP BY ALL")
def dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source of a customer: the first key, the last day."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("fonte")).agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderdate").cast("date").alias("last_seen"), F.count("*").alias("n"))


@query("q_dominant_theme", "WITH c AS (SELECT o_custkey, o_orderpriority AS theme, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, theme, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, theme) = 1")
def dominant_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("theme")).agg(F.count("*").alias("n"))
    best = c.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("o"), "theme", "n")).alias("b"))
    return best.select("o_custkey", "b.theme", "b.n")


@query("q_dashboard_union", """
SELECT 'orders' AS metric, count(*) FILTER (WHERE o_orderstatus = 'P') || ' pending / ' || count(*) || ' total' AS value FROM orders
UNION ALL SELECT 'events', count(*) FILTER (WHERE event_type = 'error') || ' failed / ' || count(*) || ' total' FROM events UNION ALL SELECT 'parts', count(*)::VARCHAR FROM part""")
def dashboard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, metric, c, word: table(spark, sf_dir, name).agg(F.lit(metric).alias("metric"), F.concat(F.count_if(c), F.lit(f" {word} / "), F.count("*"), F.lit(" total")).alias("value"))
    parts = table(spark, sf_dir, "part").agg(F.lit("parts").alias("metric"), F.count("*").cast("string").alias("value"))
    return of("orders", "orders", F.col("o_orderstatus") == "P", "pending").unionByName(of("events", "events", F.col("event_type") == "error", "failed")).unionByName(parts)


@query("q_bucket_by_day", using({"calls": CALLS}, """
WITH d AS (SELECT unnest(generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS dia), t AS (SELECT DISTINCT estagio FROM calls)
SELECT d.dia, t.estagio, count(c.id) AS n FROM d CROSS JOIN t LEFT JOIN calls c ON c.dia = d.dia AND c.estagio = t.estagio GROUP BY ALL"""))
def bucket_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen days a stage with zeros filled in: each stage is exploded to its days."""
    c = calls(spark, sf_dir)
    days = F.explode(F.sequence(F.lit("2024-01-17").cast("date"), F.lit("2024-01-30").cast("date")))
    grid = c.select("estagio").distinct().select(days.alias("dia"), "estagio")
    n = c.filter("dia BETWEEN DATE '2024-01-17' AND DATE '2024-01-30'").groupBy("dia", "estagio").agg(F.count("*").alias("n"))
    return grid.join(n, ["dia", "estagio"], "left").na.fill({"n": 0})
