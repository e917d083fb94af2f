"""Value per thousand points: metrics, latest observations, comparisons, benchmarks, bands, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.graph import written
from granary.operators.quantiles import exact_percentiles
from granary.registry import query, using
from granary.sources.tables import OFFERS, offers, round_to, table


def per_thousand(price: Column, points: Column) -> Column:
    """Price per thousand points to 4 places; null unless both are positive."""
    return F.when((price > 0) & (points > 0), round_to(price / points * 1000, 4))


def with_metrics(obs: DataFrame) -> DataFrame:
    price, points, hybrid = F.col("reference_price"), F.col("standard_points"), F.col("hybrid_points")
    return obs.select(
        "*",
        per_thousand(price, points).alias("vpm_standard"),
        per_thousand(price, F.col("elite_points")).alias("vpm_elite"),
        per_thousand(F.col("hybrid_cash"), points - hybrid).alias("vpm_hybrid_marginal"),
        F.when(points > hybrid, points - hybrid).alias("preserved_points"),
        ((F.coalesce(price, F.lit(0.0)) > 0) & (F.coalesce(points, F.lit(0)) > 0) & F.col("match_confidence").isin("high", "medium") & (F.col("availability") != "not_listed")).alias("is_comparable"),
        F.when(price.isNull() | (price <= 0), "missing_reference_price").when(points.isNull(), "missing_standard_points").when(F.col("match_confidence").isin("low", "rejected"), "low_match_confidence").alias("comparison_reason"),
    )


METRICS = """
  SELECT *, CASE WHEN reference_price > 0 AND standard_points > 0 THEN floor(reference_price / standard_points * 1000 * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE END AS vpm_standard,
         CASE WHEN reference_price > 0 AND elite_points > 0 THEN floor(reference_price / elite_points * 1000 * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE END AS vpm_elite,
         CASE WHEN hybrid_cash > 0 AND standard_points > hybrid_points THEN floor(hybrid_cash / (standard_points - hybrid_points) * 1000 * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE END AS vpm_hybrid_marginal,
         CASE WHEN standard_points > hybrid_points THEN standard_points - hybrid_points END AS preserved_points,
         coalesce(reference_price, 0) > 0 AND coalesce(standard_points, 0) > 0 AND match_confidence IN ('high', 'medium') AND availability <> 'not_listed' AS is_comparable,
         CASE WHEN reference_price IS NULL OR reference_price <= 0 THEN 'missing_reference_price' WHEN standard_points IS NULL THEN 'missing_standard_points'
              WHEN match_confidence IN ('low', 'rejected') THEN 'low_match_confidence' END AS comparison_reason
  FROM offers"""
LATEST = """
  SELECT * FROM metrics QUALIFY row_number() OVER (PARTITION BY product_id, program_code ORDER BY is_comparable DESC, captured_at DESC, id DESC, vpm_standard DESC NULLS LAST) = 1"""
VIEWS = {"offers": OFFERS, "metrics": METRICS, "latest": LATEST}


def latest(metrics: DataFrame) -> DataFrame:
    """The best, then newest observation of a product under a programme."""
    order = Window.partitionBy("product_id", "program_code").orderBy(F.desc("is_comparable"), F.desc("captured_at"), F.desc("id"), F.desc_nulls_last("vpm_standard"))
    return metrics.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(with_metrics(offers(spark, sf_dir)))


@query("q_vpm_metrics", using(VIEWS, "SELECT id, vpm_standard, vpm_elite, vpm_hybrid_marginal, preserved_points, is_comparable, comparison_reason FROM metrics"))
def vpm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_metrics(offers(spark, sf_dir)).select("id", "vpm_standard", "vpm_elite", "vpm_hybrid_marginal", "preserved_points", "is_comparable", "comparison_reason")


@query("q_latest_per_key", using(VIEWS, "SELECT product_id, program_code, captured_at, vpm_standard, vpm_elite, is_comparable FROM latest"))
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("product_id", "program_code", "captured_at", "vpm_standard", "vpm_elite", "is_comparable")


def _best(value: str) -> Column:
    """(programme, value) of the comparable observation with the highest value; ties to the smaller programme."""
    ok = F.col("is_comparable") & F.col(value).isNotNull()
    return F.min(F.when(ok, F.struct((-F.col(value)).alias("order"), "program_code", F.col(value).alias("value"))))


@query("q_sku_comparison", using(VIEWS, """
WITH c AS (SELECT product_id, min(captured_at) AS win_start, max(captured_at) AS win_end, count(DISTINCT program_code) AS programs_available,
                  count(*) FILTER (WHERE is_comparable) AS valid_observations FROM latest GROUP BY product_id),
s AS (SELECT product_id, program_code, vpm_standard FROM latest WHERE is_comparable AND vpm_standard IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY vpm_standard DESC, program_code) = 1),
e AS (SELECT product_id, program_code, vpm_elite FROM latest WHERE is_comparable AND vpm_elite IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY vpm_elite DESC, program_code) = 1)
SELECT product_id, win_start, win_end, programs_available, valid_observations, s.program_code AS best_standard_program, s.vpm_standard AS best_standard_vpm,
       e.program_code AS best_elite_program, e.vpm_elite AS best_elite_vpm,
       CASE WHEN programs_available >= 3 AND valid_observations = programs_available THEN 'complete' ELSE 'partial' END AS comparison_status,
       CASE valid_observations WHEN 0 THEN 'no_data' WHEN 1 THEN 'insufficient' WHEN 2 THEN 'indicative' ELSE 'minimum' END AS quality_status
FROM c LEFT JOIN s USING (product_id) LEFT JOIN e USING (product_id)"""))
def sku_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregation: the two best-of laterals become minima of structs, so nothing is joined back."""
    c = _latest(spark, sf_dir).groupBy("product_id").agg(
        F.min("captured_at").alias("win_start"), F.max("captured_at").alias("win_end"), F.count("*").alias("programs_available"),
        F.count_if("is_comparable").alias("valid_observations"), _best("vpm_standard").alias("s"), _best("vpm_elite").alias("e"),
    )
    n = F.col("valid_observations")
    return c.select(
        "product_id", "win_start", "win_end", "programs_available", "valid_observations",
        F.col("s.program_code").alias("best_standard_program"), F.col("s.value").alias("best_standard_vpm"),
        F.col("e.program_code").alias("best_elite_program"), F.col("e.value").alias("best_elite_vpm"),
        F.when((F.col("programs_available") >= 3) & (n == F.col("programs_available")), "complete").otherwise("partial").alias("comparison_status"),
        F.when(n == 0, "no_data").when(n == 1, "insufficient").when(n == 2, "indicative").otherwise("minimum").alias("quality_status"),
    )


def sample_quality(n: Column) -> Column:
    return F.when(n == 0, "no_data").when(n == 1, "insufficient").when(n == 2, "indicative").when(n <= 4, "minimum").when(n <= 9, "usable").otherwise("robust")


_Q = ", ".join(f"floor(quantile_cont(vpm_{k}, {p}) FILTER (WHERE is_comparable AND vpm_{k} IS NOT NULL) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS vpm_{k}_{name}" for k in ("standard", "elite") for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)))


@query("q_category_benchmarks", using(VIEWS, f"""
WITH t AS (SELECT p_type AS category_code, count(*) AS total_products FROM part GROUP BY p_type),
b AS (SELECT category_code, program_code, count(*) FILTER (WHERE is_comparable AND vpm_standard IS NOT NULL) AS valid_products, {_Q} FROM latest GROUP BY category_code, program_code)
SELECT b.*, total_products, floor(valid_products::DOUBLE / total_products * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS coverage_rate,
       CASE WHEN valid_products = 0 THEN 'no_data' WHEN valid_products = 1 THEN 'insufficient' WHEN valid_products = 2 THEN 'indicative'
            WHEN valid_products <= 4 THEN 'minimum' WHEN valid_products <= 9 THEN 'usable' ELSE 'robust' END AS sample_quality
FROM b JOIN t USING (category_code)"""))
def category_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few groups of many products: percentiles of both columns are ranked by ranges (exact_percentiles) in one run, not in one buffer a group."""
    keys = ["category_code", "program_code"]
    rows = written(_latest(spark, sf_dir).select(*keys, "is_comparable", "vpm_standard", "vpm_elite"))
    kept = lambda v: F.when(F.col("is_comparable"), F.col(v))
    probs = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    groups = rows.groupBy(*keys).agg(F.count(kept("vpm_standard")).alias("valid_products"))
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), kept(f"vpm_{k}").alias("x")) for k in ("standard", "elite")])).alias("v")
    found = exact_percentiles(rows.select(*keys, both).select(*keys, "v.k", "v.x"), [*keys, "k"], "x", probs)
    wide = [F.max(F.when(F.col("k") == k, F.col(name))).alias(f"vpm_{k}_{name}") for k in ("standard", "elite") for name in probs]
    groups = groups.join(found.groupBy(*keys).agg(*wide), keys, "left")
    totals = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category_code")).agg(F.count("*").alias("total_products"))
    n = F.col("valid_products")
    return groups.join(totals, "category_code").select(
        *keys, "valid_products", "total_products", round_to(n / F.col("total_products"), 4).alias("coverage_rate"),
        *[round_to(F.col(f"vpm_{k}_{name}"), 4).alias(f"vpm_{k}_{name}") for k in ("standard", "elite") for name in probs], sample_quality(n).alias("sample_quality"),
    )


@query("q_program_summary", using(VIEWS, """
SELECT program_code, count(*) AS observed, count(*) FILTER (WHERE is_comparable) AS comparable, count(DISTINCT category_code) AS categories,
       max(captured_at) AS newest, round(avg(vpm_standard), 6) AS vpm_mean FROM latest GROUP BY program_code"""))
def program_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).groupBy("program_code").agg(
        F.count("*").alias("observed"), F.count_if("is_comparable").alias("comparable"), F.countDistinct("category_code").alias("categories"), F.max("captured_at").alias("newest"), F.round(F.avg("vpm_standard"), 6).alias("vpm_mean")
    )


@query("q_sku_pivot", using(VIEWS, """
SELECT product_id, max(vpm_standard) FILTER (WHERE program_code = 'p0') AS p0, max(vpm_standard) FILTER (WHERE program_code = 'p1') AS p1,
       max(vpm_standard) FILTER (WHERE program_code = 'p2') AS p2 FROM latest GROUP BY product_id"""))
def sku_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).groupBy("product_id").pivot("program_code", ["p0", "p1", "p2"]).agg(F.max("vpm_standard"))


@query("q_coverage_gaps", using(VIEWS, """
WITH x AS (SELECT p_partkey AS product_id, unnest(['p0', 'p1', 'p2']) AS program_code FROM part)
SELECT x.product_id, x.program_code, CASE WHEN l.id IS NULL THEN 'not_observed' ELSE coalesce(comparison_reason, 'not_listed') END AS reason
FROM x LEFT JOIN latest l USING (product_id, program_code) WHERE l.id IS NULL OR NOT is_comparable"""))
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grid is each product times three programmes: an explode, not a cross join."""
    grid = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.explode(F.array(*map(F.lit, ("p0", "p1", "p2")))).alias("program_code"))
    seen = _latest(spark, sf_dir).select("product_id", "program_code", "id", "is_comparable", "comparison_reason")
    return (
        grid.join(seen, ["product_id", "program_code"], "left")
        .filter("id IS NULL OR NOT is_comparable")
        .select("product_id", "program_code", F.when(F.col("id").isNull(), "not_observed").otherwise(F.coalesce("comparison_reason", F.lit("not_listed"))).alias("reason"))
    )


def without_outliers(rows: DataFrame, keys: list[str], value: str, threshold: float = 3.5) -> DataFrame:
    """Adds z and kept: modified z-score by the median absolute deviation with a floor of 0.1 % of the median; fewer than three values are all kept."""
    w = Window.partitionBy(*keys)
    rows = rows.filter(F.col(value).isNotNull()).withColumn("__n", F.count("*").over(w)).withColumn("__med", F.median(value).over(w))
    rows = rows.withColumn("__dev", F.abs(F.col(value) - F.col("__med")))
    rows = rows.withColumn("__scale", F.greatest(F.median("__dev").over(w), F.lit(1e-3) * F.abs("__med")))
    z = F.when((F.col("__n") >= 3) & (F.col("__scale") > 0), F.lit(0.6745) * F.col("__dev") / F.col("__scale"))
    return rows.withColumn("z", z).withColumn("kept", F.coalesce(F.col("z") <= threshold, F.lit(True))).drop("__n", "__med", "__dev", "__scale")


MAD = {
    **VIEWS,
    "m1": "SELECT product_id, id, vpm_standard AS x, count(*) OVER w AS n, median(vpm_standard) OVER w AS med FROM metrics WHERE vpm_standard IS NOT NULL WINDOW w AS (PARTITION BY product_id)",
    "m2": "SELECT *, abs(x - med) AS dev FROM m1",
    "m3": "SELECT *, greatest(median(dev) OVER (PARTITION BY product_id), 1e-3 * abs(med)) AS scale FROM m2",
    "mad": "SELECT product_id, id, x, CASE WHEN n >= 3 AND scale > 0 THEN 0.6745::DOUBLE * dev / scale END AS z FROM m3",
}


@query("q_mad_outliers", using(MAD, "SELECT product_id, id, x AS vpm_standard, round(z, 6) AS z, coalesce(z <= 3.5, true) AS kept FROM mad"))
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_metrics(offers(spark, sf_dir)).select("product_id", "id", "vpm_standard")
    return without_outliers(rows, ["product_id"], "vpm_standard").withColumn("z", F.round("z", 6))


def sample_confidence(n: Column) -> Column:
    return F.when(n >= 8, "alta").when(n >= 5, "media").when(n >= 3, "baixa").otherwise("em-formacao")


@query("q_vpm_band", using(MAD, """
WITH k AS (SELECT * FROM mad WHERE coalesce(z <= 3.5, true))
SELECT product_id, count(*) AS n, min(x) AS floor_vpm, median(x) AS median_vpm, max(x) AS ceiling_vpm,
       CASE WHEN count(*) >= 8 THEN 'alta' WHEN count(*) >= 5 THEN 'media' WHEN count(*) >= 3 THEN 'baixa' ELSE 'em-formacao' END AS confidence
FROM k GROUP BY product_id"""))
def vpm_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_metrics(offers(spark, sf_dir)).select("product_id", "id", "vpm_standard")
    kept = without_outliers(rows, ["product_id"], "vpm_standard").filter("kept")
    n = F.count("*")
    return kept.groupBy("product_id").agg(n.alias("n"), F.min("vpm_standard").alias("floor_vpm"), F.median("vpm_standard").alias("median_vpm"), F.max("vpm_standard").alias("ceiling_vpm"), sample_confidence(n).alias("confidence"))


@query("q_iqr_outliers", using(VIEWS, """
WITH q AS (SELECT product_id, quantile_cont(vpm_standard, 0.25) AS a, quantile_cont(vpm_standard, 0.75) AS b FROM metrics WHERE vpm_standard IS NOT NULL GROUP BY product_id)
SELECT id, vpm_standard, vpm_standard < a - 1.5 * (b - a) OR vpm_standard > b + 1.5 * (b - a) AS outlier FROM metrics JOIN q USING (product_id) WHERE vpm_standard IS NOT NULL"""))
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_metrics(offers(spark, sf_dir)).filter("vpm_standard IS NOT NULL")
    w = Window.partitionBy("product_id")
    rows = rows.withColumn("a", F.percentile("vpm_standard", F.lit(0.25)).over(w)).withColumn("b", F.percentile("vpm_standard", F.lit(0.75)).over(w))
    spread = F.lit(1.5) * (F.col("b") - F.col("a"))
    return rows.select("id", "vpm_standard", ((F.col("vpm_standard") < F.col("a") - spread) | (F.col("vpm_standard") > F.col("b") + spread)).alias("outlier"))


@query("q_median_of_medians", using(VIEWS, """
WITH a AS (SELECT product_id, program_code, median(vpm_standard) AS m, count(vpm_standard) AS n FROM metrics GROUP BY ALL)
SELECT product_id, median(m) AS median_vpm, count(*) AS programs FROM a WHERE n >= 3 GROUP BY product_id"""))
def median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = with_metrics(offers(spark, sf_dir)).groupBy("product_id", "program_code").agg(F.median("vpm_standard").alias("m"), F.count("vpm_standard").alias("n"))
    return a.filter("n >= 3").groupBy("product_id").agg(F.median("m").alias("median_vpm"), F.count("*").alias("programs"))


_FORMULAS = """
SELECT id, floor(reference_price / (standard_points / 1000.0::DOUBLE) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS cpm,
       floor(20 * standard_points / 1000.0::DOUBLE * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS implied_price,
       floor((reference_price / standard_points * 1000 - 20) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS spread
FROM offers WHERE reference_price > 0 AND standard_points > 0"""


@query("q_formulas", using({"offers": OFFERS}, _FORMULAS))
def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per thousand, price implied by a reference of 20 a thousand, and the spread between them."""
    price, points = F.col("reference_price"), F.col("standard_points")
    return offers(spark, sf_dir).filter((price > 0) & (points > 0)).select(
        "id", round_to(price / (points / 1000.0), 4).alias("cpm"), round_to(20 * points / 1000.0, 2).alias("implied_price"), round_to(price / points * 1000 - 20, 4).alias("spread")
    )


@query("q_cpm_effective", """
WITH o AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_discount, p_retailprice, s_acctbal
           FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
c AS (SELECT *, CASE WHEN s_acctbal > 0 THEN s_acctbal / 10000 END AS ratio FROM o)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, floor(p_retailprice / ((1 + l_discount) * ratio) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS cpm,
       CASE WHEN ratio IS NULL THEN 'sem_ratio' WHEN p_retailprice IS NULL THEN 'sem_custo' ELSE 'calculado' END AS fonte FROM c""")
def cpm_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cost / ((1 + bonus) * ratio); a missing ratio leaves the result null, never 1:1."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    ratio = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 10000)
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", round_to(F.col("p_retailprice") / ((1 + F.col("l_discount")) * ratio), 2).alias("cpm"),
        F.when(ratio.isNull(), "sem_ratio").when(F.col("p_retailprice").isNull(), "sem_custo").otherwise("calculado").alias("fonte"),
    )


@query("q_audit_tolerance", using(VIEWS, "SELECT id, vpm_standard, abs(vpm_standard - reference_price / standard_points * 1020) / (reference_price / standard_points * 1020) <= 0.02 AS within FROM metrics WHERE vpm_standard IS NOT NULL"))
def audit_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated value against a recomputed one (here 2 % off), within 2 %."""
    other = F.col("reference_price") / F.col("standard_points") * 1020
    return with_metrics(offers(spark, sf_dir)).filter("vpm_standard IS NOT NULL").select("id", "vpm_standard", (F.abs(F.col("vpm_standard") - other) / other <= 0.02).alias("within"))
