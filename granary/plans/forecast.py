"""Recurrence of dated series: waves, intervals, forecast, prediction, back-test.

A series is a route (origin and target) or a cluster (target alone).  Its days are
collapsed to waves by a fold over the sorted distinct days: a day opens a new wave
when it lies more than EPSILON days after the anchor of the current one.  A series
has at most as many days as the calendar, so its arrays stay small at any corpus size.
"""

from __future__ import annotations

import bisect
import functools
import math
import statistics

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.graph import written
from granary.plans.quality import TEMPORAL, temporal
from granary.registry import query, using
from granary.sources.tables import AS_OF, as_of, half_up, ledger, round_to

# The forecast and prediction configuration.
EPSILON = 3
FORECAST = {"min_samples": 2, "samples_alta": 4, "samples_media": 3, "cv_alta": 0.35, "cv_media": 0.6, "min_waves": 5, "long_days": 365, "extreme_days": 540, "horizon_days": 180}
PREDICT = {"min_samples": 3, "samples_media": 6, "samples_alta": 10, "cv_media": 0.6, "cv_alta": 0.35, "half_life": 4, "backtest_min": 3}
HORIZONS = (7, 15, 30, 60, 90, 180)
# Fixed value: the gap beyond which the radar counts a critical row.
FAR_GAP = 2200


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origem, destino, d, percentual, n, far): rows on a route between two programmes, counted by day and percentage and written.

    n are those with an admissible date, far those with a suspect year and a gap beyond FAR_GAP.
    At most one row a route, day and percentage, however many offers there are; all that
    is told of series is read from here, so the ledger is joined once.
    """
    rows = temporal(ledger(spark, sf_dir).filter("origem <> destino")).select("origem", "destino", F.col("event_date").alias("d"), "percentual", "include", ((F.col("severity") == "critical") & (F.col("gap") > FAR_GAP)).alias("far"))
    return written(rows.groupBy("origem", "destino", "d", "percentual").agg(F.count_if("include").alias("n"), F.count_if("far").alias("far")))


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origem, destino, d, percentual, n): n rows with an admissible date on a route between two programmes."""
    return admissible(dated(spark, sf_dir))


def admissible(counted: DataFrame) -> DataFrame:
    return counted.filter("n > 0").select("origem", "destino", "d", "percentual", "n")


def waves_of(days: Column, epsilon: int = EPSILON) -> Column:
    """The anchors of the waves of an array of days."""
    none = F.array().cast("array<date>")
    fold = lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.element_at(acc, -1)) > epsilon), F.concat(acc, F.array(d))).otherwise(acc)
    return F.aggregate(F.array_sort(days), none, fold)


def series(rows: DataFrame) -> DataFrame:
    """(scope, route, waves, typical): one row a route and one a cluster; typical is the rounded median of positive percentages."""
    both = rows.select("d", "percentual", "n", F.explode(F.array(F.struct(F.lit("route").alias("scope"), F.concat("origem", F.lit("→"), "destino").alias("route")), F.struct(F.lit("cluster").alias("scope"), F.concat(F.lit("→"), "destino").alias("route")))).alias("s"))
    counts = both.groupBy("s.scope", "s.route", "d", "percentual").agg(F.sum("n").alias("c"))
    middle = F.percentile(F.when(F.col("percentual") > 0, F.col("percentual")), F.lit(0.5), F.col("c"))
    grouped = counts.groupBy("scope", "route").agg(F.collect_set("d").alias("days"), half_up(middle).alias("typical"))
    return grouped.select("scope", "route", waves_of(F.col("days")).alias("waves"), "typical")


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def array_quantile(xs: Column, p: float) -> Column:
    """Linear interpolation over a sorted array; null if empty."""
    at = F.lit(p) * (F.size(xs) - 1)
    low, high = F.get(xs, F.floor(at).cast("int")), F.get(xs, F.ceil(at).cast("int"))
    return F.when(F.size(xs) > 0, low + (high - low) * (at - F.floor(at)))


def _stdev(xs: Column, mean: Column) -> Column:
    squares = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(xs) > 1, F.sqrt(squares / (F.size(xs) - 1)))


SERIES = {
    **TEMPORAL,
    "eligible": "SELECT origem, destino, event_date AS d, percentual FROM temporal WHERE include AND origem <> destino",
    "ev": "SELECT 'route' AS scope, origem || '→' || destino AS route, d, percentual FROM eligible UNION ALL SELECT 'cluster', '→' || destino, d, percentual FROM eligible",
    "days": "SELECT scope, route, d, max(percentual) AS pct FROM ev GROUP BY ALL",
    "anchors": f"SELECT scope, route, min(d) AS d FROM days GROUP BY ALL UNION ALL SELECT days.scope, days.route, min(days.d) FROM anchors JOIN days ON anchors.scope = days.scope AND anchors.route = days.route AND days.d > anchors.d + {EPSILON} GROUP BY days.scope, days.route, anchors.d",
    "waves": "SELECT scope, route, d, pct, row_number() OVER w AS i, count(*) OVER (PARTITION BY scope, route) AS n, (d - lag(d) OVER w)::BIGINT AS gap FROM anchors JOIN days USING (scope, route, d) WINDOW w AS (PARTITION BY scope, route ORDER BY d)",
}


@query("q_waves", using(SERIES, "SELECT scope, route, d AS wave FROM waves"))
def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(eligible(spark, sf_dir)).select("scope", "route", F.explode("waves").alias("wave"))


@query("q_intervals", using(SERIES, "SELECT scope, route, d AS wave, gap AS days FROM waves WHERE gap IS NOT NULL"))
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("scope", "route").orderBy("wave")
    return waves(spark, sf_dir).withColumn("days", F.datediff("wave", F.lag("wave").over(order)).cast("bigint")).filter("days IS NOT NULL")


@query("q_cadence_stats", using(SERIES, """
SELECT scope, route, any_value(n) AS samples, round(avg(gap), 6) AS mean_days, round(stddev_samp(gap), 6) AS stdev_days, round(stddev_samp(gap) / avg(gap), 6) AS cv, max(gap) AS max_days
FROM waves GROUP BY scope, route HAVING count(gap) > 1"""))
def cadence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.col("days")
    found = intervals(spark, sf_dir).groupBy("scope", "route").agg((F.count("*") + 1).alias("samples"), F.round(F.avg(days), 6).alias("mean_days"), F.round(F.stddev_samp(days), 6).alias("stdev_days"), F.round(F.try_divide(F.stddev_samp(days), F.avg(days)), 6).alias("cv"), F.max(days).alias("max_days"))
    return found.filter("samples > 2")


@query("q_median_variants", using(SERIES, """
SELECT scope, route, median(gap) AS median_plain, floor(median(gap) + 0.5)::BIGINT AS median_rounded FROM waves WHERE gap IS NOT NULL GROUP BY scope, route"""))
def median_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.median("days")
    return intervals(spark, sf_dir).groupBy("scope", "route").agg(m.alias("median_plain"), half_up(m).alias("median_rounded"))


def forecasts(rows: DataFrame) -> DataFrame:
    """One row a series: cadence, confidence, window and the editorial gate."""
    c = FORECAST
    w = series(rows).select("scope", "route", "typical", F.explode("waves").alias("wave"))
    w = w.withColumn("gap", F.datediff("wave", F.lag("wave").over(Window.partitionBy("scope", "route").orderBy("wave"))))
    s = w.groupBy("scope", "route").agg(
        F.max("typical").alias("typical"), F.count("*").alias("samples"), F.max("wave").alias("last"), F.max("gap").cast("bigint").alias("max_gap"),
        half_up(F.median("gap")).alias("med"), half_up(F.avg("gap")).alias("mean_days"), half_up(F.coalesce(F.stddev_samp("gap"), F.lit(0.0))).alias("sd_days"),
    )
    s = s.withColumn("cv", F.when(F.col("mean_days") > 0, F.col("sd_days") / F.col("mean_days")).otherwise(1.0))
    step = F.when(F.col("med") == 0, 30).otherwise(F.col("med"))
    steps = F.greatest(F.lit(1), F.least(F.lit(241), F.ceil(F.datediff(as_of(), "last") / step)))
    s = s.withColumn("center", F.date_add("last", (steps * step).cast("int")))
    half = half_up(F.col("sd_days") / 2)
    s = s.withColumn("half", F.least(F.lit(12), F.greatest(F.lit(3), half)).cast("int")).withColumn("ahead", F.datediff("center", as_of()).cast("bigint"))
    enough = F.col("samples") >= c["min_samples"]
    cadence = F.when((F.col("samples") >= 3) & F.col("med").between(24, 37) & (F.col("cv") <= 0.4), "mensal").when(F.col("med") > 75, "esparsa").otherwise("irregular")
    confidence = (
        F.when(~enough, "em-formacao")
        .when((F.col("samples") >= c["samples_alta"]) & (F.col("cv") <= c["cv_alta"]), "alta")
        .when((F.col("samples") >= c["samples_media"]) & (F.col("cv") <= c["cv_media"]), "media")
        .otherwise("baixa")
    )
    only = lambda x: F.when(enough, x)
    block = (
        F.when(~enough, F.concat(F.lit("em_formacao ("), "samples", F.lit(f"<{c['min_samples']} ondas)")))
        .when(F.col("samples") < c["min_waves"], F.concat(F.lit("historico_insuficiente_para_publicacao ("), "samples", F.lit(f"<{c['min_waves']} ondas)")))
        .when(F.col("max_gap") >= c["extreme_days"], F.concat(F.lit("intervalo_extremo ("), "max_gap", F.lit(f"d ≥ {c['extreme_days']})")))
        .when(F.col("ahead") > c["horizon_days"], F.concat(F.lit("horizonte_excedido ("), "ahead", F.lit(f"d > {c['horizon_days']})")))
    )
    return s.select(
        "scope", "route", "samples", only(F.col("med")).alias("median_days"), only(F.col("mean_days")).alias("mean_days"), only(F.col("sd_days")).alias("stdev_days"), "last",
        "typical", confidence.alias("confidence"), only(cadence).alias("cadence"), only(F.date_sub("center", F.col("half"))).alias("window_start"), only(F.date_add("center", F.col("half"))).alias("window_end"),
        only(F.col("max_gap")).alias("max_gap"), only(F.col("ahead")).alias("ahead"), block.alias("block_reason"), (enough & (F.col("ahead") > c["horizon_days"])).alias("requires_review"),
    )


FORECASTS = {
    **SERIES,
    "f1": """SELECT scope, route, any_value(n) AS samples, max(d) AS last, floor(median(gap) + 0.5)::BIGINT AS med, floor(avg(gap) + 0.5)::BIGINT AS mean_days,
       floor(coalesce(stddev_samp(gap), 0) + 0.5)::BIGINT AS sd_days, max(gap) AS max_gap FROM waves GROUP BY scope, route""",
    "typ": "SELECT scope, route, floor(median(percentual) FILTER (WHERE percentual > 0) + 0.5)::BIGINT AS typical FROM ev GROUP BY ALL",
    "f2": f"""SELECT f1.*, typical, CASE WHEN mean_days > 0 THEN sd_days::DOUBLE / mean_days ELSE 1.0 END AS cv, CASE WHEN med = 0 THEN 30 ELSE med END AS step,
       samples >= {FORECAST['min_samples']} AS enough FROM f1 JOIN typ USING (scope, route)""",
    "f3": f"SELECT *, last + (greatest(1, least(241, ceil((DATE '{AS_OF}' - last) / step::DOUBLE)))::BIGINT * step)::INTEGER AS center, least(12, greatest(3, floor(sd_days / 2.0::DOUBLE + 0.5)))::INTEGER AS half FROM f2",
    "f4": f"SELECT *, (center - DATE '{AS_OF}')::BIGINT AS ahead FROM f3",
    "forecast": f"""SELECT scope, route, samples, CASE WHEN enough THEN med END AS median_days, CASE WHEN enough THEN mean_days END AS mean_days, CASE WHEN enough THEN sd_days END AS stdev_days, last, typical,
       CASE WHEN NOT enough THEN 'em-formacao' WHEN samples >= {FORECAST['samples_alta']} AND cv <= {FORECAST['cv_alta']} THEN 'alta' WHEN samples >= {FORECAST['samples_media']} AND cv <= {FORECAST['cv_media']} THEN 'media' ELSE 'baixa' END AS confidence,
       CASE WHEN enough THEN CASE WHEN samples >= 3 AND med BETWEEN 24 AND 37 AND cv <= 0.4 THEN 'mensal' WHEN med > 75 THEN 'esparsa' ELSE 'irregular' END END AS cadence,
       CASE WHEN enough THEN center - half END AS window_start, CASE WHEN enough THEN center + half END AS window_end, CASE WHEN enough THEN max_gap END AS max_gap, CASE WHEN enough THEN ahead END AS ahead,
       CASE WHEN NOT enough THEN 'em_formacao (' || samples || '<{FORECAST['min_samples']} ondas)' WHEN samples < {FORECAST['min_waves']} THEN 'historico_insuficiente_para_publicacao (' || samples || '<{FORECAST['min_waves']} ondas)'
            WHEN max_gap >= {FORECAST['extreme_days']} THEN 'intervalo_extremo (' || max_gap || 'd ≥ {FORECAST['extreme_days']})' WHEN ahead > {FORECAST['horizon_days']} THEN 'horizonte_excedido (' || ahead || 'd > {FORECAST['horizon_days']})' END AS block_reason,
       enough AND coalesce(ahead > {FORECAST['horizon_days']}, false) AS requires_review FROM f4""",
}


@query("q_forecast", using(FORECASTS, "SELECT scope, route, samples, median_days, mean_days, stdev_days, last, typical, confidence, cadence, window_start, window_end FROM forecast"))
def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(eligible(spark, sf_dir)).select("scope", "route", "samples", "median_days", "mean_days", "stdev_days", "last", "typical", "confidence", "cadence", "window_start", "window_end")


@query("q_forecast_gate", using(FORECASTS, "SELECT scope, route, max_gap, ahead, block_reason IS NULL AS editorial_eligible, block_reason, requires_review, coalesce(max_gap >= 365, false) AS long_interval FROM forecast"))
def forecast_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(eligible(spark, sf_dir)).select("scope", "route", "max_gap", "ahead", F.col("block_reason").isNull().alias("editorial_eligible"), "block_reason", "requires_review", F.coalesce(F.col("max_gap") >= FORECAST["long_days"], F.lit(False)).alias("long_interval"))


@query("q_upcoming_windows", using(FORECASTS, f"""
SELECT scope, route, confidence, window_start, window_end, (window_start - DATE '{AS_OF}')::BIGINT AS days_until FROM forecast
WHERE confidence <> 'em-formacao' AND window_end >= DATE '{AS_OF}' AND window_start <= DATE '{AS_OF}' + 21"""))
def upcoming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(eligible(spark, sf_dir)).filter((F.col("confidence") != "em-formacao") & (F.col("window_end") >= as_of()) & (F.col("window_start") <= F.date_add(as_of(), 21)))
    return f.select("scope", "route", "confidence", "window_start", "window_end", F.datediff("window_start", as_of()).cast("bigint").alias("days_until"))


# ------------------------------------------------------------------ prediction


def events(rows: DataFrame) -> DataFrame:
    """(scope, route, ev): waves in order with the highest percentage of the anchor day."""
    both = rows.select("d", "percentual", F.explode(F.array(F.struct(F.lit("route").alias("scope"), F.concat("origem", F.lit("→"), "destino").alias("route")), F.struct(F.lit("cluster").alias("scope"), F.concat(F.lit("→"), "destino").alias("route")))).alias("s"))
    days = both.groupBy("s.scope", "s.route", "d").agg(F.max("percentual").alias("pct"))
    grouped = days.groupBy("scope", "route").agg(F.array_sort(F.collect_list(F.struct("d", "pct"))).alias("days"))
    none = F.array().cast("array<struct<d:date,pct:double>>")
    fold = lambda acc, x: F.when((F.size(acc) == 0) | (F.datediff(x["d"], F.element_at(acc, -1)["d"]) > EPSILON), F.concat(acc, F.array(x))).otherwise(acc)
    return grouped.select("scope", "route", F.aggregate("days", none, fold).alias("ev"))


def with_timing(rows: DataFrame, ev: str, now: Column) -> DataFrame:
    """Adds since, s0 (share of weighted intervals that outlast since), residuals, central, starts, ends and iv (struct days, w)."""
    n = F.size(ev)
    e = F.col(ev)
    iv = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.datediff(F.get(e, i)["d"], F.get(e, i - 1)["d"]).cast("bigint").alias("days"), F.pow(F.lit(0.5), (n - 1 - i) / F.lit(float(PREDICT["half_life"]))).alias("w"))))
    iv = F.coalesce(iv, F.array().cast("array<struct<days:bigint,w:double>>"))
    rows = rows.withColumn("iv", iv).withColumn("since", F.greatest(F.lit(0), F.datediff(now, F.element_at(ev, -1)["d"])).cast("bigint"))
    rows = rows.withColumn("s0", survival(F.col("iv"), F.col("since")))
    rows = rows.withColumn("residuals", F.array_sort(F.transform(F.filter("iv", lambda x: x["days"] > F.col("since")), lambda x: x["days"] - F.col("since"))))
    r = F.col("residuals")
    mid, low, high = [F.coalesce(array_quantile(r, p), F.lit(0.0)) for p in (0.5, 0.25, 0.75)]
    high = F.when(F.size(r) > 0, high).otherwise(7.0)
    shift = lambda x: F.date_add(now, half_up(x).cast("int"))
    return rows.withColumn("central", shift(mid)).withColumn("starts", shift(low)).withColumn("ends", shift(F.greatest(high, low + 1)))


def survival(iv: Column, t: Column) -> Column:
    total = F.aggregate(iv, F.lit(0.0), lambda a, x: a + x["w"])
    left = F.aggregate(iv, F.lit(0.0), lambda a, x: a + F.when(x["days"] > t, x["w"]).otherwise(0.0))
    return F.when(total > 0, left / total).otherwise(0.0)


def probability(horizon: int) -> Column:
    p = F.when(F.col("s0") > 0, 1 - survival(F.col("iv"), F.col("since") + horizon) / F.col("s0")).otherwise(1.0)
    return round_to(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)), 4)


_W = f"SELECT *, power(0.5::DOUBLE, (n - i) / {float(PREDICT['half_life'])}::DOUBLE) AS w, greatest(0, DATE '{AS_OF}' - max(d) OVER (PARTITION BY scope, route))::BIGINT AS since FROM waves"
TIMING = {
    **SERIES,
    "wv": _W,
    "tm": """SELECT scope, route, any_value(n) AS n, any_value(since) AS since, coalesce(sum(w) FILTER (WHERE gap IS NOT NULL), 0) AS total,
       coalesce(sum(w) FILTER (WHERE gap > since), 0) AS s0, quantile_cont((gap - since)::DOUBLE, 0.5) FILTER (WHERE gap > since) AS mid,
       quantile_cont((gap - since)::DOUBLE, 0.25) FILTER (WHERE gap > since) AS low, quantile_cont((gap - since)::DOUBLE, 0.75) FILTER (WHERE gap > since) AS high, """
    + ", ".join(f"coalesce(sum(w) FILTER (WHERE gap > since + {h}), 0) AS s{h}" for h in HORIZONS)
    + " FROM wv GROUP BY scope, route",
    "timing": "SELECT *, "
    + ", ".join(f"floor(least(1.0, greatest(0.0, CASE WHEN total > 0 AND s0 > 0 THEN 1 - (s{h} / total) / (s0 / total) ELSE 1.0 END)) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS p{h}" for h in HORIZONS)
    + f""", DATE '{AS_OF}' + floor(coalesce(mid, 0) + 0.5)::INTEGER AS central_date, DATE '{AS_OF}' + floor(coalesce(low, 0) + 0.5)::INTEGER AS window_start,
       DATE '{AS_OF}' + floor(greatest(coalesce(high, 7), coalesce(low, 0) + 1) + 0.5)::INTEGER AS window_end FROM tm""",
}


@query("q_survival", using(TIMING, f"SELECT scope, route, since, {', '.join(f'p{h}' for h in HORIZONS)}, central_date, window_start, window_end FROM timing WHERE n >= {PREDICT['min_samples']}"))
def survival_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted survival of intervals; an overdue series has probability 1 throughout."""
    rows = with_timing(events(eligible(spark, sf_dir)).filter(F.size("ev") >= PREDICT["min_samples"]), "ev", as_of())
    return rows.select("scope", "route", "since", *[probability(h).alias(f"p{h}") for h in HORIZONS], F.col("central").alias("central_date"), F.col("starts").alias("window_start"), F.col("ends").alias("window_end"))


def exploded(ev: DataFrame) -> DataFrame:
    """(scope, route, i, n, d, pct): one row an event, i from 1."""
    return ev.select("scope", "route", F.size("ev").alias("n"), F.posexplode("ev").alias("p", "x")).select("scope", "route", (F.col("p") + 1).cast("bigint").alias("i"), F.col("n").cast("bigint").alias("n"), "x.d", "x.pct")


@query("q_weighted_mode", using({**SERIES, "wv": _W}, """
WITH g AS (SELECT scope, route, pct AS value, sum(w) AS w FROM wv WHERE pct IS NOT NULL GROUP BY ALL)
SELECT scope, route, row_number() OVER k AS rank, value, floor(w / sum(w) OVER (PARTITION BY scope, route) * 1000.0::DOUBLE + 0.5) / 1000.0::DOUBLE AS probability
FROM g WINDOW k AS (PARTITION BY scope, route ORDER BY round(w, 9) DESC, value) QUALIFY rank <= 3"""))
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most likely values by recency weight; ties to the smaller value."""
    w = F.pow(F.lit(0.5), (F.col("n") - F.col("i")) / F.lit(float(PREDICT["half_life"])))
    g = exploded(events(eligible(spark, sf_dir))).filter("pct IS NOT NULL").groupBy("scope", "route", F.col("pct").alias("value")).agg(F.sum(w).alias("w"))
    order = Window.partitionBy("scope", "route").orderBy(F.desc(F.round("w", 9)), "value")
    total = F.sum("w").over(Window.partitionBy("scope", "route"))
    ranked = g.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("probability", round_to(F.col("w") / total, 3))
    return ranked.filter("rank <= 3").select("scope", "route", "rank", "value", "probability")


def spread(df: DataFrame) -> DataFrame:
    """Few rows with much work each: deal them over all cores, as small shuffles are merged into one partition otherwise."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "scope", "route")


class Walk:
    """What a series' prefixes say, carried from one event to the next.

    Gaps stay sorted, so their quantiles are read off at any time.  The weights of values
    decay by one factor an event, whatever value it has, so all are multiplied at once.
    """

    def __init__(self, half_life: float):
        self.decay, self.gaps, self.last = 0.5 ** (1 / half_life), [], None
        self.values: list[float] = []
        self.weights = np.zeros(0)

    def see(self, day: int, value: float | None) -> None:
        if self.last is not None and day > self.last:
            bisect.insort(self.gaps, day - self.last)
        self.last, self.weights = day, self.weights * self.decay
        if value is not None:
            at = bisect.bisect_left(self.values, value)
            if at == len(self.values) or self.values[at] != value:
                self.values.insert(at, value)
                self.weights = np.insert(self.weights, at, 0.0)
            self.weights[at] += 1

    def quantile(self, p: float) -> float:
        at = p * (len(self.gaps) - 1)
        low, high = self.gaps[math.floor(at)], self.gaps[math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    def window(self) -> tuple[int, int, int]:
        """(first day, central day, last day) of the next event, as of the last one."""
        mid, low, high = (self.quantile(p) for p in (0.5, 0.25, 0.75)) if self.gaps else (0.0, 0.0, 7.0)
        return tuple(self.last + math.floor(x + 0.5) for x in (low, mid, max(high, low + 1)))

    def heaviest(self) -> float | None:
        """Ties to the smaller value."""
        return self.values[int(np.argmax(np.round(self.weights, 9)))] if self.values else None


def walked(batches, first: int, half_life: float):
    """(scope, route, days, values) of series -> their back-tests: each event from the first-th on against the ones before it."""
    mean = lambda x: math.floor(sum(x) / len(x) * 100 + 0.5) / 100 if x else None
    for batch in batches:
        out = []
        for scope, route, days, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            walk, errors, hits, exact, near = Walk(half_life), [], [], [], []
            for i, (day, value) in enumerate(zip(days, values, strict=True)):
                if i >= first:
                    start, central, end = walk.window()
                    errors.append(abs(central - day))
                    hits.append(start <= day <= end)
                    top = walk.heaviest()
                    if top is not None and value is not None:
                        exact.append(top == value)
                        near.append(abs(top - value) <= 5)
                walk.see(day, value)
            out.append((scope, route, len(errors), float(statistics.median(errors)), mean(hits), mean(exact), mean(near)))
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4]
        names = ["scope", "route", "observations", "median_error", "hit_rate", "exact_bonus", "near_bonus"]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def backtests(ev: DataFrame) -> DataFrame:
    """Walk forward: each event from the fourth on is predicted from those before it, as of the last of them.

    One pass a series: sorted gaps and decayed weights are carried along, so an event costs
    a place in the sorted gaps and one product over the distinct values, however many came
    before it.
    """
    first = PREDICT["min_samples"]
    series = spread(ev.filter(F.size("ev") > first)).select("scope", "route", F.transform("ev", lambda x: F.unix_date(x["d"])).alias("days"), F.transform("ev", lambda x: x["pct"]).alias("values"))
    return series.mapInArrow(functools.partial(walked, first=first, half_life=float(PREDICT["half_life"])), "scope string, route string, observations long, median_error double, hit_rate double, exact_bonus double, near_bonus double")


BACKTEST = {
    **SERIES,
    "bt": f"""SELECT a.scope, a.route, a.i, a.d AS actual, a.pct AS actual_pct, b.i AS j, b.gap, b.pct, b.d, power(0.5::DOUBLE, (a.i - 1 - b.i) / {float(PREDICT['half_life'])}::DOUBLE) AS w
       FROM waves a JOIN waves b ON a.scope = b.scope AND a.route = b.route AND b.i < a.i WHERE a.i > {PREDICT['min_samples']}""",
    "bq": """SELECT scope, route, i, any_value(actual) AS actual, any_value(actual_pct) AS actual_pct, max(d) AS now, coalesce(quantile_cont(gap::DOUBLE, 0.5) FILTER (WHERE gap > 0), 0) AS mid,
       coalesce(quantile_cont(gap::DOUBLE, 0.25) FILTER (WHERE gap > 0), 0) AS low, coalesce(quantile_cont(gap::DOUBLE, 0.75) FILTER (WHERE gap > 0), 7) AS high FROM bt GROUP BY ALL""",
    "bw": "SELECT scope, route, i, pct, round(sum(w), 9) AS w FROM bt GROUP BY ALL",
    "btop": "SELECT scope, route, i, pct AS top FROM bw QUALIFY row_number() OVER (PARTITION BY scope, route, i ORDER BY w DESC, pct) = 1",
    "backtest": """SELECT scope, route, count(*) AS observations, median(abs(now + floor(mid + 0.5)::INTEGER - actual))::DOUBLE AS median_error,
       floor(avg((actual BETWEEN now + floor(low + 0.5)::INTEGER AND now + floor(greatest(high, low + 1) + 0.5)::INTEGER)::INT) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS hit_rate,
       floor(avg((top = actual_pct)::INT) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS exact_bonus, floor(avg((abs(top - actual_pct) <= 5)::INT) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS near_bonus
       FROM bq JOIN btop USING (scope, route, i) GROUP BY scope, route""",
}


@query("q_backtest", using(BACKTEST, "SELECT * FROM backtest"))
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtests(events(eligible(spark, sf_dir)))


def predictions(rows: DataFrame) -> DataFrame:
    """One row a series: timing, readiness and confidence."""
    c = PREDICT
    ev = events(rows)
    t = with_timing(ev, "ev", as_of())
    days = F.array_sort(F.transform("iv", lambda x: x["days"]))
    t = t.withColumn("days", days).withColumn("n", F.size("ev").cast("bigint")).withColumn("mean", _mean(F.col("days")))
    t = t.withColumn("cv", F.when(F.col("mean") != 0, _stdev(F.col("days"), F.col("mean")) / F.col("mean")))
    t = t.join(backtests(ev), ["scope", "route"], "left")
    n, cv = F.col("n"), F.col("cv")
    base = F.when(n >= c["samples_alta"], 2).when(n >= c["samples_media"], 1).otherwise(0)
    irregular = F.coalesce(cv > c["cv_media"], F.lit(False)) & (base >= 1)
    moderate = F.coalesce(cv > c["cv_alta"], F.lit(False)) & (base == 2) & ~irregular
    by_cv = F.when(irregular, 0).when(moderate, 1).otherwise(base)
    few = F.coalesce(F.col("observations"), F.lit(0)) < c["backtest_min"]
    weak = ~few & F.coalesce(F.col("hit_rate") < 0.5, F.lit(False))
    rank = F.when(few, F.least(by_cv, F.lit(1))).when(weak, F.greatest(by_cv - 1, F.lit(0))).otherwise(by_cv)
    short = F.coalesce(F.datediff(F.element_at("ev", -1)["d"], F.get("ev", F.lit(0))["d"]) < 2 * array_quantile(F.col("days"), 0.5), F.lit(False))
    warned = irregular | moderate | few | weak | short
    enough = n >= c["min_samples"]
    return t.select(
        "scope", "route", "n", F.when(enough, F.col("central")).alias("central_date"), F.when(enough, F.col("starts")).alias("p_start"), F.when(enough, F.col("ends")).alias("p_end"),
        F.when(~enough, "insufficient_history").when(warned | (rank == 0), "ready_with_warnings").otherwise("ready").alias("readiness"),
        F.when(~enough, "insuficiente").when(rank == 2, "alta").when(rank == 1, "media").otherwise("baixa").alias("p_confidence"),
        *[F.when(enough, probability(h)).alias(f"p{h}") for h in (30, 60)],
    )


PREDICTIONS = {
    **TIMING,
    **{k: v for k, v in BACKTEST.items() if k not in SERIES},
    "gp": "SELECT scope, route, stddev_samp(gap) / nullif(avg(gap), 0) AS cv, median(gap) AS med, (max(d) - min(d)) AS span FROM waves GROUP BY scope, route",
    "g1": f"""SELECT timing.*, cv, med, span, observations, hit_rate, CASE WHEN n >= {PREDICT['samples_alta']} THEN 2 WHEN n >= {PREDICT['samples_media']} THEN 1 ELSE 0 END AS base,
       coalesce(observations, 0) < {PREDICT['backtest_min']} AS few FROM timing JOIN gp USING (scope, route) LEFT JOIN backtest USING (scope, route)""",
    "g2": f"SELECT *, coalesce(cv > {PREDICT['cv_media']}, false) AND base >= 1 AS irregular, coalesce(cv > {PREDICT['cv_alta']}, false) AND base = 2 AND NOT coalesce(cv > {PREDICT['cv_media']}, false) AS moderate, NOT few AND coalesce(hit_rate < 0.5, false) AS weak, coalesce(span < 2 * med, false) AS short FROM g1",
    "g3": "SELECT *, CASE WHEN irregular THEN 0 WHEN moderate THEN 1 ELSE base END AS by_cv FROM g2",
    "g4": "SELECT *, CASE WHEN few THEN least(by_cv, 1) WHEN weak THEN greatest(by_cv - 1, 0) ELSE by_cv END AS rank FROM g3",
    "prediction": f"""SELECT scope, route, n, CASE WHEN n >= {PREDICT['min_samples']} THEN central_date END AS central_date, CASE WHEN n >= {PREDICT['min_samples']} THEN window_start END AS p_start, CASE WHEN n >= {PREDICT['min_samples']} THEN window_end END AS p_end,
       CASE WHEN n < {PREDICT['min_samples']} THEN 'insufficient_history' WHEN irregular OR moderate OR few OR weak OR short OR rank = 0 THEN 'ready_with_warnings' ELSE 'ready' END AS readiness,
       CASE WHEN n < {PREDICT['min_samples']} THEN 'insuficiente' WHEN rank = 2 THEN 'alta' WHEN rank = 1 THEN 'media' ELSE 'baixa' END AS p_confidence,
       CASE WHEN n >= {PREDICT['min_samples']} THEN p30 END AS p30, CASE WHEN n >= {PREDICT['min_samples']} THEN p60 END AS p60 FROM g4""",
}


@query("q_readiness", using(PREDICTIONS, "SELECT scope, route, n, readiness, p_confidence FROM prediction"))
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(eligible(spark, sf_dir)).select("scope", "route", "n", "readiness", "p_confidence")
