"""Radar: forecast and prediction of a series put together with its quality, its status, health and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.graph import written
from granary.operators.ranges import meeting, within
from granary.plans.forecast import FORECASTS, PREDICTIONS, admissible, dated, eligible, forecasts, predictions
from granary.registry import query, using
from granary.sources.tables import AS_OF, as_of, half_up, ledger

OPPORTUNITY_DAYS = 30
# The statuses that block a series, in their order.
BLOCKED = ("dataset_incomplete", "data_quality_blocked", "duplicate_review", "insufficient_history", "no_prediction")


def divergence(days: Column, overlap: Column) -> Column:
    """compatible, warning, review, block by 14, 30 and 60 days; one step less where the windows overlap."""
    step = F.when(days <= 14, 0).when(days <= 30, 1).when(days <= 60, 2).otherwise(3)
    eased = F.when(overlap & (step > 0), step - 1).otherwise(step)
    return F.when(days.isNull(), "none").otherwise(F.element_at(F.array(*map(F.lit, ("compatible", "warning", "review", "block"))), eased + 1))


def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a series: full outer join of both engines and left join of the counts of critical rows."""
    counted = dated(spark, sf_dir)
    rows = admissible(counted)
    f = forecasts(rows).select("scope", "route", "samples", "confidence", "typical", "window_start", "window_end", "block_reason", "requires_review")
    p = predictions(rows)
    crit = counted.filter("far > 0").groupBy(F.lit("route").alias("scope"), F.concat("origem", F.lit("→"), "destino").alias("route")).agg(F.sum("far").alias("critical"))
    both = f.join(p, ["scope", "route"], "full_outer").join(crit, ["scope", "route"], "left").na.fill({"critical": 0})
    return written(both)


def with_status(both: DataFrame) -> DataFrame:
    center = F.date_add("window_start", F.floor(F.datediff("window_end", "window_start") / 2).cast("int"))
    days = F.abs(F.datediff(center, "central_date")).cast("bigint")
    overlap = (F.col("window_start") <= F.col("p_end")) & (F.col("p_start") <= F.col("window_end"))
    rows = both.withColumn("divergence_days", days).withColumn("divergence", divergence(days, F.coalesce(overlap, F.lit(False))))
    ok = F.col("block_reason").isNull() & F.col("confidence").isNotNull()
    short = (F.col("readiness") == "insufficient_history") | F.col("block_reason").like("historico_insuficiente%") | (F.col("confidence") == "em-formacao")
    ahead = F.datediff(F.coalesce("p_start", "window_start"), as_of())
    good = F.coalesce("p_confidence", "confidence").isin("alta", "media")
    status = (
        F.when(F.col("critical") > 0, "data_quality_blocked")
        .when(F.coalesce(short, F.lit(False)), "insufficient_history")
        .when(F.coalesce(F.col("requires_review"), F.lit(False)) | F.col("divergence").isin("review", "block"), "review_required")
        .when(~ok, "no_prediction")
        .when(good & ahead.between(0, OPPORTUNITY_DAYS) & F.coalesce(F.col("readiness") != "insufficient_history", F.lit(True)), "opportunity")
        .otherwise("monitoring")
    )
    return rows.withColumn("status", status).withColumn("editorial_eligible", ok)


RADAR = {
    **FORECASTS,
    **{k: v for k, v in PREDICTIONS.items() if k not in FORECASTS},
    "crit": "SELECT 'route' AS scope, origem || '→' || destino AS route, count(*) AS critical FROM temporal WHERE origem <> destino AND status = 'suspect_year' AND gap > 2200 GROUP BY ALL",
    "r1": """SELECT *, coalesce(critical, 0) AS crits, abs(window_start + ((window_end - window_start) // 2)::INTEGER - central_date)::BIGINT AS divergence_days,
       coalesce(window_start <= p_end AND p_start <= window_end, false) AS overlap FROM forecast FULL JOIN prediction USING (scope, route) LEFT JOIN crit USING (scope, route)""",
    "r2": "SELECT *, CASE WHEN divergence_days <= 14 THEN 0 WHEN divergence_days <= 30 THEN 1 WHEN divergence_days <= 60 THEN 2 ELSE 3 END AS step FROM r1",
    "r3": "SELECT *, CASE WHEN divergence_days IS NULL THEN 'none' ELSE ['compatible', 'warning', 'review', 'block'][CASE WHEN overlap AND step > 0 THEN step - 1 ELSE step END + 1] END AS divergence, block_reason IS NULL AND confidence IS NOT NULL AS editorial_eligible FROM r2",
    "radar": f"""SELECT *, CASE WHEN crits > 0 THEN 'data_quality_blocked'
       WHEN coalesce(readiness = 'insufficient_history' OR block_reason LIKE 'historico_insuficiente%' OR confidence = 'em-formacao', false) THEN 'insufficient_history'
       WHEN coalesce(requires_review, false) OR divergence IN ('review', 'block') THEN 'review_required' WHEN NOT editorial_eligible THEN 'no_prediction'
       WHEN coalesce(p_confidence, confidence) IN ('alta', 'media') AND coalesce(p_start, window_start) - DATE '{AS_OF}' BETWEEN 0 AND {OPPORTUNITY_DAYS} AND coalesce(readiness <> 'insufficient_history', true) THEN 'opportunity' ELSE 'monitoring' END AS status FROM r3""",
}


@query("q_radar_status", using(RADAR, "SELECT scope, route, divergence_days, divergence, status, editorial_eligible FROM radar"))
def radar_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only gaps of over 2,200 days count as open data-quality cases here, as nearly every synthetic route has lesser ones."""
    return with_status(radar(spark, sf_dir)).select("scope", "route", "divergence_days", "divergence", "status", "editorial_eligible")


@query("q_radar_health", using(RADAR, f"""
SELECT count(*) AS series_total, count(*) FILTER (WHERE editorial_eligible) AS series_eligible, count(*) FILTER (WHERE status IN {BLOCKED}) AS series_blocked,
       count(*) FILTER (WHERE divergence IN ('review', 'block')) AS divergences, sum(crits)::BIGINT AS critical_rows,
       (max((crits > 0)::INT) + max((divergence IN ('review', 'block'))::INT))::BIGINT AS alerts FROM radar"""))
def radar_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.col("divergence").isin("review", "block")
    return with_status(radar(spark, sf_dir)).agg(
        F.count("*").alias("series_total"), F.count_if("editorial_eligible").alias("series_eligible"), F.count_if(F.col("status").isin(*BLOCKED)).alias("series_blocked"), F.count_if(split).alias("divergences"),
        F.sum("critical").alias("critical_rows"), (F.max((F.col("critical") > 0).cast("int")) + F.max(split.cast("int"))).cast("bigint").alias("alerts"),
    )


# Reasons of an editorial block that a reviewer may override.
OVERRIDABLE = r"intervalo_extremo|horizonte_excedido"


def operational(series: DataFrame, complete: bool = True, freshness: str = "fresh") -> DataFrame:
    """Series (with status, divergence, engines and counts of critical, placeholder, probable and possible rows) with engine and the flags that queues and alerts ask for."""
    ready = F.col("readiness").isin("ready", "ready_with_warnings")
    engine = F.when(ready, "predict").when(F.col("editorial_eligible") & F.col("window_start").isNotNull(), "forecast").otherwise("none")
    critical = F.col("status").isin("dataset_incomplete", "data_quality_blocked") | (F.col("critical") > 0) | (F.col("placeholder") > 0)
    return series.select(
        "*", engine.alias("engine"), critical.alias("is_critical"), F.coalesce(F.col("block_reason").rlike(OVERRIDABLE), F.lit(False)).alias("overridable"),
        F.coalesce(ready, F.lit(False)).alias("predicts"), F.coalesce((F.col("confidence") != "em-formacao") & F.col("window_start").isNotNull(), F.lit(False)).alias("forecasts"),
        F.lit(complete).alias("complete"), F.lit(freshness == "fresh").alias("fresh"),
    )


def queues(series: DataFrame) -> DataFrame:
    """(queue, scope, route) of operational() series; a series can be in several of the eight queues."""
    status = F.col("status")
    split = F.col("divergence").isin("review", "block")
    member = {
        "opportunities": F.col("complete") & F.col("fresh") & (status == "opportunity") & F.col("editorial_eligible") & ~F.col("is_critical") & (F.col("engine") != "none"),
        "review": (status == "review_required") | split | ((F.col("possible") > 0) & (F.col("probable") == 0)) | (F.col("engine") == "forecast") | F.col("overridable"),
        "blocked": status.isin(*BLOCKED) | F.col("overridable") | ~F.col("fresh"),
        "suspects": F.col("critical") > 0,
        "duplicates": F.col("probable") > 0,
        "insufficient": status == "insufficient_history",
        "stale": ~F.col("fresh"),
        "no_prediction": (F.col("engine") == "none") | (status == "no_prediction"),
    }
    return series.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in member.items()]))).alias("queue"), "scope", "route")


def alerts(series: DataFrame) -> DataFrame:
    """(alert, severity, scope, affected): a row an alert that is on; counts are of series or of the rows that quality counted."""
    n = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    kinds = [
        ("dataset_incomplete", "critical", "global", n(~F.col("complete"))), ("stale", "warning", "global", n(~F.col("fresh"))), ("temporal", "critical", "series", total("critical")), ("duplicates", "warning", "series", total("probable")),
        ("placeholders", "warning", "series", total("placeholder")), ("no_prediction", "info", "series", n(F.col("engine") == "none")), ("forecast_unavailable", "info", "series", n(~F.col("forecasts"))),
        ("predict_unavailable", "info", "series", n(~F.col("predicts"))), ("divergence_block", "critical", "series", n(F.col("divergence") == "block")),
    ]
    return _counted(series, kinds, "alert", ("severity", "scope"))


def changes(series: DataFrame) -> DataFrame:
    """(change, scope, count): what this reading found; nothing is inferred about readings before it."""
    n = lambda c: F.count_if(c)
    lost = F.col("excluded") > 0
    flag = lambda c: F.coalesce(F.max(c.cast("long")), F.lit(0))
    kinds = [
        ("campaign_excluded_now", "series", F.coalesce(F.sum("excluded"), F.lit(0))), ("probable_duplicate_detected", "series", F.coalesce(F.sum("probable"), F.lit(0))), ("temporal_issue_detected", "series", F.coalesce(F.sum("critical"), F.lit(0))),
        ("eligibility_lost", "series", n(~F.col("editorial_eligible") & lost)), ("insufficient_history_after_quality", "series", n((F.col("status") == "insufficient_history") & lost)),
        ("dataset_incomplete", "global", flag(~F.col("complete"))), ("forecast_stale", "global", flag(~F.col("fresh"))), ("predict_unavailable", "series", n(~F.col("predicts"))), ("forecast_fallback_active", "series", n(F.col("engine") == "forecast")),
        ("divergence_review_required", "series", n(F.col("divergence") == "review")), ("divergence_blocking", "series", n(F.col("divergence") == "block")),
    ]
    return _counted(series, kinds, "change", ("scope",), "count")


def _counted(series: DataFrame, kinds: list[tuple], name: str, labels: tuple[str, ...], count: str = "affected") -> DataFrame:
    """One aggregation of all counts, then a row for each that is not zero."""
    one = series.agg(*[k[-1].cast("long").alias(k[0]) for k in kinds])
    rows = F.array(*[F.struct(F.lit(k[0]).alias(name), *[F.lit(v).alias(c) for v, c in zip(k[1:-1], labels, strict=True)], F.col(k[0]).alias(count)) for k in kinds])
    return one.select(F.explode(rows).alias("x")).select("x.*").filter(F.col(count) > 0)


def series_of(spark: SparkSession, sf_dir: str, complete: bool = True, freshness: str = "fresh") -> DataFrame:
    """The radar's series with counts: a repeated offer of one day is a probable duplicate, one of another day a possible one; a product of its own number is a placeholder."""
    key = F.concat("origem", F.lit("→"), "destino")
    rows = ledger(spark, sf_dir).select(key.alias("route"), "produto", "percentual", "first_seen")
    days = rows.groupBy("route", "produto", "percentual").agg(F.count("*").alias("n"), F.count_distinct("first_seen").alias("d"))
    counts = days.groupBy("route").agg(F.sum(F.col("n") - F.col("d")).alias("probable"), F.sum(F.col("d") - 1).alias("possible"), F.sum(F.when(F.col("produto") % 97 == 0, F.col("n")).otherwise(0)).alias("placeholder"))
    both = with_status(radar(spark, sf_dir)).join(counts.withColumn("scope", F.lit("route")), ["scope", "route"], "left").na.fill(0, ["probable", "possible", "placeholder"])
    return operational(both.withColumn("excluded", F.col("critical") + F.col("placeholder")), complete, freshness)


def _ops(complete: bool, fresh: bool) -> dict[str, str]:
    return {
        **RADAR,
        "dd": "SELECT origem || '→' || destino AS route, produto, percentual, count(*) AS n, count(DISTINCT first_seen) AS d FROM ledger GROUP BY ALL",
        "dc": "SELECT 'route' AS scope, route, sum(n - d) AS probable, sum(d - 1) AS possible, sum(CASE WHEN produto % 97 = 0 THEN n ELSE 0 END) AS placeholder FROM dd GROUP BY route",
        "o1": f"""SELECT radar.*, coalesce(probable, 0) AS probable, coalesce(possible, 0) AS possible, coalesce(placeholder, 0) AS placeholder, {complete} AS complete, {fresh} AS fresh,
           coalesce(regexp_matches(block_reason, '{OVERRIDABLE}'), false) AS overridable, coalesce(readiness IN ('ready', 'ready_with_warnings'), false) AS predicts, coalesce(confidence <> 'em-formacao' AND window_start IS NOT NULL, false) AS forecasts,
           CASE WHEN readiness IN ('ready', 'ready_with_warnings') THEN 'predict' WHEN editorial_eligible AND window_start IS NOT NULL THEN 'forecast' ELSE 'none' END AS engine FROM radar LEFT JOIN dc USING (scope, route)""",
        "ops": "SELECT *, crits + placeholder AS excluded, status IN ('dataset_incomplete', 'data_quality_blocked') OR crits > 0 OR placeholder > 0 AS is_critical FROM o1",
    }


@query("q_radar_queues", using(_ops(True, True), f"""
WITH q AS (SELECT scope, route, unnest([CASE WHEN complete AND fresh AND status = 'opportunity' AND editorial_eligible AND NOT is_critical AND engine <> 'none' THEN 'opportunities' END,
  CASE WHEN status = 'review_required' OR divergence IN ('review', 'block') OR (possible > 0 AND probable = 0) OR engine = 'forecast' OR overridable THEN 'review' END, CASE WHEN status IN {BLOCKED} OR overridable OR NOT fresh THEN 'blocked' END,
  CASE WHEN crits > 0 THEN 'suspects' END, CASE WHEN probable > 0 THEN 'duplicates' END, CASE WHEN status = 'insufficient_history' THEN 'insufficient' END, CASE WHEN NOT fresh THEN 'stale' END,
  CASE WHEN engine = 'none' OR status = 'no_prediction' THEN 'no_prediction' END]) AS queue FROM ops)
SELECT queue, scope, route FROM q WHERE queue IS NOT NULL"""))
def radar_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight queues over a complete and fresh base, so that of stale series is empty."""
    return queues(series_of(spark, sf_dir))


@query("q_radar_alerts", using(_ops(True, False), """
WITH a AS (SELECT unnest([{'alert': 'dataset_incomplete', 'severity': 'critical', 'scope': 'global', 'affected': count(*) FILTER (WHERE NOT complete)}, {'alert': 'stale', 'severity': 'warning', 'scope': 'global', 'affected': count(*) FILTER (WHERE NOT fresh)},
  {'alert': 'temporal', 'severity': 'critical', 'scope': 'series', 'affected': sum(crits)::BIGINT}, {'alert': 'duplicates', 'severity': 'warning', 'scope': 'series', 'affected': sum(probable)::BIGINT}, {'alert': 'placeholders', 'severity': 'warning', 'scope': 'series', 'affected': sum(placeholder)::BIGINT},
  {'alert': 'no_prediction', 'severity': 'info', 'scope': 'series', 'affected': count(*) FILTER (WHERE engine = 'none')}, {'alert': 'forecast_unavailable', 'severity': 'info', 'scope': 'series', 'affected': count(*) FILTER (WHERE NOT forecasts)},
  {'alert': 'predict_unavailable', 'severity': 'info', 'scope': 'series', 'affected': count(*) FILTER (WHERE NOT predicts)}, {'alert': 'divergence_block', 'severity': 'critical', 'scope': 'series', 'affected': count(*) FILTER (WHERE divergence = 'block')}]) AS x FROM ops)
SELECT x.alert, x.severity, x.scope, x.affected FROM a WHERE x.affected > 0"""))
def radar_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a reading whose artifact is stale."""
    return alerts(series_of(spark, sf_dir, freshness="stale"))


@query("q_radar_changes", using(_ops(True, False), """
WITH a AS (SELECT unnest([{'change': 'campaign_excluded_now', 'scope': 'series', 'count': sum(excluded)::BIGINT}, {'change': 'probable_duplicate_detected', 'scope': 'series', 'count': sum(probable)::BIGINT}, {'change': 'temporal_issue_detected', 'scope': 'series', 'count': sum(crits)::BIGINT},
  {'change': 'eligibility_lost', 'scope': 'series', 'count': count(*) FILTER (WHERE NOT editorial_eligible AND excluded > 0)}, {'change': 'insufficient_history_after_quality', 'scope': 'series', 'count': count(*) FILTER (WHERE status = 'insufficient_history' AND excluded > 0)},
  {'change': 'dataset_incomplete', 'scope': 'global', 'count': max((NOT complete)::INT)::BIGINT}, {'change': 'forecast_stale', 'scope': 'global', 'count': max((NOT fresh)::INT)::BIGINT}, {'change': 'predict_unavailable', 'scope': 'series', 'count': count(*) FILTER (WHERE NOT predicts)},
  {'change': 'forecast_fallback_active', 'scope': 'series', 'count': count(*) FILTER (WHERE engine = 'forecast')}, {'change': 'divergence_review_required', 'scope': 'series', 'count': count(*) FILTER (WHERE divergence = 'review')}, {'change': 'divergence_blocking', 'scope': 'series', 'count': count(*) FILTER (WHERE divergence = 'block')}]) AS x FROM ops)
SELECT x.change, x.scope, x.count FROM a WHERE x.count > 0"""))
def radar_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(series_of(spark, sf_dir, freshness="stale"))


@query("q_full_outer_compose", using(RADAR, """
SELECT scope, route, forecast.route IS NOT NULL AS in_forecast, prediction.route IS NOT NULL AS in_prediction, samples, n FROM forecast FULL JOIN (SELECT * FROM prediction WHERE readiness = 'ready_with_warnings') prediction USING (scope, route)"""))
def full_outer_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = eligible(spark, sf_dir)
    f = forecasts(rows).select("scope", "route", "samples", F.lit(True).alias("f"))
    p = predictions(rows).select("scope", "route", "n", "readiness")
    p = written(p).filter("readiness = 'ready_with_warnings'").select("scope", "route", "n", F.lit(True).alias("p"))
    return f.join(p, ["scope", "route"], "full_outer").select("scope", "route", F.coalesce("f", F.lit(False)).alias("in_forecast"), F.coalesce("p", F.lit(False)).alias("in_prediction"), "samples", "n")


@query("q_override_apply", using(FORECASTS, """
WITH o AS (SELECT 'route' AS scope, a.n_name || '→' || b.n_name AS route, (a.n_nationkey + b.n_nationkey) % 3 = 0 AS muted, a.n_nationkey = b.n_regionkey AS pinned FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT scope, route, confidence, coalesce(pinned, false) AS pinned, coalesce(muted, false) AS muted FROM forecast LEFT JOIN o USING (scope, route)"""))
def override_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual overrides by scope and route; here derived from nations that share a region."""
    from granary.sources.tables import table

    a, b = table(spark, sf_dir, "nation").alias("a"), table(spark, sf_dir, "nation").alias("b")
    o = a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(
        F.lit("route").alias("scope"), F.concat("a.n_name", F.lit("→"), "b.n_name").alias("route"), ((F.col("a.n_nationkey") + F.col("b.n_nationkey")) % 3 == 0).alias("muted"), (F.col("a.n_nationkey") == F.col("b.n_regionkey")).alias("pinned")
    )
    f = forecasts(eligible(spark, sf_dir)).select("scope", "route", "confidence")
    return f.join(o, ["scope", "route"], "left").select("scope", "route", "confidence", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.coalesce("muted", F.lit(False)).alias("muted"))


@query("q_radar_consistency", using(FORECASTS, """
WITH p AS (SELECT upper(route) AS label, (typical + length(route) % 2)::BIGINT AS value FROM forecast WHERE length(route) % 5 <> 0)
SELECT f.scope, f.route, CASE WHEN p.label IS NULL THEN 'missing' WHEN value <> typical THEN 'differing' ELSE 'equal' END AS state FROM forecast f LEFT JOIN p ON p.label = upper(f.route)"""))
def radar_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published values (here some missing, some off by one) against the current forecast, by normalised label."""
    f = forecasts(eligible(spark, sf_dir)).select("scope", "route", "typical")
    p = f.filter(F.length("route") % 5 != 0).select(F.upper("route").alias("label"), (F.col("typical") + F.length("route") % 2).alias("value"))
    state = F.when(F.col("label").isNull(), "missing").when(F.col("value") != F.col("typical"), "differing").otherwise("equal")
    return f.join(p, F.upper("route") == F.col("label"), "left").select("scope", "route", state.alias("state"))


@query("q_format_window", using(FORECASTS, """
WITH m AS (SELECT scope, route, window_start AS a, window_end AS b, ['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez'] AS n FROM forecast WHERE window_start IS NOT NULL)
SELECT scope, route, CASE WHEN year(a) <> year(b) THEN day(a) || ' ' || n[month(a)] || ' ' || year(a) || ' a ' || day(b) || ' ' || n[month(b)] || ' ' || year(b)
  WHEN month(a) <> month(b) THEN day(a) || ' ' || n[month(a)] || ' a ' || day(b) || ' ' || n[month(b)] ELSE day(a) || ' a ' || day(b) || ' ' || n[month(b)] END AS label FROM m"""))
def format_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = F.array(*map(F.lit, ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")))
    a, b = F.col("window_start"), F.col("window_end")
    name = lambda d: F.element_at(months, F.month(d))
    date = lambda d: F.concat(F.dayofmonth(d), F.lit(" "), name(d))
    to = F.lit(" a ")
    label = (
        F.when(F.year(a) != F.year(b), F.concat(date(a), F.lit(" "), F.year(a), to, date(b), F.lit(" "), F.year(b)))
        .when(F.month(a) != F.month(b), F.concat(date(a), to, date(b)))
        .otherwise(F.concat(F.dayofmonth(a), to, date(b)))
    )
    return forecasts(eligible(spark, sf_dir)).filter("samples >= 2").select("scope", "route", label.alias("label"))


@query("q_interval_overlap", using(FORECASTS, """
SELECT r.route, c.route AS cluster, (least(r.window_end, c.window_end) - greatest(r.window_start, c.window_start))::BIGINT AS days
FROM forecast r JOIN forecast c ON c.scope = 'cluster' AND r.scope = 'route' AND c.route = '→' || string_split(r.route, '→')[2] AND r.window_start <= c.window_end AND c.window_start <= r.window_end"""))
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a route and its cluster that intersect: an equality on the target carries the range condition."""
    f = written(forecasts(eligible(spark, sf_dir)))
    r = f.filter("scope = 'route'").select("route", F.concat(F.lit("→"), F.element_at(F.split("route", "→"), 2)).alias("cluster"), F.col("window_start").alias("a"), F.col("window_end").alias("b"))
    c = f.filter("scope = 'cluster'").select(F.col("route").alias("cluster"), F.col("window_start").alias("x"), F.col("window_end").alias("y"))
    both = r.join(c, "cluster").filter("a <= y AND x <= b")
    return both.select("route", "cluster", F.datediff(F.least("b", "y"), F.greatest("a", "x")).cast("bigint").alias("days"))


#: Days of a bin: a forecast's window has 7 to 25 of them.
BIN_DAYS = 16


@query("q_window_pairs", using(FORECASTS, """
SELECT a.scope AS scope, a.route, b.scope AS other_scope, b.route AS other, (least(a.window_end, b.window_end) - greatest(a.window_start, b.window_start))::BIGINT AS days
FROM forecast a JOIN forecast b ON (a.scope, a.route) < (b.scope, b.route) AND a.window_start <= b.window_end AND b.window_start <= a.window_end"""))
def window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of series, whatever their target, whose windows intersect: a range join without an equality."""
    day = lambda c: F.unix_date(c).alias(c)
    f = written(forecasts(eligible(spark, sf_dir)).select("scope", "route", day("window_start"), day("window_end")))
    both = meeting(f, f, "window_start", "window_end", BIN_DAYS).filter(F.struct("a_scope", "a_route") < F.struct("b_scope", "b_route"))
    days = (F.least("a_window_end", "b_window_end") - F.greatest("a_window_start", "b_window_start")).cast("bigint")
    return both.select(F.col("a_scope").alias("scope"), F.col("a_route").alias("route"), F.col("b_scope").alias("other_scope"), F.col("b_route").alias("other"), days.alias("days"))


@query("q_near_series", using(FORECASTS, """
SELECT a.scope AS scope, a.route, b.route AS other, abs(a.last - b.last)::BIGINT AS days, abs(a.typical - b.typical)::BIGINT AS points
FROM forecast a JOIN forecast b ON a.scope = b.scope AND a.route < b.route AND abs(a.last - b.last) <= 3 AND abs(a.typical - b.typical) <= 1"""))
def near_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of one scope whose last events lie at most three days and a point apart: a join within tolerances."""
    f = written(forecasts(eligible(spark, sf_dir)).select("scope", "route", F.unix_date("last").alias("last"), "typical"))
    points = F.abs(F.col("a_typical") - F.col("b_typical"))
    both = within(f, f, "last", 3, (F.col("a_scope") == F.col("b_scope")) & (F.col("a_route") < F.col("b_route")) & (points <= 1))
    return both.select(F.col("a_scope").alias("scope"), F.col("a_route").alias("route"), F.col("b_route").alias("other"), F.abs(F.col("a_last") - F.col("b_last")).cast("bigint").alias("days"), points.cast("bigint").alias("points"))
