"""Weekly consolidation: threads, their state in the week, blocks and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.registry import query, using
from granary.sources.tables import LEDGER, ledger

START, END, PRIOR = "2000-05-01", "2000-05-31", "2000-04-01"
WATCH_DAYS = 7


def thread_key(route: Column, entity: Column, category: Column) -> Column:
    """A thread is a route, else an entity, else the slug of a category."""
    return F.coalesce(F.nullif(route, F.lit("")), F.nullif(entity, F.lit("")), F.concat(F.lit("cat:"), X.slug(F.coalesce(F.nullif(category, F.lit("")), F.lit("sem-categoria")))))
_KEY = "CASE WHEN tier < 3 THEN origem || '→' || destino WHEN origem = destino THEN origem ELSE 'cat:' || lower(publico) END"
THREADS = {
    "ledger": LEDGER,
    "inwin": f"SELECT {_KEY} AS thread, *, CASE WHEN percentual >= 8 THEN 'vale-agir' WHEN percentual >= 4 THEN 'esperaria' ELSE 'evitaria' END AS verdict FROM ledger WHERE first_seen BETWEEN DATE '{START}' AND DATE '{END}'",
    "th": """SELECT thread, count(*) AS appearances, min(inicio) AS first_day, arg_min(verdict, (first_seen, id)) AS verdict_start, arg_max(verdict, (first_seen, id)) AS verdict_end,
       arg_min(percentual, (first_seen, id)) AS score_start, arg_max(percentual, (first_seen, id)) AS score_end, max(fim) AS fim FROM inwin GROUP BY thread""",
    "prior": f"SELECT DISTINCT {_KEY} AS thread FROM ledger WHERE first_seen >= DATE '{PRIOR}' AND first_seen < DATE '{START}'",
    "wk": f"""SELECT th.*, prior.thread IS NOT NULL AS in_prior, coalesce(fim < DATE '{END}', false) AS expired, verdict_start <> 'evitaria' AND verdict_end = 'evitaria' AS turned, coalesce(first_day < DATE '{START}', false) AS before FROM th LEFT JOIN prior USING (thread)""",
    "weekly": """SELECT *, CASE WHEN turned AND NOT expired THEN 'VIROU' WHEN expired OR turned THEN 'ENCERROU' WHEN NOT before THEN CASE WHEN in_prior THEN 'SEGUE' ELSE 'NOVO' END WHEN NOT in_prior THEN 'REABRIU' ELSE 'SEGUE' END AS state,
       CASE WHEN verdict_start <> verdict_end THEN 100 ELSE 0 END + abs(score_end - score_start) AS weight FROM wk""",
}


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a thread of the window: first and last values by min_by and max_by, and whether the period before had it.

    Rows of the last tier have no route here: they are threads of their nation if that is
    one, else of their segment.
    """
    route = F.when(F.col("tier") < 3, F.concat("origem", F.lit("→"), "destino"))
    entity = F.when(F.col("origem") == F.col("destino"), F.col("origem"))
    rows = ledger(spark, sf_dir).withColumn("thread", thread_key(route, entity, F.col("publico")))
    verdict = F.when(F.col("percentual") >= 8, "vale-agir").when(F.col("percentual") >= 4, "esperaria").otherwise("evitaria")
    at = F.struct("first_seen", "id")
    t = rows.filter(F.col("first_seen").between(START, END)).withColumn("verdict", verdict).groupBy("thread").agg(
        F.count("*").alias("appearances"), F.min("inicio").alias("first_day"), F.min_by("verdict", at).alias("verdict_start"), F.max_by("verdict", at).alias("verdict_end"),
        F.min_by("percentual", at).alias("score_start"), F.max_by("percentual", at).alias("score_end"), F.max("fim").alias("fim"),
    )
    prior = rows.filter((F.col("first_seen") >= PRIOR) & (F.col("first_seen") < START)).select("thread").distinct().withColumn("p", F.lit(True))
    t = t.join(prior, "thread", "left").withColumn("in_prior", F.coalesce("p", F.lit(False))).drop("p")
    expired = F.coalesce(F.col("fim") < F.lit(END).cast("date"), F.lit(False))
    turned = (F.col("verdict_start") != "evitaria") & (F.col("verdict_end") == "evitaria")
    before = F.coalesce(F.col("first_day") < F.lit(START).cast("date"), F.lit(False))
    state = F.when(turned & ~expired, "VIROU").when(expired | turned, "ENCERROU").when(~before, F.when(F.col("in_prior"), "SEGUE").otherwise("NOVO")).when(~F.col("in_prior"), "REABRIU").otherwise("SEGUE")
    weight = F.when(F.col("verdict_start") != F.col("verdict_end"), 100).otherwise(0) + F.abs(F.col("score_end") - F.col("score_start"))
    return t.withColumn("expired", expired).withColumn("state", state).withColumn("weight", weight)


@query("q_weekly_state", using(THREADS, "SELECT thread, appearances, verdict_start, verdict_end, in_prior, state FROM weekly"))
def weekly_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(spark, sf_dir).select("thread", "appearances", "verdict_start", "verdict_end", "in_prior", "state")


@query("q_weekly_blocks", using(THREADS, """
WITH h AS (SELECT thread, weight FROM weekly WHERE weight > 0 ORDER BY weight DESC, thread LIMIT 3),
r AS (SELECT thread, row_number() OVER (ORDER BY score_end DESC, thread) AS rank FROM weekly WHERE NOT expired AND thread NOT IN (SELECT thread FROM h) QUALIFY rank <= 10)
SELECT 'highlight' AS block, thread, row_number() OVER (ORDER BY weight DESC, thread) AS rank FROM h UNION ALL SELECT 'ranking', thread, rank FROM r
UNION ALL SELECT 'movement', thread, NULL FROM weekly WHERE state IN ('VIROU', 'REABRIU') AND thread NOT IN (SELECT thread FROM h) AND thread NOT IN (SELECT thread FROM r)"""))
def weekly_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread is in one block: highlights before ranking before movement, by anti-joins on the short lists."""
    from granary.operators.graph import written

    t = written(threads(spark, sf_dir))
    rank = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    h = t.filter("weight > 0").orderBy(F.desc("weight"), "thread").limit(3)
    r = t.filter("NOT expired").join(h.select("thread"), "thread", "left_anti").orderBy(F.desc("score_end"), "thread").limit(10)
    m = t.filter(F.col("state").isin("VIROU", "REABRIU")).join(h.select("thread"), "thread", "left_anti").join(r.select("thread"), "thread", "left_anti")
    of = lambda name, df: df.select(F.lit(name).alias("block"), "thread", "rank")
    return of("highlight", rank(h, F.desc("weight"), "thread")).union(of("ranking", rank(r, F.desc("score_end"), "thread"))).union(of("movement", m.withColumn("rank", F.lit(None).cast("bigint"))))


@query("q_transitions", using(THREADS, "SELECT thread, state, verdict_start, verdict_end, verdict_start <> verdict_end AS transitioned, score_start, score_end, fim AS valid_until FROM weekly"))
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(spark, sf_dir).select("thread", "state", "verdict_start", "verdict_end", (F.col("verdict_start") != F.col("verdict_end")).alias("transitioned"), "score_start", "score_end", F.col("fim").alias("valid_until"))


@query("q_weekly_watch", using(THREADS, f"""
SELECT thread, CASE WHEN verdict_end = 'evitaria' THEN 'confirm' ELSE 'ends' END AS reason, CASE WHEN verdict_end <> 'evitaria' THEN fim END AS ends FROM weekly
WHERE verdict_end = 'evitaria' OR (fim > DATE '{END}' AND fim <= DATE '{END}' + {WATCH_DAYS})"""))
def weekly_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to watch next week: threads still to be confirmed (here those to avoid stand for them), and those that end within it."""
    t = threads(spark, sf_dir)
    open_ = F.col("verdict_end") == "evitaria"
    ends = (F.col("fim") > F.lit(END).cast("date")) & (F.col("fim") <= F.date_add(F.lit(END).cast("date"), WATCH_DAYS))
    return t.filter(open_ | F.coalesce(ends, F.lit(False))).select("thread", F.when(open_, "confirm").otherwise("ends").alias("reason"), F.when(~open_, F.col("fim")).alias("ends"))
