"""Job queue and rate limits as batch steps, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.registry import query, using
from granary.sources.tables import CALLS, calls, table

# The queue's and the limit's settings.
BATCH, BACKOFF_SECONDS, BACKOFF_MOST, MAX_ATTEMPTS = 50, 30, 8, 5
LIMIT_SECONDS, LIMIT_HITS = 60, 5

_JOBS = """
  SELECT event_id AS id, event_type AS tipo, user_id AS chave, CASE WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'retry' WHEN event_id % 4 = 2 THEN 'running' ELSE 'success' END AS status,
         (value::BIGINT % 10) AS priority, event_id % 7 AS attempts, ts AS run_after FROM events"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    status = F.when(k == 0, "pending").when(k == 1, "retry").when(k == 2, "running").otherwise("success")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("tipo"), F.col("user_id").alias("chave"), status.alias("status"), (F.rint("value").cast("bigint") % 10).alias("priority"), (F.col("event_id") % 7).alias("attempts"), F.col("ts").alias("run_after"))


@query("q_queue_claim", using({"jobs": _JOBS}, f"SELECT id, priority, attempts + 1 AS attempts FROM jobs WHERE status IN ('pending', 'retry') AND run_after <= TIMESTAMP '2024-01-20' ORDER BY priority, run_after, id LIMIT {BATCH}"))
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch by priority and time; there is one writer, so no row locks."""
    due = jobs(spark, sf_dir).filter("status IN ('pending', 'retry') AND run_after <= TIMESTAMP_NTZ '2024-01-20'")
    return due.orderBy("priority", "run_after", "id").limit(BATCH).select("id", "priority", (F.col("attempts") + 1).alias("attempts"))


# The states in which a job is open.
OPEN = ("pending", "running", "retry")


def enqueued(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (id, tipo, chave, priority) with job and inserted: the job that does the work, and whether that is a new row.

    A key that has an open job, or that came earlier in the batch, gets that job; rows
    without a key are jobs of their own.  Keys are pre-aggregated, so a hot one is a row.
    """
    open_ = queue.filter(F.col("status").isin(*OPEN) & F.col("chave").isNotNull()).groupBy("tipo", "chave").agg(F.min("id").alias("standing"))
    first = incoming.filter("chave IS NOT NULL").groupBy("tipo", "chave").agg(F.min("id").alias("first"))
    rows = incoming.join(open_, ["tipo", "chave"], "left").join(first, ["tipo", "chave"], "left")
    job = F.coalesce("standing", "first", "id")
    return rows.select("id", "tipo", "chave", "priority", job.alias("job"), (F.col("standing").isNull() & (job == F.col("id"))).alias("inserted"))


@query("q_queue_enqueue", using({"jobs": _JOBS}, """
WITH o AS (SELECT tipo, chave, min(id) AS standing FROM jobs WHERE id % 3 = 0 AND status IN ('pending', 'running', 'retry') GROUP BY ALL),
i AS (SELECT id, tipo, CASE WHEN id % 11 > 0 THEN chave END AS chave, priority FROM jobs WHERE id % 3 = 1),
f AS (SELECT tipo, chave, min(id) AS first FROM i WHERE chave IS NOT NULL GROUP BY ALL)
SELECT id, i.tipo, i.chave, priority, coalesce(standing, first, id) AS job, standing IS NULL AND coalesce(first, id) = id AS inserted
FROM i LEFT JOIN o ON o.tipo = i.tipo AND o.chave = i.chave LEFT JOIN f ON f.tipo = i.tipo AND f.chave = i.chave"""))
def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the jobs stand in the queue, a third come in; one in eleven of these has no key."""
    rows = jobs(spark, sf_dir)
    incoming = rows.filter("id % 3 = 1").withColumn("chave", F.when(F.col("id") % 11 > 0, F.col("chave")))
    return enqueued(rows.filter("id % 3 = 0"), incoming)


def after_failure(attempts: Column) -> tuple[Column, Column]:
    """(status, seconds to wait): dead letter at the last attempt, else exponential backoff."""
    dead = attempts >= MAX_ATTEMPTS
    return F.when(dead, "dead_letter").otherwise("retry"), F.when(~dead, (F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2.0), F.least(attempts, F.lit(BACKOFF_MOST)))).cast("bigint"))


@query("q_queue_backoff", using({"jobs": _JOBS}, f"SELECT id, CASE WHEN attempts >= {MAX_ATTEMPTS} THEN 'dead_letter' ELSE 'retry' END AS status, CASE WHEN attempts < {MAX_ATTEMPTS} THEN ({BACKOFF_SECONDS} * power(2, least(attempts, {BACKOFF_MOST})))::BIGINT END AS wait_seconds FROM jobs WHERE status = 'running'"))
def queue_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, wait = after_failure(F.col("attempts"))
    return jobs(spark, sf_dir).filter("status = 'running'").select("id", status.alias("status"), wait.alias("wait_seconds"))


@query("q_rate_limit", using({"calls": CALLS}, f"""
WITH h AS (SELECT user_id, dia, floor(epoch(ts))::BIGINT AS s, id FROM calls),
a AS (SELECT user_id, dia, min(s) AS anchor FROM h GROUP BY ALL UNION ALL SELECT h.user_id, h.dia, min(s) FROM a JOIN h ON a.user_id = h.user_id AND a.dia = h.dia AND h.s >= a.anchor + 1800 GROUP BY h.user_id, h.dia, a.anchor),
w AS (SELECT h.id, h.user_id, max(anchor) AS anchor, h.s FROM h JOIN a ON a.user_id = h.user_id AND a.dia = h.dia AND a.anchor <= h.s GROUP BY h.id, h.user_id, h.s)
SELECT id, row_number() OVER (PARTITION BY user_id, anchor ORDER BY s, id) AS hit, row_number() OVER (PARTITION BY user_id, anchor ORDER BY s, id) > 2 AS blocked FROM w"""))
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window opens at the first hit after the last one closed; hits beyond the limit are blocked.

    The fold over a user's day keeps (window start, hits); here windows of half an
    hour allow two hits, as events are sparse.  Live it is limited_stream().
    """
    rows = calls(spark, sf_dir).select("user_id", "dia", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("s"), "id")
    grouped = rows.groupBy("user_id", "dia").agg(F.array_sort(F.collect_list(F.struct("s", "id"))).alias("h"))
    none = F.struct(F.lit(None).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<id:bigint,hit:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["start"].isNull() | (x["s"] >= acc["start"] + 1800)
        n = F.when(fresh, F.lit(1).cast("bigint")).otherwise(acc["n"] + 1)
        return F.struct(F.when(fresh, x["s"]).otherwise(acc["start"]).alias("start"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), n.alias("hit")))).alias("out"))

    out = grouped.select(F.explode(F.aggregate("h", none, step)["out"]).alias("x"))
    return out.select("x.id", "x.hit", (F.col("x.hit") > 2).alias("blocked"))


@query("q_freshness", using({"calls": CALLS}, """
WITH l AS (SELECT estagio, user_id % 50 AS shard, max(ts) AS last, count(custo) AS priced, count(*) AS n FROM calls GROUP BY ALL)
SELECT estagio, shard, CASE WHEN priced = 0 THEN 'invalid' WHEN n < 30 THEN 'incomplete' WHEN last < TIMESTAMP '2024-01-30' THEN 'stale' ELSE 'fresh' END AS freshness FROM l"""))
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artifact is invalid, incomplete, stale after a day, or fresh."""
    a = calls(spark, sf_dir).groupBy("estagio", (F.col("user_id") % 50).alias("shard")).agg(F.max("ts").alias("last"), F.count("custo").alias("priced"), F.count("*").alias("n"))
    state = F.when(F.col("priced") == 0, "invalid").when(F.col("n") < 30, "incomplete").when(F.expr("last < TIMESTAMP_NTZ '2024-01-30'"), "stale").otherwise("fresh")
    return a.select("estagio", "shard", state.alias("freshness"))
