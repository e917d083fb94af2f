"""The database's functions as SQL functions of a session: call register(spark) once, then use them in spark.sql().

Scalar functions are macros that Catalyst puts into the plan; table functions read the
views ``queue_jobs`` (jobid, jobname, command, schedule, active) and ``queue_runs`` (jobid,
status, start_time, end_time, return_message), which ``views`` makes of two DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import ACCENTED, PLAIN
from granary.registry import query, using
from granary.sources.tables import AS_OF, CALLS, LEDGER, calls, ledger

#: name -> CREATE statement; what reads the views stands behind what does not.
SCALARS = {
    "estado_vigencia": """(fim DATE, confiavel BOOLEAN, tem_tier1 BOOLEAN DEFAULT false, ref DATE DEFAULT current_date()) RETURNS STRING RETURN CASE
        WHEN confiavel IS NOT TRUE OR fim IS NULL THEN 'indeterminada' WHEN fim < date_sub(ref, 30) THEN 'historica' WHEN fim < ref THEN 'encerrada'
        WHEN fim <= date_add(ref, 3) THEN 'ultimos_dias' WHEN tem_tier1 THEN 'ativa' ELSE 'detectada' END""",
    "texto_normalizado": f"(t STRING) RETURNS STRING RETURN trim(regexp_replace(translate(lower(t), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' '))",
    "slug": "(t STRING) RETURNS STRING RETURN replace(texto_normalizado(t), ' ', '-')",
    "espera_de_tentativa": "(tentativas INT) RETURNS BIGINT RETURN CAST(30 * power(2, least(tentativas, 8)) AS BIGINT)",
    "grupo_de_job": "(nome STRING) RETURNS STRING RETURN CASE WHEN nome LIKE 'ingest%' THEN 'coleta' WHEN nome LIKE 'extract%' THEN 'analise' WHEN nome LIKE 'backfill%' THEN 'backfill' ELSE 'outro' END",
}
TABLES = {
    "admin_list_jobs": """() RETURNS TABLE (jobid BIGINT, jobname STRING, grupo STRING, fn_target STRING, schedule STRING, active BOOLEAN, last_status STRING, last_start TIMESTAMP, last_msg STRING) RETURN
        SELECT j.jobid, j.jobname, grupo_de_job(j.jobname), coalesce(nullif(regexp_extract(j.command, 'functions/v1/([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(j.command, '[.]co/([a-zA-Z0-9_-]+)', 1), '')),
               j.schedule, j.active, r.last.status, r.last.start_time, r.last.return_message
        FROM queue_jobs j LEFT JOIN (SELECT jobid, max_by(struct(status, start_time, return_message), struct(start_time, status, return_message)) AS last FROM queue_runs GROUP BY jobid) r ON r.jobid = j.jobid""",
    "admin_recent_runs": """(p_limit INT DEFAULT 30) RETURNS TABLE (jobname STRING, status STRING, start_time TIMESTAMP, end_time TIMESTAMP, return_message STRING) RETURN
        SELECT jobname, status, start_time, end_time, return_message FROM (
          SELECT j.jobname, r.status, r.start_time, r.end_time, r.return_message, row_number() OVER (ORDER BY r.start_time DESC, j.jobname, r.status) AS k FROM queue_runs r JOIN queue_jobs j ON j.jobid = r.jobid)
        WHERE k <= p_limit""",
}


def views(jobs: DataFrame, runs: DataFrame) -> None:
    jobs.createOrReplaceTempView("queue_jobs")
    runs.createOrReplaceTempView("queue_runs")


def register(spark: SparkSession) -> None:
    """All functions that the session does not have yet; those that read the views only where these are there."""
    there = spark.catalog.tableExists("queue_jobs") and spark.catalog.tableExists("queue_runs")
    for name, body in (SCALARS | TABLES if there else SCALARS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


@query("q_state_sql", using({"ledger": LEDGER}, f"""
SELECT id, CASE WHEN tier = 3 OR fim IS NULL THEN 'indeterminada' WHEN fim < DATE '{AS_OF}' - 30 THEN 'historica' WHEN fim < DATE '{AS_OF}' THEN 'encerrada'
  WHEN fim <= DATE '{AS_OF}' + 3 THEN 'ultimos_dias' WHEN tier = 1 THEN 'ativa' ELSE 'detectada' END AS state FROM ledger"""))
def state_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state function called from SQL over the ledger."""
    register(spark)
    ledger(spark, sf_dir).createOrReplaceTempView("ledger_rows")
    return spark.sql(f"SELECT id, estado_vigencia(fim, tier < 3, tier = 1, DATE '{AS_OF}') AS state FROM ledger_rows")


@query("q_job_listing", using({"calls": CALLS}, r"""
WITH j AS (SELECT DISTINCT user_id AS jobid FROM calls),
r AS (SELECT user_id AS jobid, estagio AS status, ts AS start_time, tokens::VARCHAR AS msg, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, estagio DESC, tokens::VARCHAR DESC) AS k FROM calls WHERE user_id % 5 > 0)
SELECT j.jobid, ['ingest', 'extract', 'backfill', 'x'][j.jobid % 4 + 1] || '-' || j.jobid AS jobname, ['coleta', 'analise', 'backfill', 'outro'][j.jobid % 4 + 1] AS grupo,
       CASE j.jobid % 3 WHEN 0 THEN 'fn-' || j.jobid WHEN 1 THEN 'run_' || j.jobid END AS fn_target, r.status AS last_status, r.msg AS last_msg
FROM j LEFT JOIN r ON r.jobid = j.jobid AND r.k = 1"""))
def job_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job listing called from SQL: each user's calls are the runs of a job, and every fifth job has none."""
    rows = calls(spark, sf_dir)
    key = F.col("user_id").cast("string")
    name = F.concat(F.get(F.array(*map(F.lit, ("ingest", "extract", "backfill", "x"))), (F.col("user_id") % 4).cast("int")), F.lit("-"), key)
    command = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("post https://x.example/functions/v1/fn-"), key)).when(F.col("user_id") % 3 == 1, F.concat(F.lit("post https://y.z.co/run_"), key)).otherwise("vacuum")
    jobs = rows.select("user_id").distinct().select(F.col("user_id").alias("jobid"), name.alias("jobname"), command.alias("command"), F.lit("* * * * *").alias("schedule"), F.lit(True).alias("active"))
    start = F.col("ts").cast("timestamp")
    runs = rows.filter("user_id % 5 > 0").select(F.col("user_id").alias("jobid"), F.col("estagio").alias("status"), start.alias("start_time"), start.alias("end_time"), F.col("tokens").cast("string").alias("return_message"))
    views(jobs, runs)
    register(spark)
    return spark.sql("SELECT jobid, jobname, grupo, fn_target, last_status, last_msg FROM admin_list_jobs()")
