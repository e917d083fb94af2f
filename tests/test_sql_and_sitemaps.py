"""SQL functions of a session, and sitemaps that point to sitemaps."""

import datetime as dt

from pyspark.sql import functions as F

from granary.sources import sitemaps, sql


def test_scalar_functions(spark):
    sql.register(spark)
    sql.register(spark)  # again: nothing changes
    got = spark.sql("""
      SELECT estado_vigencia(DATE '2026-01-01', true, false, DATE '2026-03-01') a, estado_vigencia(DATE '2026-02-20', true, false, DATE '2026-03-01') b,
             estado_vigencia(DATE '2026-03-04', true, false, DATE '2026-03-01') c, estado_vigencia(DATE '2026-04-01', true, true, DATE '2026-03-01') d,
             estado_vigencia(DATE '2026-04-01', true, ref => DATE '2026-03-01') e, estado_vigencia(DATE '2026-04-01', null) f, estado_vigencia(null, true) g,
             texto_normalizado(' Ação  &  Café ') h, slug('Ação & Café') i, espera_de_tentativa(3) j""").first()
    assert tuple(got) == ("historica", "encerrada", "ultimos_dias", "ativa", "detectada", "indeterminada", "indeterminada", "acao cafe", "acao-cafe", 240)


def test_table_functions(spark):
    jobs = spark.createDataFrame([(1, "ingest-a", "post https://h/functions/v1/coleta-x", "* *", True), (2, "y", "post https://p.supabase.co/roda", "0 *", False), (3, "extract", "vacuum", "0 1", True)], "jobid long, jobname string, command string, schedule string, active boolean")
    at = lambda n: dt.datetime(2026, 1, n, tzinfo=dt.UTC)
    runs = spark.createDataFrame([(1, "ok", at(1), at(2), "a"), (1, "failed", at(3), at(4), "b"), (2, "ok", at(2), at(2), "c")], "jobid long, status string, start_time timestamp, end_time timestamp, return_message string")
    sql.views(jobs, runs)
    sql.register(spark)
    got = {r["jobid"]: (r["grupo"], r["fn_target"], r["last_status"], r["last_msg"]) for r in spark.sql("SELECT * FROM admin_list_jobs()").collect()}
    assert got == {1: ("coleta", "coleta-x", "failed", "b"), 2: ("outro", "roda", "ok", "c"), 3: ("analise", None, None, None)}
    assert [r["return_message"] for r in spark.sql("SELECT * FROM admin_recent_runs(2) ORDER BY start_time DESC").collect()] == ["b", "c"]
    assert spark.sql("SELECT * FROM admin_recent_runs()").count() == 3


def index(*locs):
    return "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"


def urls(*locs, day=""):
    return "<?xml version='1.0'?><urlset>" + "".join(f"<url><loc> {x} </loc>{day}</url>" for x in locs) + "</urlset>"


def test_tree_with_a_cycle(spark):
    documents = [
        ("r", index("a", "b", "gone")), ("a", index("c", "r", "a")), ("b", urls("p1", "<![CDATA[p2?x&y]]>", "p3&amp;z", day="<lastmod>2026-01-02T03:04Z</lastmod>")),
        ("c", urls("p1", "p4", day="<lastmod>2026-02-02</lastmod>") + "\n"), ("d", urls("never")), ("e", "no xml <loc>at</loc>"),
    ]
    df = spark.createDataFrame(documents, "loc string, xml string")
    out = sitemaps.crawled(df, df.select("loc").filter("loc = 'r'"))
    got = {r["loc"]: (r["lastmod"], r["depth"]) for r in out.collect()}
    early, late = dt.date(2026, 1, 2), dt.date(2026, 2, 2)
    assert got == {"p1": (late, 2), "p2?x&y": (early, 2), "p3&z": (early, 2), "p4": (late, 3)} and out.count() == 4
    assert {r["loc"] for r in sitemaps.crawled(df, df.select("loc").filter("loc = 'r'"), follow="^b$").collect()} == {"p1", "p2?x&y", "p3&z"}
    assert sitemaps.crawled(df.limit(0), df.select("loc")).count() == 0
    assert sitemaps.crawled(df, spark.createDataFrame([("d",), (None,), ("d",)], "loc string")).select(F.max("loc")).first()[0] == "never"
