"""Operators without a query on the given tables, known vectors, and random series against plain Python."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.operators import sinks
from granary.operators.graph import components
from granary.operators.quantiles import exact_percentiles
from granary.plans.forecast import waves_of
from granary.plans.score import band, shrunk, weighted
from granary.plans.shopping import with_metrics
from granary.sources import scans, web


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def value(spark, column, **columns):
    return one(spark, **columns).select(column.alias("x")).first()["x"]


def test_waves_compare_with_the_anchor(spark):
    day = lambda n: dt.date(2026, 1, n)
    df = spark.createDataFrame([([day(n) for n in (7, 1, 5, 3)],)], "d array<date>")
    assert df.select(waves_of(F.col("d")).alias("w")).first()["w"] == [day(1), day(5)]


def test_waves_of_random_series(spark):
    rng = random.Random(7)
    rows = [(i, [dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(400)) for _ in range(rng.randrange(1, 60))]) for i in range(40)]
    found = {r["i"]: r["w"] for r in spark.createDataFrame(rows, "i int, d array<date>").select("i", waves_of(F.col("d")).alias("w")).collect()}
    for i, days in rows:
        want = []
        for d in sorted(set(days)):
            if not want or (d - want[-1]).days > 3:
                want.append(d)
        assert found[i] == want


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 500)] + [("b", float(x)) for x in rng.normal(size=3000)] + [("c", 1.0), ("d", None)]
    found = {r["k"]: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p10": 0.1, "p50": 0.5}).collect()}
    assert set(found) == {"a", "b", "c"}
    for k in "abc":
        x = [v for key, v in rows if key == k]
        assert found[k]["n"] == len(x)
        assert np.allclose([found[k]["p10"], found[k]["p50"]], np.quantile(x, [0.1, 0.5]))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent}
    assert {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_known_value_per_thousand(spark):
    rows = [
        ("1", 2609.91, 186329, 131236, 114832, 1013.28), ("2", 2799.00, 201528, 185406, None, None), ("3", 1889.10, 136498, 94992, 83118, 733.43),
        ("4", 7691.90, 615295, 386775, 338428, 2986.28), ("5", None, 221592, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, reference_price double, standard_points long, elite_points long, hybrid_points long, hybrid_cash double")
    got = {r["id"]: r for r in with_metrics(df.withColumn("match_confidence", F.lit("high")).withColumn("availability", F.lit("available"))).collect()}
    want = {"1": (14.007, 19.8871, 71497, 14.1723), "2": (13.8889, 15.0966, None, None), "3": (13.8398, 19.8869, 53380, 13.7398), "4": (12.5012, 19.8873, 276867, 10.786)}
    for k, (std, elite, kept, marginal) in want.items():
        assert abs(got[k]["vpm_standard"] - std) < 0.02 and abs(got[k]["vpm_elite"] - elite) < 0.02 and got[k]["preserved_points"] == kept
        assert marginal is None or abs(got[k]["vpm_hybrid_marginal"] - marginal) < 0.02
    assert got["5"]["vpm_standard"] is None and got["5"]["comparison_reason"] == "missing_reference_price" and not got["5"]["is_comparable"]


def test_known_scores(spark):
    cases = [(0.8125, 40, 0.95, 0.25, 1.0, 77), (0.5, 1, 0.75, 0.25, 1.0, 59), (0.96, 50, None, 0.25, 1.0, 79), (0.25, 50, None, 0.25, 1.0, 37), (0.5, 3, 0.05, 0.65, 1.0, 44), (None, None, None, 0.25, 0.3, 27)]
    df = spark.createDataFrame(cases, "p double, n int, e double, r double, a double, want int")
    s = weighted({"percentil": shrunk(F.col("p"), F.col("n")), "eficiencia": F.col("e"), "raridade": F.col("r"), "abrangencia": F.col("a")})
    rows = df.select(F.floor(s * 100 + 0.5).alias("s"), "want").collect()
    assert [r["s"] for r in rows] == [r["want"] for r in rows]
    assert value(spark, band(F.lit(85))) == "Vale agir" and value(spark, band(F.lit(39))) == "Evitaria"


def test_numbers_dates_and_prices(spark):
    for raw, want in (("1.234,56", 1234.56), ("1.234", 1234.0), ("16.84", 16.84), ("R$ 7,5", 7.5), ("", None)):
        assert value(spark, X.br_number(F.lit(raw))) == want
    for raw, want in (("2026-02-30", None), ("31/1/2026", dt.date(2026, 1, 31)), ("1999-01-01", None), ("na", None)):
        assert value(spark, X.date_of(F.lit(raw))) == want


def test_thousands_after_more_than_three_digits(spark):
    for raw, want in (("1000.000", 1000000.0), ("R$ 12345.678", 12345678.0), ("1000.00", 1000.0)):
        assert value(spark, X.br_number(F.lit(raw))) == want


def test_sitemap_meta_and_products(spark):
    xml = "<urlset><url><loc><![CDATA[https://a.example/x?a=1&amp;b=2]]></loc><lastmod>2026-01-02T00:00:00Z</lastmod></url><url><loc> https://a.example/y </loc></url></urlset>"
    assert [tuple(e) for e in value(spark, web.sitemap_entries(F.lit(xml)))] == [("https://a.example/x?a=1&b=2", dt.date(2026, 1, 2)), ("https://a.example/y", None)]
    assert value(spark, web.allowed(F.lit("/private/x"), ["/private*"])) is False and value(spark, web.allowed(F.lit("/open"), ["/private*", "/open/*$"])) is True
    html = """<meta content="T &amp; U" property="og:title"><link rel="canonical" href="https://a/x"><script type="application/ld+json">{"@graph": [{"@type": "Org"}, {"@type": "Product", "offers": {"price": "12.5"}}]}</script>"""
    assert value(spark, web.meta(F.lit(html), "og:title")) == "T & U" and value(spark, web.canonical(F.lit(html))) == "https://a/x"
    deep = """<script type="application/ld+json">[{"@graph": [{"@type": "Offer"}, {"@graph": [{"@graph": [{"@type": "Product", "name": "deep", "gtin": "7", "offers": [{"lowPrice": "R$ 1.399,00"}]}]}]}]}]</script>"""
    bad = """<script type="application/ld+json">{"@type": "Product", "offers": </script><script type='application/ld+json'>"text"</script>"""
    assert tuple(value(spark, web.product_price(F.lit(bad + deep)))) == (1399.0, "deep", "7")
    assert value(spark, F.size(web.json_ld(F.lit(bad)))) == 0 and value(spark, web.product_price(F.lit(bad))) is None
    assert [r for r in value(spark, web.json_ld(F.lit(html)))] == ['{"@type":"Product","offers":{"price":"12.5"}}']
    page = lambda *blocks: F.lit("".join(f'<script type="application/ld+json">{b}</script>' for b in blocks))
    for blocks, want in (
        (("not json", '[{"@type": "Org"}, {"@type": "Product", "name": "TV", "gtin13": "78", "offers": [{"price": "1.399,00"}, {"price": "9"}]}]'), (1399.0, "TV", "78")),
        (('{"@type": "Offer", "price": "45.000"}',), (45000.0, None, None)),
        (('{"@type": "Product", "offers": {"lowPrice": "R$ 10,50"}, "gtin": "5"}',), (10.5, None, "5")),
        (('{"@type": "Product", "name": "no price"}', '{"@graph": [{"@type": "Product", "offers": {"price": "7,00"}}]}'), (7.0, None, None)),
        (('{"@type": "Thing"}',), None),
    ):
        got = value(spark, web.product_price(page(*blocks)))
        assert (got and tuple(got)) == want
    for slug, text, want in (("oferta-ate-90-azul", "10%", (90, "slug")), ("bonus-80", None, (80, "slug")), ("bonus-de-70/x", "", (70, "slug")), ("80-por-cento", "ganhe 45 %", (45, "text")), ("bonus-800", "sem", None)):
        got = value(spark, web.percentage(F.lit(slug), F.lit(text).cast("string")))
        assert (got and tuple(got)) == want, slug
    assert value(spark, web.points_in(F.lit("50 pontos ou 12.000 milhas"), [r"([\d.]+) pontos", r"([\d.]+) milhas"])) == 12000


def test_replaced_slices_and_readers(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.replace_slice(spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string"), at, "d")
    sinks.replace_slice(spark.createDataFrame([(3, "b")], "v int, d string"), at, "d")
    assert sorted(map(tuple, spark.read.parquet(at).select("v", "d").collect())) == [(1, "a"), (3, "b")]
    (tmp_path / "j").mkdir()
    for n, d in ((1, "2026-01-05"), (2, "2026-02-01")):
        (tmp_path / "j" / f"{n}.json").write_text(f'{{\n"number": {n}, "date": "{d}"}}')
    assert [r["number"] for r in scans.json_documents(spark, str(tmp_path / "j"), "number int, date string", "2026-01-01", "2026-01-31").collect()] == [1]
    (tmp_path / "c.csv").write_text("# note\na,b\n1,x\n")
    assert scans.commented_csv(spark, str(tmp_path / "c.csv"), "a int, b string").first()["b"] == "x"


def test_streams(spark, tmp_path):
    from granary.streaming import jobs

    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    spark.createDataFrame([(i % 2, i * 10) for i in range(12)], "user_id long, ts_s long").repartition(3).write.parquet(src)
    for _ in range(2):  # a second run finds nothing new
        assert jobs.drain(spark, src, "user_id long, ts_s long", sink, mark, files_per_batch=1)
    assert spark.read.parquet(sink).count() == 12


def test_drain_stops_at_a_deadline_and_goes_on(spark, tmp_path):
    from granary.streaming import jobs

    src, sink, mark = (str(tmp_path / x) for x in ("src", "sink", "mark"))
    for k in range(6):
        spark.range(k * 100, k * 100 + 100).coalesce(1).write.mode("append").parquet(src)
    tasks = lambda df: df.withColumn("task", F.spark_partition_id())
    run = lambda deadline: jobs.drain(spark, src, "id long", sink, mark, tasks, files_per_batch=1, rows_per_task=24, deadline=deadline)
    assert run(0.0) is False  # the first batch that ends is behind it
    some = spark.read.parquet(sink).count()
    assert 0 < some < 600
    assert run(600) is True
    rows = spark.read.parquet(sink)
    assert rows.count() == 600 and rows.select("id").distinct().count() == 600
    sizes = [r["count"] for r in rows.groupBy("batch", "task").count().collect()]
    assert max(sizes) <= 24 + 2 and len(sizes) == 30


def test_upsert_stream(spark, tmp_path):
    from granary.streaming import jobs

    src, table, mark = (str(tmp_path / x) for x in ("src", "table", "mark"))
    schema = "k long, at long, v string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: jobs.upsert_stream(spark.readStream.schema(schema).parquet(src), ["k"], ["at"], table, mark, buckets=4).awaitTermination()
    write([(i, 0, "old") for i in range(20)] + [(3, 2, "newest"), (3, 1, "newer")])
    run()
    write([(4, 5, "changed"), (30, 5, "added"), (3, 1, "late")])
    run()
    got = {r["k"]: r["v"] for r in spark.read.parquet(table).collect()}
    assert len(got) == 21 and got[3] == "newest" and got[4] == "changed" and got[30] == "added" and got[5] == "old"
    run()  # nothing new
    assert spark.read.parquet(table).count() == 21
    # a table that is there but cannot be read is an error, not an empty one
    for name in os.listdir(table):
        for part in os.listdir(f"{table}/{name}") if name.startswith("bucket=") else ():
            with open(f"{table}/{name}/{part}", "wb") as f:
                f.write(b"no parquet")
    write([(i, 9, "lost?") for i in range(20)])
    before = sorted(os.listdir(table))
    with pytest.raises(Exception, match="not a Parquet file|CANNOT_READ|FAILED_READ"):
        run()
    assert sorted(os.listdir(table)) == before and all(open(f"{table}/{n}/{x}", "rb").read() == b"no parquet" for n in before if n.startswith("bucket=") for x in os.listdir(f"{table}/{n}"))


def test_daily_counts_and_snapshots(spark, tmp_path):
    from granary.streaming import jobs

    src, mark = str(tmp_path / "src"), str(tmp_path / "mark")
    rows = [(dt.datetime(2026, 1, 1 + i % 3, 12), ("view", "buy")[i % 2]) for i in range(12)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(src)
    q = jobs.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {}
    for ts, kind in rows:
        want[ts.date(), kind] = want.get((ts.date(), kind), 0) + 1
    assert {(r["day"], r["event_type"]): r["n"] for r in spark.table("daily").collect()} == want
    at = str(tmp_path / "snapshots")
    for day, n in (("2026-01-01", 3), ("2026-01-02", 4), ("2026-01-02", 5)):
        sinks.snapshot(spark.range(n), at, day)
    assert spark.read.parquet(at).groupBy("as_of_date").count().orderBy("as_of_date").collect() == [(dt.date(2026, 1, 1), 3), (dt.date(2026, 1, 2), 5)]


def test_places_over_ranges(spark):
    from granary.operators.ordering import numbered

    rng = random.Random(2)
    rows = [(i, rng.randrange(40)) for i in range(3000)]
    got = {r["i"]: r["place"] for r in numbered(spark.createDataFrame(rows, "i long, v long"), [F.desc("v"), F.asc("i")], "place").collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
