"""Adapters: owners, robots rules, sitemaps followed by owner, outcomes of pages."""

import datetime as dt

from pyspark.sql import functions as F

from granary.sources.adapters import SITES, Adapter, discovered, outcomes, owner, permitted, wanted


def test_addresses(spark):
    rows = [
        ("https://www.a.example/en/x", "alpha", True, True), ("https://a.example/de/x", "alpha", True, False), ("https://a.example/en/x?q=1", "alpha", False, False), ("https://a.example/en/x#a?b", "alpha", True, True),
        ("HTTPS://B.example:8080/en/1", "beta", True, True), ("https://b.example/en/91", "beta", True, False), ("https://other.a.example/en/x", None, False, False), ("https://shop.c.example/de/x", "gamma", False, False),
        ("https://shop.c.example/x.html", "gamma", False, False), ("https://shop.c.example/x.html?y", "gamma", True, True), ("no address", None, False, False), (None, None, False, False),
    ]
    df = spark.createDataFrame(rows, "url string, owner string, permitted boolean, wanted boolean")
    url = F.when(F.col("url").startswith("HTTPS"), F.lower("url")).otherwise(F.col("url"))
    got = df.select("url", owner(url, SITES), permitted(url, SITES), wanted(url, SITES)).collect()
    assert [tuple(r) for r in got] == rows


def test_sitemaps_by_owner(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in locs) + "</sitemapindex>"
    urls = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc><lastmod>2026-01-0{i + 1}</lastmod></url>" for i, x in enumerate(locs)) + "</urlset>"
    documents = [
        ("r", index("https://b.example/map-1", "https://b.example/old", "https://d.example/map-1", "https://a.example/m")),
        ("https://b.example/map-1", urls("https://b.example/en/1", "https://b.example/en/9", "https://d.example/en/1")),
        ("https://b.example/old", urls("https://b.example/en/2")), ("https://d.example/map-1", urls("https://a.example/en/3")),
        ("https://a.example/m", index("https://a.example/m", "https://b.example/map-1", "https://a.example/n")), ("https://a.example/n", urls("https://a.example/x", "https://a.example/fr/4", "https://a.example/fr/4")),
    ]
    found = discovered(spark.createDataFrame(documents, "loc string, xml string"), spark.createDataFrame([("r",)], "loc string"), SITES).collect()
    assert sorted(map(tuple, found)) == [("alpha", "https://a.example/fr/4", dt.date(2026, 1, 3), 3), ("beta", "https://b.example/en/1", dt.date(2026, 1, 1), 2)]


def test_outcomes(spark):
    page = '<title>t</title><p>10 pontos, 45.000 pontos</p><script type="application/ld+json">{"@type":"Product","price":"9,50"}</script>'
    rows = [
        (1, "https://a.example/en/bonus-80", 200, page), (2, "https://shop.c.example/p", 200, page), (3, "https://shop.c.example/de/p", 200, page), (4, "https://a.example/x", 302, page), (5, "https://a.example/x", 500, page),
        (6, "https://a.example/x", 200, None), (7, "https://a.example/x", None, page), (8, None, 200, page),
    ]
    df = spark.createDataFrame(rows, "id long, url string, status int, html string")
    out = {r["id"]: r for r in outcomes(df, SITES).select("id", "adapter", "outcome", "page.title", "page.percentage", "product.cash", "points").collect()}
    assert [out[i]["outcome"] for i in range(1, 9)] == ["read", "read", "forbidden", "ended", "failed", "failed", "failed", "unknown"]
    assert tuple(out[1])[3:] == ("t", 80, 9.5, None)
    assert tuple(out[2])[3:] == ("t", None, 9.5, None)  # a number under 100 is the first that the pattern meets
    assert all(tuple(out[i])[3:] == (None,) * 4 for i in range(3, 9))
    one = [Adapter("solo", ("a.example",), points=(r"x(\d+)", r"([\d.]+)\s*pontos<"))]
    assert [r["points"] for r in outcomes(df.filter("id = 1"), one).collect()] == [None]
    assert outcomes(df.limit(0), SITES).count() == 0
