"""Adapters of sites: what differs from site to site is configuration, from which column expressions are built.

An adapter owns the addresses of its hosts.  It says which of them are campaigns, which
sitemaps lead there, what its robots rules forbid, where a page's title stands and how
its shop writes points.  All adapters are read in one pass over the pages: a map from host
to adapter, and one CASE over the adapters where their patterns differ; what they share
(markup, address, percentage) is computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.registry import query
from granary.sources.sitemaps import crawled
from granary.sources.tables import table
from granary.sources.web import allowed, campaign_page, points_in, product_price


@dataclass(frozen=True)
class Adapter:
    """Patterns are tested on whole addresses; empty ones test nothing.  hosts stand without www."""

    name: str
    hosts: tuple[str, ...]
    include: str = ""
    exclude: str = ""
    follow: str = ""
    disallow: tuple[str, ...] = ()
    titles: tuple[str, ...] = ("og:title",)
    points: tuple[str, ...] = ()


def owner(url: Column, adapters: list[Adapter]) -> Column:
    """The name of the adapter whose host an address has, or null."""
    pairs = [F.lit(x) for a in adapters for h in a.hosts for x in (h, a.name)]
    host = F.regexp_extract(F.lower(url), r"^https?://(?:www\.)?([^/?#:]+)", 1)
    return F.try_element_at(F.create_map(*pairs), host)


def _each(name: Column, adapters: list[Adapter], of: Callable[[Adapter], Column]) -> Column:
    """of(adapter) for the adapter named, null for none."""
    out = F
    for a in adapters:
        out = out.when(name == a.name, of(a))
    return out


def permitted(url: Column, adapters: list[Adapter]) -> Column:
    """Whether the robots rules of the address's owner let it be read; a rule sees path and query.  False without an owner."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^#]*)", 1)
    return F.coalesce(_each(owner(url, adapters), adapters, lambda a: allowed(path, list(a.disallow))), F.lit(False))


def wanted(url: Column, adapters: list[Adapter]) -> Column:
    """Whether an address is a campaign of its owner that may be read."""

    def test(a: Adapter) -> Column:
        ok = url.rlike(a.include) if a.include else F.lit(True)
        return ok & ~url.rlike(a.exclude) if a.exclude else ok

    return permitted(url, adapters) & F.coalesce(_each(owner(url, adapters), adapters, test), F.lit(False))


def discovered(documents: DataFrame, roots: DataFrame, adapters: list[Adapter]) -> DataFrame:
    """(adapter, loc, lastmod, depth) of all campaigns in the sitemaps below roots (loc); documents has (loc, xml).

    An index is followed as far as its owner's pattern of sitemaps says.
    """
    at = F.col("loc")
    follow = F.coalesce(_each(owner(at, adapters), adapters, lambda a: at.rlike(a.follow) if a.follow else F.lit(True)), F.lit(False))
    found = crawled(documents, roots, follow).filter(wanted(at, adapters))
    return found.select(owner(at, adapters).alias("adapter"), "loc", "lastmod", "depth")


def outcomes(pages: DataFrame, adapters: list[Adapter], url: str = "url", status: str = "status", html: str = "html") -> DataFrame:
    """pages with (adapter, outcome, page, product, points).

    outcome is unknown (no adapter), forbidden (robots), ended (the site sends elsewhere),
    failed (any other answer but 200, or no text) or read; page, product and points are
    null unless it was read.  points are the first pattern of the adapter with 100 or more.
    """
    u, s, h = F.col(url), F.col(status), F.col(html)
    named = pages.withColumn("adapter", owner(u, adapters))
    a = F.col("adapter")
    outcome = (
        F.when(a.isNull(), "unknown")
        .when(~permitted(u, adapters), "forbidden")
        .when(s.between(300, 399), "ended")
        .when(~s.eqNullSafe(200) | (F.coalesce(F.trim(h), F.lit("")) == ""), "failed")
        .otherwise("read")
    )
    rows = named.withColumn("outcome", outcome)
    read = F.col("outcome") == "read"
    # titles rarely differ: adapters of equal titles share one expression
    kinds = {}
    for x in adapters:
        kinds.setdefault(x.titles, []).append(x.name)
    page = F
    for titles, names in kinds.items():
        page = page.when(read & a.isin(*names), campaign_page(h, u, titles))
    said = X.let(X.tag_free(h), lambda body: _each(a, adapters, lambda x: points_in(body, list(x.points)) if x.points else F.lit(None).cast("bigint")))
    return rows.withColumn("page", page).withColumn("product", F.when(read, product_price(h))).withColumn("points", F.when(read, said))


#: The adapters of the queries: sites that the queries make from the given tables.
SITES = [
    Adapter("alpha", ("a.example",), include=r"/(en|fr)/", disallow=("/*?*", "")),
    Adapter("beta", ("b.example", "beta.example"), include=r"/[a-z]{2}/\d", exclude=r"/[a-z]{2}/9", follow=r"/map-", titles=("twitter:title", "og:title"), points=(r"(?i)por\s+([\d.]+)\s*milhas", r"(?i)([\d.]+)\s*milhas")),
    Adapter("gamma", ("shop.c.example",), disallow=("/de/", "/*.html$"), points=(r"(?i)([\d.]+)\s*pontos",)),
]
_HOSTS = ("www.a.example", "B.example", "shop.c.example", "d.example")


@query("q_adapter_discovery", r"""
WITH t AS (SELECT page_id % 4 AS k, floor(page_id / 500)::BIGINT % 2 AS old, ['www.a.example', 'B.example', 'shop.c.example', 'd.example'][(page_id % 4 + 1)::INTEGER] AS host, regexp_extract(url, '^https?://[^/?#]+(.*)$', 1) AS path, DATE '2024-01-01' - (page_id % 900)::INTEGER AS lastmod FROM pages),
u AS (SELECT k, old, 'https://' || host || path AS loc, regexp_extract(path, '^[^#]*') AS seen, lastmod FROM t WHERE k < 3)
SELECT ['alpha', 'beta', 'gamma'][(k + 1)::INTEGER] AS adapter, loc, max(lastmod) AS lastmod, 3::BIGINT AS depth FROM u
WHERE CASE k WHEN 0 THEN regexp_matches(loc, '/(en|fr)/') AND NOT contains(seen, '?') WHEN 1 THEN old = 0 AND regexp_matches(loc, '/[a-z]{2}/[0-9]') AND NOT regexp_matches(loc, '/[a-z]{2}/9') ELSE NOT starts_with(seen, '/de/') AND NOT regexp_matches(seen, '\.html$') END
GROUP BY k, loc""")
def adapter_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' paths on four hosts, in sitemaps by 500 ids below an index a host; one adapter follows half of its sitemaps, one host has none."""
    p = table(spark, sf_dir, "pages")
    k, n = (F.col("page_id") % 4).cast("int"), F.floor(F.col("page_id") / 500)
    host = F.get(F.array(*[F.lit(h) for h in _HOSTS]), k)
    day = F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 900).cast("int")).cast("string")
    loc = F.concat(F.lit("https://"), host, F.regexp_extract("url", r"^https?://[^/?#]+(.*)$", 1))
    entry = F.concat(F.lit("<url><loc><![CDATA["), loc, F.lit("]]></loc><lastmod>"), day, F.lit("</lastmod></url>"))
    place = F.concat(F.lit("https://"), host, F.when(n % 2 == 0, "/map-").otherwise("/old-"), n.cast("string"), F.lit(".xml"))
    sets = p.groupBy(host.alias("host"), place.alias("loc")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    tagged = lambda tag, body: F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))
    listed = lambda c: F.array_join(F.collect_list(tagged("sitemap", tagged("loc", c))), "")
    index = F.concat(F.lit("https://"), F.col("host"), F.lit("/map-index.xml"))
    by_host = sets.groupBy("host").agg(listed(F.col("loc")).alias("body")).select(index.alias("loc"), tagged("sitemapindex", F.col("body")).alias("xml"))
    top = sets.select("host").distinct().agg(listed(index).alias("body")).select(F.lit("https://root.example/index.xml").alias("loc"), tagged("sitemapindex", F.col("body")).alias("xml"))
    documents = sets.select("loc", tagged("urlset", F.col("body")).alias("xml")).union(by_host).union(top)
    return discovered(documents, spark.range(1).select(F.lit("https://root.example/index.xml").alias("loc")), SITES)


@query("q_adapter_pages", """
WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, p_partkey % 7 AS m, 10 + p_size AS pct, p_name, 5000 + p_partkey % 4000 AS points FROM part),
o AS (SELECT *, CASE WHEN k = 3 THEN 'unknown' WHEN k = 0 AND m = 1 OR k = 2 AND m = 1 THEN 'forbidden' WHEN m = 2 THEN 'ended' WHEN m IN (3, 4) THEN 'failed' ELSE 'read' END AS outcome FROM t)
SELECT p_partkey, ['alpha', 'beta', 'gamma', NULL][(k + 1)::INTEGER] AS adapter, outcome, CASE WHEN outcome = 'read' THEN CASE k WHEN 1 THEN 'T ' || p_name ELSE 'O ' || p_name END END AS title,
       CASE WHEN outcome = 'read' THEN pct::INTEGER END AS percentage, CASE WHEN outcome = 'read' THEN pct + 0.5::DOUBLE END AS cash, CASE WHEN outcome = 'read' THEN '789' || p_partkey END AS gtin,
       CASE WHEN outcome = 'read' AND k = 1 THEN points WHEN outcome = 'read' AND k = 2 THEN 7000 END::BIGINT AS points FROM o""")
def adapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four hosts: addresses that robots forbid, redirects, errors, empty pages, and pages read back with each adapter's titles and points."""
    k, m = (F.col("p_partkey") % 4).cast("int"), F.col("p_partkey") % 7
    pct, name = (F.col("p_size") + 10).cast("string"), F.col("p_name")
    points = (5000 + F.col("p_partkey") % 4000).cast("string")
    host = F.get(F.array(*[F.lit(h) for h in _HOSTS]), k)
    url = F.concat(F.lit("https://"), host, F.when(m == 1, "/de/x?page=").otherwise("/en/bonus-"), pct)
    html = F.concat(
        F.lit('<meta property="og:title" content="O '), name, F.lit('"><meta name="twitter:title" content="T '), name, F.lit('"><meta name="description" content="'), pct, F.lit('% agora">'),
        F.lit('<script type="application/ld+json">{"@type": "Product", "gtin13": "789'), F.col("p_partkey").cast("string"), F.lit('", "offers": {"price": "'), pct, F.lit(',50"}}</script>'),
        F.lit("<p>ganhe 12 milhas, 7.000 pontos, por "), points, F.lit(" milhas</p>"),
    )
    pages = table(spark, sf_dir, "part").select("p_partkey", url.alias("url"), F.when(m == 2, 302).when(m == 3, 404).otherwise(200).alias("status"), F.when(m == 4, F.lit(" ")).otherwise(html).alias("html"))
    read = outcomes(pages, SITES)
    return read.select("p_partkey", "adapter", "outcome", "page.title", "page.percentage", "product.cash", "product.gtin", "points")
