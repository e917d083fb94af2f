"""Sitemaps that point to sitemaps: all addresses below some roots, each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.graph import removed, shared_dir, written
from granary.registry import query
from granary.sources.tables import table
from granary.sources.web import sitemap_entries

_ENTRY = "array<struct<loc:string,lastmod:string>>"
#: What the two kinds of sitemap have below their root element.
SCHEMA = f"sitemap {_ENTRY}, url {_ENTRY}"


def parsed(xml: Column) -> Column:
    """(is_index, entries array<struct<loc, lastmod date>>) of a sitemap by Spark's XML reader; where the text is no well-formed XML, by its marks."""
    read = F.from_xml(xml, SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    found = F.concat(*[F.coalesce(read[k], F.array().cast(_ENTRY)) for k in ("sitemap", "url")])
    plain = F.transform(found, lambda e: F.struct(F.trim(e["loc"]).alias("loc"), F.try_to_date(F.left(e["lastmod"], F.lit(10))).alias("lastmod")))
    entries = F.when(F.size(found) > 0, plain).otherwise(sitemap_entries(xml))
    return F.struct(F.coalesce(xml.rlike(r"(?i)<(\w+:)?sitemapindex[\s>]"), F.lit(False)).alias("is_index"), F.filter(entries, lambda e: e["loc"] != "").alias("entries"))


def crawled(documents: DataFrame, roots: DataFrame, follow: str | Column | None = None) -> DataFrame:
    """(loc, lastmod, depth): every address that the sitemaps below the roots list, once.

    documents has (loc, xml) of all sitemaps at hand, roots (loc).  Each round reads the
    sitemaps that the one before found and that none has read yet, so that an index of
    indexes is followed to its end and a cycle is left.  follow is a pattern of the
    sitemaps to read, or a condition on loc.  A sitemap that is not at hand has no addresses; of an address listed
    several times the least depth and the newest day count.
    """
    spark = documents.sparkSession
    at = written(documents.select("loc", parsed(F.col("xml")).alias("x")))
    visited = written(roots.select("loc").filter("loc IS NOT NULL").distinct())
    front, found, depth, steps = visited, None, 0, []
    while True:
        depth += 1
        entries = written(at.join(front, "loc", "left_semi").select("x.is_index", F.explode("x.entries").alias("e")).select("is_index", "e.*"))
        pages = entries.filter("NOT is_index").select("loc", "lastmod", F.lit(depth).alias("depth"))
        found = pages if found is None else found.union(pages)
        next_ = entries.filter("is_index").select("loc").distinct().join(visited, "loc", "left_anti")
        if follow is not None:
            next_ = next_.filter(F.col("loc").rlike(follow) if isinstance(follow, str) else follow)
        next_ = written(next_)
        if next_.isEmpty():
            break
        steps.append(where := shared_dir(spark))
        visited, front = written(visited.union(next_), where), next_
    out = written(found.groupBy("loc").agg(F.max("lastmod").alias("lastmod"), F.min("depth").cast("bigint").alias("depth")))
    for where in steps:
        removed(spark, where)
    return out


@query("q_sitemap_tree", r"""
SELECT url AS loc, max(DATE '2024-01-01' - (page_id % 900)::INTEGER) AS lastmod, 3::BIGINT AS depth FROM pages WHERE url IS NOT NULL AND trim(url) <> '' GROUP BY url""")
def sitemap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses in sitemaps of up to 500, listed by host in indexes below one root; each index also lists the root, a cycle."""
    p = table(spark, sf_dir, "pages").filter("url IS NOT NULL AND trim(url) <> ''")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    marked = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    day = F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 900).cast("int")).cast("string")
    entry = F.concat(F.lit("<url><loc>"), marked, F.lit("</loc><lastmod>"), day, F.lit("T00:00:00Z</lastmod></url>"))
    number = F.floor(F.col("page_id") / 500).cast("string")  # ids are dense, so a sitemap has at most 500 addresses
    sets = p.groupBy(host.alias("host"), number.alias("k")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    sets = sets.select("host", F.concat(F.lit("https://"), "host", F.lit("/map-"), "k", F.lit(".xml")).alias("loc"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "body", F.lit("</urlset>")).alias("xml"))
    place = lambda c: F.concat(F.lit("<sitemap><loc><![CDATA["), c, F.lit("]]></loc></sitemap>"))
    index = lambda body: F.concat(F.lit("<sitemapindex>"), body, F.lit("</sitemapindex>"))
    of_host = F.concat(F.lit("https://"), F.col("host"), F.lit("/index.xml"))
    root = F.lit("https://root.example/index.xml")
    hosts = sets.groupBy("host").agg(F.array_join(F.collect_list(place(F.col("loc"))), "").alias("body")).select(of_host.alias("loc"), index(F.concat("body", place(root))).alias("xml"))
    top = sets.select("host").distinct().agg(F.array_join(F.collect_list(place(of_host)), "").alias("body")).select(root.alias("loc"), index(F.col("body")).alias("xml"))
    documents = sets.select("loc", "xml").union(hosts).union(top)
    return crawled(documents, spark.range(1).select(root.alias("loc")))
