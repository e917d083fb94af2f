"""Pages and sitemaps: discovery of addresses, page metadata, offers and products in markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.registry import query
from granary.sources.tables import dealt, table

ASSETS = r"\.(jpg|jpeg|png|gif|css|js|svg|pdf)$"


def sitemap_entries(xml: Column) -> Column:
    """array<struct<loc, lastmod>> of a urlset or index; CDATA marks go and references are decoded."""
    parts = F.filter(F.split(xml, r"<(?:url|sitemap)>"), lambda x: x.rlike("<loc>"))
    loc = lambda x: X.unescaped(F.trim(F.regexp_replace(F.regexp_extract(x, r"(?s)<loc>(.*?)</loc>", 1), r"<!\[CDATA\[|\]\]>", "")))
    return F.transform(parts, lambda x: F.struct(loc(x).alias("loc"), F.try_to_date(F.left(F.regexp_extract(x, r"<lastmod>([^<]*)</lastmod>", 1), F.lit(10))).alias("lastmod")))


def robots_rule(path: str) -> str:
    """A robots.txt path rule as a regular expression."""
    import re

    return "^" + "".join(".*" if c == "*" else "$" if c == "$" and i == len(path) - 1 else re.escape(c) for i, c in enumerate(path))


def allowed(path: Column, disallow: list[str]) -> Column:
    ok = F.lit(True)
    for rule in disallow:
        if rule:
            ok = ok & ~path.rlike(robots_rule(rule))
    return ok


@query("q_sitemap_backfill", r"""
SELECT DISTINCT sha256(lower(url)) AS key, url AS loc, DATE '2024-01-01' - (page_id % 900)::INTEGER AS lastmod FROM pages
WHERE NOT regexp_matches(lower(url), '\.(jpg|jpeg|png|gif|css|js|svg|pdf)$') AND DATE '2024-01-01' - (page_id % 900)::INTEGER >= DATE '2022-07-01' AND length(url) % 7 <> 0""")
def sitemap_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of sitemaps (written from the pages' addresses) that are no assets, new enough and not yet known."""
    p = table(spark, sf_dir, "pages")
    day = F.date_sub(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 900).cast("int"))
    url = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<urlset><url><loc>"), url, F.lit("</loc><lastmod>"), day.cast("string"), F.lit("</lastmod></url><url><loc>"), url, F.lit(".png</loc></url></urlset>"))
    found = p.select(F.explode(sitemap_entries(xml)).alias("e")).select("e.*").filter(~F.lower("loc").rlike(ASSETS) & (F.col("lastmod") >= F.lit("2022-07-01").cast("date")))
    known = p.filter(F.length("url") % 7 == 0).select(F.sha2(F.lower("url"), 256).alias("key"))
    return found.select(F.sha2(F.lower("loc"), 256).alias("key"), "loc", "lastmod").distinct().join(known, "key", "left_anti")


@query("q_url_discovery", r"""
SELECT DISTINCT url AS loc, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages
WHERE regexp_matches(url, '^https?://[^/?#]+/(en|fr)/') AND NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/en/1.*')""")
def url_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included language paths, without those that a robots rule forbids."""
    u = F.col("url")
    path = F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1)
    rows = table(spark, sf_dir, "pages").filter(u.rlike(r"^https?://[^/?#]+/(en|fr)/") & allowed(path, ["/en/1*", ""]))
    return rows.select(u.alias("loc"), F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host")).distinct()


def meta(html: Column, name: str) -> Column:
    """The content of a meta element by name or property, either order of attributes."""
    a = F.regexp_extract(html, rf"""(?i)<meta[^>]+(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]*(?:name|property)=["']{name}["']""", 1)
    return X.unescaped(F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def canonical(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"""(?i)<link[^>]+rel=["']canonical["'][^>]*href=["']([^"']*)["']""", 1), F.lit(""))


# How a percentage stands in an address and in a curated text.
PERCENT_SLUG, PERCENT_TEXT = r"(?i)(?:ate|bonus|bonus-de)-(\d{1,3})(?=-|/|$)", r"(\d{1,3})\s*%"


def percentage(slug: Column, text: Column) -> Column:
    """(value, source): a percentage of 1 to 100 in the address, else in the text, or null; the first of each counts."""
    first = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit("")).try_cast("int")
    a, b = first(slug, PERCENT_SLUG), first(text, PERCENT_TEXT)
    return F.when(a.between(1, 100), F.struct(a.alias("value"), F.lit("slug").alias("source"))).when(b.between(1, 100), F.struct(b.alias("value"), F.lit("text").alias("source")))


_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"


@query("q_page_meta", rf"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1) AS lang, {_TITLE} AS title,
       regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '([^/]*)/?$', 1) AS slug, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, u = F.col("html"), F.col("url")
    path = F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(h, r'<html[^>]*lang="([a-z]+)"', 1).alias("lang"), F.trim(F.regexp_extract(h, "<title>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract(path, "([^/]*)/?$", 1).alias("slug"), F.regexp_count(h, F.lit("<p>")).cast("bigint").alias("paragraphs"),
    )


@query("q_url_host", r"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n, count(*) FILTER (WHERE regexp_matches(url, '^https?://[^/?#]+/[a-z]+/[0-9]+')) AS collectable FROM pages GROUP BY 1")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"), F.count_if(F.col("url").rlike(r"^https?://[^/?#]+/[a-z]+/[0-9]+")).alias("collectable"))


_PLAIN = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _mark, _raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_mark}', '{_raw}')"
_PLAIN = rf"trim(regexp_replace({_PLAIN}, '[ \t\r\n]+', ' ', 'g'))"


@query("q_html_text", f"SELECT page_id, length({_PLAIN}) AS n, sha256({_PLAIN}) AS text_sha256 FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", X.tag_free(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("bigint").alias("n"), F.sha2("t", 256).alias("text_sha256"))


# How prices, points and their absence stand in shop pages.
STATE_PRICE = r'(?i)"(?:price|preco|valor|amount|cashPrice|price_brl|referencePrice)"\s*:\s*"?(\d{1,7}(?:[.,]\d{2})?)"?'
TEXT_PRICE = r"R\$\s*([\d.]{1,3}(?:[.,]\d{2,3})*)"
POINTS = r"(?i)([\d.]{4,})\s*(?:pontos|milhas)"
ELITE_POINTS = r"(?i)(?:clube|elite|a partir de)[^\d]{0,20}([\d.]{4,})\s*(?:pontos|milhas)"
HYBRID = r"(?i)([\d.]{4,})\s*(?:pontos|milhas)\s*\+\s*R\$\s*([\d.,]+)"
SOLD_OUT = r"(?i)(indispon[ií]vel|esgotad|fora de estoque|sem estoque)"


def page_number(text: Column) -> Column:
    """A number of a page: 1.399,00 and 45.000 group by dots; 12.5 and 1399.00 have a decimal point."""
    t = F.regexp_replace(text, r"[^\d.,]", "")
    plain = F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(t.rlike(r"^\d{1,3}(\.\d{3})+$"), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return F.regexp_extract(plain, r"^\d*\.?\d+", 0).try_cast("double")


def listing(html: Column) -> Column:
    """(price, price_source, standard, elite, hybrid_points, hybrid_cash, availability, confidence) of a shop page.

    The price is that of product markup, else of a meta element or marked attribute, else
    of the state that a script holds, else the first amount in the text; the first source
    that has one counts.  A price under 10 beside 1,000 points or more is none: it is a
    rating or an instalment.
    """
    number = lambda c, p, g=1: page_number(F.nullif(F.regexp_extract(c, p, g), F.lit("")))

    def of(x: Column) -> Column:
        page, body = x["html"], x["body"]
        markup = product_price(page)["cash"]
        marked = page_number(F.coalesce(meta(page, "product:price:amount"), F.nullif(F.regexp_extract(page, r"""(?i)<[^>]+itemprop=["']price["'][^>]*content=["']([^"']*)["']""", 1), F.lit("")), F.nullif(F.regexp_extract(page, r"""(?i)<[^>]+data-price=["']([^"']*)["']""", 1), F.lit(""))))
        scripts = F.array_join(F.regexp_extract_all(page, F.lit(r"(?is)<script(?![^>]*\bsrc=)[^>]*>(.{41,}?)</script>"), F.lit(1)), "\n")
        state = F.get(F.filter(F.transform(F.regexp_extract_all(scripts, F.lit(STATE_PRICE), F.lit(1)), page_number), lambda n: (n >= 1) & (n < 1_000_000)), F.lit(0))
        found = F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(name).alias("source"))) for name, v in (("markup", markup), ("meta", marked), ("state", state), ("text", number(body, TEXT_PRICE)))])
        return F.struct(found.alias("found"), number(body, POINTS).alias("standard"), number(body, ELITE_POINTS).alias("elite"), number(body, HYBRID).alias("hp"), number(body, HYBRID, 2).alias("hc"), body.rlike(SOLD_OUT).alias("out"))

    def told(x: Column) -> Column:
        doubtful = (x["found"]["v"] < 10) & (F.coalesce(x["standard"], F.lit(0.0)) >= 1000)
        price = F.when(~F.coalesce(doubtful, F.lit(False)), x["found"]["v"])
        there = price.isNotNull() | x["standard"].isNotNull()
        return F.struct(
            price.alias("price"), F.when(price.isNotNull(), x["found"]["source"]).alias("price_source"), x["standard"].alias("standard"), F.when(~x["elite"].eqNullSafe(x["standard"]), x["elite"]).alias("elite"), x["hp"].alias("hybrid_points"), x["hc"].alias("hybrid_cash"),
            F.when(x["out"], "out_of_stock").when(there, "in_stock").otherwise("unknown").alias("availability"), F.when(price.isNotNull() & x["standard"].isNotNull(), "medium").otherwise("low").alias("confidence"),
        )

    return X.let(X.let(F.struct(html.alias("html"), X.tag_free(html).alias("body")), of), told)


def _made_page(price: Column, points: Column, k: Column) -> Column:
    """Shop pages of six kinds for one price and number of points."""
    text = lambda n: F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    cents = F.concat(price.cast("string"), F.lit(".50"))
    return F.get(F.array(
        F.concat(F.lit('<script type="application/ld+json">{"@type": "Product", "offers": {"price": "'), price.cast("string"), F.lit(',50"}}</script><p>por '), text(points), F.lit(" pontos</p>")),
        F.concat(F.lit('<meta property="product:price:amount" content="'), cents, F.lit('"><p>Clube: '), text(points - 1000), F.lit(" milhas ou "), text(points), F.lit(" milhas</p>")),
        F.concat(F.lit('<script id="__NEXT_DATA__">{"props": {"pageProps": {"id": 7, "price": "'), cents, F.lit('"}}}</script><p>'), text(points), F.lit(" pontos + R$ 99,90</p>")),
        F.concat(F.lit("<p>R$ "), price.cast("string"), F.lit(",50 esgotado</p>")),
        F.concat(F.lit("<p>nota R$ 4,17 de 5, "), text(points), F.lit(" pontos</p>")),
        F.lit("<p>em breve</p>"),
    ), k)


@query("q_offer_extract", """
WITH t AS (SELECT p_partkey, p_partkey % 6 AS k, p_size + 100 AS price, 5000 + p_partkey % 4000 AS points FROM part)
SELECT p_partkey, CASE WHEN k < 4 THEN price + 0.5::DOUBLE END AS price, ['markup', 'meta', 'state', 'text', NULL, NULL][(k + 1)::INTEGER] AS price_source,
       CASE WHEN k IN (0, 2, 4) THEN points::DOUBLE WHEN k = 1 THEN points::DOUBLE - 1000 END AS standard, CASE WHEN k = 2 THEN points::DOUBLE END AS hybrid_points, CASE WHEN k = 2 THEN 99.9::DOUBLE END AS hybrid_cash,
       ['in_stock', 'in_stock', 'in_stock', 'out_of_stock', 'in_stock', 'unknown'][(k + 1)::INTEGER] AS availability, CASE WHEN k < 3 THEN 'medium' ELSE 'low' END AS confidence FROM t""")
def offer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop pages of six kinds, read back: price from markup, meta, state and text, a doubtful price, and none."""
    k = (F.col("p_partkey") % 6).cast("int")
    page = _made_page((F.col("p_size") + 100).cast("int"), 5000 + F.col("p_partkey") % 4000, k)
    rows = table(spark, sf_dir, "part").select("p_partkey", listing(page).alias("x"))
    return rows.select("p_partkey", *[F.col(f"x.{c}").alias(c) for c in ("price", "price_source", "standard", "hybrid_points", "hybrid_cash", "availability", "confidence")])


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first element of a name, null if there is none or it is empty."""
    return F.nullif(X.tag_free(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))


def slug_of(url: Column) -> Column:
    """The last two parts of an address's path, without a closing mark of an ended offer."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"(?i)/(encerrada|index)/?$", ""), "/$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/")


def campaign_page(html: Column, url: Column, titles: tuple[str, ...] = ("og:title",)) -> Column:
    """(url, title, description, slug, percentage, source): what an official page says of itself; a percentage comes from its address or its curated texts, never from its body. titles are the meta elements that a title is looked for in first."""
    none = F.lit("")

    def of(x: Column) -> Column:
        at = F.coalesce(canonical(x["html"]), x["url"])
        title = F.coalesce(*[meta(x["html"], t) for t in titles], tag_text(x["html"], "title"), tag_text(x["html"], "h1"))
        description = F.coalesce(meta(x["html"], "description"), meta(x["html"], "og:description"))
        pct = percentage(slug_of(at), F.concat_ws(" ", title, description, F.coalesce(tag_text(x["html"], "h1"), none)))
        return F.struct(at.alias("url"), title.alias("title"), description.alias("description"), slug_of(at).alias("slug"), pct["value"].alias("percentage"), pct["source"].alias("source"))

    return X.let(F.struct(html.alias("html"), url.alias("url")), of)


@query("q_campaign_page", """
WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, 10 + p_size AS pct, p_name FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN 'https://a.example/promo/bonus-' || pct ELSE 'https://a.example/x/p-' || p_partkey || '/encerrada' END AS url, CASE k WHEN 1 THEN p_name || ' & mais' WHEN 3 THEN p_name ELSE 'T ' || p_name END AS title,
       CASE WHEN k = 2 THEN 'ganhe ' || pct || '% agora' END AS description, CASE WHEN k = 0 THEN 'promo/bonus-' || pct ELSE 'x/p-' || p_partkey END AS slug, CASE WHEN k IN (0, 2) THEN pct::INTEGER END AS percentage, CASE k WHEN 0 THEN 'slug' WHEN 2 THEN 'text' END AS source FROM t""")
def campaign_page_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official pages of four kinds, read back; the body's percentage never counts."""
    k, pct, name = (F.col("p_partkey") % 4).cast("int"), (F.col("p_size") + 10).cast("string"), F.col("p_name")
    body = F.lit("<body><p>99% de tudo</p></body>")
    html = F.get(F.array(
        F.concat(F.lit("<title>T "), name, F.lit('</title><link rel="canonical" href="https://a.example/promo/bonus-'), pct, F.lit('">'), body),
        F.concat(F.lit('<meta property="og:title" content="'), name, F.lit(' &amp; mais"><title>x</title>'), body),
        F.concat(F.lit('<meta name="description" content="ganhe '), pct, F.lit('% agora"><title>T '), name, F.lit("</title>"), body),
        F.concat(F.lit("<h1><b>"), name, F.lit("</b></h1>"), body),
    ), k)
    url = F.concat(F.lit("https://a.example/x/p-"), F.col("p_partkey").cast("string"), F.lit("/encerrada"))
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey").select("p_partkey", campaign_page(html, url).alias("x")).select("p_partkey", "x.*")


#: Graphs within graphs that are looked into.
GRAPH_DEPTH = 6


def json_ld_nodes(html: Column, depth: int = GRAPH_DEPTH) -> Column:
    """All JSON-LD objects of type Product or Offer as array<variant>, in order: alone, in an array, or (products) within @graph, graphs within graphs too; blocks that are not JSON are passed over.

    Each block is parsed once; what is read of an object later is a path into the variant.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    none = F.array().cast("array<variant>")
    items = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    kind = lambda v: F.try_variant_get(v, "$['@type']", "string")

    def found(v: Column, kinds: tuple[str, ...], left: int) -> Column:
        own = F.when(kind(v).isin(*kinds), F.array(v)).otherwise(none)
        if not left:
            return own
        graph = F.coalesce(items(v, "$['@graph']"), none)
        return F.concat(own, F.flatten(F.transform(graph, lambda g: found(g, ("Product",), left - 1))))

    def block(text: Column) -> Column:
        v = F.try_parse_json(F.trim(text))
        return X.let(v, lambda x: F.flatten(F.transform(F.coalesce(items(x, "$"), F.array(x)), lambda n: found(n, ("Product", "Offer"), depth))))

    return F.flatten(F.transform(F.filter(blocks, lambda b: F.try_parse_json(F.trim(b)).isNotNull()), block))


def json_ld(html: Column) -> Column:
    """json_ld_nodes() as JSON texts."""
    return F.transform(json_ld_nodes(html), lambda v: F.to_json(v))


def written_number(text: Column) -> Column:
    """R$ 1.399,00 and 45.000: dots group, the comma is the decimal sign; null without digits."""
    plain = F.replace(F.replace(F.regexp_replace(text, r"[^\d.,]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.regexp_extract(plain, r"^\d*\.?\d+", 0).try_cast("double")


def product_price(html: Column) -> Column:
    """(cash, name, gtin) of the first product or offer with a price: that of its first offer, the lowest of a range, or its own."""
    at = lambda o, *paths: F.coalesce(*[F.try_variant_get(o, p, "string") for p in paths])

    def read(o: Column) -> Column:
        price = at(o, "$.offers[0].price", "$.offers[0].lowPrice", "$.offers.price", "$.offers.lowPrice", "$.price")
        return F.struct(written_number(price).alias("cash"), at(o, "$.name").alias("name"), at(o, "$.gtin13", "$.gtin", "$.gtin14").alias("gtin"))

    return F.get(F.filter(F.transform(json_ld_nodes(html), read), lambda x: x["cash"] > 0), F.lit(0))


def points_in(text: Column, patterns: list[str]) -> Column:
    """The first pattern whose number is 100 or more."""
    def number(p: str) -> Column:
        n = F.regexp_replace(F.regexp_extract(text, p, 1), r"\.", "").try_cast("bigint")
        return F.when(n >= 100, n)

    return F.coalesce(*[number(p) for p in patterns])
