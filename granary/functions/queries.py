"""Queries that grade the scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import offers as O
from granary.functions import text as X
from granary.functions.bloom import MOST_BITS, bloom, may_hold
from granary.operators.graph import written
from granary.registry import query
from granary.sources.tables import dealt, table

_FOLD = "trim(regexp_replace(translate(lower({}), '" + X.ACCENTED + "', '" + X.PLAIN + "'), '[^a-z0-9]+', ' ', 'g'))"
_DOC = _FOLD.format("coalesce(text, '')")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("q_normalize_text", f"SELECT doc_id, sha256({_DOC}) AS folded_sha256, length({_DOC}) AS n FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("f", X.folded(F.col("text"))).select("doc_id", F.sha2("f", 256).alias("folded_sha256"), F.length("f").cast("bigint").alias("n"))


@query("q_slugify", "SELECT p_partkey, regexp_replace(" + _FOLD.format("p_brand || ' ' || p_name || ' ' || p_type") + ", ' ', '-', 'g') AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("slug"))


# Names under which a programme is known, and its code.  A bank and its card for firms ("bb", "bb-empresas") are programmes of their own.
ALIASES = {
    "azul fidelidade": "azul",
    "latam pass": "latampass",
    "latam-pass": "latampass",
    "tudoazul": "azul",
    "smiles gol": "smiles",
    "connect miles": "connectmiles",
    "life miles": "lifemiles",
    "amex mr": "amex-mr",
    "membership rewards": "amex-mr",
}


def programme(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The code of a programme: its name in lower case with single spaces, or what that is an alias of."""
    m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return X.let(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " ")), lambda n: F.coalesce(F.try_element_at(m, n), n))


_NAMES = ("Azul  Fidelidade", "LATAM Pass", "latam-pass", "TudoAzul", " Smiles GOL ", "Connect Miles", "Life Miles", "Amex MR", "Membership Rewards", "bb", "BB-Empresas", "Livelo")
_CODES = ("azul", "latampass", "latampass", "azul", "smiles", "connectmiles", "lifemiles", "amex-mr", "amex-mr", "bb", "bb-empresas", "livelo")


@query("q_alias_map", f"SELECT c_custkey, {list(_CODES)}[(c_custkey % 12 + 1)::INTEGER] AS code FROM customer")
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % 12).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", programme(name).alias("code"))


_DAY = "lpad(day(o_orderdate)::VARCHAR, 2, '0')"


@query("q_validity_end", f"""
WITH t AS (SELECT o_orderkey, o_orderdate, o_orderkey % 7 AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 3) THEN iso WHEN k = 5 THEN CASE WHEN month(o_orderdate) < 6 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END || substr(iso, 5) WHEN k IN (4, 6) THEN '20' || strftime(o_orderdate, '%y-%m-%d') END AS day,
       ['full_date', 'no_day_and_month', 'no_end_stated', 'full_date', 'year_inferred', 'year_inferred', 'address_and_today'][(k + 1)::INTEGER] AS reason FROM t""")
def validity_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven ways to state the order's day as a last day, read back."""
    d, k = F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 7).cast("int")
    months = F.array(*map(F.lit, O.MONTHS))
    mon = lambda c: F.get(months, F.month(c) - 1)
    text = F.get(F.array(F.concat(F.lit("Válido até "), F.date_format(d, "dd/MM/yyyy")), F.concat(F.lit("começa a partir de "), F.date_format(d, "dd/MM/yyyy")), F.concat(F.lit("Não há data, talvez "), F.date_format(d, "dd/MM/yyyy")), F.concat(F.lit("a partir de 01/01/1990, encerra "), F.date_format(d, "dd/MM/yyyy")), F.concat(F.lit("termina em "), F.date_format(d, "dd/MM")), F.concat(F.lit("até "), F.date_format(d, "dd/MM")), F.lit("somente hoje")), k)
    address = F.when(k == 4, F.concat(F.lit("promo-"), mon(d), F.date_format(d, "yy"))).when(k == 6, F.concat(F.lit("oferta-"), F.dayofmonth(d), mon(d), F.date_format(d, "yy"))).otherwise("")
    published = F.when(k == 5, F.make_date(F.year(d), F.lit(6), F.lit(1)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", O.validity_end(text, address, published).alias("v"))
    return rows.select("o_orderkey", "v.day", "v.reason")


@query("q_price_per_thousand", """
WITH t AS (SELECT p_partkey, p_partkey % 5 AS k, 10 + p_size AS whole, p_partkey % 100 AS cents FROM part)
SELECT p_partkey, CASE WHEN k < 4 THEN round(whole + cents / 100.0::DOUBLE, 2) END AS value, CASE WHEN k < 4 THEN k = 2 END AS is_floor, CASE WHEN k < 4 THEN k = 3 END AS approximate FROM t""")
def price_per_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a thousand points written in five ways, read back; the last is not tied to the unit."""
    k = (F.col("p_partkey") % 5).cast("int")
    price = F.concat(F.col("p_size") + 10, F.lit(","), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))
    text = F.get(F.array(F.concat(F.lit("Compre por R$ "), price, F.lit(" o milheiro")), F.concat(F.lit("Milheiro cai de R$ 1.999,00 para R$"), price), F.concat(F.lit("milheiro a partir de R$ "), price), F.concat(F.lit("R$ 5 de taxa e nada mais a pagar por isso aqui; milheiro a R$ ~"), price), F.concat(F.lit("pague R$ "), price, F.lit(" de taxa"))), k)
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", O.price_per_thousand(text).alias("p"))
    return rows.select("p_partkey", F.col("p.value").alias("value"), F.col("p.floor").alias("is_floor"), F.col("p.approximate").alias("approximate"))


@query("q_tiered_bonus", """
WITH t AS (SELECT s_suppkey, 10 + s_suppkey % 80 AS pct, s_suppkey % 3 AS k FROM supplier),
x AS (SELECT s_suppkey, pct::INTEGER AS pct, ['clube', 'cartao', NULL][(k + 1)::INTEGER] AS audience FROM t UNION ALL SELECT s_suppkey, 5, 'geral' FROM t)
SELECT * FROM x""")
def tiered_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tier for one audience, named twice, and a general one, far apart."""
    pct, k = F.col("s_suppkey") % 80 + 10, (F.col("s_suppkey") % 3).cast("int")
    gap = "x" * 90
    text = F.concat(pct, F.lit("% de bônus "), F.get(F.array(F.lit("para o clube "), F.lit("no cartão "), F.lit("")), k), F.lit(f"{gap} bônus de "), pct, F.lit(f"% {gap} até 5% bônus para todos"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(O.tiered_bonus(text)).alias("b"))
    return rows.select("s_suppkey", "b.pct", "b.audience")


@query("q_parse_br_number", """
WITH t AS (SELECT p_partkey, p_retailprice, CASE p_partkey % 3 WHEN 0 THEN 'R$ ' || (floor(p_retailprice)::INTEGER // 1000) || '.' || lpad((floor(p_retailprice)::INTEGER % 1000)::VARCHAR, 3, '0') || ',50' WHEN 1 THEN (p_partkey // 100) || '.' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') ELSE (p_size::VARCHAR || '.84') END AS raw FROM part)
SELECT p_partkey, raw, CASE p_partkey % 3 WHEN 0 THEN floor(p_retailprice)::INTEGER + 0.5::DOUBLE WHEN 1 THEN ((p_partkey // 100) || lpad((p_partkey % 1000)::VARCHAR, 3, '0'))::DOUBLE ELSE (p_size::VARCHAR || '.84')::DOUBLE END AS value FROM t JOIN part USING (p_partkey, p_retailprice)""")
def parse_br_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in three ways, read back."""
    k, price = F.col("p_partkey"), F.floor("p_retailprice").cast("int")
    three = lambda x: F.lpad((x % 1000).cast("string"), 3, "0")
    raw = (
        F.when(k % 3 == 0, F.concat(F.lit("R$ "), F.floor(price / 1000), F.lit("."), three(price), F.lit(",50")))
        .when(k % 3 == 1, F.concat(F.floor(k / 100), F.lit("."), three(k)))
        .otherwise(F.concat("p_size", F.lit(".84")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), X.br_number(raw).alias("value"))


@query("q_parse_dates", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) WHEN 2 THEN '30/2/2001' ELSE 'na' END AS raw, o_orderdate FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 4 < 2 AND year(o_orderdate) BETWEEN 2000 AND 2100 THEN o_orderdate::DATE END AS parsed FROM t""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.concat_ws("/", F.dayofmonth(d), F.month(d), F.year(d))).when(k == 2, "30/2/2001").otherwise("na")
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), X.date_of(raw).alias("parsed"))


@query("q_date_functions", """
SELECT o_orderkey, (DATE '2001-08-01' - o_orderdate::DATE)::BIGINT AS days, o_orderdate::DATE + 30 AS plus_30, isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS iso_week,
       floor((o_orderdate::DATE - DATE '1970-01-01') / 7.0::DOUBLE)::BIGINT AS week_bucket FROM orders""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.lit("2001-08-01").cast("date"), d).cast("bigint").alias("days"), F.date_add(d, 30).alias("plus_30"), week.alias("iso_week"), F.floor(F.unix_date(d) / F.lit(7.0)).cast("bigint").alias("week_bucket"))


@query("q_month_calendar", """
SELECT o_orderkey, greatest(o_orderdate::DATE, DATE '1998-03-01') AS bar_start, least(o_orderdate::DATE + 30, last_day(DATE '1998-03-01')) AS bar_end
FROM orders WHERE o_orderdate::DATE <= last_day(DATE '1998-03-01') AND o_orderdate::DATE + 30 >= DATE '1998-03-01'""")
def month_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a month, clipped to it."""
    a = F.lit("1998-03-01").cast("date")
    d = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").filter((d <= F.last_day(a)) & (F.date_add(d, 30) >= a))
    return rows.select("o_orderkey", F.greatest(d, a).alias("bar_start"), F.least(F.date_add(d, 30), F.last_day(a)).alias("bar_end"))


@query("q_promo_flag", f"SELECT doc_id, regexp_matches({_DOC}, '{X.PROMO}') AND length({_DOC}) > 40 AS promo FROM documents")
def promo_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = X.folded(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", (f.rlike(X.PROMO) & (F.length(f) > 40)).alias("promo"))


_WORDS = "list_filter(string_split(" + _FOLD.format("coalesce(text, '')") + ", ' '), lambda w: w <> '')"
_TOKENS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM d)),
bg AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM b)),
bn AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id)"""


def gram_hash(ws: Column, i: Column, n: int) -> Column:
    """A hash of the n words from place i (from 0) on."""
    return F.xxhash64(*[F.get(ws, i + k) for k in range(n)])


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, j, g, h): the n-grams of items, their places and hashes; written, as they are read several times and looked up."""
    rows = items.select("item_id", X.words(F.coalesce("text", F.lit(""))).alias("ws")).filter(F.size("ws") >= n)
    rows = rows.select("item_id", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - n)).alias("j"))
    return written(rows.select("item_id", "j", F.array_join(F.slice("ws", F.col("j") + 1, n), " ").alias("g"), gram_hash(F.col("ws"), F.col("j"), n).alias("h")))


def source_grams(texts: DataFrame, grams: DataFrame, n: int, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, i, g): the n-grams of texts that may be among the items'.

    Hashes are tested against a Bloom filter of the items', one row of fixed size, as
    places and hashes are generated from a text's words: generators are compiled together
    with the test, which a lambda over the array is not, and hold a hash that is used
    several times. The few that pass in vain find no partner in the join by the n-gram itself.
    """
    rows = texts.select("doc_id", X.words(F.col("text")).alias("ws")).crossJoin(F.broadcast(bloom(grams, "h", most_bits)))
    rows = rows.select("*", F.explode(F.when(F.size("ws") >= n, F.sequence(F.lit(0), F.size("ws") - n))).alias("i"))
    rows = rows.select("*", F.explode(F.array(gram_hash(F.col("ws"), F.col("i"), n))).alias("h")).filter(may_hold(F.col("words"), F.col("h")))
    return rows.select("doc_id", "i", F.array_join(F.slice("ws", F.col("i") + 1, n), " ").alias("g"))


def shared_grams(spark: SparkSession, sf_dir: str, n: int = 4) -> tuple[DataFrame, DataFrame]:
    """item_grams of the benchmark and source_grams of the documents; both are written, so that one pass over the texts serves several results."""
    grams = item_grams(table(spark, sf_dir, "benchmark"), n)
    return grams, written(source_grams(docs(spark, sf_dir), grams, n))


def overlaps(grams: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of shared_grams: the share of an item's n-grams that a document holds, where there are any.

    Only n-grams that pass the filter of the items' are shuffled; the items' side is a
    written table, so a hot n-gram is split by documents.
    """
    b = written(grams.select("item_id", "g").distinct())
    d = held.select("doc_id", "g").distinct()
    size = b.groupBy("item_id").agg(F.count("*").alias("n"))
    return d.join(b, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("k")).join(size, "item_id").select("doc_id", "item_id", (F.col("k") / F.col("n")).alias("share"))


@query("q_shingle_overlap", _TOKENS + "SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) AS share FROM dg JOIN bg USING (g) JOIN bn USING (item_id) GROUP BY doc_id, item_id")
def shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(*shared_grams(spark, sf_dir))


def longest_runs(grams: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, item_id, run) of shared_grams of four words: the longest common run of four or more words.

    Equal 4-grams on one diagonal (position in the document less position in the
    item) that follow one another form a run: islands by row_number, no quadratic table.
    """
    hits = held.join(grams, "g").select("doc_id", "item_id", "i", (F.col("i") - F.col("j")).alias("diagonal"))
    order = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("i")
    runs = hits.withColumn("island", F.col("i") - F.row_number().over(order)).groupBy("doc_id", "item_id", "diagonal", "island").agg((F.count("*") + 3).alias("run"))
    return runs.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


_RUNS = f"""
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(range(1, len(ws) - 2)) AS i, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) AS g FROM d),
bw AS (SELECT item_id, unnest(range(1, len(ws) - 2)) AS j, unnest(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) AS g FROM b),
h AS (SELECT doc_id, item_id, i, i - j AS diag, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS isl FROM dw JOIN bw USING (g)),
runs AS (SELECT doc_id, item_id, max(k) AS run FROM (SELECT doc_id, item_id, count(*) + 3 AS k FROM h GROUP BY doc_id, item_id, diag, isl) GROUP BY ALL)"""


@query("q_longest_run", f"WITH {_RUNS.strip()} SELECT doc_id, item_id, run FROM runs")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_runs(*shared_grams(spark, sf_dir))
