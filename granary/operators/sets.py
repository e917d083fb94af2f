"""Set forms: Jaccard similarity of word sets, constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.graph import written
from granary.registry import query, using
from granary.sources.tables import LEDGER, ledger, table


@query("q_jaccard_titles", """
WITH t AS (SELECT DISTINCT concat_ws(' ', p_brand, p_type, p_name) AS a FROM part), w AS (SELECT a, unnest(list_distinct(string_split(a, ' '))) AS w FROM t), n AS (SELECT a, count(*) AS n FROM w GROUP BY a)
SELECT x.a, y.a AS b, count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)) AS jaccard FROM w x JOIN w y ON x.w = y.w AND x.a < y.a JOIN n p ON p.a = x.a JOIN n q ON q.a = y.a
GROUP BY x.a, y.a HAVING count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)) >= 0.6""")
def jaccard_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles meet by a shared word; at 0.6 two sets of n and m words share at least 0.375 * (n + m) of them.

    Prefix filtering: with words in one fixed order, sets that reach the threshold
    share one of their first n - ceil(0.6 * n) + 1 words, so only those are joined.  The
    order is rarest first, so common words hardly ever bring titles together.
    """
    words = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("a")).distinct().select("a", F.explode(F.array_distinct(F.split("a", " "))).alias("k"))
    often = words.groupBy("k").agg(F.count("*").alias("n"))
    t = words.join(often, "k").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "k"))).alias("o")).select("a", F.transform("o", lambda x: x["k"]).alias("w"))
    head = F.slice("w", F.lit(1), (F.size("w") - F.ceil(F.size("w") * F.lit(0.6)) + 1).cast("int"))
    rows = written(t.select("a", "w", F.explode(head).alias("k")))  # written, so that a word of many heads is split on both sides
    other = rows.select(F.col("a").alias("b"), F.col("w").alias("v"), "k")
    near = rows.join(other, "k").filter("a < b").select("a", "b", (F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v"))).alias("jaccard"))
    return near.filter("jaccard >= 0.6").distinct()


@query("q_constraint_violations", """
SELECT 'duplicate_key' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'domain', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'order_check', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.1 OR l_quantity <= 0""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, domains, references and checks that a database would enforce, as counts."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    named = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    row = l.agg(F.count_if(~F.col("l_returnflag").isin("A", "R")).alias("d"), F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 0.1) | (F.col("l_quantity") <= 0)).alias("c"))
    flat = row.select(F.explode(F.array(F.struct(F.lit("domain").alias("rule"), F.col("d").alias("n")), F.struct(F.lit("order_check").alias("rule"), F.col("c").alias("n")))).alias("x")).select("x.rule", "x.n")
    return named("duplicate_key", l.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")).union(flat).union(named("orphan", l.select("l_orderkey").join(orders, "l_orderkey", "left_anti")))


@query("q_content_hash", using({"ledger": LEDGER}, "SELECT id, sha256(concat_ws('|', origem, destino, tipo, percentual::BIGINT::VARCHAR, coalesce(fim::VARCHAR, 'na'))) AS content_hash FROM ledger"))
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["origem", "destino", "tipo", F.col("percentual").cast("bigint").cast("string"), F.coalesce(F.col("fim").cast("string"), F.lit("na"))]
    return ledger(spark, sf_dir).select("id", F.sha2(F.concat_ws("|", *parts), 256).alias("content_hash"))
