"""Scans, readers and completeness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.graph import shared_dir
from granary.registry import query
from granary.sources.tables import table


def json_documents(spark: SparkSession, folder: str, schema, start: str, end: str, day: str = "date") -> DataFrame:
    """One multi-line JSON document a file, of days from start to end, in order."""
    rows = spark.read.schema(schema).json(folder, multiLine=True)
    return rows.filter(F.col(day).between(start, end)).orderBy(day)


def commented_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header and comment lines that begin with #; a quote inside quotes is doubled."""
    return spark.read.schema(schema).csv(path, header=True, comment="#", escape='"')


@query("q_scan_project", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_quantity < 5")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and columns reach the Parquet scan."""
    return table(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '2000-01-01' AND l_quantity < 5").select("l_orderkey", "l_extendedprice")


@query("q_dataset_complete", """
SELECT 'lineitem' AS name, count(*) AS rows, count(DISTINCT l_orderkey) <= (SELECT count(*) FROM orders) AS complete FROM lineitem
UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey) = count(*) FROM orders""")
def dataset_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts against what another table says there should be."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    keys = l.agg(F.count("*").alias("rows"), F.count_distinct("l_orderkey").alias("keys")).join(F.broadcast(o.agg(F.count("*").alias("o"))))
    whole = o.agg(F.lit("orders").alias("name"), F.count("*").alias("rows"), (F.count_distinct("o_orderkey") == F.count("*")).alias("complete"))
    return keys.select(F.lit("lineitem").alias("name"), "rows", (F.col("keys") <= F.col("o")).alias("complete")).union(whole)


@query("q_json_window", """
SELECT strftime(o_orderdate, '%Y-%m') || '-01' AS date, count(*) AS n, max(o_totalprice) AS top, list(DISTINCT o_orderstatus ORDER BY o_orderstatus)::VARCHAR[] AS statuses FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1""")
def json_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a month, written over several lines and read back for thirty months; documents are as many as there are months, whatever the orders."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))
    text = F.to_json(F.struct(F.concat("month", F.lit("-01")).alias("date"), "n", "top", "statuses"), {"pretty": "true"})
    folder = shared_dir(spark)
    rows.select("month", text.alias("value")).repartition("month").write.partitionBy("month").text(folder)
    found = json_documents(spark, folder, "date string, n long, top double, statuses array<string>, month string", "1996-01-01", "1998-06-30")
    return found.select("date", "n", "top", "statuses")


@query("q_commented_csv", "SELECT c_custkey, c_name || ', \"' || c_mktsegment || '\" #' AS label, c_acctbal FROM customer")
def commented_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with quotes, commas and marks in a column, written with a header a file and a comment before each fifth, read back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('" #')).alias("label"), "c_acctbal")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its partition, and so of its file
    header = F.when(first, "c_custkey,label,c_acctbal")
    note = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("# from here: "), "c_custkey"))
    path = shared_dir(spark)
    rows.select(F.concat_ws("\n", header, note, F.to_csv(F.struct("c_custkey", "label", "c_acctbal"), {"escape": '"'})).alias("value")).write.text(path)
    return commented_csv(spark, path, "c_custkey long, label string, c_acctbal double")
