"""Operator 13: exact duplicates by a content sort.

Texts are equal if they are the same after each run of white space has become one space.
One range exchange and one external sort put equal texts next to one another:

1. Spark samples splitters of the sort key and deals the rows out by ranges of it.  The
   key is the first ``PREFIX`` characters and a hash of the normalised text, so that the
   sample that splitters are taken from stays small, however long the texts;
2. each range is sorted by that key and the whole normalised text, spilling to disk where
   it must;
3. a window over the sorted rows compares neighbours by their full texts: a run of equal
   ones is a group, and its smallest identifier stays.

A group of over ``RUN_ROWS`` rows or ``RUN_BYTES`` bytes is sorted in several runs, dealt
out by row number: a pass before the sort counts rows and bytes by hash, added up before
the shuffle, and the largest ``MAX_SPLIT`` hashes are the only thing broadcast, twelve
bytes each.  Heads of such runs, one row each, are then merged by their full texts, added
up before the shuffle too.  So no task holds a group of unbounded size, and which groups
are split never changes a result.

Null counts as empty; empty texts are equal to one another, and so are texts of white
space (one space).  Null identifiers come after all others, so a null stays only where a
group has nothing else.  Of rows that share identifier and text one stays.  Very long
texts are rows like any other, sorted whole.  An empty table gives an empty result.
Other columns do not reach the result of ``duplicates``, so their names cannot clash;
``one_of_each`` returns them all.  Row numbers split large groups, so the rows must come
in the same order if a task is run again, as they do from files.

Everything is built-in Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, table, written

#: Characters of a text in the sort key that splitters are sampled from.
PREFIX = 32
#: Rows and bytes of a group that are sorted as one run.
RUN_ROWS, RUN_BYTES = 1024, 8 << 20
#: Groups that are split at most, the largest first; bounds what is broadcast to some MB.
MAX_SPLIT = 1 << 18
#: Bytes of text that a range is given.
RANGE_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _split(rows: DataFrame, run_rows: int, run_bytes: int, most: int) -> tuple[DataFrame, int]:
    """(h, runs) of the groups to split, and the bytes of all texts."""
    counts = written(rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")))
    runs = F.greatest(F.ceil(F.col("n") / run_rows), F.least(F.ceil(F.col("bytes") / run_bytes), "n")).cast("int")
    large = counts.select("h", runs.alias("runs")).filter("runs > 1").orderBy(F.desc("runs"), "h").limit(most)
    return large, counts.agg(F.sum("bytes")).first()[0] or 0


def _grouped(rows: DataFrame, run_rows: int, run_bytes: int, most: int) -> DataFrame:
    """rows (id, t, h, ...) with keep, n and head: the smallest id and the rows of a row's group, and whether it is the row that stays."""
    large, n_bytes = _split(rows, run_rows, run_bytes, most)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // RANGE_BYTES))
    run = F.when(F.col("runs").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("runs")).cast("int"))
    dealt = rows.join(F.broadcast(large), "h", "left").withColumn("run", run).drop("runs").withColumn("prefix", F.substring("t", 1, PREFIX))
    key = ["prefix", "h", "run"]
    group = Window.partitionBy(*key, "t")
    order = group.orderBy(F.col("id").asc_nulls_last())
    ranged = dealt.repartitionByRange(parts, *key)
    seen = ranged.withColumns({
        "keep": F.first("id").over(order),
        "head": F.row_number().over(order) == 1,
        "n": F.count("*").over(group.orderBy(F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    return seen.drop("prefix")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal=normalised, carry: bool = False, texts: bool = False, run_rows: int = RUN_ROWS, run_bytes: int = RUN_BYTES, most: int = MAX_SPLIT) -> DataFrame:
    """The sorted rows (id, keep, n, head, run, sha, text): smallest id, rows and first row of each run of equal texts.

    run is null where a run is its whole group.  text is the compared text of the heads
    of other runs or, with texts, of all heads.  With carry, row holds all input columns.
    """
    rest = [F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("t"), *rest)
    seen = _grouped(rows.withColumn("h", F.xxhash64("t")), run_rows, run_bytes, most)
    needed = F.col("head") if texts else F.col("head") & F.col("run").isNotNull()
    return seen.select("id", "keep", "n", "head", "run", F.sha2(F.col("t"), 256).alias("sha"), F.when(needed, F.col("t")).alias("text"), *(["row"] if carry else []))


def settled(seen: DataFrame) -> DataFrame:
    """runs(), written -> (id, keep_id, group_size, kept, text_sha256, further columns): the runs of one group merged by their full texts."""
    names = [c for c in seen.columns if c not in ("id", "keep", "n", "head", "run", "sha", "text")]
    first = F.struct(F.col("keep").isNull().alias("none"), "keep", "run")
    heads = seen.filter("head AND run IS NOT NULL").groupBy("text", "sha").agg(F.min(first).alias("first"), F.sum("n").alias("all"))
    heads = written(heads.select("sha", "first", "all"))  # written, so that a hot text on the other side of the join is a plain shuffle
    whole = seen.filter("run IS NULL").select("id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("head").alias("kept"), F.col("sha").alias("text_sha256"), *names)
    stays = F.col("head") & (F.col("run") == F.col("first.run"))
    merged = seen.filter("run IS NOT NULL").join(heads, "sha")
    return whole.union(merged.select("id", F.col("first.keep").alias("keep_id"), F.col("all").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256"), *names))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, and with carry=True row, a struct of its columns; options as those of runs()."""
    return settled(written(runs(docs, id_col, text_col, **options)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return duplicates(docs, id_col, text_col, carry=True, **options).filter("kept").select("row.*")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
