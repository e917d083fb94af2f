"""Operator 5: line dedup by a suffix array over sequences of line ids.

A run of lines in a document is a *later copy* if the same lines stand at an earlier
place, in order of document id, text hash and line number.  Every line in a later copy
of ``MIN_WORDS`` words or more is deleted; runs have any length.

The documents' lines are sequences of 128-bit line ids, whose suffixes are sorted (see
``suffixes``).  Suffixes that share a prefix are an interval of the array; the first of
them, by place, is the original, and the prefix of each other one is a later copy.
Not every depth of the intervals needs a look: a line lies in a later copy of enough
words if and only if it lies in a smallest one, which cannot lose its last line or
cannot lose its first line and keep ``MIN_WORDS`` words.  So an interval is read at the
depth at which its suffixes first have enough words, and at those depths at which all
but their first line have too few; that is at most two looks a line.  A suffix is
sorted as far as it is looked at, which is a line or two in prose and as far as it takes
elsewhere.  Overlapping copies merge into the maximal runs that are deleted.

Suffixes that share nothing with their neighbours are left out before intervals are
numbered; intervals are aggregated before they are shuffled and looked up in a written
table, so Spark can broadcast it or split a skewed interval.

Null text counts as empty and has one empty line; an empty table gives an empty
result; a very long text is hashed part by part and its lines are rows like any other.
Rows equal in id and text are one document and get the same result.  Lines without
words are deleted only as part of a run.  Of the columns passed through, one with the
name of a result column gives way.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, row_slices, string_buffer, table, word_hashes, word_spans, written
from .suffixes import KEY, WIDTH, intervals, keys_of, refined, sorted_suffixes

MIN_WORDS = 4
_DOC = ["id", "th"]


def _read_lines(batches, min_words: int):
    """(id, ih, th, text) -> a row for each line at which a look begins or that lies under a deep one: id, KEY, key, shortest, most, need.

    shortest: lines from here on until there are min_words words; most: the deepest look,
    as many lines as leave fewer than min_words words without the first; both null if
    there never are min_words words.  need: lines from here on under looks of more than
    WIDTH lines.
    """
    for batch in batches:
        for a, b in row_slices(batch.column(3)):
            part = batch.slice(a, b - a)
            data, offsets = string_buffer(part.column(3))
            breaks = np.flatnonzero(data == 10)
            starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
            ends = np.sort(np.concatenate([breaks, offsets[1:]]))
            n_lines = 1 + np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=len(part))
            first = np.concatenate([[0], np.cumsum(n_lines)])
            doc = np.repeat(np.arange(len(part)), n_lines)
            line = np.arange(len(starts))
            words = word_spans(data, offsets)[0]
            so_far = np.concatenate([[0], np.cumsum(np.searchsorted(words, ends) - np.searchsorted(words, starts))])
            end = first[1:][doc]
            enough = np.searchsorted(so_far, so_far[:-1] + min_words)
            look = enough <= end
            shortest = np.where(look, np.maximum(enough - line, 1), 0)
            few = np.minimum(np.searchsorted(so_far, so_far[1:] + min_words) - 1, end)
            most = np.where(look, np.maximum(shortest, few - line), 0)
            need = np.maximum(np.maximum.accumulate(np.where(most > WIDTH, line + most, 0)) - line, 0)
            at = np.flatnonzero(look | (need > 0))
            ids = np.stack([word_hashes(data, starts, ends, k) for k in (0, 1)], axis=1)
            lens = np.minimum(np.minimum(np.maximum(most, need)[at], WIDTH), end[at] - at)
            take = pa.array(doc[at])
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(i).take(take) for i in range(3)],
                    pa.array((line - first[:-1][doc])[at], pa.int64()),
                    keys_of(ids, at, lens),
                    *[pa.array(x[at], pa.int64(), mask=~look[at]) for x in (shortest, most)],
                    pa.array(need[at], pa.int64()),
                ],
                names=["id", *KEY, "key", "shortest", "most", "need"],
            )


def _id_key(id_: str | Column) -> Column:
    col = F.col(id_) if isinstance(id_, str) else id_
    return F.xxhash64(col.isNull(), col)


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, pos, lines): later copies of runs of lines, th being the hash of the text; those of a document overlap to its maximal ones."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), _id_key(id_col).alias("ih"), F.xxhash64(text).alias("th"), text.alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ih long, th long, pos long, key binary, shortest long, most long, need long"
    suffixes = sorted_suffixes(rows.mapInArrow(functools.partial(_read_lines, min_words=min_words), schema))
    shared = F.greatest("lcp", "after")
    depths = F.explode(F.sequence(F.col("shortest"), F.least(F.col("most"), shared)))
    tests = suffixes.filter(F.col("shortest") <= shared).select("i", *KEY, "id", "lcp", depths.alias("depth"))
    deep = suffixes.filter(F.col("need") > 0)
    if not deep.isEmpty():
        order = refined(deep)
        looks = deep.filter(F.col("most") > WIDTH).select(*KEY, "id", F.explode(F.sequence(F.greatest("shortest", F.lit(WIDTH + 1)), "most")).alias("depth"))
        tests = tests.union(looks.join(order, KEY).select(*tests.columns))
    found = written(intervals(tests))
    place = F.struct("id", "th", "pos")
    originals = written(found.groupBy("interval").agg(F.count("*").alias("n"), F.min(place).alias("original")).filter("n > 1").drop("n"))
    copies = found.join(originals, "interval").filter(~F.col("original").eqNullSafe(place))
    return copies.select("id", "th", "pos", F.col("depth").alias("lines"))


def _without(batches):
    """(id, text, runs, ...) -> (id, text, n_lines, n_deleted, runs, ...): deletes the runs' lines."""
    for batch in batches:
        texts, totals, deleted, merged = [], [], [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = text.split("\n")
            spans: list[list[int]] = []
            for r in sorted(runs or [], key=lambda r: (r["pos"], r["lines"])):
                if spans and r["pos"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r["pos"] + r["lines"])
                else:
                    spans.append([r["pos"], r["pos"] + r["lines"]])
            kept, at = [], 0
            for a, b in spans:
                kept += lines[at:a]
                at = b
            kept += lines[at:]
            texts.append("\n".join(kept))
            totals.append(len(lines))
            deleted.append(len(lines) - len(kept))
            merged.append([{"from": a, "to": b} for a, b in spans])
        kind = pa.list_(pa.struct([pa.field("from", pa.int64()), pa.field("to", pa.int64())]))
        columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(deleted, pa.int64()), pa.array(merged, kind), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n_lines", "n_deleted", "runs", *batch.schema.names[3:]])


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """(id_col, text_col, n_lines, n_deleted, runs, other columns): runs are the maximal deleted line spans [from, to)."""
    made = [id_col, text_col, "n_lines", "n_deleted", "runs"]
    keep = kept_columns(docs, made, []) if keep is None else keep
    inner = {c: f"keep_{i}" for i, c in enumerate(keep)}
    runs = repeated_runs(docs, id_col, text_col, min_words).groupBy(*_DOC).agg(F.collect_list(F.struct("pos", "lines")).alias("runs"))
    runs = runs.select(F.col("id").alias("rid"), F.col("th").alias("rth"), "runs")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).alias(n) for c, n in inner.items()]).withColumn("th", F.xxhash64("text"))
    both = rows.join(runs, (rows["th"] == runs["rth"]) & rows["id"].eqNullSafe(runs["rid"]), "left").select("id", "text", "runs", *inner.values())
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_deleted", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
        *[T.StructField(n, rows.schema[n].dataType) for n in inner.values()],
    ])
    return both.mapInArrow(_without, schema).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_deleted", "runs", *[F.col(n).alias(c) for c, n in inner.items()])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("kept_sha256"))


#: Another way to the same lines: all smallest runs, those that cannot lose their last line and those that cannot lose their first, grouped by their whole content.
OP5_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM d),
w AS (SELECT *, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS upto,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
e AS (
  SELECT a.doc_id, a.pos AS i, min(b.pos) AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.words >= {MIN_WORDS}
  GROUP BY a.doc_id, a.pos
  UNION
  SELECT a.doc_id, max(b.pos) AS i, a.pos AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND a.upto - b.upto + b.words >= {MIN_WORDS}
  GROUP BY a.doc_id, a.pos),
r AS (SELECT e.*, md5(array_to_string(ls[i:j], chr(10))) AS run, j - i AS more FROM e JOIN d USING (doc_id)),
c AS (SELECT doc_id, i, j FROM r QUALIFY row_number() OVER (PARTITION BY more, run ORDER BY doc_id, i) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS pos FROM c),
m AS (SELECT l.*, x.pos IS NOT NULL AS gone FROM l LEFT JOIN x USING (doc_id, pos))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
