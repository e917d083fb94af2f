"""Operator 12: importance resampling towards a target distribution.

Texts are bags of hashed runs of words.  The gain of a bucket is the logarithm of how much
more of it the target (``benchmark``) has than the source (``documents``); a text's weight
is the mean gain of its features.  Weights plus noise of the Gumbel distribution, fixed by
the document's id, make the highest scores a sample without replacement in proportion to
the exponentiated weights.

1. identical texts are collapsed by grouping them by their full text (the content sort of
   operator 13 on the texts as they are): one row of each group is a text's *bearer*, with
   the group's size;
2. bearers alone are cut into features, once, which are kept as bucket numbers;
3. buckets are counted over bearers, each count times the group's size, in an array of
   ``BUCKETS`` numbers a task; the sums over tasks, a fixed number of them, make the gains;
4. bearers are weighed, once, and weights are joined back to all copies by the text's digest;
5. each document adds its noise.  A histogram of the scores gives the lowest score drawn,
   and what reaches it is ranked by ranges.

Words are runs of 0-9, a-z and characters beyond ASCII, A-Z in lower case.  Null and empty
texts have no features, weight 0 and are never drawn.  Texts that are not equal but hold the
same words are weighed each.  A null id has noise of its own (that of an empty id).  Equal
scores are ranked by id, nulls last; repeated rows are documents of their own, with equal
noise.  A very long text is cut into words in slices.  Empty tables give an empty result; an
empty target makes all gains those of a target without features.  Other columns are not
passed through, so their names cannot clash.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from . import exact
from .common import row_slices, table, written

LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text cut into words at once, and features that a Python worker remembers.
_SLICE, _MEMO = 1 << 20, 1 << 20


class _Buckets(dict):
    """Feature -> bucket, remembered while it is small."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features(text: str | None, longest: int, bucket: _Buckets) -> np.ndarray:
    """The buckets of all runs of 1 to longest words of a text."""
    data, at, parts, before = (text or "").encode().lower(), 0, [], []
    while at < len(data):
        cut = _BREAK.search(data, at + _SLICE) if at + _SLICE < len(data) else None
        end = cut.end() if cut else len(data)
        words = _WORD.findall(data, at, end)
        parts.append(np.fromiter(map(bucket.__getitem__, words), np.uint32, len(words)))
        if longest > 1:
            words, n = before + words, len(before)
            for k in range(2, longest + 1):
                runs = [b" ".join(words[i - k : i]) for i in range(max(k, n + 1), len(words) + 1)]
                parts.append(np.fromiter(map(bucket.__getitem__, runs), np.uint32, len(runs)))
            before = words[len(words) - min(len(words), longest - 1) :]
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _featured(batches, longest: int, buckets: int, keep: bool = True):
    """Batches with a text column -> the same with n_features and buckets (little-endian unsigned 32-bit) of texts that are not null; text goes, but for runs of a larger group."""
    bucket = _Buckets(buckets)
    for batch in batches:
        names = batch.schema.names
        for a, b in row_slices(batch.column(names.index("text"))):
            part = batch.slice(a, b - a)
            texts = part.column(names.index("text")).to_pylist()
            found = [None if t is None else features(t, longest, bucket) for t in texts]
            columns = dict(zip(names, part.columns, strict=True))
            if keep:
                columns["text"] = pa.array([None if run is None else t for t, run in zip(texts, columns["run"].to_pylist(), strict=True)], columns["text"].type)
            else:
                del columns["text"]
            columns["n_features"] = pa.array([None if x is None else len(x) for x in found], pa.int64())
            columns["buckets"] = pa.array([None if x is None else x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _counted(batches, buckets: int):
    """(times, buckets) -> (bucket, n): a task's counts, each feature times its text's copies."""
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        for times, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            counts += np.bincount(np.frombuffer(data or b"", np.uint32), minlength=buckets) * times
    here = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(counts[here])], names=["bucket", "n"])


def counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over rows (times, buckets): a fixed number of sums, whatever the rows."""
    found = rows.mapInArrow(functools.partial(_counted, buckets=buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of target share over source share of each bucket, one added to each count, floored."""
    n, all_s, all_t = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * all_s / ((float(source[i]) + 1) * all_t))) for i in range(n)], np.int64)


def _weighed(batches, gain: np.ndarray):
    """(.., buckets) -> (.., weight): the floored mean gain of a text's features."""
    for batch in batches:
        data = [np.frombuffer(x or b"", np.uint32) for x in batch.column(batch.num_columns - 1).to_pylist()]
        weight = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in data]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.int64())], names=[*batch.schema.names[:-1], "weight"])


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor(1000 times Gumbel noise) fixed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, **options) -> DataFrame:
    """(id, n_features, weight) of every row of docs; target has its texts in text_col too; options as those of exact.runs()."""
    plain = lambda text: F.coalesce(text.cast("string"), F.lit(""))
    cut = functools.partial(_featured, longest=longest, buckets=buckets)
    seen = exact.runs(docs, id_col, text_col, plain, texts=True, **options)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in seen.schema)
    seen = exact.settled(written(seen.mapInArrow(cut, f"{schema}, n_features long, buckets binary")))
    bearers = seen.filter("kept").select("id", F.col("text_sha256").alias("text"), F.col("group_size").alias("times"), "n_features", "buckets")
    aims = target.select(F.lit(1).cast("long").alias("times"), plain(F.col(text_col)).alias("text")).mapInArrow(functools.partial(cut, keep=False), "times long, n_features long, buckets binary")
    gain = gains(counts(bearers.select("times", "buckets"), buckets), counts(aims.select("times", "buckets"), buckets))
    kind = bearers.schema["id"].dataType.simpleString()
    weighed = written(bearers.mapInArrow(functools.partial(_weighed, gain=gain), f"id {kind}, text string, times long, n_features long, weight long"))
    copies = seen.filter("NOT kept").select("id", F.col("text_sha256").alias("text"))
    back = copies.join(weighed.filter("times > 1").select("text", "n_features", "weight"), "text")
    return weighed.select("id", "n_features", "weight").union(back.select("id", "n_features", "weight"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, **options) -> DataFrame:
    """(id, n_features, weight, score, rank): percent of the rows with least features or more have a rank, from 1."""
    scored = written(weights(docs, target, id_col, text_col, **options).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    scored = scored.withColumn("at", F.monotonically_increasing_id())
    able = F.col("n_features") >= least
    levels = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).toPandas()  # whole scores: some ten thousands at most
    wanted = int(levels["n"].sum()) * percent // 100
    upto = levels["n"].cumsum()
    lowest = None if not wanted else int(levels["score"][int(np.searchsorted(upto.to_numpy(), wanted))])
    high = (able & (F.col("score") >= lowest)) if wanted else F.lit(False)
    ranked = numbered(scored.filter(high), [F.desc("score"), F.col("id").asc_nulls_last(), F.col("at")], "place")
    place = F.when(F.col("place") <= wanted, F.col("place")).cast("long").alias("rank")
    names = ["id", "n_features", "weight", "score"]
    return ranked.select(*names, place).union(scored.filter(~high).select(*names, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (table(spark, sf_dir, x) for x in ("documents", "benchmark"))
    return drawn(docs.select("doc_id", "text"), target.select("text")).withColumnRenamed("id", "doc_id")


OP12_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
src AS (SELECT doc_id, text, 'd' AS kind FROM documents UNION ALL SELECT NULL, text, 'b' FROM benchmark),
words AS (
  SELECT row_number() OVER () AS r, doc_id, kind,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM src),
bag AS (SELECT r, kind, w, count(*) AS n FROM (SELECT r, kind, unnest(ws) AS w FROM words) GROUP BY ALL),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM bag)),
bytes AS (
  SELECT w, list_transform(range(length(h) // 2), lambda i: 16 * instr('123456789ABCDEF', substr(h, 2 * i + 1, 1)) + instr('123456789ABCDEF', substr(h, 2 * i + 2, 1))) AS b FROM hexed),
hashed AS (SELECT w, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM bytes, crc),
f AS (SELECT r, kind, k, n FROM bag JOIN hashed USING (w)),
tot AS (SELECT coalesce(sum(n) FILTER (WHERE kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE kind = 'b'), 0)::DOUBLE AS t FROM f),
g AS (
  SELECT k, floor(1000 * ln((coalesce(sum(n) FILTER (WHERE kind = 'b'), 0) + 1)::DOUBLE * (tot.s + 10000)
         / ((coalesce(sum(n) FILTER (WHERE kind = 'd'), 0) + 1)::DOUBLE * (tot.t + 10000))))::BIGINT AS gain FROM f, tot GROUP BY k, tot.s, tot.t),
w AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM f JOIN g USING (k) WHERE kind = 'd' GROUP BY r),
x AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN w USING (r) WHERE kind = 'd'),
y AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM x WHERE n_features >= 20) THEN place END AS rank FROM y
"""
