"""Quality of dated offers: temporal plausibility, eligibility, probable duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.graph import written
from granary.operators.tiles import TILE_ROWS, joined_rows, linked_rows
from granary.registry import query, using
from granary.sources.tables import LEDGER, ledger

# Days and scores of the quality rules.
FAR_WARNING, FAR_CRITICAL, AFTER_TOLERANCE, YEAR_MISMATCH, NEAR_PROVENANCE = 180, 300, 30, 300, 15
POSSIBLE, PROBABLE = 3, 5
YEAR_TOLERANCE, SUSPECT_GAP = 65, 365
#: Kinds of rows up to which their results (100 bytes each) are broadcast.
BROADCAST_KINDS = 1 << 20


def id_date() -> Column:
    tail = F.right("id", F.lit(10))  # a pattern over ten characters, not one searched for in the whole id
    return F.try_to_date(F.when(tail.rlike(r"^\d{4}-\d{2}-\d{2}$"), tail))


def temporal(rows: DataFrame) -> DataFrame:
    """Adds event_date, min_prov, gap, flags, status, severity, include, reprocess and review."""
    rows = rows.withColumn("id_date", id_date()).withColumn("event_date", F.coalesce("inicio", "id_date", "fim"))
    rows = rows.withColumn("min_prov", F.least("first_seen", "observed_at")).withColumn("max_prov", F.greatest("first_seen", "observed_at"))
    rows = rows.withColumn("gap", F.datediff("min_prov", "event_date").cast("bigint"))
    apart = lambda a, b: F.coalesce(F.abs(F.datediff(a, b)) > YEAR_MISMATCH, F.lit(False))
    conflict = F.coalesce(F.col("fim") < F.col("inicio"), F.lit(False)) | apart("inicio", "id_date") | apart("inicio", "fim") | apart("id_date", "fim")
    critical = F.coalesce((F.col("gap") > FAR_CRITICAL) & F.col("inicio").isNull(), F.lit(False))
    far = F.coalesce(F.col("gap") > FAR_WARNING, F.lit(False)) & ~critical
    review_far = F.coalesce((F.col("gap") > FAR_CRITICAL) & F.col("inicio").isNotNull(), F.lit(False))
    after = F.coalesce(F.datediff("event_date", "max_prov") > AFTER_TOLERANCE, F.lit(False))
    named = [("conflicting_event_dates", conflict), ("event_far_before_source", far), ("suspect_year", critical), ("event_after_source", after)]
    missing = F.col("event_date").isNull()
    status = (
        F.when(missing, "missing_event_date").when(critical, "suspect_year").when(conflict, "conflicting_event_dates").when(after, "event_after_source").when(far, "event_far_before_source").otherwise("valid")
    )
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named]))
    return (
        rows.withColumn("flags", F.when(missing, F.array(F.lit("missing_event_date"))).when(F.size(flags) == 0, F.array(F.lit("valid"))).otherwise(flags))
        .withColumn("status", status)
        .withColumn("severity", F.when(status == "suspect_year", "critical").when(status == "valid", "ok").otherwise("warning"))
        .withColumn("include", ~missing & ~critical)
        .withColumn("reprocess", ~missing & critical)
        .withColumn("review", ~missing & (conflict | critical | review_far | after))
    )


TEMPORAL = {
    "ledger": LEDGER,
    "t1": r"SELECT *, TRY_CAST(nullif(regexp_extract(id, '(\d{4}-\d{2}-\d{2})$', 1), '') AS DATE) AS id_date FROM ledger",
    "t2": "SELECT *, coalesce(inicio, id_date, fim) AS event_date, least(first_seen, observed_at) AS min_prov, greatest(first_seen, observed_at) AS max_prov FROM t1",
    "t3": f"""SELECT *, (min_prov - event_date)::BIGINT AS gap,
       coalesce(fim < inicio, false) OR coalesce(abs(inicio - id_date) > {YEAR_MISMATCH}, false) OR coalesce(abs(inicio - fim) > {YEAR_MISMATCH}, false) OR coalesce(abs(id_date - fim) > {YEAR_MISMATCH}, false) AS conflict,
       coalesce(event_date - max_prov > {AFTER_TOLERANCE}, false) AS late FROM t2""",
    "t4": f"SELECT *, coalesce(gap > {FAR_CRITICAL} AND inicio IS NULL, false) AS crit, coalesce(gap > {FAR_WARNING} AND NOT (gap > {FAR_CRITICAL} AND inicio IS NULL), false) AS far FROM t3",
    "temporal": f"""SELECT *, CASE WHEN event_date IS NULL THEN 'missing_event_date' WHEN crit THEN 'suspect_year' WHEN conflict THEN 'conflicting_event_dates' WHEN late THEN 'event_after_source'
       WHEN far THEN 'event_far_before_source' ELSE 'valid' END AS status, event_date IS NOT NULL AND NOT crit AS include, event_date IS NOT NULL AND crit AS reprocess,
       event_date IS NOT NULL AND (conflict OR crit OR late OR coalesce(gap > {FAR_CRITICAL} AND inicio IS NOT NULL, false)) AS review FROM t4""",
}
_SEVERITY = "CASE status WHEN 'suspect_year' THEN 'critical' WHEN 'valid' THEN 'ok' ELSE 'warning' END"


@query("q_temporal_quality", using(TEMPORAL, f"""
SELECT id, event_date, gap, status, {_SEVERITY} AS severity, include, reprocess, review,
       array_to_string(CASE WHEN event_date IS NULL THEN ['missing_event_date'] WHEN NOT (conflict OR far OR crit OR late) THEN ['valid'] ELSE
         list_filter([CASE WHEN conflict THEN 'conflicting_event_dates' END, CASE WHEN far THEN 'event_far_before_source' END, CASE WHEN crit THEN 'suspect_year' END, CASE WHEN late THEN 'event_after_source' END], lambda x: x IS NOT NULL) END, ',') AS flags
FROM temporal"""))
def temporal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal(ledger(spark, sf_dir)).select("id", "event_date", "gap", "status", "severity", "include", "reprocess", "review", F.array_join("flags", ",").alias("flags"))


@query("q_suspect_year", using(TEMPORAL, f"""
SELECT id, gap, floor(gap / 365.0::DOUBLE + 0.5)::BIGINT AS years,
       (floor(gap / 365.0::DOUBLE + 0.5) >= 1 AND abs(gap - floor(gap / 365.0::DOUBLE + 0.5) * 365) <= {YEAR_TOLERANCE}) OR gap > {SUSPECT_GAP} AS suspect FROM temporal WHERE event_date IS NOT NULL"""))
def suspect_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap is near whole years, or over a year."""
    years = F.floor(F.col("gap") / F.lit(365.0) + F.lit(0.5)).cast("bigint")
    rows = temporal(ledger(spark, sf_dir)).filter("event_date IS NOT NULL")
    return rows.select("id", "gap", years.alias("years"), (((years >= 1) & (F.abs(F.col("gap") - years * 365) <= YEAR_TOLERANCE)) | (F.col("gap") > SUSPECT_GAP)).alias("suspect"))


@query("q_dedup_key", using(TEMPORAL, """
WITH k AS (SELECT concat_ws('|', origem, destino, tipo, percentual::BIGINT, 'w' || (floor((event_date - DATE '1970-01-01') / 7.0::DOUBLE)::BIGINT)::VARCHAR) AS dedup_key FROM temporal WHERE event_date IS NOT NULL)
SELECT dedup_key, count(*) AS n FROM k GROUP BY dedup_key HAVING count(*) > 1"""))
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.concat(F.lit("w"), F.floor(F.unix_date("event_date") / F.lit(7.0)).cast("bigint").cast("string"))
    rows = temporal(ledger(spark, sf_dir)).filter("event_date IS NOT NULL")
    return rows.groupBy(F.concat_ws("|", "origem", "destino", "tipo", F.col("percentual").cast("bigint"), week).alias("dedup_key")).agg(F.count("*").alias("n")).filter("n > 1")


#: Rows that are compared with one another: one route and kind.
BLOCK = ["origem", "destino", "tipo"]
_PAIR_COLUMNS = ["percentual", "first_seen", "observed_at", "fonte", "publico", "severity", "event_date"]


def _unsigned(columns: dict[str, np.ndarray], narrow: int = 16000) -> dict[str, np.ndarray]:
    """Whole numbers, nan for null, of one scale as unsigned ones from 0 on, two bytes wide where they fit.

    So |x - y| <= d is x + d - y <= 2 * d, in one subtraction that wraps around.  A null is
    far from all numbers and, as its place is another on the right side (``_null``), from nulls.
    """
    known = np.concatenate([v[~np.isnan(v)] for v in columns.values()])
    low = known.min() if len(known) else 0
    kind, null = (np.uint16, 30000) if not len(known) or known.max() - low <= narrow else (np.uint32, 1 << 30)
    return {k: np.where(np.isnan(v), null, v - low).astype(kind) for k, v in columns.items()}


def pair_columns(t: pa.Table) -> dict[str, np.ndarray]:
    """What pair_scores() reads of rows: numbers for texts, days and percentages as _unsigned(), where those are whole."""
    number = lambda name: (c.cast(pa.int32()) if pa.types.is_date((c := t.column(name)).type) else c).cast(pa.float64()).to_numpy()
    days = {k: number(k) for k in ("first_seen", "observed_at", "event_date")}
    text = {k: np.array([-1 if v is None else v for v in t.column(k).combine_chunks().dictionary_encode().indices.to_pylist()], np.int32) for k in ("publico", "fonte")}
    pct = number("percentual")
    known = pct[~np.isnan(pct)]
    whole = bool((np.abs(known) < 1 << 24).all() and (known == np.floor(known)).all())
    severe = np.array([v == "critical" for v in t.column("severity").to_pylist()], bool)
    return {**_unsigned(days), **text, "severe": severe, "dated": ~np.isnan(days["event_date"]), "percentual": _unsigned({"p": pct})["p"] if whole else pct}


def _null(x: np.ndarray) -> np.ndarray:
    """The left side's numbers with nulls at another place than the right side's, as far from all numbers."""
    here, there = (30000, 46000) if x.dtype == np.uint16 else (1 << 30, 3 << 29)
    return np.where(x == here, x.dtype.type(there), x)


def _within(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return (_null(x) + x.dtype.type(most))[:, None] - y[None, :] <= 2 * most


def pair_scores(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """The score 0 to 10 of each row of a with each of b (of pair_columns()); what is missing on a side gives no points.

    Percentages equal 2, at most five points apart 1; provenance at most 15 days apart 2;
    audience equal 1, source too 1; one date critical and the other not 3; event dates over
    300 days apart 1.
    """
    points = lambda x: x.view(np.int8)
    equal = lambda k: np.where(a[k] < 0, -2, a[k])[:, None] == b[k][None, :]
    p, q = a["percentual"], b["percentual"]
    if p.dtype == np.float64:
        gap = np.abs(p[:, None] - q[None, :])  # not a number beside a null: no comparison holds
        same, close = gap == 0, gap <= 5
    else:
        same, close = _null(p)[:, None] == q[None, :], _within(p, q, 5)
    score = points(same) + points(close)
    near = np.zeros(score.shape, bool)
    for x in ("first_seen", "observed_at"):
        for y in ("first_seen", "observed_at"):
            near |= _within(a[x], b[y], NEAR_PROVENANCE)
    score += 2 * points(near)
    audience = equal("publico")
    score += points(audience)
    audience &= equal("fonte")
    score += points(audience)
    score += 3 * points(a["severe"][:, None] != b["severe"][None, :])
    apart = ~_within(a["event_date"], b["event_date"], YEAR_MISMATCH)
    apart &= a["dated"][:, None]
    apart &= b["dated"][None, :]
    return score + points(apart)


def _kind(seed: int = 0) -> Column:
    """A number of the values by which pair_scores() and the blocks tell rows apart; nulls count by their places."""
    names = [*BLOCK, *_PAIR_COLUMNS]
    return F.xxhash64(F.lit(seed), *names, *[F.col(c).isNull() for c in names])


def _head() -> Column:
    """The first seven bytes of an id as a number of the same order, whose minimum needs no sort of ids."""
    return F.conv(F.hex(F.rpad(F.substring(F.col("id").cast("binary"), 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("bigint")


def numbered(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Rows that keys do not tell apart as one row, written: id is a number, n how many they are."""
    return written(rows.groupBy(*keys).agg(F.count("*").alias("n"), *more).withColumn("id", F.monotonically_increasing_id()), compression="zstd")


def _alike(rows: DataFrame) -> bool:
    """Whether kinds of rows are at most about half as many as rows, so that they are worth their shuffle; either way gives the same results."""
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(_kind())).first()
    return 2 * kinds <= n


def _linked(rows: DataFrame, size: int) -> DataFrame:
    return joined_rows(linked_rows(rows, BLOCK, pair_columns, pair_scores, POSSIBLE, PROBABLE, size))


def _dated(rows: DataFrame) -> DataFrame:
    return temporal(rows).withColumn("percentual", F.col("percentual") + F.lit(0.0))  # -0.0 is 0.0, in hashes too


def _each(rows: DataFrame, size: int, once: bool, roots: bool, told) -> DataFrame:
    """told() of the rows with a possible duplicate, as (id, root, links, strong, best, n), n being the rows that one stands for; told() keeps the id.

    Where most rows have the values of another, each kind of row is compared once and
    weighs as many as it stands for; ids do not move but for those of the result.
    """
    rows = _dated(rows).select("id", *BLOCK, *_PAIR_COLUMNS)
    rows = written(rows if once else rows.dropDuplicates(["id"]), compression="zstd")
    if not _alike(rows):
        return told(_linked(rows, size).withColumn("n", F.lit(1)))
    kinds = numbered(rows, [*BLOCK, *_PAIR_COLUMNS], *([F.min(_head()).alias("head")] if roots else []))
    kinds_n, seed = kinds.count(), 0
    while kinds.agg(F.count_distinct(_kind(seed))).first()[0] < kinds_n:  # no two kinds share a number
        seed += 1
    kind = _kind(seed).alias("kind")
    found = _linked(kinds.drop("head"), size).join(kinds.select("id", "n", kind, *(["head"] if roots else [])), "id")
    if roots:  # the smallest id of all rows, where a root is the smallest number of a kind; only ids that begin as it does are compared whole
        found = written(found)
        heads = found.groupBy("root").agg(F.min("head").alias("head"))
        near = rows.select("id", _head().alias("head"), kind).join(written(found.join(heads, ["root", "head"]).select("root", "head", "kind")), ["kind", "head"])
        named = written(near.groupBy("root").agg(F.min("id").alias("smallest")))
        found = found.drop("head").join(named, "root").drop("root").withColumnRenamed("smallest", "root")
    found = written(told(written(found.drop("id").withColumnRenamed("kind", "id"))).withColumnRenamed("id", "kind"))
    return rows.select("id", kind).join(F.broadcast(found) if kinds_n <= BROADCAST_KINDS else found, "kind").drop("kind")


def compared(rows: DataFrame, size: int = TILE_ROWS, once: bool = False) -> DataFrame:
    """(id, root, links, strong, best) of rows with a possible duplicate in their block, whatever its size; rows equal in id are one row (once: there are none)."""
    return _each(rows, size, once, True, lambda found: found.select("id", "root", "links", "strong", "best"))


PAIRS = {
    **TEMPORAL,
    "one": f"SELECT *, {_SEVERITY} AS severity FROM temporal QUALIFY row_number() OVER (PARTITION BY id) = 1",
    "pairs": f"""SELECT a.id AS a, b.id AS b, (CASE WHEN a.percentual = b.percentual THEN 2 WHEN abs(a.percentual - b.percentual) <= 5 THEN 1 ELSE 0 END
       + CASE WHEN least(abs(a.first_seen - b.first_seen), abs(a.first_seen - b.observed_at), abs(a.observed_at - b.first_seen), abs(a.observed_at - b.observed_at)) <= {NEAR_PROVENANCE} THEN 2 ELSE 0 END
       + CASE WHEN a.publico = b.publico THEN 1 ELSE 0 END + CASE WHEN a.publico = b.publico AND a.fonte = b.fonte THEN 1 ELSE 0 END
       + CASE WHEN (a.severity = 'critical') <> (b.severity = 'critical') THEN 3 ELSE 0 END
       + CASE WHEN abs(a.event_date - b.event_date) > {YEAR_MISMATCH} THEN 1 ELSE 0 END)::BIGINT AS score
       FROM one a JOIN one b ON a.origem = b.origem AND a.destino = b.destino AND a.tipo = b.tipo AND a.id < b.id""",
}


@query("q_pair_score", using(PAIRS, f"""
SELECT id, count(*) AS links, count(*) FILTER (WHERE score >= {PROBABLE}) AS probable, max(score) AS best
FROM (SELECT a AS id, score FROM pairs UNION ALL SELECT b, score FROM pairs) WHERE score >= {POSSIBLE} GROUP BY id"""))
def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possible and probable duplicates of each row, and the best score, over all pairs of a route and kind."""
    return _each(ledger(spark, sf_dir, once=True), TILE_ROWS, True, False, lambda found: found.select("id", "links", F.col("strong").alias("probable"), "best"))


@query("q_pair_block_join", using(PAIRS, "SELECT a.origem, a.destino, a.tipo, count(*) AS pairs FROM pairs JOIN one a ON pairs.a = a.id GROUP BY ALL"))
def pair_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in each block, from the block sizes alone."""
    n = F.count_distinct("id")
    return ledger(spark, sf_dir).groupBy(*BLOCK).agg((n * (n - 1) / 2).cast("bigint").alias("pairs")).filter("pairs > 0")


def _status(found: DataFrame) -> DataFrame:
    """(id, root, n, score, status) of the rows of _each(); score is the best of a cluster's pairs."""
    each = found.groupBy("root").agg(F.sum("n").alias("n"), F.max("best").alias("score"))
    status = F.when(F.col("score") >= PROBABLE, "probable_duplicate").otherwise("possible_duplicate")
    return found.select("id", "root").join(written(each), "root").select("id", "root", "n", "score", status.alias("status"))


def clusters(rows: DataFrame, size: int = TILE_ROWS, once: bool = False) -> DataFrame:
    """(id, root, n, score, status) of rows in clusters of two or more."""
    return _each(rows, size, once, True, _status)


CLUSTERS = {
    **PAIRS,
    "edges": f"SELECT * FROM pairs WHERE score >= {POSSIBLE}",
    "sides": "SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges",
    "reach": "SELECT a AS id, b AS r FROM sides UNION SELECT reach.id, e.b FROM reach JOIN sides e ON e.a = reach.r",
    "roots": "SELECT id, least(id, min(r)) AS root FROM reach GROUP BY id",
    "clusters": f"""SELECT id, root, count(*) OVER (PARTITION BY root) AS n, score, CASE WHEN score >= {PROBABLE} THEN 'probable_duplicate' ELSE 'possible_duplicate' END AS status
       FROM roots JOIN (SELECT root, max(score) AS score FROM edges JOIN roots ON edges.a = roots.id GROUP BY root) USING (root)""",
}


@query("q_dup_clusters", using(CLUSTERS, "SELECT id, root, n, score, status FROM clusters"))
def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(ledger(spark, sf_dir, once=True), once=True)


@query("q_eligibility", using(CLUSTERS, """
SELECT CASE WHEN origem = destino THEN 'placeholder_program' WHEN include THEN 'eligible' WHEN c.status = 'probable_duplicate' THEN o.status || '+probable_duplicate' ELSE o.status END AS outcome,
       count(*) AS n, count(*) FILTER (WHERE review) AS to_review
FROM one o LEFT JOIN clusters c USING (id) GROUP BY 1"""))
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probable duplicate is excluded only where its date is inadmissible too; a route onto itself stands for a placeholder."""
    return outcomes(ledger(spark, sf_dir, once=True))


def outcomes(rows: DataFrame, size: int = TILE_ROWS) -> DataFrame:
    """(outcome, n, to_review) of rows of different ids: only kinds of rows and their numbers are moved."""
    keys = [*BLOCK, *_PAIR_COLUMNS, "status", "include", "review"]
    rows = written(_dated(rows).select(*keys, F.lit(1).alias("n")).withColumn("id", F.monotonically_increasing_id()), compression="zstd")
    if _alike(rows):
        rows = numbered(rows, keys)
    found = _linked(rows.select("id", "n", *BLOCK, *_PAIR_COLUMNS), size)
    dup = _status(found.withColumn("n", F.lit(1))).select("id", F.col("status").alias("dup"))
    outcome = (
        F.when(F.col("origem") == F.col("destino"), F.lit("placeholder_program"))
        .when(F.col("include"), F.lit("eligible"))
        .when(F.col("dup") == "probable_duplicate", F.concat("status", F.lit("+probable_duplicate")))
        .otherwise(F.col("status"))
    )
    return rows.join(dup, "id", "left").groupBy(outcome.alias("outcome")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("review"), F.col("n")).otherwise(0)).alias("to_review"))
