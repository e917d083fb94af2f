"""Operator 4: quality rules as one Spark projection.

A table of thresholds (``RULES``) over a handful of measures (``measures``) is
compiled into a single boolean expression.  Everything is built-in Spark SQL:
no user functions, no shuffle, one pass over the text; a hot source or a group
of copies costs no more than other rows, since each row is judged alone.

Null text counts as empty and an empty text fails the least number of words; there is
no most.  A very long text is one row, whose 3-word windows are sorted once.  Repeated
rows give repeated results; an empty table gives an empty result.  Other columns pass
through; where one bears the name of a measure, the measure wins.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, kept_columns, let, table, words_col

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to in is was for on with that it as are at be by this from or an".split()
    + "der die das und in zu den von mit ist auf für im dem nicht ein eine als auch es an".split()
    + "le la les de des du et un une en est que qui dans pour par sur au pas avec ce il".split()
    + "el la los las de del y que en un una es por con para se no su al lo como".split()
)
_LONGEST = max(map(len, STOP_WORDS))


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high (either may be None)."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Base rules: length and repetition inside the text.
BASE_RULES = (
    Rule("n_words", low=50),
    Rule("repeat_share", high=0.5),
)
#: The thresholds of the method: length, symbols, stop words and lines.
RULES = (
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_share", low=0.02),
    Rule("lower_share", low=0.5),
    Rule("dup_line_share", high=0.5),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(starts: Column) -> Column:
    """Words in the 3-word windows that start at these ascending positions."""
    return F.when(
        F.size(starts) > 0,
        F.aggregate(
            F.transform(starts, lambda p, i: F.when(i == F.size(starts) - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get(starts, i + 1) - p))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    ).otherwise(F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are sorted by a 64-bit hash of their words with their position, so
    that equal windows are neighbours: n log n for any text length.
    """
    last = F.size(words) - 2

    def starts(s: Column) -> Column:
        again = F.filter(
            F.transform(
                s,
                lambda x, i: F.when(
                    ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
                    x["p"],
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return let(F.sort_array(again), _covered)

    windows = F.transform(
        F.sequence(F.lit(0), last - 1),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )
    return F.when(last > 0, let(F.sort_array(windows), starts)).otherwise(F.lit(0))


def measures(text: Column) -> Column:
    """A struct of the counts and shares that the rules speak of."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")
    without = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))

    def counted(words: Column, rest: Column, lines: Column) -> Column:
        """rest is the text without a to z: what else is counted is counted there."""
        return F.struct(
            long(F.size(words)).alias("n_words"),
            long(F.length(text) - without(rest, SPACE_CHARS)).alias("word_chars"),
            long(without(rest, SYMBOLS)).alias("n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            long(F.size(lines)).alias("n_lines"),
            long(_repeat_words(words)).alias("n_repeat_words"),
            long(F.size(F.filter(words, lambda w: (F.length(w) <= _LONGEST) & F.lower(w).isin(sorted(set(STOP_WORDS)))))).alias("n_stop_words"),
            long(F.regexp_count(rest, F.lit(r"\p{Lu}"))).alias("n_upper"),
            long(F.length(text) - F.length(rest) + F.regexp_count(rest, F.lit(r"\p{Ll}"))).alias("n_lower"),
        )

    def shares(m: Column) -> Column:
        share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return F.struct(
            *[m[c].alias(c) for c in COUNTS],
            share(m["word_chars"], m["n_words"]).alias("mean_word_chars"),
            share(m["n_symbols"], m["n_words"]).alias("symbols_per_word"),
            share(m["n_stop_words"], m["n_words"]).alias("stop_word_share"),
            F.when(m["n_upper"] + m["n_lower"] > 0, m["n_lower"] / (m["n_upper"] + m["n_lower"])).otherwise(F.lit(1.0)).alias("lower_share"),
            share(m["n_dup_lines"], m["n_lines"]).alias("dup_line_share"),
            share(m["n_repeat_words"], m["n_words"]).alias("repeat_share"),
        )

    rest = F.translate(text, string.ascii_lowercase, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    return let(let(words_col(text), lambda w: let(rest, lambda r: let(lines, lambda x: counted(w, r, x)))), shares)


def passes(measure: Column, rules: tuple[Rule, ...]) -> Column:
    """The rules compiled into one boolean expression over a measures() struct."""
    ok = F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (measure[r.measure] >= r.low)
        if r.high is not None:
            ok = ok & (measure[r.measure] <= r.high)
    return ok


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """docs with the counts, base_failed and kept; one narrow projection."""
    made = [*COUNTS, "base_failed", "kept"]
    rest = kept_columns(docs, [id_col, text_col], made)
    m = F.col("__m")
    return (
        docs.select(id_col, text_col, *rest, measures(F.col(text_col)).alias("__m"))
        .select(id_col, text_col, *rest, *[m[c].alias(c) for c in COUNTS], (~passes(m, base)).alias("base_failed"), (passes(m, base) & passes(m, rules)).alias("kept"))
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).drop("text")


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_stop_list()}))) AS n_stop,
         len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '\p{{Ll}}')) AS n_lower,
         len(ls) AS n_lines
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words BETWEEN 2 AND 14
       AND n_symbols / n_words <= 0.1
       AND n_stop / n_words >= 0.02
       AND (n_upper + n_lower = 0 OR n_lower / (n_upper + n_lower) >= 0.5)
       AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS kept
FROM b
"""
