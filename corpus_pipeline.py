"""The corpus pipeline: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes all rows that its predecessor kept and returns the columns of
documents, but for the last, which returns the packed pieces.  Between stages a
table is written to the shared folder and read again.

Null and empty texts fail the quality rules, so later stages see none unless they empty
a text themselves; such a document stays, with an empty text.  Very long texts are rows
like any other; ties and repeated rows are settled as the operators say; an empty table
gives an empty result.  Columns beyond those of documents pass through all stages but
the last, under their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import lines, near, packing, passages, quality
from granary.llm.common import mark, release, shared_dir, table, written


def _changed(docs: DataFrame, operator) -> DataFrame:
    """docs with the texts that the operator leaves; n_chars follows the text.  Other columns go along as one, so that no name can clash with the operator's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = operator(docs.select("doc_id", "text", F.struct(*rest).alias("__rest")))
    columns = {c: F.col(f"__rest.{c}") for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    return quality.judged(rows).filter("kept").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts."""
    return _changed(docs, lines.without_repeated_lines)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: proposed by SimHash with multi-index hashing and, beyond its radius, by MinHash bands; a 5-word Jaccard of 0.8 or more decides."""
    return near.one_of_each(docs).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out; the rest of a text stays as it was."""
    return _changed(docs, lambda rows: passages.without_repeats(rows, spacing="source"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return packing.pieces_of(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL can express neither tokenising nor packing; tests/llm hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents.

    A stage's own intermediate tables and its input go once its output is written; what
    the last stage reads stays, as its result is not written here.
    """
    docs, since, at = table(spark, sf_dir, "documents"), mark(), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            at = shared_dir(spark)
            docs = written(docs, at)
            release(spark, since, keep=(at,))
    return docs
