"""Tiles: a block below a tile is moved once; scores by wrapped numbers are those of plain comparisons."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.operators.tiles import linked_rows
from granary.plans import quality
from tests.test_ranges import LEDGER, ledger_rows, plain_score


def test_block_of_thousands_is_moved_once(spark):
    """A block of 3,000 rows used to be sent three times."""
    df = spark.createDataFrame(ledger_rows(40), LEDGER)
    many = df.crossJoin(spark.range(75).withColumnRenamed("id", "k")).withColumn("id", F.concat("id", F.lit("-"), "k")).withColumn("destino", F.lit("x")).withColumn("origem", F.lit("y")).withColumn("tipo", F.lit("z"))
    dated = quality.temporal(many.drop("k")).select("id", *quality.BLOCK, *quality._PAIR_COLUMNS)
    found = linked_rows(dated, quality.BLOCK, quality.pair_columns, quality.pair_scores, quality.POSSIBLE, quality.PROBABLE)
    assert found.count() == found.select("id").distinct().count() > 0 and found.filter("tiles > 1").isEmpty()


@pytest.mark.parametrize("wide", [False, True])
def test_scores_with_nulls_and_far_days(wide):
    rng, day = random.Random(5), dt.date(1995, 1, 1)
    maybe = lambda x: None if rng.random() < 0.15 else x
    date = lambda: maybe(day + dt.timedelta(rng.randrange(900_000 if wide and rng.random() < 0.5 else 500)))
    rows = [
        {"percentual": maybe(rng.choice([0.5, 5.5, 6.0, 11.0] if wide else [0.0, 4.0, 9.0, 30.0])), "first_seen": date(), "observed_at": date(), "event_date": date(), "fonte": maybe(rng.choice("OF")), "publico": maybe(rng.choice("AB")), "severity": rng.choice(["critical", "ok"])}
        for _ in range(120)
    ]
    kinds = {"percentual": pa.float64(), "first_seen": pa.date32(), "observed_at": pa.date32(), "event_date": pa.date32()}
    table = pa.table({k: pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in rows[0]})
    columns = quality.pair_columns(table)
    got = quality.pair_scores(columns, columns)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            assert got[i, j] == plain_score(a, b), (a, b)
