"""Steps shared by queries over the ledger: read once, counted once, dealt over all cores."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from granary.plans.forecast import eligible
from granary.plans.quality import temporal
from granary.sources.tables import ledger

SMOKE = "/root/testdata/sf0.001"


def test_days_are_counted_once(spark):
    """One row a route, day and percentage; it was one an order line."""
    rows = eligible(spark, SMOKE)
    keys = ["origem", "destino", "d", "percentual"]
    want = temporal(ledger(spark, SMOKE)).filter("include AND origem <> destino").groupBy("origem", "destino", F.col("event_date").alias("d"), "percentual").agg(F.count("*").alias("n"))
    assert rows.count() == rows.select(keys).distinct().count()
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()


@pytest.mark.parametrize("name", ["q_score_single_side", "q_efficiency", "q_edition_consistency"])
def test_ledger_is_not_joined_again(spark, name):
    """What is read several times is written; the last plan used to join order lines and orders itself."""
    assert "l_orderkey" not in entry.queries()[name](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["q_campaign_page", "q_price_per_thousand"])
def test_texts_of_parts_are_dealt(spark, name):
    assert entry.queries()[name](spark, SMOKE).rdd.getNumPartitions() >= 8
