"""Ranks, percentiles and pair comparison of groups that take many tasks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators.quantiles import exact_percentiles, placed
from granary.plans import quality
from granary.plans.score import inverse_ecdf, midrank


def groups(seed=3):
    rng = np.random.default_rng(seed)
    rows = [("all", float(x)) for x in rng.normal(size=4000).round(3)] + [("few", float(x)) for x in rng.integers(0, 5, 300)] + [(None, float(x)) for x in range(7)]
    return rows + [("one", 1.0), ("none", None)] + [(f"g{i}", float(i % 3)) for i in range(50)]


@pytest.mark.parametrize("ranges", [None, 1, 13])
def test_percentiles(spark, ranges):
    rows = groups()
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p100": 1.0}, ranges=ranges).collect()}
    assert set(found) == {k for k, v in rows if v is not None}
    for k, r in found.items():
        x = [v for key, v in rows if key == k and v is not None]
        assert r["n"] == len(x) and np.allclose([r["p0"], r["p25"], r["p50"], r["p100"]], np.quantile(x, [0, 0.25, 0.5, 1]))


def test_a_group_takes_several_ranges(spark):
    df = spark.range(20_000).select(F.lit("all").alias("k"), F.col("id").cast("double").alias("v"))
    at = placed(df, ["k"], "v", "below", "here", "n", ranges=16)
    assert at.filter("below <> v OR here <> 1 OR n <> 20000").isEmpty() and at.count() == 20_000
    dealt = df.groupBy("k", "v").count().repartitionByRange(16, "k", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 16 and max(r["count"] for r in dealt) < 3 * 20_000 / 16


def test_midranks(spark):
    rows = groups(5)
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "i long, k string, v double")
    for found, key in ((midrank(df, ["k"], "v", "rank", "n"), lambda k: k), (inverse_ecdf(df, "v", "rank"), lambda k: 0)):
        got = {r["i"]: r["rank"] for r in found.collect()}
        assert len(got) == len(rows)
        for i in range(0, len(rows), 37):
            k, v = rows[i]
            x = [b for a, b in rows if b is not None and key(a) == key(k)]
            if v is None:
                assert got[i] is None
                continue
            want = (sum(b < v for b in x) + 0.5 * sum(b == v for b in x)) / len(x)
            assert got[i] == pytest.approx(want if key(k) == k else 1 - want)


LEDGER = "id string, origem string, destino string, tipo string, produto long, percentual double, inicio date, fim date, first_seen date, observed_at date, fonte string, publico string"


def ledger_rows(n, seed=2):
    rng = random.Random(seed)
    day = lambda a, b: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(a, b))
    rows = []
    for i in range(n):
        seen = rng.choice([day(0, 900), None])
        rows.append((f"r{i:04d}-{day(0, 900)}" if i % 3 else f"r{i:04d}", "a", "b" if i % 5 else "c", "k", i, rng.choice([10.0, 12.0, 18.0, 40.0, None]), rng.choice([day(0, 900), None]), rng.choice([day(0, 900), None, None]), seen, rng.choice([day(0, 900), seen]), rng.choice(["O", "F", None]), rng.choice(["x", "y", "z", None])))
    return rows


def plain_score(a, b):
    """a and b with severity and event date behind the columns."""
    s = 0
    if a["percentual"] is not None and b["percentual"] is not None:
        gap = abs(a["percentual"] - b["percentual"])
        s += 2 if gap == 0 else gap <= 5
    days = [abs((x - y).days) for x in (a["first_seen"], a["observed_at"]) for y in (b["first_seen"], b["observed_at"]) if x and y]
    s += 2 * (bool(days) and min(days) <= 15)
    if a["publico"] and a["publico"] == b["publico"]:
        s += 1 + bool(a["fonte"] and a["fonte"] == b["fonte"])
    s += 3 * ((a["severity"] == "critical") != (b["severity"] == "critical"))
    return s + bool(a["event_date"] and b["event_date"] and abs((a["event_date"] - b["event_date"]).days) > 300)


@pytest.mark.parametrize("size", [1024, 16, 1])
def test_duplicates_in_tiles(spark, size):
    """Every pair of a block, whatever its tiles; nulls give no points; the largest block holds most rows."""
    df = spark.createDataFrame(ledger_rows(70 if size == 1 else 160), LEDGER)
    rows = [r.asDict() for r in quality.temporal(df).collect()]
    root, best, links = {r["id"]: r["id"] for r in rows}, {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a["destino"] == b["destino"] and (s := plain_score(a, b)) >= 3:
                x, y = sorted((find(a["id"]), find(b["id"])))
                root[y] = x
                for r in (a, b):
                    best[r["id"]], links[r["id"]] = max(best.get(r["id"], 0), s), links.get(r["id"], 0) + 1
    found = {r["id"]: (r["links"], r["best"]) for r in quality.compared(df, size).collect()}
    assert found == {i: (links[i], best[i]) for i in best}
    clusters = {r["id"]: (r["root"], r["score"]) for r in quality.clusters(df, size).collect()}
    assert clusters == {i: (find(i), max(best[j] for j in best if find(j) == find(i))) for i in best}
    assert quality.clusters(df.limit(0)).count() == 0
