"""Range joins against nested loops, without a nested-loop join in the plan, and corroboration by tier and audience."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators.ranges import meeting, within
from granary.plans.gates import audience, corroborated


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_intervals_that_meet(spark, width):
    rng = random.Random(width)
    rows = [(i, a := rng.randrange(-50, 300), a + rng.choice([0, 3, 20, 150])) for i in range(80)] + [(80, None, 5), (81, 5, None), (82, 9, 2)] + [(100 + i, 40, 41) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, s int, e int")
    out = meeting(df, df, "s", "e", width)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["a_i"], r["b_i"]) for r in out.collect())
    whole = [r for r in rows if r[1] is not None and r[2] is not None and r[1] <= r[2]]
    assert got == sorted((x[0], y[0]) for x in whole for y in whole if x[1] <= y[2] and y[1] <= x[2])


@pytest.mark.parametrize("tolerance", [0, 1, 5, 0.5])
def test_values_within_a_tolerance(spark, tolerance):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.randrange(-20, 60) / 2, 7.0])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, v double")
    out = within(df, df, "v", tolerance, F.col("a_i") < F.col("b_i"))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["a_i"], r["b_i"]) for r in out.collect()) == sorted((i, j) for i, x in rows for j, y in rows if i < j and x is not None and y is not None and abs(x - y) <= tolerance)


def test_corroboration(spark):
    azul = [(50.0, "geral"), (100.0, "clube"), (120.0, "diamante")]
    cases = [
        (1, None, "geral", azul, "nao_verificavel"), (2, 15.0, "geral", None, "nao_verificavel"), (3, 15.0, "geral", [], "nao_verificavel"),
        (4, 15.0, "geral", [(10.0, "geral"), (20.0, "geral")], "refuta"),  # between the tiers, near none
        (5, 101.0, "geral", azul, "corrobora_com_ajuste"), (6, 30.0, "geral", [(30.0, "clube")], "corrobora_com_ajuste"),
        (7, 30.0, " Todos", [(30.0, "geral")], "corrobora_limpo"), (8, 31.5, "assinantes", [(30.0, "Clube"), (30.0, "clube")], "corrobora_limpo"),
        (9, 30.0, "geral", [(30.0, None)], "corrobora_limpo"), (10, 30.0, None, [(30.0, "geral")], "corrobora_com_ajuste"), (11, 33.0, "geral", [(30.0, "geral")], "refuta"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "i int, pct double, publico string, tiers array<struct<pct:double,publico:string>>")
    tiers = F.transform("tiers", lambda t: F.struct(t["pct"].alias("pct"), audience(t["publico"]).alias("publico")))
    got = {r["i"]: r["o"] for r in df.select("i", corroborated(F.col("pct"), audience(F.col("publico")), tiers).alias("o")).collect()}
    assert got == {c[0]: c[4] for c in cases}
