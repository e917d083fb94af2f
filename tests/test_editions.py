"""The edition gates on two editions: one in order, one with every fault, and with nulls."""

import datetime as dt

from granary.plans.editions import edition_checks

DAY = dt.date(2026, 7, 15)
LATER, PAST = DAY + dt.timedelta(3), DAY - dt.timedelta(3)
EDITIONS = "edition string, day date, signal string, disclaimer string, cards string"
ITEMS = "edition string, list string, origem string, destino string, tipo string, verdict string, fim date"
CAMPAIGNS = "edition string, id string, origem string, destino string, tipo string, estado string, tier int, score double, verdict string, fim date"


def failed(spark, editions, items, campaigns):
    out = edition_checks(spark.createDataFrame(editions, EDITIONS), spark.createDataFrame(items, ITEMS), spark.createDataFrame(campaigns, CAMPAIGNS), "d", ("itau",)).collect()
    assert all(r["ok"] == (r["failed"] == 0) for r in out)
    return {(r["edition"], r["check"]): r["failed"] for r in out if r["failed"]}, {(r["edition"], r["check"]) for r in out}


def test_in_order(spark):
    campaigns = [
        ("a", "1", "livelo", "smiles", "t", "ativa", 1, 90.0, "Vale agir", LATER), ("a", "0", "itau", None, "transferencia", "ultimos_dias", 1, 1.0, "Esperaria", LATER),
        ("a", "2", "esfera", "azul", "t", "encerrada", 1, 50.0, "Evitaria", PAST),
    ]
    items = [("a", "deal", "livelo", "smiles", "t", "vale-agir", LATER), ("a", "offer", "itau", None, "transferencia", "esperaria", None), ("a", "closed", "esfera", "azul", "t", None, PAST)]
    bad, checks = failed(spark, [("a", DAY, "livelo paga 30", "d", "dois: 2")], items, campaigns)
    assert bad == {} and len(checks) == 18


def test_every_fault(spark):
    campaigns = [
        ("b", "1", "livelo", "smiles", "t", "historica", 1, 90.0, "Vale agir", PAST), ("b", "2", "x", "y", "t", "ativa", 2, 1.0, "Vale agir", LATER), ("b", "3", "z", "w", "t", "encerrada", 1, None, "Evitaria", PAST),
        ("c", "1", "livelo", "smiles", "t", "ativa", 1, 90.0, "Vale olhar", LATER),
    ]
    items = [
        ("b", "deal", "livelo", "smiles", "t", "esperaria", PAST), ("b", "deal", "nobody", "smiles", "t", "vale-agir", LATER), ("b", "deal", "x", "y", "t", "vale-olhar", None), ("b", "deal", "x", "y", "t", "vale-olhar", LATER),
        ("b", "offer", "x", "y", "other kind", "vale-agir", None), ("b", "offer", "x", "y", "t", "vale-olhar", None), ("b", "closed", "z", "w", "t", None, PAST), ("b", "closed", "z", "w", "t", None, LATER),
    ]
    bad, _ = failed(spark, [("b", DAY, "no number", None, "no number"), ("c", DAY, "30 for nobody", "other", None)], items, campaigns)
    assert bad == {
        ("b", "fields_present"): 1, ("b", "disclaimer_literal"): 1, ("b", "signal_number"): 1, ("b", "deal_cap"): 1, ("b", "cards_number"): 1, ("b", "cards_backed"): 1,
        ("b", "deal_found"): 1, ("b", "deal_gates"): 3, ("b", "deal_verdict"): 1, ("b", "deal_eligible"): 3, ("b", "deal_not_expired"): 2,
        ("b", "offer_found"): 1, ("b", "offer_gates"): 1, ("b", "offer_reading"): 1, ("b", "closed_found"): 1, ("b", "closed_in_time"): 1,
        ("c", "disclaimer_literal"): 1, ("c", "none_eligible"): 1, ("c", "signal_names_candidate"): 1,
    }


def test_empty(spark):
    bad, checks = failed(spark, [], [], [])
    assert bad == {} and checks == set()
