"""Identity resolution and the tier-1 steps on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from granary.plans import identity, tier1

ALIASES = [("livelo", "livelo", "bancario"), ("smiles", "smiles", "aereo"), ("gol", "smiles", "aereo"), ("smiles gol", "smiles", "aereo"), ("c&a", "cea", "varejo"), ("itau", "itau", "bancario"), ("bb", "bb", "bancario")]


def given(spark):
    return (
        spark.createDataFrame(ALIASES, "alias string, code string, kind string"),
        spark.createDataFrame([("desconhecido",), ("FGTS",)], "name string"),
        spark.createDataFrame([("cartão",), ("cartoes",)], "name string"),
    )


def test_sides(spark):
    names = ["Livelo", "desconhecido", "", None, "Hotel Fasano Resort", "Garuda Airlines", "Marca Nova Qualquer", "Cartões", "Programa  Smiles/GOL e Livelo", "C&A", "bb", "abb bbc", "Itaú Personnalité"]
    found = {r["raw"]: (r["side"], r["code"], r["kind"]) for r in identity.sides(spark.createDataFrame([(n,) for n in names], "raw string"), *given(spark), {"hotel": "hotelaria", "default": "outro"}).collect()}
    assert found["Livelo"] == ("programme", "livelo", "bancario") and found["desconhecido"][0] == "noise" and found[""][0] == found[None][0] == "empty"
    assert found["Hotel Fasano Resort"] == ("bucket", "hotelaria", "hotel") and found["Garuda Airlines"] == ("bucket", "outro", "aereo") and found["Marca Nova Qualquer"] == ("bucket", "outro", "outro")
    assert found["Cartões"][0] == "generic" and found["Programa  Smiles/GOL e Livelo"][1] == "smiles" and found["C&A"][1] == "cea" and found["bb"][1] == "bb"
    assert found["abb bbc"][0] == "bucket" and found["Itaú Personnalité"][1] == "itau"


def test_identities(spark):
    day = dt.date(2026, 9, 1)
    cases = [
        ("Livelo", "Smiles", "transferencia", None, "transferencia_bonificada|livelo|smiles|geral"),
        ("Livelo", "desconhecido", "transferencia", None, "transferencia_sem_destino"),
        ("Smiles", "desconhecido", "compra", None, "compra_pontos|smiles|sem_destino|geral"),
        ("desconhecido", "Smiles", "transferencia", None, "origem_nao_resolvida"),
        ("", "Smiles", "compra", None, "origem_nao_resolvida"),
        ("cartao", "desconhecido", "cartao", None, "origem_generica_recuperavel"),
        ("Smiles", "gol", "transferencia", None, "transferencia_self_loop"),
        ("Smiles", "gol", "compra", None, "compra_pontos|smiles|smiles|geral"),
        ("cartoes", "Smiles", "transferencia", "clube", "transferencia_bonificada|multiplos_cartoes|smiles|cartao"),
        ("Livelo", "Hotel Bourbon Resort", "transferência", "só para o clube", "transferencia_bonificada|livelo|outro|clube"),
        ("Livelo", "Smiles", "xyz", None, "tipo_indefinido"),
    ]
    rows = [(str(i), o, d, t, n, day, 1) for i, (o, d, t, n, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id string, origem string, destino string, tipo string, notes string, fim date, tier int")
    got = {r["id"]: r for r in identity.identities(df, *given(spark), day=F.lit(dt.date(2026, 7, 16))).collect()}
    for i, (*_, want) in enumerate(cases):
        r = got[str(i)]
        assert (r["identity_key"] or r["review"]) == want
        assert r["state"] == "ativa"
    assert got["2"]["single_side"] and got["9"]["bucketed"] and got["8"]["many_cards"] and not got["0"]["single_side"]


def test_tier1_steps_are_idempotent(spark):
    day = F.lit(dt.date(2026, 7, 16))
    c = spark.createDataFrame([("a", dt.date(2026, 9, 1), True, "detectada", "k1"), ("b", dt.date(2026, 7, 1), True, "encerrada", "k2")], "id string, fim date, reliable boolean, state string, identity_key string")
    s = spark.createDataFrame([("b", "u2", 1)], "campaign_id string, url string, tier int")
    asked = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("x", "u3")], "campaign_id string, url string")
    one = tier1.confirmed(c, s, asked, day)
    got = {r["campaign_id"]: r for r in one.outcome.collect()}
    assert got["a"]["new_source"] and got["a"]["promoted"] and not got["b"]["new_source"] and not got["x"]["found"]
    assert {r["id"]: r["state"] for r in one.campaigns.collect()} == {"a": "ativa", "b": "encerrada"} and one.versions.count() == 1 and one.sources.count() == 2
    two = tier1.confirmed(one.campaigns, one.sources, asked, day)
    assert two.versions.count() == 0 and two.sources.count() == 2
    offers = spark.createDataFrame([("k1", "u1", dt.date(2026, 9, 1), True), ("k3", "u9", dt.date(2026, 8, 1), True), ("k3", "u9", dt.date(2026, 8, 1), True), (None, "u", None, False)], "identity_key string, url string, fim date, reliable boolean")
    three = tier1.born(one.campaigns, one.sources, offers, day)
    assert sorted((r["identity_key"], r["created"]) for r in three.outcome.collect()) == [("k1", False), ("k3", True)]
    assert {r["event"] for r in three.versions.collect()} == {"nascimento_tier1", "confirmacao_tier1"} and three.campaigns.count() == 3
    again = tier1.born(three.campaigns, three.sources, offers, day)
    assert not any(r["created"] for r in again.outcome.collect()) and again.campaigns.count() == 3 and again.versions.count() == 0
