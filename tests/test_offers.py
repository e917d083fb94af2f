"""Prices, validity and tiers read from offer texts."""

import datetime as dt

from pyspark.sql import functions as F

from granary.functions import offers as O

PRICES = [
    ("R$ 29,93 /milheiro", 29.93, False), ("R$35/milheiro", 35.0, False), ("16.84", 16.84, False), ("R$35", 35.0, False), ("R$ 1.234", 1234.0, False),
    ("Compra de pontos Livelo por R$ 30,50 o milheiro", 30.5, False), ("Turbo Livelo - milheiro por R$ 29,50", 29.5, False), ("milheiro a partir de R$ 16,84 - barato vs piso 21", 16.84, True),
    ("exclusivo Clube. Milheiro cai de R$70 para R$35. Ate 31/07.", 35.0, False), ("milheiro" + " x" * 40 + " R$ 9", None, None), ("pague R$ 40 de taxa", None, None), ("", None, None), (None, None, None),
    ("R$ 99 de taxa fixa para qualquer compra feita no mes; milheiro por R$ 20", 20.0, False), ("milheiro ~ R$ ~15,5", 15.5, False),
]
VALIDITY = [
    ("Azul oferece até 15 pontos por real, até sábado (17)", "", None, None), ("promo válida até 30/06", "", None, None), ("Mudança começa a valer a partir do dia 20/02", "btg-jan25", None, None),
    ("8% de cashback na Amazon 06/02. Não é informado até qual data", "intershop-fev22", None, None), ("15 pontos por real na farmácia 17/06/25", "", None, "2025-06-17"), ("válida até 14/05", "oferta-azul-esfera-80-mai25", None, "2025-05-14"),
    ("somente hoje (10/10)", "clube-livelo-out25", None, "2025-10-10"), ("3 promoções que terminam hoje", "terminam-hoje-9mai25", None, "2025-05-09"), ("Compre créditos Uber com 10% de cashback", "cashback-uber-inter-19jun26", None, None),
    ("promoção válida até 31/01", "", dt.date(2025, 12, 10), "2026-01-31"), ("válida até 30/06", "", dt.date(2025, 1, 15), "2025-06-30"), ("a partir de 12/05/2025 e até 20/05/2025", "", None, "2025-05-20"),
    ("45/13/2025 e depois 5/3/25", "", None, "2025-03-05"), (None, None, None, None),
]


def test_prices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PRICES)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", O.price_per_thousand(F.col("t")).alias("p")).collect()}
    for i, (text, want, floor) in enumerate(PRICES):
        assert (got[i] and (got[i]["value"], got[i]["floor"])) == (want and (want, floor)), text
    assert got[len(PRICES) - 1]["approximate"] and not got[0]["approximate"]


def test_validity(spark):
    df = spark.createDataFrame([(i, t, s, p) for i, (t, s, p, _) in enumerate(VALIDITY)], "i int, t string, s string, p date")
    got = {r["i"]: r["v"] for r in df.select("i", O.validity_end(F.col("t"), F.col("s"), F.col("p")).alias("v")).collect()}
    for i, (text, _, _, want) in enumerate(VALIDITY):
        assert got[i]["day"] == want, (text, got[i])
    assert got[1]["reason"] == "no_year" and got[3]["reason"] == "no_end_stated"


def test_tiers(spark):
    cases = [
        ("Transfira seus pontos. Valido ate 31/07/2026. 50% de bonus para todos os participantes", [(50, "geral")]),
        ("Parcelamento em 12x. 5% de desconto no PIX. width:100%.", []),
        ("clube Diamante: até 375% de bônus; " + "x" * 80 + " 30% de bônus " + "y" * 80 + " bônus de 20% no cartão", [(375, "clube"), (30, None), (20, "cartao")]),
        ("80% de bônus " + "z" * 120 + " 80% de bônus para assinantes do clube", [(80, "clube")]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: [tuple(x) for x in r["b"]] for r in df.select("i", O.tiered_bonus(F.col("t")).alias("b")).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i] == want, text
