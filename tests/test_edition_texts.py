"""The gates of an edition's texts on three editions: one in order, one with every fault, one with nothing."""

from granary.plans.edition_texts import edition_text_checks

EDITIONS = "edition string, summary string, worked string, narrative string, chance string, origem string, destino string, typical int, predicted int, lab boolean, reviewed boolean, automation double"
BLOCKS = "edition string, block string, title string, body string, url string, source string, note double, account string, verdict string, tipo string, origem string, destino string"
TEMPLATES = {"alta": "De {rota}{historico}: alta.", "em-formacao": "De {rota}: em formação."}


def block(edition, name, **given):
    known = dict.fromkeys("title body url source note account verdict tipo origem destino".split()) | given
    return (edition, name, *known.values())


def failed(spark, editions, blocks, windows):
    made = [spark.createDataFrame(rows, schema) for rows, schema in ((editions, EDITIONS), (blocks, BLOCKS), (windows, "edition string, confidence string"))]
    out = edition_text_checks(*made, TEMPLATES, " (uns {n}%)", r"(?i)score\s*\d").collect()
    assert all(r["ok"] == (r["failed"] == 0) for r in out)
    return {(r["edition"], r["check"]): r["failed"] for r in out if r["failed"]}, len(out)


def test_in_order_and_nothing(spark):
    sourced = {"url": "u", "source": "s"}
    blocks = [
        block("a", "deal", body="1.234,5 e 80%", account="conta 1.234,5 dá 80%"), block("a", "quick", verdict="x"),  # beside a deal
        block("a", "radar", title="Score 80", note=1.0, **sourced), block("a", "radar", title="algo", **sourced), block("a", "card", body="SEM CONFIRMACAO", **sourced), block("a", "card", note=2.0, **sourced),
        block("a", "offer", tipo="clube", origem="livelo", destino="sem_destino"), block("a", "offer", tipo="transferencia", origem="sem destino"), block("unknown", "card"),
    ]
    editions = [("a", "são 3", "conta 1.234,5 dá 80%", "De X → Y (uns 30%): alta.", "alta", "X", "Y", 30, 1, True, False, 0.85), ("b", *[None] * 11), (None, *[None] * 11)]
    assert failed(spark, editions, blocks, [("a", "alta"), ("a", "media"), ("unknown", "alta")]) == ({}, 3 * 18)


def test_every_fault(spark):
    blocks = [
        block("a", "deal", body="80% e 7", account="8 e 0"), block("a", "deal", body="9", account=None), block("a", "radar", title="score 7", url="u", source=""), block("a", "card", body="bom", source="s"),
        block("a", "offer", tipo="compra", origem="sem destino", destino=""), block("a", "offer", tipo="compra", title="recomputado"),
        block("b", "quick", verdict="x"), block("b", "quick", verdict="y", title="um TIER 2"),
        block(None, "quick", verdict="x"),
    ]
    editions = [
        ("a", "nada", "outra", "corra, de 1 a 15 de 2027", "alta", "X", "Y", None, 2, True, None, None), ("b", None, None, "De X → Y: alta", "nova", "X", "Y", None, 0, None, None, None), (None, *[None] * 11),
    ]
    bad, n = failed(spark, editions, blocks, [("a", "alta")])
    of = lambda e: {c: k for (x, c), k in bad.items() if x == e}
    assert n == 3 * 18
    assert of("a") == {
        "prose_traced": 2, "radar_sourced": 1, "radar_claims_no_score": 1, "card_sourced": 1, "card_honest": 1, "route_named": 1, "jargon_free": 1, "summary_number": 1, "worked_traced": 1, "lab_reviewed": 1,
        "predicted_recomputed": 1, "chance_visible": 1, "narrative_without_year": 1, "narrative_without_window": 1, "narrative_without_urgency": 1, "narrative_literal": 1,
    }
    assert of("b") == {"quick_without_verdict": 2, "jargon_free": 1, "predicted_positive": 1, "chance_visible": 1, "narrative_literal": 1}
    assert of(None) == {"quick_without_verdict": 1}
