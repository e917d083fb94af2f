"""Gates of an edition's texts: what each block says is traced to what stands beside it, or to what is known.

editions  (edition, summary, worked, narrative, chance, origem, destino, typical, predicted, lab, reviewed, automation): one row an edition
blocks    (edition, block, title, body, url, source, note, account, verdict, tipo, origem, destino): its items, block being deal, quick, radar, card or offer
windows   (edition, confidence): forecast windows known on its day

A part that an edition does not have breaks nothing.  All checks on items are counts of one
aggregation over the blocks, added up before the shuffle, and meet the edition's own row;
so an edition of any length is one row.  Items and windows of an unknown edition are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.lints import _URGENT, JARGON
from granary.operators.graph import written
from granary.registry import query, using
from granary.sources.tables import table

# The words of a chance, what an item without a score says of itself, and the limits.
CHANCES = {"baixa": "baixa", "media": "média", "alta": "alta", "em-formacao": "em formação"}
HONEST = r"(?iu)sem confirma[çc][ãa]o|fora da r[ée]gua|sem nota"
NO_TARGET = r"(?i)sem[_ ]destino"
BOUGHT = ("compra", "clube")
LEAST_AUTOMATION = 0.85
_NUMBER = r"\d+(?:[.,]\d+)*%?"


def _given(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def _jargon(*columns: str) -> Column:
    text = F.concat_ws("\n", *columns)
    broken = F.lit(False)
    for pattern in JARGON.values():
        broken = broken | text.rlike(pattern)
    return broken


def narrative(templates: dict[str, str], history: str) -> Column:
    """The sentence that an edition's chance, route and typical percentage make; null where the chance is unknown.  Marks are {rota}, {historico} and, in history, {n}."""
    of = F.try_element_at(F.create_map(*[F.lit(x) for kv in templates.items() for x in kv]), F.col("chance"))
    route = F.concat_ws(" → ", "origem", "destino")
    said = F.when(F.col("typical").isNotNull(), F.replace(F.lit(history), F.lit("{n}"), F.col("typical").cast("string"))).otherwise("")
    return F.replace(F.replace(of, F.lit("{rota}"), route), F.lit("{historico}"), said)


def block_checks(claim: str) -> dict[str, tuple[str, Column]]:
    """check -> (block, the condition that its items must meet)."""
    numbers = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(_NUMBER), F.lit(0))
    account = F.coalesce("account", F.lit(""))
    sourced = _given("url") & _given("source")
    words = F.concat_ws(" ", "title", "body")
    real = F.when(_given("destino") & ~F.col("destino").rlike(NO_TARGET), F.col("destino"))
    shown = F.coalesce(real, "origem", F.lit(""))
    return {
        "prose_traced": ("deal", F.forall(numbers, lambda n: F.contains(account, n))),
        "radar_sourced": ("radar", sourced),
        "radar_claims_no_score": ("radar", F.col("note").isNotNull() | ~words.rlike(claim)),
        "card_sourced": ("card", sourced),
        "card_honest": ("card", F.col("note").isNotNull() | words.rlike(HONEST)),
        "route_named": ("offer", ~F.coalesce(F.col("tipo").isin(*BOUGHT), F.lit(False)) | ~shown.rlike(NO_TARGET)),
    }


def edition_text_checks(editions: DataFrame, blocks: DataFrame, windows: DataFrame, templates: dict[str, str], history: str, claim: str) -> DataFrame:
    """(edition, check, ok, failed): each check of each edition, failed being how many items break it.

    templates and history are the sanctioned sentences by chance; claim is a pattern of
    texts that tell a score.
    """
    checks = block_checks(claim)
    worked = editions.select(F.col("edition").alias("e"), "worked")
    rows = blocks.join(worked, F.col("edition").eqNullSafe(F.col("e")))
    deal = F.col("block") == "deal"
    sums = [F.count_if((F.col("block") == block) & ~F.coalesce(ok, F.lit(False))).alias(name) for name, (block, ok) in checks.items()]
    sums += [
        F.count_if(deal).alias("deals"),
        F.count_if(deal & (F.col("account") == F.col("worked"))).alias("traced"),
        F.count_if((F.col("block") == "quick") & F.col("verdict").isNotNull()).alias("chips"),
        F.count_if(_jargon("title", "body", "account")).alias("jargon"),
    ]
    items = rows.groupBy("e").agg(*sums)
    strong = windows.groupBy(F.col("edition").alias("w")).agg(F.count_if(F.col("confidence") == "alta").alias("strong"))
    whole = editions.join(items, F.col("edition").eqNullSafe(F.col("e")), "left").join(strong, F.col("edition").eqNullSafe(F.col("w")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    told, text = _given("narrative"), F.coalesce("narrative", F.lit(""))
    word = F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANCES.items() for x in kv]), F.col("chance"))
    bad = lambda present, ok: (present & ~F.coalesce(ok, F.lit(False))).cast("bigint")
    failed = {name: n(name) for name in checks} | {
        "quick_without_verdict": F.when(n("deals") == 0, n("chips")).otherwise(0),
        "jargon_free": n("jargon") + _jargon("summary", "worked", "narrative").cast("bigint"),
        "summary_number": bad(_given("summary"), F.col("summary").rlike(r"\d")),
        "worked_traced": bad(_given("worked"), (n("traced") > 0) | (n("deals") == 0)),
        "lab_reviewed": bad(F.coalesce("lab", F.lit(False)), F.coalesce("reviewed", F.lit(False)) | F.coalesce(F.col("automation") >= LEAST_AUTOMATION, F.lit(False))),
        "predicted_positive": bad(F.col("predicted").isNotNull(), F.col("predicted") > 0),
        "predicted_recomputed": bad(F.col("predicted").isNotNull(), F.col("predicted") == n("strong")),
        "chance_visible": bad(told, F.contains(text, word)),
        "narrative_without_year": bad(told, ~text.rlike(r"\d{4}")),
        "narrative_without_window": bad(told, ~text.rlike(r"(?i)\bde \d{1,2} a \d{1,2}\b")),
        "narrative_without_urgency": bad(told, ~text.rlike(_URGENT)),
        "narrative_literal": bad(told, text == narrative(templates, history)),
    }
    one = F.array(*[F.struct(F.lit(name).alias("check"), c.cast("bigint").alias("failed")) for name, c in failed.items()])
    flat = whole.select("edition", F.explode(one).alias("x")).select("edition", "x.check", "x.failed")
    return flat.select("edition", "check", (F.col("failed") == 0).alias("ok"), "failed")


_TEMPLATES = {
    "baixa": "A rota {rota}{historico} tem chance baixa.", "media": "A rota {rota}{historico} tem chance média.",
    "alta": "A rota {rota}{historico} tem chance alta.", "em-formacao": "A rota {rota}{historico} ainda está em formação.",
}
_HISTORY = " (cerca de {n}%)"
_CLAIM = r"(?i)score\s*\d"
_FAULTY = "Veja de 3 a 9 de 2027, imperdível"

_TEXTS = {
    "o": "SELECT strftime(o_orderdate, '%Y-%m') AS edition, o_orderkey % 7 AS m, o_custkey % 5 AS b, o_custkey % 100 AS n, o_orderkey % 11 = 0 AS strong FROM orders",
    "ed": """SELECT edition, count(*) % 4 AS k, count(*) FILTER (WHERE b = 0) AS deals, count(*) FILTER (WHERE strong) AS strong, count(*) FILTER (WHERE b = 0 AND m = 3) AS prose,
       count(*) FILTER (WHERE b = 1 AND m = 2) AS chips, count(*) FILTER (WHERE b = 2 AND m IN (1, 4)) AS radar, count(*) FILTER (WHERE b = 2 AND m = 5) AS claim, count(*) FILTER (WHERE b = 3 AND m IN (1, 4)) AS card,
       count(*) FILTER (WHERE b = 3 AND m = 0) AS mute, count(*) FILTER (WHERE b = 4 AND m = 1) AS route, count(*) FILTER (WHERE m = 6) AS jargon FROM o GROUP BY edition""",
    "x": "SELECT *, (k = 1)::BIGINT AS faulty, unnest(['prose_traced', 'radar_sourced', 'radar_claims_no_score', 'card_sourced', 'card_honest', 'route_named', 'quick_without_verdict', 'jargon_free', 'summary_number', 'worked_traced', 'lab_reviewed', 'predicted_positive', 'predicted_recomputed', 'chance_visible', 'narrative_without_year', 'narrative_without_window', 'narrative_without_urgency', 'narrative_literal']) AS \"check\" FROM ed",
    "f": """SELECT edition, "check", (CASE "check" WHEN 'prose_traced' THEN prose WHEN 'radar_sourced' THEN radar WHEN 'radar_claims_no_score' THEN claim WHEN 'card_sourced' THEN card WHEN 'card_honest' THEN mute WHEN 'route_named' THEN route
       WHEN 'quick_without_verdict' THEN CASE WHEN deals = 0 THEN chips ELSE 0 END WHEN 'jargon_free' THEN jargon WHEN 'summary_number' THEN (k = 0)::BIGINT WHEN 'worked_traced' THEN (k = 1 AND deals > 0)::BIGINT WHEN 'lab_reviewed' THEN (k IN (1, 3))::BIGINT
       WHEN 'predicted_positive' THEN (k > 0 AND strong = 0)::BIGINT WHEN 'predicted_recomputed' THEN (k = 0)::BIGINT ELSE faulty END)::BIGINT AS failed FROM x""",
}


@query("q_edition_texts", using(_TEXTS, 'SELECT edition, "check", failed = 0 AS ok, failed FROM f'))
def edition_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edition a month, its blocks written from the month's orders, some with faults; texts of the edition itself by the number of its orders."""
    o = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("edition"), (F.col("o_orderkey") % 7).alias("m"), F.get(F.array(*[F.lit(x) for x in ("deal", "quick", "radar", "card", "offer")]), (F.col("o_custkey") % 5).cast("int")).alias("block"),
        (F.col("o_custkey") % 100).alias("n"), F.when(F.col("o_orderkey") % 11 == 0, "alta").otherwise("media").alias("confidence"),
    )
    o = written(o)
    m, n = F.col("m"), F.col("n").cast("string")
    is_ = lambda name: F.col("block") == name
    next_ = (F.col("n") + 1).cast("string")
    account = F.concat(F.lit("linhas "), n, F.lit("% "), next_)
    body = (
        F.when(is_("deal"), F.concat(F.lit("paga "), n, F.lit("% e "), next_, F.when(m == 3, " por 999.999").otherwise("")))
        .when(is_("card") & (m == 5), "Sem confirmação oficial")
        .when(is_("card") & (m == 6), "fora da regua")
        .otherwise("nada")
    )
    title = F.when(m == 6, "uma fonte TIER 1").when(is_("radar") & (m == 5), "Score 80").otherwise("titulo")
    blocks = o.select(
        "edition", "block", title.alias("title"), body.alias("body"), F.when(m != 1, "https://a.example/x").alias("url"), F.when(m == 4, "").otherwise("fonte").alias("source"), F.when(~m.isin(0, 5, 6), 7.0).alias("note"), F.when(is_("deal"), account).alias("account"),
        F.when(is_("quick") & (m == 2), "vale-agir").alias("verdict"), F.when(m < 3, "compra").otherwise("transferencia").alias("tipo"), F.when(m == 1, "sem_destino").otherwise("livelo").alias("origem"), F.when(m.isin(0, 1, 4), "sem_destino").otherwise("smiles").alias("destino"),
    )
    months = o.groupBy("edition").agg(F.count("*").alias("c"), F.count_if(F.col("confidence") == "alta").alias("strong"), F.min(F.when(is_("deal"), account)).alias("own")).withColumn("k", (F.col("c") % 4).cast("int"))
    k = F.col("k")
    texts = months.select(
        "edition", F.when(k == 0, "sem numero").otherwise("sao 3").alias("summary"), F.when(k == 1, "outra conta").when(k == 2, F.col("own")).alias("worked"), F.get(F.array(*[F.lit(c) for c in CHANCES]), k).alias("chance"),
        F.lit("Livelo").alias("origem"), F.lit("Smiles").alias("destino"), F.when(k != 2, 30 + k).alias("typical"), (F.col("strong") + (k == 0).cast("int")).alias("predicted"), (k > 0).alias("lab"), F.when(k > 1, False).alias("reviewed"), F.when(k == 2, 0.9).when(k == 3, 0.8).alias("automation"),
    )
    texts = texts.withColumn("narrative", F.when(F.col("chance") == "media", _FAULTY).otherwise(narrative(_TEMPLATES, _HISTORY)))
    return edition_text_checks(texts, blocks, o.select("edition", "confidence"), _TEMPLATES, _HISTORY, _CLAIM)
