"""Gates of an edition before it goes out: every printed item recomputed from the campaigns, block by block.

editions   (edition, day, signal, disclaimer, cards): one row an edition; texts may be null
items      (edition, list, origem, destino, tipo, verdict, fim): what it prints, list being deal, offer or closed
campaigns  (edition, id, origem, destino, tipo, estado, tier, score, verdict, fim): what is known on its day

Items meet campaigns by equality of their route (offers and closed ones also of kind, the
latter of last day too); of several campaigns the one of least id counts, by an aggregate
that is added up before the shuffle.  Checks are sums over an edition's items, so an edition
of any length is a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.graph import written
from granary.plans.gates import _STATE, state
from granary.registry import query, using
from granary.sources.tables import LEDGER, ledger

# The states of a live campaign, the verdicts of the deal desk, how readings are printed, and the limits.
LIVE = ("ativa", "ultimos_dias")
DESK = {"Vale agir": "vale-agir", "Vale olhar": "vale-olhar"}
READINGS = DESK | {"Só para casos específicos": "casos-especificos", "Esperaria": "esperaria", "Evitaria": "evitaria"}
MOST_DEALS, CLOSED_DAYS = 3, 7
BANK_KINDS = ("cartao", "transferencia")


def gates(c: str = "c") -> Column:
    """Live, from a first-hand source and with a score that could be computed."""
    return F.col(f"{c}.estado").isin(*LIVE) & (F.col(f"{c}.tier") == 1) & F.col(f"{c}.score").isNotNull()


_FINEST = ["origem", "destino", "tipo", "fim"]


def _least(campaigns: DataFrame) -> DataFrame:
    """(edition, keys of all items, c): the campaign of least id of each; sorted through once, what coarser keys ask for is taken of it."""
    return written(campaigns.groupBy("edition", *_FINEST).agg(F.min_by(F.struct("id", "estado", "tier", "score", "verdict", "fim"), "id").alias("c")))


def _met(items: DataFrame, least: DataFrame, keys: list[str]) -> DataFrame:
    """items with c, the campaign of least id that they name, or null; null keys are equal."""
    one = least if keys == _FINEST else written(least.groupBy("edition", *keys).agg(F.min_by("c", "c.id").alias("c")))
    same = items["edition"].eqNullSafe(one["edition"])
    for k in keys:
        same = same & items[k].eqNullSafe(one[k])
    return items.join(one, same, "left").select(*[items[x] for x in items.columns], one["c"])


def _number(text: Column) -> Column:
    return F.coalesce(text.rlike("[0-9]"), F.lit(False))


def edition_checks(editions: DataFrame, items: DataFrame, campaigns: DataFrame, disclaimer: str, banks: tuple[str, ...]) -> DataFrame:
    """(edition, check, ok, failed): each check of each edition, failed being the items that break it; campaigns are read twice."""
    least = _least(campaigns)
    day = editions.select(F.col("edition").alias("e"), "day")
    of = lambda name: items.filter(F.col("list") == name).join(day, F.col("edition").eqNullSafe(F.col("e"))).drop("e")
    known = F.col("c").isNotNull()
    reading = F.try_element_at(F.create_map(*[F.lit(x) for kv in READINGS.items() for x in kv]), F.col("c.verdict"))
    tests = [
        (_met(of("deal"), least, ["origem", "destino"]), {
            "deal_found": known, "deal_gates": gates(), "deal_verdict": F.col("verdict").isin(*DESK.values()), "deal_eligible": gates() & F.col("c.verdict").isin(*DESK),
            "deal_not_expired": F.col("fim") >= F.col("day"),
        }),
        (_met(of("offer"), least, ["origem", "destino", "tipo"]), {"offer_found": known, "offer_gates": gates(), "offer_reading": reading == F.col("verdict")}),
        (_met(of("closed"), least, ["origem", "destino", "tipo", "fim"]), {
            "closed_found": known,
            "closed_in_time": (F.col("c.estado") == "encerrada") & (F.col("c.tier") == 1) & F.col("c.score").isNotNull() & F.col("c.fim").between(F.date_sub("day", CLOSED_DAYS), F.col("day")),
        }),
    ]
    found = None
    for rows, checks in tests:
        # what is missing is told once: the other checks of an item without a campaign fail no further, but for those on the item alone
        alone = {"deal_verdict", "deal_not_expired"}
        broken = [F.struct(F.lit(name).alias("check"), F.count_if(~F.coalesce(ok, F.lit(False)) & (F.lit(name in alone or name.endswith("_found")) | known)).alias("failed")) for name, ok in checks.items()]
        part = rows.groupBy("edition").agg(F.array(*broken).alias("x")).select("edition", F.explode("x").alias("x")).select("edition", "x.check", "x.failed")
        found = part if found is None else found.union(part)
    signal = F.lower(F.coalesce("signal", F.lit("")))
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    totals = items.filter("list = 'deal'").groupBy("edition").agg(F.count("*").alias("deals"))
    backed = (F.col("tipo") == BANK_KINDS[0]) | ((F.col("tipo") == BANK_KINDS[1]) & F.col("origem").isin(*banks))
    around = campaigns.groupBy("edition").agg(
        F.count_if(F.col("estado").isin(*LIVE) & (F.col("tier") == 1) & F.col("score").isNotNull() & F.col("verdict").isin(*DESK)).alias("eligible"),
        F.count_if(F.col("estado").isin(*LIVE) & backed).alias("backing"),
        F.array_union(F.collect_set(F.lower("origem")), F.collect_set(F.lower("destino"))).alias("codes"),  # programme codes, a fixed list
    )
    whole = editions
    for other in (totals, around):
        other = other.withColumnRenamed("edition", "e")
        whole = whole.join(other, F.col("edition").eqNullSafe(F.col("e")), "left").drop("e")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none, cards = zero("deals") == 0, F.coalesce(F.col("cards"), F.lit("")) != ""
    own = {
        "fields_present": F.col("day").isNotNull() & (signal != "") & F.col("disclaimer").isNotNull(),
        "disclaimer_literal": F.coalesce(F.col("disclaimer") == disclaimer, F.lit(False)),
        "signal_number": _number(F.col("signal")),
        "deal_cap": zero("deals") <= MOST_DEALS,
        "none_eligible": ~none | (zero("eligible") == 0),
        "signal_names_candidate": ~none | F.exists(codes, lambda x: (x != "") & F.contains(signal, x)),
        "cards_number": ~cards | _number(F.col("cards")),
        "cards_backed": ~cards | (zero("backing") > 0),
    }
    flat = whole.select("edition", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), (~c).cast("bigint").alias("failed")) for n, c in own.items()])).alias("x"))
    return flat.select("edition", "x.check", "x.failed").union(found).select("edition", "check", (F.col("failed") == 0).alias("ok"), "failed")


_DISCLAIMER, _BANKS = "conteudo informativo", ("BRAZIL", "CANADA")
_DAY = "last_day(first_seen)"
_VERDICTS = "CASE WHEN percentual >= 8 THEN 'Vale agir' WHEN percentual >= 6 THEN 'Vale olhar' WHEN percentual >= 3 THEN 'Esperaria' ELSE 'Evitaria' END"
_PRINTED = "CASE WHEN percentual >= 8 THEN 'vale-agir' WHEN percentual >= 6 THEN 'vale-olhar' WHEN percentual >= 3 THEN 'esperaria' ELSE 'evitaria' END"
_KIND = "CASE tipo WHEN '1-URGENT' THEN 'cartao' WHEN '2-HIGH' THEN 'transferencia' ELSE tipo END"
_STAGED = f"""SELECT strftime(first_seen, '%Y-%m') AS edition, id, produto, origem, destino, {_KIND} AS tipo, {_STATE.replace("DATE '{0}'", _DAY)} AS estado, tier,
       CASE WHEN fonte <> 'O' THEN percentual * 10 END AS score, {_VERDICTS} AS verdict, fim, {_DAY} AS day FROM ledger"""
_LIST = "CASE WHEN produto % 400 = 3 THEN 'deal' WHEN produto % 9 = 1 THEN 'offer' WHEN produto % 11 = 2 THEN 'closed' END"
_LIVE_SQL = "estado IN ('ativa', 'ultimos_dias') AND tier = 1 AND score IS NOT NULL"


def _one(keys: str) -> str:
    return f"SELECT edition, {keys}, true AS known, arg_min(estado, id) AS estado, arg_min(tier, id) AS tier, first(score ORDER BY id) AS score, arg_min(verdict, id) AS c_verdict, first(fim ORDER BY id) AS c_fim FROM cam GROUP BY edition, {keys}"


_EDITIONS = {
    "ledger": LEDGER,
    "cam": _STAGED,
    "items": f"""SELECT edition, {_LIST} AS list, CASE WHEN produto % 13 = 0 THEN 'x' ELSE origem END AS origem, destino, tipo, CASE WHEN produto % 6 = 0 THEN 'vale-olhar' ELSE {_PRINTED.replace('percentual', 'pct')} END AS verdict, fim, day
       FROM (SELECT cam.*, l.percentual AS pct FROM cam JOIN (SELECT id, any_value(percentual) AS percentual FROM ledger GROUP BY id) l USING (id)) WHERE {_LIST} IS NOT NULL""",
    "ed": "SELECT edition, any_value(day) AS day, count(*) % 3 AS k, min(origem) AS named, max(CASE WHEN tipo = 'cartao' THEN 1 END) AS card FROM cam GROUP BY edition",
    "texts": f"SELECT edition, day, CASE WHEN k = 0 THEN 'sem numero' ELSE 'bonus de 10 em ' || named END AS signal, CASE WHEN substr(edition, 7, 1) = '3' THEN 'outro' ELSE '{_DISCLAIMER}' END AS disclaimer, CASE k WHEN 1 THEN 'dois cartoes' WHEN 2 THEN '3 cartoes' END AS cards FROM ed",
    "deals": f"SELECT i.*, coalesce(known, false) AS known, {_LIVE_SQL} AS gates, c_verdict FROM (SELECT * FROM items WHERE list = 'deal') i LEFT JOIN ({_one('origem, destino')}) USING (edition, origem, destino)",
    "offs": f"SELECT i.*, coalesce(known, false) AS known, {_LIVE_SQL} AS gates, c_verdict FROM (SELECT * FROM items WHERE list = 'offer') i LEFT JOIN ({_one('origem, destino, tipo')}) USING (edition, origem, destino, tipo)",
    "cls": f"""SELECT i.*, coalesce(known, false) AS known, estado = 'encerrada' AND tier = 1 AND score IS NOT NULL AND c_fim BETWEEN day - {CLOSED_DAYS} AND day AS okay
       FROM (SELECT * FROM items WHERE list = 'closed') i LEFT JOIN ({_one('origem, destino, tipo, fim')}) c ON c.edition = i.edition AND c.origem = i.origem AND c.destino = i.destino AND c.tipo = i.tipo AND c.fim IS NOT DISTINCT FROM i.fim""",
    "around": f"""SELECT edition, count(*) FILTER (WHERE {_LIVE_SQL} AND verdict IN ('Vale agir', 'Vale olhar')) AS eligible,
       count(*) FILTER (WHERE estado IN ('ativa', 'ultimos_dias') AND (tipo = 'cartao' OR tipo = 'transferencia' AND origem IN {_BANKS})) AS backing, list_distinct(list_concat(list(lower(origem)), list(lower(destino)))) AS codes FROM cam GROUP BY edition""",
    "n": "SELECT edition, count(*) AS deals FROM items WHERE list = 'deal' GROUP BY edition",
    "w": "SELECT texts.*, coalesce(deals, 0) AS deals, eligible, backing, codes FROM texts LEFT JOIN n USING (edition) LEFT JOIN around USING (edition)",
    "f": f"""SELECT edition, 'fields_present' AS "check", 0 AS failed FROM w UNION ALL SELECT edition, 'disclaimer_literal', (disclaimer <> '{_DISCLAIMER}')::BIGINT FROM w
       UNION ALL SELECT edition, 'signal_number', (NOT regexp_matches(signal, '[0-9]'))::BIGINT FROM w UNION ALL SELECT edition, 'deal_cap', (deals > {MOST_DEALS})::BIGINT FROM w
       UNION ALL SELECT edition, 'none_eligible', (deals = 0 AND eligible > 0)::BIGINT FROM w UNION ALL SELECT edition, 'signal_names_candidate', (deals = 0 AND len(list_filter(codes, lambda x: contains(lower(signal), x))) = 0)::BIGINT FROM w
       UNION ALL SELECT edition, 'cards_number', (cards IS NOT NULL AND NOT regexp_matches(cards, '[0-9]'))::BIGINT FROM w UNION ALL SELECT edition, 'cards_backed', (cards IS NOT NULL AND backing = 0)::BIGINT FROM w
       UNION ALL SELECT edition, 'deal_found', count(*) FILTER (WHERE NOT known) FROM deals GROUP BY edition UNION ALL SELECT edition, 'deal_gates', count(*) FILTER (WHERE known AND NOT coalesce(gates, false)) FROM deals GROUP BY edition
       UNION ALL SELECT edition, 'deal_verdict', count(*) FILTER (WHERE verdict NOT IN ('vale-agir', 'vale-olhar')) FROM deals GROUP BY edition
       UNION ALL SELECT edition, 'deal_eligible', count(*) FILTER (WHERE known AND NOT coalesce(gates AND c_verdict IN ('Vale agir', 'Vale olhar'), false)) FROM deals GROUP BY edition
       UNION ALL SELECT edition, 'deal_not_expired', count(*) FILTER (WHERE NOT coalesce(fim >= day, false)) FROM deals GROUP BY edition
       UNION ALL SELECT edition, 'offer_found', count(*) FILTER (WHERE NOT known) FROM offs GROUP BY edition UNION ALL SELECT edition, 'offer_gates', count(*) FILTER (WHERE known AND NOT coalesce(gates, false)) FROM offs GROUP BY edition
       UNION ALL SELECT edition, 'offer_reading', count(*) FILTER (WHERE known AND verdict <> CASE c_verdict WHEN 'Vale agir' THEN 'vale-agir' WHEN 'Vale olhar' THEN 'vale-olhar' WHEN 'Esperaria' THEN 'esperaria' ELSE 'evitaria' END) FROM offs GROUP BY edition
       UNION ALL SELECT edition, 'closed_found', count(*) FILTER (WHERE NOT known) FROM cls GROUP BY edition UNION ALL SELECT edition, 'closed_in_time', count(*) FILTER (WHERE known AND NOT coalesce(okay, false)) FROM cls GROUP BY edition""",
}


@query("q_edition_gate", using(_EDITIONS, 'SELECT edition, "check", failed = 0 AS ok, failed::BIGINT AS failed FROM f'))
def edition_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edition a month over the ledger's offers of that month, some of them misprinted or unknown."""
    p, pct = F.col("produto"), F.col("percentual")
    rows = ledger(spark, sf_dir).withColumn("day", F.last_day("first_seen")).withColumn("edition", F.date_format("first_seen", "yyyy-MM"))
    kind = F.when(F.col("tipo") == "1-URGENT", "cartao").when(F.col("tipo") == "2-HIGH", "transferencia").otherwise(F.col("tipo"))
    band = lambda names: F.when(pct >= 8, names[0]).when(pct >= 6, names[1]).when(pct >= 3, names[2]).otherwise(names[3])
    rows = written(rows.select("edition", "id", "produto", "percentual", "origem", "destino", kind.alias("tipo"), state(F.col("day")).alias("estado"), "tier", F.when(F.col("fonte") != "O", pct * 10).alias("score"), band(("Vale agir", "Vale olhar", "Esperaria", "Evitaria")).alias("verdict"), "fim", "day"))
    name = F.when(p % 400 == 3, "deal").when(p % 9 == 1, "offer").when(p % 11 == 2, "closed")
    printed = F.when(p % 6 == 0, "vale-olhar").otherwise(band(("vale-agir", "vale-olhar", "esperaria", "evitaria")))
    items = rows.select("edition", name.alias("list"), F.when(p % 13 == 0, "x").otherwise(F.col("origem")).alias("origem"), "destino", "tipo", printed.alias("verdict"), "fim").filter("list IS NOT NULL")
    k = F.col("n") % 3
    months = rows.groupBy("edition").agg(F.max("day").alias("day"), F.count("*").alias("n"), F.min("origem").alias("named"))
    texts = months.select(
        "edition", "day", F.when(k == 0, "sem numero").otherwise(F.concat(F.lit("bonus de 10 em "), "named")).alias("signal"), F.when(F.substring("edition", 7, 1) == "3", "outro").otherwise(_DISCLAIMER).alias("disclaimer"),
        F.when(k == 1, "dois cartoes").when(k == 2, "3 cartoes").alias("cards"),
    )
    return edition_checks(texts, items, rows.drop("produto", "percentual", "day"), _DISCLAIMER, _BANKS)
