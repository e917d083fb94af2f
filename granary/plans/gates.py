"""Gates over texts and evidence: rejection, flags, copies, confidence, thresholds, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import offers as O
from granary.functions import text as X
from granary.functions.queries import _DOC, docs
from granary.operators.graph import written
from granary.registry import query, using
from granary.sources.tables import AS_OF, LEDGER, as_of, ledger, round_to, table

# The vocabulary of points mechanics, which protects a text, and the rules in order: name, pattern, whether mechanics protect, whether an issuer as origin does.
MECHANICS = r"(pontos?|milhas?|milheiro|cashback|bonus|transferenc)"
RULES = (
    ("produto_blog", r"(\b(cursos?|mentoria|masterclass)\b|dominando o|assine nosso)", False, False),
    ("perk_sem_pontos", r"(salas? vip|uber one|disney\+|gemini|clube ifood|ifood gratis|streaming gratis)", True, False),
    ("anuidade_sem_pontos", r"(anuidade gratis|anuidade gratuita|sem anuidade|isencao de anuidade)", True, False),
    ("cupom_varejo", r"(\bcupom\b|\bcupons\b|\boff\b)", True, False),
    ("cupom_varejo", r"(% de desconto|r\$ ?\d[\d.,]* de desconto|desconto no abastec)", True, True),
    ("tarifa_pacote_dinheiro", r"(a partir de r\$|diarias?|all inclusive|\bvoos?\b|\bpassagens?\b|\bpacotes?\b)", True, True),
)
HOTEL_KIND, HOTEL_REASON = "hotelaria", "tipo=hotelaria sem pontos"


def rejection(title: Column, snippet: Column, kind: Column, origin: Column, issuers: list[str]) -> Column:
    """(rule, evidence) of the first rule that a text breaks, or null.

    A text about points, miles or cashback is only rejected for selling a course; an
    offer of a programme that issues points (issuers: names in lower case without
    accents) is not taken for a shop's coupon or a fare.  A hotel offer without points
    is a fare whatever its words.
    """

    def of(x: Column) -> Column:
        protected, issuer = x["text"].rlike(MECHANICS), x["origin"].isin(*issuers) if issuers else F.lit(False)
        out = None
        for name, pattern, spares_mechanics, spares_issuers in RULES:
            hit, evidence = x["text"].rlike(pattern), F.regexp_extract(x["text"], pattern, 0)
            if name == "tarifa_pacote_dinheiro":
                hit, evidence = hit | (x["kind"] == HOTEL_KIND), F.when(x["kind"] == HOTEL_KIND, HOTEL_REASON).otherwise(evidence)
            if spares_mechanics:
                hit = hit & ~protected
            if spares_issuers:
                hit = hit & ~issuer
            broken = F.struct(F.lit(name).alias("rule"), evidence.alias("evidence"))
            out = F.when(hit, broken) if out is None else out.when(hit, broken)
        return out

    none = F.lit("")
    text = O.unaccented(F.concat(F.coalesce(title, none), F.lit(" "), F.coalesce(snippet, none)))
    return X.let(F.struct(text.alias("text"), O.unaccented(kind).alias("kind"), O.unaccented(origin).alias("origin")), of)


# Titles for the query, with the rule that each must break.
_TITLES = (
    ("Curso: dominando o mercado de milhas", "produto_blog"), ("Sala VIP grátis no aeroporto", "perk_sem_pontos"), ("Sala VIP e 10.000 pontos", "passa"), ("Cartão com anuidade grátis", "anuidade_sem_pontos"),
    ("Cupom de R$ 20 na loja", "cupom_varejo"), ("30% de desconto no resgate", "cupom_varejo"), ("Voos a partir de R$ 199", "tarifa_pacote_dinheiro"), ("Hospedagem em Gramado", "passa"), ("100% de bônus na transferência", "passa"), ("Notícia comum", "passa"),
)
_TITLE_SQL = "[" + ", ".join(f"'{r}'" for _, r in _TITLES) + "]"


@query("q_rejection_gate", f"""
SELECT p_partkey, CASE WHEN p_partkey % 10 = 7 AND p_size % 2 = 0 AND p_size % 3 > 0 THEN 'tarifa_pacote_dinheiro' WHEN p_partkey % 10 IN (5, 6) AND p_size % 3 = 0 THEN 'passa' ELSE {_TITLE_SQL}[(p_partkey % 10 + 1)::INTEGER] END AS outcome FROM part""")
def rejection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of ten kinds; parts of even size are hotel offers where the title is one of lodging, sizes divisible by three come from an issuer."""
    k = (F.col("p_partkey") % 10).cast("int")
    title = F.get(F.array(*[F.lit(t) for t, _ in _TITLES]), k)
    kind = F.when((k == 7) & (F.col("p_size") % 2 == 0), "Hotelaria").otherwise("promocao")
    origin = F.when(F.col("p_size") % 3 == 0, "Smiles").otherwise("Loja")
    outcome = rejection(title, F.lit(None).cast("string"), kind, origin, ["smiles"])
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(outcome["rule"], F.lit("passa")).alias("outcome"))


_FLAGS = {
    "percentual_teto": "percentual > 9",
    "vigencia_bug_ano": "fim < first_seen - 180",
    "sem_fonte": "fonte = 'P' AND tier = 3",
    "self_loop": "origem = destino",
    "sem_fim": "fim IS NULL AND inicio IS NULL",
    "valor_extremo": "valor > 100000",
    "visto_antes": "first_seen < inicio - 365",
}


@query("q_presurface_flags", using({"ledger": LEDGER}, "WITH f AS (SELECT unnest([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS.items()) + "]) AS flag FROM ledger) SELECT flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY flag"))
def presurface_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven flags a row, exploded and counted (map-side before the shuffle)."""
    conditions = {
        "percentual_teto": F.col("percentual") > 9, "vigencia_bug_ano": F.col("fim") < F.date_sub("first_seen", 180), "sem_fonte": (F.col("fonte") == "P") & (F.col("tier") == 3),
        "self_loop": F.col("origem") == F.col("destino"), "sem_fim": F.col("fim").isNull() & F.col("inicio").isNull(), "valor_extremo": F.col("valor") > 100000, "visto_antes": F.col("first_seen") < F.date_sub("inicio", 365),
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    return ledger(spark, sf_dir).select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


# Weights of the five signals of evidence.
SIGNALS = {"tier = 1": 0.35, "fim IS NOT NULL": 0.20, "inicio IS NOT NULL": 0.20, "fonte = 'F'": 0.15, "percentual > 0": 0.10}
_CONF = "floor((" + " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w in SIGNALS.items()) + ") * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE"
# Names of audiences that mean the same, and the tolerance in points.
AUDIENCES = {"todos": "geral", "cartoes": "cartao", "assinante": "clube", "assinantes": "clube", "diamante": "clube"}
TOLERANCE = 2
_AUDIENCE = "nullif(CASE lower(trim({0})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AUDIENCES.items()) + " ELSE lower(trim({0})) END, '')"
CONFIDENCE = {
    "ledger": LEDGER,
    "tiers": f"SELECT DISTINCT produto, origem, percentual, {_AUDIENCE.format('publico')} AS publico FROM ledger WHERE tier = 1 AND percentual IS NOT NULL",
    "scale": "SELECT produto, origem, count(DISTINCT percentual) AS faixas FROM tiers GROUP BY ALL",
    "near": f"SELECT id, count(*) AS hits, count(*) FILTER (WHERE t.publico IS NULL OR t.publico IS NOT DISTINCT FROM {_AUDIENCE.format('l.publico')}) AS own FROM ledger l JOIN tiers t ON t.produto = l.produto AND t.origem = l.origem AND abs(t.percentual - l.percentual) <= {TOLERANCE} GROUP BY id",
    "conf": f"""SELECT id, {_CONF} AS confidence, CASE WHEN faixas IS NULL OR percentual IS NULL THEN 'nao_verificavel' WHEN hits IS NULL THEN 'refuta' WHEN faixas > 1 OR own = 0 THEN 'corrobora_com_ajuste' ELSE 'corrobora_limpo' END AS outcome
       FROM ledger LEFT JOIN scale USING (produto, origem) LEFT JOIN near USING (id)""",
}


def audience(name: Column) -> Column:
    """The audience that a name stands for; null for none."""
    known = F.create_map(*[F.lit(x) for kv in AUDIENCES.items() for x in kv])
    plain = F.lower(F.trim(name))
    return F.nullif(F.coalesce(F.try_element_at(known, plain), plain), F.lit(""))


def corroborated(pct: Column, own: Column, tiers: Column) -> Column:
    """Whether the official tiers (array of pct and publico, null if there are none) bear a percentage out.

    It must be near one tier, not merely between the lowest and the highest.  Where the
    scale has several percentages, or the tiers it is near to are another audience's, it
    stands only with an adjustment; a tier without an audience is everyone's.
    """
    near = F.filter(tiers, lambda t: F.abs(t["pct"] - pct) <= TOLERANCE)
    scale = F.size(F.array_distinct(F.transform(tiers, lambda t: t["pct"]))) > 1
    fits = F.exists(near, lambda t: t["publico"].isNull() | t["publico"].eqNullSafe(own))
    return (
        F.when(pct.isNull() | tiers.isNull() | (F.size(tiers) == 0), "nao_verificavel").when(F.size(near) == 0, "refuta").when(scale | ~fits, "corrobora_com_ajuste").otherwise("corrobora_limpo")
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, confidence, outcome): weighted signals, and agreement with the confirmed tiers of the product.

    A product's tiers are its distinct percentages by audience, a few values.
    """
    rows = ledger(spark, sf_dir)
    official = rows.filter("tier = 1 AND percentual IS NOT NULL").groupBy("produto", "origem")
    tiers = official.agg(F.collect_set(F.struct(F.col("percentual").alias("pct"), audience(F.col("publico")).alias("publico"))).alias("tiers"))
    score = F.lit(0.0)
    for c, w in SIGNALS.items():
        score = score + F.when(F.expr(c), F.lit(w)).otherwise(0.0)
    outcome = corroborated(F.col("percentual"), audience(F.col("publico")), F.col("tiers"))
    return rows.join(tiers, ["produto", "origem"], "left").select("id", round_to(score, 4).alias("confidence"), outcome.alias("outcome"))


@query("q_confidence", using(CONFIDENCE, "SELECT id, confidence, outcome FROM conf"))
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir)


@query("q_threshold_grid", using(CONFIDENCE, """
WITH g AS (SELECT unnest([0.6, 0.7, 0.75, 0.8, 0.9]::DOUBLE[]) AS threshold, confidence, outcome FROM conf)
SELECT threshold, count(*) FILTER (WHERE confidence >= threshold AND outcome LIKE 'corrobora%') AS confirmed, count(*) FILTER (WHERE outcome = 'refuta') AS refuted, count(*) FILTER (WHERE confidence < threshold AND outcome <> 'refuta') AS to_review FROM g GROUP BY threshold"""))
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by confidence and outcome first, so only those few rows meet the grid."""
    c = evidence(spark, sf_dir).groupBy("confidence", "outcome").agg(F.count("*").alias("n"))
    g = c.select(F.explode(F.array(*[F.lit(t) for t in (0.6, 0.7, 0.75, 0.8, 0.9)])).alias("threshold"), "*")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    high, refuted = F.col("confidence") >= F.col("threshold"), F.col("outcome") == "refuta"
    return g.groupBy("threshold").agg(n(high & F.col("outcome").like("corrobora%")).alias("confirmed"), n(refuted).alias("refuted"), n(~high & ~refuted).alias("to_review"))


_STATE = "CASE WHEN tier = 3 OR fim IS NULL THEN 'indeterminada' WHEN fim < DATE '{0}' - 30 THEN 'historica' WHEN fim < DATE '{0}' THEN 'encerrada' WHEN fim <= DATE '{0}' + 3 THEN 'ultimos_dias' WHEN tier = 1 THEN 'ativa' ELSE 'detectada' END"


def state(day) -> object:
    """State from a reliable last day, at a day."""
    fim = F.col("fim")
    return (
        F.when((F.col("tier") == 3) | fim.isNull(), "indeterminada").when(fim < F.date_sub(day, 30), "historica").when(fim < day, "encerrada").when(fim <= F.date_add(day, 3), "ultimos_dias").when(F.col("tier") == 1, "ativa").otherwise("detectada")
    )


@query("q_state_fsm", using({"ledger": LEDGER}, f"SELECT id, {_STATE.format(AS_OF)} AS state, {_STATE.format('2000-01-01')} AS state_before FROM ledger"))
def state_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("id", state(as_of()).alias("state"), state(F.lit("2000-01-01").cast("date")).alias("state_before"))


@query("q_revalidation", using({"ledger": LEDGER}, f"""
WITH live AS (SELECT produto, origem, max(fim) AS fim, max(tier) AS tier FROM ledger WHERE fonte <> 'F' GROUP BY ALL),
items AS (SELECT DISTINCT produto, origem FROM ledger WHERE percentual = 10)
SELECT produto, origem, CASE WHEN live.produto IS NULL THEN 'sem_match_vivo' WHEN fim < DATE '2000-06-01' THEN 'vencida' WHEN fim IS NULL OR tier = 3 THEN 'estado_nao_vivo' ELSE 'ok' END AS reason FROM items LEFT JOIN live USING (produto, origem)"""))
def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    live = rows.filter("fonte <> 'F'").groupBy("produto", "origem").agg(F.max("fim").alias("fim"), F.max("tier").alias("tier"))
    items = rows.filter("percentual = 10").select("produto", "origem").distinct()
    reason = F.when(F.col("tier").isNull(), "sem_match_vivo").when(F.col("fim") < F.lit("2000-06-01").cast("date"), "vencida").when(F.col("fim").isNull() | (F.col("tier") == 3), "estado_nao_vivo").otherwise("ok")
    return items.join(live, ["produto", "origem"], "left").select("produto", "origem", reason.alias("reason"))


@query("q_gold_eval", f"""
WITH p AS (SELECT doc_id, length({_DOC}) < 300 OR NOT regexp_matches({_DOC}, '[aeiou]') AS rejected FROM documents), j AS (SELECT rejected, quality = 0 AS bad, toxic = 1 AS toxic FROM labels JOIN p USING (doc_id))
SELECT field, count(*) AS n, count(*) FILTER (WHERE rejected AND truth) AS tp, count(*) FILTER (WHERE rejected AND NOT truth) AS fp, count(*) FILTER (WHERE NOT rejected AND truth) AS fn,
       round(count(*) FILTER (WHERE rejected AND truth) / nullif(count(*) FILTER (WHERE rejected), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE rejected AND truth) / nullif(count(*) FILTER (WHERE truth), 0)::DOUBLE, 6) AS recall
FROM (SELECT 'quality' AS field, rejected, bad AS truth FROM j UNION ALL SELECT 'toxic', rejected, toxic FROM j) GROUP BY field""")
def gold_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule against labelled rows: counts of hits and misses, precision and recall a field."""
    f = X.folded(F.col("text"))
    p = docs(spark, sf_dir).select("doc_id", ((F.length(f) < 300) | ~f.rlike("[aeiou]")).alias("rejected"))
    pair = lambda k, c: F.struct(F.lit(k).alias("field"), c.alias("truth"))
    j = table(spark, sf_dir, "labels").join(p, "doc_id").select("rejected", F.explode(F.array(pair("quality", F.col("quality") == 0), pair("toxic", F.col("toxic") == 1))).alias("x")).select("rejected", "x.field", "x.truth")
    hit, false, miss = [F.count_if(c) for c in (F.col("rejected") & F.col("truth"), F.col("rejected") & ~F.col("truth"), ~F.col("rejected") & F.col("truth"))]
    return j.groupBy("field").agg(
        F.count("*").alias("n"), hit.alias("tp"), false.alias("fp"), miss.alias("fn"), F.round(F.try_divide(hit, F.count_if("rejected")), 6).alias("precision"), F.round(F.try_divide(hit, F.count_if("truth")), 6).alias("recall"),
    )


# The kinds of outcome that count as retrieved and as relevant, by field.
RETRIEVED = {"code": ("match", "wrong", "spurious"), "pct": ("match", "wrong", "spurious"), "day": ("match", "wrong", "year_error", "overprecision")}
RELEVANT = {"code": ("match", "wrong", "missed"), "pct": ("match", "wrong", "missed"), "day": ("match", "wrong", "year_error", "missed")}


def match_kind(field: str, found: Column, gold: Column) -> Column:
    """How an extracted value stands to the labelled one; null is no value.  A day that is right but for its year is a year error, one where none can be known overprecise."""
    both = F.when(found == gold, "match")
    if field == "day":
        both = both.when((F.month(found) == F.month(gold)) & (F.dayofmonth(found) == F.dayofmonth(gold)), "year_error")
    nothing, invented = {"code": ("match", "spurious"), "pct": ("match_null", "spurious"), "day": ("match_indet", "overprecision")}[field]
    return F.when(gold.isNull() & found.isNull(), nothing).when(gold.isNull(), invented).when(found.isNull(), "missed").otherwise(F.coalesce(both.otherwise("wrong"), F.lit("wrong")))


def evaluated(rows: DataFrame, fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    """rows with each field's found and gold column -> (field, kind, n); fields: name -> (sort of field, found, gold)."""
    pair = [F.struct(F.lit(name).alias("field"), match_kind(sort, F.col(found), F.col(gold)).alias("kind")) for name, (sort, found, gold) in fields.items()]
    return rows.select(F.explode(F.array(*pair)).alias("x")).groupBy("x.field", "x.kind").agg(F.count("*").alias("n"))


def precision_recall(kinds: DataFrame, fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(field, correct, retrieved, relevant, precision, recall) of (field, kind, n)."""
    among = lambda table: F.coalesce(F.sum(F.when(_any([(F.col("field") == name) & F.col("kind").isin(*table[sort]) for name, (sort, _, _) in fields.items()]), F.col("n"))), F.lit(0))
    sums = kinds.groupBy("field").agg(F.coalesce(F.sum(F.when(F.col("kind") == "match", F.col("n"))), F.lit(0)).alias("correct"), among(RETRIEVED).alias("retrieved"), among(RELEVANT).alias("relevant"))
    return sums.withColumn("precision", F.round(F.try_divide("correct", "retrieved"), 6)).withColumn("recall", F.round(F.try_divide("correct", "relevant"), 6))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


_GOLD_FIELDS = {"origin": ("code", "f_origem", "origem"), "percentage": ("pct", "f_pct", "pct"), "validity": ("day", "f_fim", "fim")}
_GOLD = {
    "ledger": LEDGER,
    "g": """SELECT CASE WHEN produto % 5 > 0 THEN origem END AS origem, CASE WHEN produto % 7 > 0 THEN percentual END AS pct, fim,
       CASE produto % 4 WHEN 0 THEN NULL WHEN 1 THEN destino ELSE origem END AS f_origem, CASE produto % 3 WHEN 0 THEN NULL WHEN 1 THEN percentual + 1 ELSE percentual END AS f_pct,
       CASE produto % 6 WHEN 0 THEN NULL WHEN 1 THEN fim + INTERVAL 1 YEAR WHEN 2 THEN fim + 1 WHEN 3 THEN coalesce(fim, DATE '2000-01-01') ELSE fim END::DATE AS f_fim FROM ledger""",
    "k": """SELECT unnest([
         {'field': 'origin', 'kind': CASE WHEN origem IS NULL AND f_origem IS NULL THEN 'match' WHEN origem IS NULL THEN 'spurious' WHEN f_origem IS NULL THEN 'missed' WHEN origem = f_origem THEN 'match' ELSE 'wrong' END},
         {'field': 'percentage', 'kind': CASE WHEN pct IS NULL AND f_pct IS NULL THEN 'match_null' WHEN pct IS NULL THEN 'spurious' WHEN f_pct IS NULL THEN 'missed' WHEN pct = f_pct THEN 'match' ELSE 'wrong' END},
         {'field': 'validity', 'kind': CASE WHEN fim IS NULL AND f_fim IS NULL THEN 'match_indet' WHEN fim IS NULL THEN 'overprecision' WHEN f_fim IS NULL THEN 'missed' WHEN fim = f_fim THEN 'match'
           WHEN month(fim) = month(f_fim) AND day(fim) = day(f_fim) THEN 'year_error' ELSE 'wrong' END}]) AS x FROM g""",
    "kinds": "SELECT x.field AS field, x.kind AS kind, count(*) AS n FROM k GROUP BY ALL",
}


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as labels, and what a poor extraction would make of it."""
    p, c = F.col("produto"), F.col
    rows = ledger(spark, sf_dir)
    return rows.select(
        F.when(p % 5 > 0, c("origem")).alias("origem"), F.when(p % 7 > 0, c("percentual")).alias("pct"), "fim",
        F.when(p % 4 == 1, c("destino")).when(p % 4 > 1, c("origem")).alias("f_origem"), F.when(p % 3 == 1, c("percentual") + 1).when(p % 3 == 2, c("percentual")).alias("f_pct"),
        F.when(p % 6 == 1, F.add_months("fim", 12)).when(p % 6 == 2, F.date_add("fim", 1)).when(p % 6 == 3, F.coalesce("fim", F.lit("2000-01-01").cast("date"))).when(p % 6 > 3, c("fim")).alias("f_fim"),
    )


@query("q_gold_kinds", using(_GOLD, "SELECT field, kind, n FROM kinds"))
def gold_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(_gold(spark, sf_dir), _GOLD_FIELDS)


@query("q_gold_precision", using(_GOLD, """
WITH s AS (SELECT field, coalesce(sum(n) FILTER (WHERE kind = 'match'), 0)::BIGINT AS correct, coalesce(sum(n) FILTER (WHERE kind IN ('match', 'wrong', 'spurious', 'year_error', 'overprecision')), 0)::BIGINT AS retrieved,
  coalesce(sum(n) FILTER (WHERE kind IN ('match', 'wrong', 'missed', 'year_error')), 0)::BIGINT AS relevant FROM kinds GROUP BY field)
SELECT *, round(correct::DOUBLE / nullif(retrieved, 0), 6) AS precision, round(correct::DOUBLE / nullif(relevant, 0), 6) AS recall FROM s"""))
def gold_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precision_recall(evaluated(_gold(spark, sf_dir), _GOLD_FIELDS), _GOLD_FIELDS)


def edition_verdict(published: DataFrame, campaigns: DataFrame, day: Column) -> DataFrame:
    """published (item, pct, fim) against campaigns (id, percentual, fim, tier): the first data check that an item fails.

    It must name a campaign, which must be alive on the day, with the same percentage and
    the same last day.
    """
    c = campaigns.select(F.col("id").alias("item"), F.col("percentual").alias("c_pct"), F.col("fim").alias("c_fim"), state(day).alias("c_state")).dropDuplicates(["item"])
    rows = published.join(c, "item", "left")
    verdict = (
        F.when(F.col("c_state").isNull(), "missing").when(~F.col("c_state").isin("ativa", "ultimos_dias", "detectada"), "not_live").when(~F.col("pct").eqNullSafe(F.col("c_pct")), "percentage_differs")
        .when(~F.col("fim").eqNullSafe(F.col("c_fim")), "validity_differs").otherwise("ok")
    )
    return rows.select("item", verdict.alias("verdict"))


@query("q_edition_consistency", using({"ledger": LEDGER}, f"""
WITH c AS (SELECT id, any_value(percentual) AS percentual, any_value(fim) AS fim, any_value(tier) AS tier, any_value(produto) AS p FROM ledger GROUP BY id),
x AS (SELECT CASE WHEN p % 11 = 0 THEN 'x' || id ELSE id END AS item, p, {_STATE.format('2000-01-01')} AS st, fim FROM c)
SELECT item, CASE WHEN p % 11 = 0 THEN 'missing' WHEN st NOT IN ('ativa', 'ultimos_dias', 'detectada') THEN 'not_live' WHEN p % 5 = 0 THEN 'percentage_differs' WHEN p % 7 = 0 THEN 'validity_differs' ELSE 'ok' END AS verdict FROM x"""))
def edition_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edition of all offers, some of which are misprinted."""
    rows = written(ledger(spark, sf_dir).select("id", "percentual", "fim", "tier", "produto").dropDuplicates(["id"]))  # the edition and what it is held against
    p = F.col("produto")
    printed = rows.select(F.when(p % 11 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("item"), (F.col("percentual") + F.when(p % 5 == 0, 1).otherwise(0)).alias("pct"), F.when(p % 7 == 0, F.date_add("fim", 1)).otherwise(F.col("fim")).alias("fim"))
    return edition_verdict(printed, rows, F.lit("2000-01-01").cast("date"))
