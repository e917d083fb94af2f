"""Who an offer is between: programme aliases, kinds of offer, audiences, and the canonical identity of a campaign.

Aliases, noise and generic names are tables that the caller gives; names are resolved
once each, by equality joins on their word runs, whatever their number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions.offers import unaccented
from granary.plans.gates import state
from granary.registry import query, using
from granary.sources.tables import AS_OF, LEDGER, as_of, ledger, table

# Kinds of offer under the names that sources give them; what is unknown goes to review.
KINDS = {
    "transferencia": "transferencia_bonificada", "transferencia_bonificada": "transferencia_bonificada", "compra": "compra_pontos", "compra_pontos": "compra_pontos", "clube": "clube",
    "cartao": "bonus_acumulo", "bonus_acumulo": "bonus_acumulo", "status match": "status_match", "statusmatch": "status_match", "status_match": "status_match", "shopping": "shopping",
    "pontos_mais_dinheiro": "pontos_mais_dinheiro", "promocao_emissao": "promocao_emissao", "hotelaria": "outro", "estrutural": "outro", "assinatura": "outro", "sorteio": "outro",
    "resgate": "outro", "promocao": "outro", "cashback": "outro", "cadastro": "outro", "abertura": "outro", "desconto": "outro", "leilao": "outro", "upgrade": "outro", "concurso": "outro", "outro": "outro",
}
TRANSFER, NO_TARGET, MANY_CARDS = "transferencia_bonificada", "sem_destino", "multiplos_cartoes"
AUDIENCES = (("clube", r"\bclube\b"), ("cartao", r"\bcartao\b|\bcartoes\b|\bcard\b"), ("selecionados", r"\bselecionad|\bconvidad|\bsegmentad"))
# Words that tell the kind of a company that no alias names.
COMPANY_WORDS = (
    ("aereo", r"\b(air|airways|airline|airlines|aerol|aviacao|jet|wings|lineas|voo|flug|aereo)\b|airlines?$"),
    ("hotel", r"\b(hotel|hoteis|resort|thermas|termas|pousada|inn|palace|spa|lodge|beach|bonvoy|iberostar|melia|bourbon|nannai|palladium|wyndham|hyatt|marriott|hilton)\b"),
    ("combustivel", r"\b(gas|combust|posto|petro|gnv)\b"),
    ("streaming", r"\b(play|stream|music|deezer|spotify|hbo|globoplay|crunchyroll|netflix|paramount|max)\b"),
    ("varejo", r"\b(shop|store|loja|magaz|market|outlet|store)\b"),
)


def normal(name: Column) -> Column:
    """Lower case without accents; anything but letters, digits and & is one space."""
    return F.trim(F.regexp_replace(unaccented(name), "[^a-z0-9&]+", " "))


def kind_of(raw: Column) -> Column:
    """The canonical kind of an offer, null if unknown; the names in the table are compared as they read when normalised."""
    names = {k.replace("_", " "): v for k, v in KINDS.items()}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(m, normal(raw))


def audience_of(*texts: Column) -> Column:
    """Whom an offer is for, by the words of its notes."""
    words, out = normal(F.concat_ws(" ", *texts)), F.lit("geral")
    for name, pattern in reversed(AUDIENCES):
        out = F.when(words.rlike(pattern), name).otherwise(out)
    return out


def sides(names: DataFrame, aliases: DataFrame, noise: DataFrame, generic: DataFrame, buckets: dict[str, str] | None = None) -> DataFrame:
    """names (raw) -> (raw, name, side, code, kind), one row a distinct raw name.

    side: empty, generic, noise, programme, or bucket (a company that no alias names,
    coded by its kind).  aliases: (alias, code, kind); noise, generic: (name).  An alias
    of three letters or more counts within a name: the earliest, then the longest; one
    that is the whole name comes first.
    """
    buckets = buckets or {}
    distinct = names.select("raw").distinct().withColumn("name", F.coalesce(normal(F.col("raw")), F.lit("")))
    known = aliases.select(normal(F.col("alias")).alias("alias"), "code", F.coalesce("kind", F.lit("outro")).alias("kind")).filter("alias <> ''").dropDuplicates(["alias"])
    # a name meets an alias at the alias's first word, so an alias of many words costs no more than others
    known = known.withColumn("words", F.split("alias", " ")).withColumn("word", F.get("words", F.lit(0)))
    at = distinct.filter("name <> ''").select("name").distinct().select("name", F.split("name", " ").alias("w")).select("name", "w", F.posexplode("w").alias("pos", "word"))
    hits = at.join(known, "word").filter(F.slice("w", F.col("pos") + 1, F.size("words")) == F.col("words")).filter((F.length("alias") >= 3) | (F.col("alias") == F.col("name")))
    best = hits.groupBy("name").agg(F.min_by(F.struct("code", "kind"), F.struct(F.col("alias") != F.col("name"), "pos", -F.length("alias"))).alias("hit"))
    listed = lambda df, flag: df.select(normal(F.col("name")).alias("name")).distinct().withColumn(flag, F.lit(True))
    rows = distinct.join(best, "name", "left").join(listed(generic, "g"), "name", "left").join(listed(noise, "x"), "name", "left")
    company = F.lit("outro")
    for kind, pattern in reversed(COMPANY_WORDS):
        company = F.when(F.col("name").rlike(pattern), kind).otherwise(company)
    default = buckets.get("default", "outro")
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in buckets.items() for v in kv]), company), F.lit(default)) if buckets else F.lit(default)
    side = F.when(F.col("name") == "", "empty").when(F.col("g"), "generic").when(F.col("x"), "noise").when(F.col("hit").isNotNull(), "programme").otherwise("bucket")
    return rows.withColumn("side", side).select(
        "raw", "name", "side", F.when(F.col("side") == "programme", F.col("hit.code")).when(F.col("side") == "bucket", code).alias("code"), F.when(F.col("side") == "programme", F.col("hit.kind")).when(F.col("side") == "bucket", company).alias("kind")
    )


def identities(campaigns: DataFrame, aliases: DataFrame, noise: DataFrame, generic: DataFrame, buckets: dict[str, str] | None = None, day: Column | None = None) -> DataFrame:
    """campaigns (id, origem, destino, tipo, notes, fim, tier) with kind, codes, audience, state, identity_key, review and flags.

    review names why a row has no identity: unknown kind, a generic or unresolved origin,
    a transfer without target or of a programme to itself.  A transfer from any card to a
    real target has many cards as its origin; kinds other than transfers may be single-sided.
    """
    names = campaigns.select(F.col("origem").alias("raw")).union(campaigns.select(F.col("destino").alias("raw")))
    found = sides(names, aliases, noise, generic, buckets)
    of = lambda prefix, col: found.select(F.col("raw").alias(f"{prefix}_raw"), F.col("side").alias(f"{prefix}_side"), F.col("code").alias(f"{prefix}_code"), F.col("kind").alias(f"{prefix}_kind"))
    rows = campaigns.join(of("o", "origem"), F.col("origem").eqNullSafe(F.col("o_raw")), "left").join(of("d", "destino"), F.col("destino").eqNullSafe(F.col("d_raw")), "left")
    kind = kind_of(F.col("tipo"))
    real = F.col("d_side").isin("programme", "bucket")
    cards = (F.col("o_side") == "generic") & (kind == TRANSFER) & real
    target = F.when(real, F.col("d_code")).when(kind != TRANSFER, F.lit(NO_TARGET))
    review = (
        F.when(kind.isNull(), "tipo_indefinido")
        .when((F.col("o_side") == "generic") & ~cards, "origem_generica_recuperavel")
        .when(F.col("o_side").isin("noise", "empty"), "origem_nao_resolvida")
        .when(target.isNull(), "transferencia_sem_destino")
        .when((kind == TRANSFER) & (F.col("o_code") == target), "transferencia_self_loop")
    )
    audience = F.when(cards, "cartao").otherwise(audience_of(F.col("notes"), F.col("tipo")))
    rows = rows.withColumn("kind", kind).withColumn("review", review).withColumn("audience", audience).withColumn("origin_code", F.when(cards, MANY_CARDS).otherwise(F.col("o_code"))).withColumn("target_code", target)
    key = F.when(F.col("review").isNull(), F.concat_ws("|", "kind", "origin_code", "target_code", "audience"))
    return rows.select(
        *campaigns.columns, "kind", "origin_code", "target_code", "audience", state(as_of() if day is None else day).alias("state"), key.alias("identity_key"), "review",
        (~real & F.col("review").isNull()).alias("single_side"), ((F.col("o_side") == "bucket") | (F.col("d_side") == "bucket")).alias("bucketed"), cards.alias("many_cards"),
    )


# Tables for the queries: the nations as programmes, but for a noise, a generic and some unknown names.
_PROGRAMMES = "n_nationkey < 20"


def given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation")
    aliases = n.filter(_PROGRAMMES).select(F.explode(F.array("n_name", F.concat(F.lit("banco "), "n_name"), F.concat(F.lit("clube do "), "n_name"))).alias("alias"), F.concat(F.lit("p"), "n_nationkey").alias("code"), F.lit("bancario").alias("kind"))
    return aliases, n.filter("n_nationkey = 20").select(F.col("n_name").alias("name")), n.filter("n_nationkey = 21").select(F.col("n_name").alias("name"))


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct routes, kinds and audiences of the ledger as raw campaigns."""
    r = ledger(spark, sf_dir).groupBy("origem", "destino", "tipo", "publico").agg(F.max("fim").alias("fim"), F.min("tier").alias("tier"))
    head = F.left(F.col("tipo"), F.lit(1))
    tipo = F.when(head.isin("1", "2"), "Transferência").when(head == "3", "compra").when(head == "4", "Status Match").otherwise("xyz")
    notes = F.when(F.col("publico") == "BUILDING", "só para o Clube!").when(F.col("publico") == "MACHINERY", "cartões selecionados").otherwise("")
    key = F.concat_ws("/", "origem", "destino", F.col("tipo"), F.col("publico"))
    return r.select(key.alias("id"), F.concat(F.lit("Banco "), F.col("origem"), F.lit(" (visa)")).alias("origem"), "destino", tipo.alias("tipo"), notes.alias("notes"), "fim", "tier")


_IDENTITY = f"""
WITH r AS (SELECT origem, destino, tipo, publico, max(fim) AS fim, min(tier) AS tier FROM ledger GROUP BY ALL),
n AS (SELECT n_name, n_nationkey AS k FROM nation),
s AS (
  SELECT r.*, o.k AS ok, d.k AS dk, CASE left(tipo, 1) WHEN '1' THEN 'transferencia_bonificada' WHEN '2' THEN 'transferencia_bonificada' WHEN '3' THEN 'compra_pontos' WHEN '4' THEN 'status_match' END AS kind,
         CASE publico WHEN 'BUILDING' THEN 'clube' WHEN 'MACHINERY' THEN 'cartao' ELSE 'geral' END AS audience
  FROM r JOIN n o ON o.n_name = origem JOIN n d ON d.n_name = destino),
t AS (
  SELECT *, CASE WHEN ok < 20 THEN 'p' || ok ELSE 'outro' END AS origin_code, dk < 20 OR dk > 21 AS real_target, CASE WHEN dk < 20 THEN 'p' || dk WHEN dk > 21 THEN 'outro' WHEN kind <> 'transferencia_bonificada' THEN '{NO_TARGET}' END AS target_code FROM s),
u AS (
  SELECT *, CASE WHEN kind IS NULL THEN 'tipo_indefinido' WHEN target_code IS NULL THEN 'transferencia_sem_destino' WHEN kind = 'transferencia_bonificada' AND origin_code = target_code THEN 'transferencia_self_loop' END AS review FROM t)
SELECT concat_ws('/', origem, destino, tipo, publico) AS id, kind, origin_code, target_code, audience, review, CASE WHEN review IS NULL THEN concat_ws('|', kind, origin_code, target_code, audience) END AS identity_key,
       review IS NULL AND NOT real_target AS single_side, ok >= 20 OR dk > 21 AS bucketed,
       CASE WHEN tier = 3 OR fim IS NULL THEN 'indeterminada' WHEN fim < DATE '{AS_OF}' - 30 THEN 'historica' WHEN fim < DATE '{AS_OF}' THEN 'encerrada' WHEN fim <= DATE '{AS_OF}' + 3 THEN 'ultimos_dias' WHEN tier = 1 THEN 'ativa' ELSE 'detectada' END AS state FROM u"""


@query("q_identity", using({"ledger": LEDGER}, _IDENTITY))
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes between nations, 20 of which have aliases, one is noise, one generic and the rest unknown companies."""
    found = identities(campaigns(spark, sf_dir), *given(spark, sf_dir))
    return found.select("id", "kind", "origin_code", "target_code", "audience", "review", "identity_key", "single_side", "bucketed", "state")


@query("q_alias_resolve", """
SELECT DISTINCT raw, CASE WHEN k < 20 THEN 'p' || k WHEN k > 21 OR style < 2 THEN 'outro' END AS code, CASE WHEN k < 20 THEN 'programme' WHEN k > 21 OR style < 2 THEN 'bucket' WHEN k = 20 THEN 'noise' ELSE 'generic' END AS side
FROM (SELECT n_nationkey AS k, c_custkey % 3 AS style, CASE c_custkey % 3 WHEN 0 THEN 'Clube do ' || n_name || ' e banco NATION_1' WHEN 1 THEN 'o  ' || n_name || '!' ELSE n_name END AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey)
WHERE NOT (k > 19 AND style = 0)""")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest, then longest alias in a name: written in three ways, the first naming a second programme later on."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    style = F.col("c_custkey") % 3
    raw = F.when(style == 0, F.concat(F.lit("Clube do "), "n_name", F.lit(" e banco NATION_1"))).when(style == 1, F.concat(F.lit("o  "), "n_name", F.lit("!"))).otherwise(F.col("n_name"))
    names = c.filter((F.col("n_nationkey") < 20) | (style > 0)).select(raw.alias("raw"))
    return sides(names, *given(spark, sf_dir)).select("raw", "code", "side")


@query("q_resolver_coverage", """
WITH t AS (SELECT n_nationkey AS k, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
c AS (SELECT CASE WHEN k < 20 THEN 'programme' WHEN k = 20 THEN 'noise' WHEN k = 21 THEN 'generic' ELSE 'bucket' END AS side, n FROM t)
SELECT side, count(*) AS names, sum(n)::BIGINT AS rows, sum(n) / sum(sum(n)) OVER ()::DOUBLE AS share FROM c GROUP BY side""")
def resolver_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resolver's classes over names, weighed by how often each occurs."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("raw"))
    used = table(spark, sf_dir, "customer").join(n, "c_nationkey").groupBy("raw").agg(F.count("*").alias("n"))
    found = sides(used, *given(spark, sf_dir)).join(used, "raw")
    by_side = found.groupBy("side").agg(F.count("*").alias("names"), F.sum("n").alias("rows"))
    return by_side.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))
