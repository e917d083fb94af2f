"""Explainable composite score: components, shrinkage, redistribution, overrides, buckets, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.graph import written
from granary.operators.quantiles import placed
from granary.registry import query, using
from granary.sources.tables import LEDGER, half_up, ledger, round_to, table

# The weight vector and the bands.
WEIGHTS = {"percentil": 0.45, "eficiencia": 0.30, "raridade": 0.15, "abrangencia": 0.10}
SHRINK, MIN_SAMPLES = 5, 3
RARITY = ((2, 0.85), (5, 0.65), (20, 0.45), (50, 0.25))
RARITY_COMMON = 0.10
REACH = {"BUILDING": 1.0, "AUTOMOBILE": 0.7, "MACHINERY": 0.5, "HOUSEHOLD": 0.3}
BANDS = ((85, "Vale agir"), (70, "Vale olhar"), (55, "Só para casos específicos"), (40, "Esperaria"))
LOWEST, UNCONFIRMED = "Evitaria", "Não confirmado"


def midrank(rows: DataFrame, keys: list[str], value: str, out: str, n: str) -> DataFrame:
    """Adds the mid-rank (below + half of the ties) / n of value within keys.

    Ranks are those of distinct values, taken by ranges (placed), so a group's rows are
    pre-aggregated and neither they nor its values meet in one task.
    """
    at = placed(rows, keys, value, "below__", "here__", n)
    same = rows[value] == at[value]
    for k in keys:
        same = same & rows[k].eqNullSafe(at[k])
    rank = (F.col("below__") + F.col("here__") * 0.5) / at[n]
    return rows.join(at, same, "left").select(*[rows[c] for c in rows.columns], rank.alias(out), at[n])


@query("q_ecdf_midrank", using({"ledger": LEDGER}, """
WITH c AS (SELECT origem, destino, percentual, count(*) AS c FROM ledger GROUP BY ALL)
SELECT origem, destino, percentual, round((sum(c) OVER (PARTITION BY origem, destino ORDER BY percentual) - c * 0.5) / sum(c) OVER (PARTITION BY origem, destino), 9) AS midrank,
       (sum(c) OVER (PARTITION BY origem, destino))::BIGINT AS n FROM c"""))
def ecdf_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("origem", "destino", "percentual")
    return midrank(rows, ["origem", "destino"], "percentual", "midrank", "n").select("origem", "destino", "percentual", F.round("midrank", 9).alias("midrank"), "n").distinct()


def cost(rows: DataFrame) -> DataFrame:
    """Adds cpm: value a thousand units, whole cents; null for the last programme."""
    return rows.withColumn("cpm", F.when(F.col("tier") < 3, F.floor(F.col("valor") / F.col("quantidade") * 100) / 100))


def inverse_ecdf(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds 1 - mid-rank of value over all rows, by ranges of values: no task sorts the whole table."""
    at = placed(rows, [], value, "below__", "here__", "all__")
    ranked = at.select(value, (1 - (F.col("below__") + F.col("here__") * 0.5) / F.col("all__")).alias(out))
    return rows.join(ranked, value, "left")


COST = {"ledger": LEDGER, "cost": "SELECT *, CASE WHEN tier < 3 THEN floor(valor / quantidade * 100) / 100 END AS cpm FROM ledger"}
EFFICIENCY = {
    **COST,
    "ec": "SELECT cpm, count(*) AS c FROM cost WHERE cpm IS NOT NULL GROUP BY cpm",
    "eff": "SELECT cpm, 1 - (sum(c) OVER (ORDER BY cpm) - c * 0.5::DOUBLE) / sum(c) OVER () AS eficiencia FROM ec",
}


@query("q_efficiency", using(EFFICIENCY, "SELECT id, cpm, round(eficiencia, 9) AS eficiencia FROM cost LEFT JOIN eff USING (cpm)"))
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(cost(ledger(spark, sf_dir)).select("id", "cpm"))  # read for the ranks and for the rows
    return inverse_ecdf(rows, "cpm", "eficiencia").select("id", "cpm", F.round("eficiencia", 9).alias("eficiencia"))


def rarity(n: Column) -> Column:
    out = None
    for most, value in RARITY:
        out = F.when(n <= most, value) if out is None else out.when(n <= most, value)
    return out.otherwise(RARITY_COMMON)


def reach(publico: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in reversed(REACH.items()):
        out = F.when(publico == name, value).otherwise(out)
    return out


def components(rows: DataFrame) -> DataFrame:
    """Adds percentil (and base_n), eficiencia, raridade and abrangencia, and cpm for value and quantity; the history of a row is its route and product kind."""
    keys = ["origem", "destino", "tipo"]
    rows = written(cost(rows).drop("valor", "quantidade"))  # three statistics are taken of the same rows
    # null percentages count in the route, not in the rank
    ranks = placed(rows, keys, "percentual", "below__", "here__", "base_n").select(
        *[F.col(k).alias(f"s_{k}") for k in keys], F.col("percentual").alias("pct"), ((F.col("below__") + F.col("here__") * 0.5) / F.col("base_n")).alias("percentil"), "base_n"
    )
    routes = written(rows.groupBy(*keys).agg(F.count("*").alias("route_n")))
    rows = inverse_ecdf(rows, "cpm", "eficiencia")
    same = F.col("percentual") == F.col("pct")
    for k in keys:
        same = same & (F.col(k) == F.col(f"s_{k}"))
    rows = rows.join(ranks, same, "left").drop("pct", *[f"s_{k}" for k in keys]).join(routes, keys)
    return rows.withColumn("raridade", rarity(F.col("route_n"))).withColumn("abrangencia", reach(F.col("publico")))


_RARITY = "CASE " + " ".join(f"WHEN route_n <= {m} THEN {v}::DOUBLE" for m, v in RARITY) + f" ELSE {RARITY_COMMON}::DOUBLE END"
_REACH = "CASE publico " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in REACH.items()) + " END"
_BAND = "CASE " + " ".join(f"WHEN bruto >= {m} THEN '{n}'" for m, n in BANDS) + f" ELSE '{LOWEST}' END"
COMPONENTS = {
    **EFFICIENCY,
    "pc": "SELECT origem, destino, tipo, percentual, count(*) AS c FROM cost GROUP BY ALL",
    "pr": "SELECT origem, destino, tipo, percentual, (sum(c) OVER (PARTITION BY origem, destino, tipo ORDER BY percentual) - c * 0.5::DOUBLE) / sum(c) OVER (PARTITION BY origem, destino, tipo) AS percentil, (sum(c) OVER (PARTITION BY origem, destino, tipo))::BIGINT AS base_n FROM pc",
    "comp": f"SELECT cost.*, percentil, base_n, eficiencia, {_RARITY} AS raridade, {_REACH} AS abrangencia FROM (SELECT *, count(*) OVER (PARTITION BY origem, destino, tipo) AS route_n FROM cost) cost LEFT JOIN pr USING (origem, destino, tipo, percentual) LEFT JOIN eff USING (cpm)",
    "sc1": f"""SELECT *, (percentil * base_n + 0.5 * {SHRINK}) / (base_n + {SHRINK}) AS p_used, CASE WHEN eficiencia IS NULL THEN 0 ELSE {WEIGHTS['eficiencia']} END AS we, CASE WHEN abrangencia IS NULL THEN 0 ELSE {WEIGHTS['abrangencia']} END AS wa FROM comp""",
    "sc2": f"""SELECT *, floor((({WEIGHTS['percentil']}::DOUBLE * p_used + we::DOUBLE * coalesce(eficiencia, 0) + {WEIGHTS['raridade']}::DOUBLE * raridade + wa::DOUBLE * coalesce(abrangencia, 0))
       / ({WEIGHTS['percentil']}::DOUBLE + we::DOUBLE + {WEIGHTS['raridade']}::DOUBLE + wa::DOUBLE)) * 100 + 0.5 + 1e-9)::BIGINT AS bruto FROM sc1""",
    "score": f"""SELECT *, {_BAND} AS veredito_bruto, base_n < {MIN_SAMPLES} AS base_curta, CASE WHEN fonte = 'O' AND eficiencia IS NULL THEN 'conta_nao_calculavel' WHEN tier <> 1 THEN 'sem_tier1' END AS override FROM sc2""",
}


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's columns that a score reads; the rest is not written."""
    return ledger(spark, sf_dir).select("id", "origem", "destino", "tipo", "percentual", "fonte", "tier", "publico", "valor", "quantidade")


@query("q_score_components", using(COMPONENTS, "SELECT id, round(percentil, 9) AS percentil, base_n, round(eficiencia, 9) AS eficiencia, raridade, abrangencia FROM comp"))
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_offered(spark, sf_dir)).select("id", F.round("percentil", 9).alias("percentil"), "base_n", F.round("eficiencia", 9).alias("eficiencia"), "raridade", "abrangencia")


def shrunk(p: Column, n: Column) -> Column:
    return (p * n + F.lit(0.5) * SHRINK) / (n + SHRINK)


def weighted(values: dict[str, Column]) -> Column:
    """Weighted mean over the components that are present: a missing one gives its weight to the others."""
    parts = F.array(*[F.struct(F.lit(WEIGHTS[k]).alias("w"), v.cast("double").alias("v")) for k, v in values.items()])
    there = F.filter(parts, lambda x: x["v"].isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x["w"])
    return F.when(total > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x["w"] * x["v"]) / total).otherwise(0.0)


def band(score: Column) -> Column:
    out = None
    for low, name in BANDS:
        out = F.when(score >= low, name) if out is None else out.when(score >= low, name)
    return out.otherwise(LOWEST)


def scored(rows: DataFrame) -> DataFrame:
    """Adds bruto, veredito_bruto, override, veredito and base_curta; of two overrides the missing value comes first."""
    values = {k: F.col(k) for k in WEIGHTS} | {"percentil": shrunk(F.col("percentil"), F.col("base_n"))}
    # a tiny nudge keeps exact halves on one side whatever the order of summation
    rows = rows.withColumn("bruto", F.floor(weighted(values) * 100 + F.lit(0.5) + F.lit(1e-9)).cast("bigint"))
    no_value = (F.col("fonte") == "O") & F.col("eficiencia").isNull()
    rows = rows.withColumn("veredito_bruto", band(F.col("bruto"))).withColumn("override", F.when(no_value, "conta_nao_calculavel").when(F.col("tier") != 1, "sem_tier1"))
    return rows.withColumn("veredito", F.when(F.col("override").isNull(), F.col("veredito_bruto")).otherwise(UNCONFIRMED)).withColumn("base_curta", F.col("base_n") < MIN_SAMPLES)


@query("q_score", using(COMPONENTS, f"SELECT id, bruto, veredito_bruto, override, CASE WHEN override IS NULL THEN veredito_bruto ELSE '{UNCONFIRMED}' END AS veredito, base_curta FROM score"))
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the staging ledger every row has a percentile, so open orders without a cost stand for rows without a value."""
    return scored(components(_offered(spark, sf_dir))).select("id", "bruto", "veredito_bruto", "override", "veredito", "base_curta")


@query("q_distribution", using(COMPONENTS, "SELECT 'veredito' AS kind, veredito_bruto AS value, count(*) AS n FROM score GROUP BY 2 UNION ALL SELECT 'override', coalesce(override, 'nenhum'), count(*) FROM score GROUP BY 2"))
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    s = scored(components(_offered(spark, sf_dir)))
    return s.select(F.explode(F.array(pair("veredito", F.col("veredito_bruto")), pair("override", F.coalesce("override", F.lit("nenhum"))))).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


BUCKETS = {**COMPONENTS, "bk": "SELECT *, coalesce(override = 'conta_nao_calculavel', false) AS beco, bruto >= 70 AS alto, tier = 1 AS t1, origem IN ('NATION_1', 'NATION_2', 'NATION_3') OR destino IN ('NATION_1', 'NATION_2', 'NATION_3') AS alcance FROM score"}


def _bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(components(_offered(spark, sf_dir)))
    dead, high, t1 = F.coalesce(F.col("override") == "conta_nao_calculavel", F.lit(False)), F.col("bruto") >= 70, F.col("tier") == 1
    crawl = F.col("origem").isin("NATION_1", "NATION_2", "NATION_3") | F.col("destino").isin("NATION_1", "NATION_2", "NATION_3")
    return s.withColumn("b1", ~dead & high & ~t1).withColumn("b2", dead).withColumn("b3", ~dead & ~high & ~t1).withColumn("b4", ~dead & high & crawl).withColumn("ready", ~dead & high & t1)


@query("q_score_buckets", using(BUCKETS, """
SELECT origem AS programa, count(*) AS n, count(*) FILTER (WHERE NOT beco AND alto AND NOT t1) AS b1, count(*) FILTER (WHERE beco) AS b2, count(*) FILTER (WHERE NOT beco AND NOT alto AND NOT t1) AS b3,
       count(*) FILTER (WHERE NOT beco AND alto AND alcance) AS b4, count(*) FILTER (WHERE NOT beco AND alto AND t1) AS publishable FROM bk GROUP BY origem"""))
def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bucketed(spark, sf_dir)
    return b.groupBy(F.col("origem").alias("programa")).agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in ("b1", "b2", "b3", "b4")], F.count_if("ready").alias("publishable"))


@query("q_anomalies", using(BUCKETS, """
WITH ax AS (SELECT 'origem' AS eixo, origem AS programa, * FROM bk UNION ALL SELECT 'destino', destino, * FROM bk),
g AS (SELECT eixo, programa, count(*) AS n, count(*) FILTER (WHERE beco) AS beco, count(*) FILTER (WHERE NOT beco) AS computavel, count(DISTINCT bruto) FILTER (WHERE NOT beco) AS distintos,
             count(*) FILTER (WHERE NOT beco AND bruto >= 85) AS altos, count(*) FILTER (WHERE origem = destino AND tipo = '1-URGENT') AS self_loops FROM ax GROUP BY ALL)
SELECT eixo, programa, n, beco, computavel, distintos, self_loops, n >= 5 AND (beco >= 0.9 * n OR (computavel >= 5 AND (distintos <= 1 OR altos >= 0.9 * computavel))) AS anomalous FROM g"""))
def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both axes in one pass: each row is exploded to its origin and its target."""
    axis = lambda k: F.struct(F.lit(k).alias("eixo"), F.col(k).alias("programa"))
    b = _bucketed(spark, sf_dir).select(F.explode(F.array(axis("origem"), axis("destino"))).alias("x"), "b2", "bruto", (F.col("origem") == F.col("destino")).alias("loop"), "tipo")
    live = ~F.col("b2")
    g = b.groupBy("x.eixo", "x.programa").agg(
        F.count("*").alias("n"), F.count_if("b2").alias("beco"), F.count_if(live).alias("computavel"), F.count_distinct(F.when(live, F.col("bruto"))).alias("distintos"),
        F.count_if(live & (F.col("bruto") >= 85)).alias("altos"), F.count_if(F.col("loop") & (F.col("tipo") == "1-URGENT")).alias("self_loops"),
    )
    odd = (F.col("n") >= 5) & ((F.col("beco") >= 0.9 * F.col("n")) | ((F.col("computavel") >= 5) & ((F.col("distintos") <= 1) | (F.col("altos") >= 0.9 * F.col("computavel")))))
    return g.select("eixo", "programa", "n", "beco", "computavel", "distintos", "self_loops", odd.alias("anomalous"))


_SINGLE = {
    "ledger": LEDGER,
    "l": """SELECT *, count(percentual) OVER (PARTITION BY tipo, produto) AS n, rank() OVER (PARTITION BY tipo, produto ORDER BY percentual) - 1 AS below, count(*) OVER (PARTITION BY tipo, produto, percentual) AS ties,
       count(*) OVER (PARTITION BY tipo, produto) AS freq, CASE WHEN tier < 3 THEN floor(valor / quantidade * 100) / 100 END AS cpm FROM ledger""",
    "c": "SELECT cpm, count(*) AS c FROM l WHERE cpm IS NOT NULL GROUP BY cpm",
    "e": "SELECT cpm, 1 - (sum(c) OVER (ORDER BY cpm) - c * 0.5::DOUBLE) / sum(c) OVER () AS eff FROM c",
}
_R4 = "floor({} * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE"


@query("q_score_single_side", using(_SINGLE, f"""
SELECT id, CASE WHEN percentual IS NULL THEN NULL WHEN n >= 3 THEN {_R4.format("((below + 0.5::DOUBLE * ties) / n)")} ELSE 0.5 END AS percentil, CASE WHEN percentual IS NULL THEN NULL WHEN n >= 3 THEN n ELSE 0 END AS base_n,
       CASE WHEN percentual IS NULL THEN NULL WHEN n >= 3 THEN 'merchant' ELSE 'neutro' END AS population, {_R4.format("eff")} AS eficiencia,
       (CASE {" ".join(f"WHEN freq <= {n} THEN {v}" for n, v in RARITY)} ELSE {RARITY_COMMON} END)::DOUBLE AS raridade, (CASE publico {" ".join(f"WHEN '{k}' THEN {v}" for k, v in REACH.items())} END)::DOUBLE AS abrangencia,
       percentual IS NULL AND cpm IS NULL AS no_value
FROM l LEFT JOIN e USING (cpm)"""))
def score_single_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four components of an offer with one side only.

    Percentile among offers of its kind and merchant (three at least, else neutral: 0.5
    on a base of 0, never borrowed from other merchants); efficiency against all costs;
    rarity by how often the merchant makes such offers; reach by audience.  What cannot
    be computed is null, and an offer without percentage and cost has no value to score.
    """
    rows = written(cost(ledger(spark, sf_dir)).select("id", "tipo", "produto", "percentual", "cpm", "publico"))
    often = written(rows.groupBy(F.col("tipo").alias("k"), F.col("produto").alias("m")).agg(F.count("*").alias("freq")))
    at = placed(rows, ["tipo", "produto"], "percentual", "below__", "here__", "n")
    # what is told of a merchant meets its percentages first, so that the offers are shuffled once
    known = often.join(at, F.col("k").eqNullSafe(F.col("tipo")) & F.col("m").eqNullSafe(F.col("produto"))).select("k", "m", F.col("percentual").alias("v"), "freq", ((F.col("below__") + F.col("here__") * 0.5) / F.col("n")).alias("p"), "n")
    without = often.select("k", "m", F.lit(None).cast(rows.schema["percentual"].dataType).alias("v"), "freq", F.lit(None).cast("double").alias("p"), F.lit(None).cast("bigint").alias("n"))
    same = F.col("tipo").eqNullSafe(F.col("k")) & F.col("produto").eqNullSafe(F.col("m")) & F.col("percentual").eqNullSafe(F.col("v"))
    ranks = placed(rows, [], "cpm", "below__", "here__", "all__").select("cpm", (1 - (F.col("below__") + F.col("here__") * 0.5) / F.col("all__")).alias("eff"))
    r = rows.join(known.union(without), same, "left").join(ranks, "cpm", "left")
    has, enough = F.col("percentual").isNotNull(), F.col("n") >= 3
    rarity = F.lit(RARITY_COMMON)
    for most, value in reversed(RARITY):
        rarity = F.when(F.col("freq") <= most, value).otherwise(rarity)
    reach = F.lit(None).cast("double")
    for audience, value in REACH.items():
        reach = F.when(F.col("publico") == audience, value).otherwise(reach)
    return r.select(
        "id", F.when(has, F.when(enough, round_to(F.col("p"), 4)).otherwise(0.5)).alias("percentil"), F.when(has, F.when(enough, F.col("n")).otherwise(0)).cast("bigint").alias("base_n"), F.when(has, F.when(enough, "merchant").otherwise("neutro")).alias("population"),
        round_to(F.col("eff"), 4).alias("eficiencia"), rarity.alias("raridade"), reach.alias("abrangencia"), (~has & F.col("cpm").isNull()).alias("no_value"),
    )


# Weights of the eight criteria of the older score, in hundredths, and the score from which no person need look.
CRITERIA = {"valor": 25, "regra": 15, "vigencia": 15, "friccao": 10, "aplicabilidade": 10, "liquidez": 10, "estoque": 10, "fontes": 5}
AUTOMATIC = 0.85


def reconciled(marks: dict[str, Column], declared: Column, verdict: Column) -> Column:
    """(score, sums, fits): the weighted sum of the marks (0 to 100; a missing one is 0), whether the declared score is that, and whether the verdict is the declared score's band."""
    total = F.lit(0.0)
    for name, weight in CRITERIA.items():
        total = total + F.coalesce(marks[name].cast("double"), F.lit(0.0)) * weight
    score = half_up(total / 100)
    return F.struct(score.alias("score"), (score == declared).alias("sums"), (band(declared) == verdict).alias("fits"))


def automation_score(anchors: Column, record: Column) -> Column:
    """Up to 0.15 for anchors in data and up to 0.7 for the share of resolved patterns of the kind; what is missing counts nothing."""
    a = F.least(F.lit(0.5), F.greatest(F.coalesce(anchors, F.lit(0)), F.lit(0)) * 0.1) * 0.3
    return round_to(a + F.least(F.lit(1.0), F.greatest(F.coalesce(record, F.lit(0.0)), F.lit(0.0))) * 0.7, 6)


_MARKS = {k: f"(p_size * {i + 1} + p_partkey) % 101" for i, k in enumerate(CRITERIA)}
_TOTAL = "floor((" + " + ".join(f"{w} * ({_MARKS[k]})" for k, w in CRITERIA.items()) + ") / 100.0::DOUBLE + 0.5)::BIGINT"


@query("q_weighted_check", f"""
WITH s AS (SELECT p_partkey, {_TOTAL} AS score FROM part), d AS (SELECT *, score + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS bruto FROM s)
SELECT p_partkey, score, p_partkey % 4 > 0 AS sums, {_BAND} = CASE WHEN p_partkey % 9 = 0 THEN '{LOWEST}' ELSE {_BAND} END AS fits FROM d""")
def weighted_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks made of a part's numbers; one declared score in four is off by one, one verdict in nine is the lowest."""
    marks = {k: (F.col("p_size") * (i + 1) + F.col("p_partkey")) % 101 for i, k in enumerate(CRITERIA)}
    score = reconciled(marks, F.lit(0), F.lit(""))["score"]
    declared = score + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)
    verdict = F.when(F.col("p_partkey") % 9 == 0, LOWEST).otherwise(band(declared))
    return table(spark, sf_dir, "part").select("p_partkey", reconciled(marks, declared, verdict).alias("r")).select("p_partkey", "r.*")


_AUTO = "floor((least(0.5::DOUBLE, anchors * 0.1::DOUBLE) * 0.3::DOUBLE + record * 0.7::DOUBLE) * 1e6 + 0.5) / 1e6"


@query("q_automation_score", using({"ledger": LEDGER}, f"""
WITH a AS (SELECT produto, count(DISTINCT fim) AS anchors, count(*) FILTER (WHERE tier = 1)::DOUBLE / count(*) AS record FROM ledger GROUP BY produto)
SELECT produto, {_AUTO} AS score, {_AUTO} < {AUTOMATIC} AS needs_review FROM a"""))
def automation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product's known last days are its anchors, its confirmed offers its record."""
    a = ledger(spark, sf_dir).groupBy("produto").agg(F.count_distinct("fim").alias("anchors"), (F.count_if(F.col("tier") == 1) / F.count("*")).alias("record"))
    s = automation_score(F.col("anchors"), F.col("record"))
    return a.select("produto", s.alias("score"), (s < AUTOMATIC).alias("needs_review"))
