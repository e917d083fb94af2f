"""Projections, filters, facets, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.ordering import numbered
from granary.registry import query, using
from granary.sources.tables import AS_OF, CALLS, LEDGER, as_of, calls, ledger, table


@query("q_filter_predicates", using({"ledger": LEDGER}, "SELECT id, origem, percentual FROM ledger WHERE tipo IN ('1-URGENT', '2-HIGH') AND percentual > 3 AND origem <> destino AND (inicio IS NULL OR fim IS NOT NULL)"))
def filter_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return ledger(spark, sf_dir).filter(c("tipo").isin("1-URGENT", "2-HIGH") & (c("percentual") > 3) & (c("origem") != c("destino")) & (c("inicio").isNull() | c("fim").isNotNull())).select("id", "origem", "percentual")


@query("q_review_queue", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%RING%' AND list_contains(['ECONOMY', 'SMALL', 'PROMO'], p_type)")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%RING%") & F.col("p_type").isin("ECONOMY", "SMALL", "PROMO")).select("p_partkey", "p_name", "p_brand")


def facets_match(given: dict[str, object]) -> Column:
    """A conjunction of the facets that are given; None is no condition."""
    ok = F.lit(True)
    for name, value in given.items():
        if value is None:
            continue
        if name == "search":
            ok = ok & (F.contains(F.lower(F.concat_ws(" ", "origem", "destino", "tipo")), F.lit(str(value).lower())))
        elif name.startswith("min_"):
            ok = ok & (F.col(name[4:]) >= value)
        elif name.startswith("max_"):
            ok = ok & (F.col(name[4:]) <= value)
        else:
            ok = ok & F.col(name).isin(*value if isinstance(value, (list, tuple)) else (value,))
    return ok


@query("q_radar_filters", using({"ledger": LEDGER}, "SELECT id FROM ledger WHERE tier IN (1, 2) AND percentual >= 2 AND percentual <= 8 AND contains(lower(concat_ws(' ', origem, destino, tipo)), 'nation_1') AND publico = 'BUILDING'"))
def radar_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"tier": [1, 2], "fonte": None, "min_percentual": 2, "max_percentual": 8, "search": "NATION_1", "publico": "BUILDING", "destino": None}
    return ledger(spark, sf_dir).filter(facets_match(given)).select("id")


@query("q_facets", using({"ledger": LEDGER}, "SELECT DISTINCT facet, value FROM (SELECT unnest(['tipo', 'publico', 'fonte', 'tier']) AS facet, unnest([tipo, publico, fonte, tier::VARCHAR]) AS value FROM ledger)"))
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("tipo", "publico", "fonte", "tier")])
    return ledger(spark, sf_dir).select(F.explode(pairs).alias("f")).select("f.facet", "f.value").distinct()


LIVE = "fim IS NOT NULL AND fim >= DATE '2000-01-01'"


@query("q_three_gates", using({"ledger": LEDGER}, f"SELECT id, coalesce({LIVE}, false) AS live, tier = 1 AS tier1, percentual > 0 AS computable, coalesce({LIVE}, false) AND tier = 1 AND percentual > 0 AS eligible FROM ledger"))
def three_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, t1, ok = F.coalesce(F.expr(LIVE), F.lit(False)), F.col("tier") == 1, F.col("percentual") > 0
    return ledger(spark, sf_dir).select("id", live.alias("live"), t1.alias("tier1"), ok.alias("computable"), (live & t1 & ok).alias("eligible"))


@query("q_closed_window", using({"ledger": LEDGER}, f"SELECT id, fim, CASE WHEN fim < DATE '{AS_OF}' THEN 'closed' ELSE 'closing' END AS state FROM ledger WHERE fim BETWEEN DATE '{AS_OF}' - 37 AND DATE '{AS_OF}' + 3"))
def closed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).filter(F.col("fim").between(F.date_sub(as_of(), 37), F.date_add(as_of(), 3)))
    return rows.select("id", "fim", F.when(F.col("fim") < as_of(), "closed").otherwise("closing").alias("state"))


@query("q_live_offers", "SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type IN ('purchase', 'signup') AS conversion FROM events WHERE (props->>'$.k')::BIGINT >= 50 AND list_contains(['view', 'purchase', 'signup'], event_type)")
def live_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").filter((k >= 50) & F.array_contains(F.array(*map(F.lit, ("view", "purchase", "signup"))), F.col("event_type"))).select("event_id", k.alias("k"), F.col("event_type").isin("purchase", "signup").alias("conversion"))


@query("q_min_rows_guard", using({"ledger": LEDGER}, "SELECT origem, destino, id FROM ledger WHERE percentual = 10 AND tier = 1 QUALIFY count(*) OVER (PARTITION BY origem, destino) >= 5"))
def min_rows_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block appears only with five rows or more: a semi-join on pre-aggregated counts keeps large blocks out of one window task."""
    rows = ledger(spark, sf_dir).filter("percentual = 10 AND tier = 1").select("origem", "destino", "id")
    return rows.join(rows.groupBy("origem", "destino").count().filter("count >= 5"), ["origem", "destino"], "left_semi")


@query("q_case_labels", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'coleta' WHEN o_orderpriority LIKE '3%' THEN 'analise' ELSE 'outro' END AS grupo, coalesce(nullif(o_orderstatus, 'P'), 'pendente') || ' / ' || (o_orderkey % 10)::VARCHAR AS label FROM orders")
def case_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    group = F.when(p.like("1%") | p.like("2%"), "coleta").when(p.like("3%"), "analise").otherwise("outro")
    label = F.concat(F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("pendente")), F.lit(" / "), (F.col("o_orderkey") % 10).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", group.alias("grupo"), label.alias("label"))


@query("q_pin_mute_order", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal < 0 DESC, s_nationkey = 7, s_acctbal DESC, s_suppkey) AS position FROM supplier")
def pin_mute_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place: pinned first, muted last, then by value."""
    order = [(F.col("s_acctbal") < 0).desc(), (F.col("s_nationkey") == 7).asc(), F.desc("s_acctbal"), F.asc("s_suppkey")]
    return numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), order, "position").select("s_suppkey", "position")


@query("q_topk_nulls_last", using({"ledger": LEDGER}, "SELECT id, fim FROM ledger ORDER BY fim DESC NULLS LAST, id LIMIT 50"))
def topk_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("id", "fim").orderBy(F.desc_nulls_last("fim"), "id").limit(50)


@query("q_deal_desk", using({"ledger": LEDGER}, """
WITH r AS (SELECT publico, id, percentual, row_number() OVER (PARTITION BY publico ORDER BY percentual DESC, id) AS rn, count(*) OVER (PARTITION BY publico) AS n FROM ledger WHERE tier = 1)
SELECT publico, id, percentual, rn, n - 8 AS cut FROM r WHERE rn <= 8"""))
def deal_desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight a list and how many were cut: rank <= 8 becomes a group limit before the shuffle, the counts are a small aggregate."""
    rows = ledger(spark, sf_dir).filter("tier = 1").select("publico", "id", "percentual")
    best = rows.withColumn("rn", F.row_number().over(Window.partitionBy("publico").orderBy(F.desc("percentual"), "id")).cast("bigint")).filter("rn <= 8")
    return best.join(rows.groupBy("publico").agg((F.count("*") - 8).alias("cut")), "publico")


@query("q_enum_sort", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, list_position(['P', 'O', 'F'], o_orderstatus)::BIGINT AS place FROM orders GROUP BY ALL")
def enum_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.array_position(F.array(*map(F.lit, ("P", "O", "F"))), F.col("o_orderstatus")).cast("bigint")).orderBy("place", "o_orderpriority")


@query("q_relevance_sort", "SELECT p_partkey, class, row_number() OVER (ORDER BY class, p_partkey) AS position FROM (SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^red') THEN 0 WHEN regexp_matches(p_name, 'ring') THEN 1 ELSE 2 END AS class FROM part)")
def relevance_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its relevance class and place; equal classes keep the order of input."""
    cls = F.when(F.col("p_name").rlike("^red"), 0).when(F.col("p_name").rlike("ring"), 1).otherwise(2)
    return numbered(table(spark, sf_dir, "part").select("p_partkey", cls.cast("int").alias("class")), [F.asc("class"), F.asc("p_partkey")], "position")


@query("q_json_props", using({"calls": CALLS}, "SELECT id, tokens, CASE estagio WHEN 'view' THEN 'leitura' WHEN 'click' THEN 'acao' WHEN 'purchase' THEN 'compra' WHEN 'signup' THEN 'cadastro' ELSE 'falha' END AS rotulo FROM calls"))
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label map; an unknown label raises."""
    names = {"view": "leitura", "click": "acao", "purchase": "compra", "signup": "cadastro", "error": "falha"}
    label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("estagio"))
    return calls(spark, sf_dir).select("id", "tokens", F.coalesce(label, F.raise_error(F.concat(F.lit("unknown label "), "estagio")).cast("string")).alias("rotulo"))
