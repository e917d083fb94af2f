"""Confirmation of campaigns by an official source, and campaigns that are born from one, in batches.

Each step returns the new tables and the rows that it adds; nothing is written in
place.  Both are idempotent: run again with the same requests, they add nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.gates import state
from granary.registry import query, using
from granary.sources.tables import AS_OF, LEDGER, as_of, ledger

CONFIRMED, BORN, ROLE = "confirmacao_tier1", "nascimento_tier1", "confirmacao_oficial"


@dataclass(frozen=True)
class Step:
    campaigns: DataFrame
    sources: DataFrame
    versions: DataFrame
    outcome: DataFrame


def confirmed(campaigns: DataFrame, sources: DataFrame, requests: DataFrame, day: Column) -> Step:
    """requests (campaign_id, url) confirmed: a tier-1 source each, the state derived anew, and an event where anything changed.

    campaigns: (id, fim, reliable, state); sources: (campaign_id, url, tier).  outcome has
    a row a request: found, new_source, state_before, state_after, promoted.
    """
    asked = requests.select("campaign_id", "url").distinct()
    official = sources.filter("tier = 1").select("campaign_id", "url").distinct().withColumn("known", F.lit(True))
    now = state(day)
    held = campaigns.select(F.col("id").alias("campaign_id"), F.col("state").alias("state_before"), F.col("fim"), F.when(F.col("reliable"), 1).otherwise(3).alias("tier")).withColumn("state_after", now).drop("fim", "tier")
    rows = asked.join(held.withColumn("found", F.lit(True)), "campaign_id", "left").join(official, ["campaign_id", "url"], "left")
    fresh = F.col("found").isNotNull() & F.col("known").isNull()
    outcome = rows.select("campaign_id", "url", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce(fresh, F.lit(False)).alias("new_source"), "state_before", "state_after", F.coalesce(F.col("state_before") != F.col("state_after"), F.lit(False)).alias("promoted"))
    done = outcome.filter("found").select(F.col("campaign_id").alias("id"), "state_after").distinct()
    after = campaigns.join(done, "id", "left").withColumn("state", F.coalesce("state_after", "state")).select(*campaigns.columns)
    added = outcome.filter("new_source").select("campaign_id", "url", F.lit(1).alias("tier"))
    events = outcome.filter("new_source OR promoted").select("campaign_id", F.lit(CONFIRMED).alias("event"), "state_before", "state_after", "url")
    return Step(after, sources.select("campaign_id", "url", "tier").union(added), events, outcome)


def born(campaigns: DataFrame, sources: DataFrame, offers: DataFrame, day: Column) -> Step:
    """offers (identity_key, url, fim, reliable) that no campaign of that identity and official address stands for become campaigns, confirmed at once.

    campaigns also has identity_key.  A new campaign's id follows from its identity and
    address, so a repeated offer is the same campaign.  outcome: (identity_key, url, campaign_id, created).
    """
    asked = offers.filter("identity_key IS NOT NULL AND url IS NOT NULL").groupBy("identity_key", "url").agg(F.max(F.struct("fim", "reliable")).alias("x")).select("identity_key", "url", "x.*")
    official = sources.filter("tier = 1").join(campaigns.select(F.col("id").alias("campaign_id"), "identity_key"), "campaign_id").groupBy("identity_key", "url").agg(F.min("campaign_id").alias("standing"))
    made = F.concat(F.lit("tl_"), F.left(F.sha2(F.concat_ws("\n", "identity_key", "url"), 256), F.lit(32)))
    rows = asked.join(official, ["identity_key", "url"], "left").withColumn("campaign_id", F.coalesce("standing", made)).withColumn("created", F.col("standing").isNull())
    outcome = rows.select("identity_key", "url", "campaign_id", "created")
    before = state(day)  # as if not confirmed yet: the tier-1 state is the confirmation's
    fresh = rows.filter("created").select(F.col("campaign_id").alias("id"), "identity_key", "fim", "reliable", F.when(F.col("reliable"), 2).otherwise(3).alias("tier")).withColumn("state", before).drop("tier")
    births = fresh.select(F.col("id").alias("campaign_id"), F.lit(BORN).alias("event"), F.lit(None).cast("string").alias("state_before"), F.col("state").alias("state_after")).join(outcome.filter("created").select("campaign_id", "url"), "campaign_id")
    step = confirmed(campaigns.unionByName(fresh, allowMissingColumns=True), sources, outcome.filter("created").select("campaign_id", "url"), day)
    return Step(step.campaigns, step.sources, step.versions.unionByName(births), outcome)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Campaigns by product and origin; their sources by ledger status; requests for products divisible by three, a few of them unknown."""
    rows = ledger(spark, sf_dir)
    key = F.concat_ws("/", F.col("produto").cast("string"), "origem")
    c = rows.groupBy(key.alias("id")).agg(F.max("fim").alias("fim"), (F.min("tier") < 3).alias("reliable"), F.min("produto").alias("produto"))
    c = c.withColumn("tier", F.when(F.col("reliable"), 2).otherwise(3)).withColumn("state", state(as_of())).drop("tier").withColumn("identity_key", F.concat(F.lit("k"), F.col("id")))
    s = rows.filter("fonte = 'F' AND produto % 2 = 0").select(key.alias("campaign_id"), F.lit("https://official.example/a").alias("url"), F.lit(1).alias("tier")).distinct()
    r = c.filter("produto % 3 = 0").select(F.when(F.col("produto") % 5 == 0, F.concat(F.lit("no-"), "id")).otherwise(F.col("id")).alias("campaign_id"), F.lit("https://official.example/a").alias("url"))
    return c.drop("produto"), s, r


_ST = "CASE WHEN NOT reliable OR fim IS NULL THEN 'indeterminada' WHEN fim < DATE '{0}' - 30 THEN 'historica' WHEN fim < DATE '{0}' THEN 'encerrada' WHEN fim <= DATE '{0}' + 3 THEN 'ultimos_dias' ELSE '{1}' END"
_CAMPAIGNS = {
    "ledger": LEDGER,
    "c": "SELECT concat_ws('/', produto, origem) AS id, max(fim) AS fim, min(tier) < 3 AS reliable, min(produto) AS produto FROM ledger GROUP BY 1",
    "s": "SELECT DISTINCT concat_ws('/', produto, origem) AS campaign_id FROM ledger WHERE fonte = 'F' AND produto % 2 = 0",
}


@query("q_confirm_tier1", using(_CAMPAIGNS, f"""
WITH r AS (SELECT CASE WHEN produto % 5 = 0 THEN 'no-' || id ELSE id END AS campaign_id FROM c WHERE produto % 3 = 0),
x AS (SELECT id, {_ST.format(AS_OF, "detectada")} AS state_before, {_ST.format(AS_OF, "ativa")} AS state_after FROM c)
SELECT r.campaign_id, x.id IS NOT NULL AS found, x.id IS NOT NULL AND s.campaign_id IS NULL AS new_source, state_before, state_after, coalesce(state_before <> state_after, false) AS promoted
FROM r LEFT JOIN x ON x.id = r.campaign_id LEFT JOIN s ON s.campaign_id = r.campaign_id"""))
def confirm_tier1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, r = _tables(spark, sf_dir)
    return confirmed(c, s, r, as_of()).outcome.drop("url")


@query("q_born_tier1", using(_CAMPAIGNS, """
WITH o AS (SELECT DISTINCT 'k' || id AS identity_key, id, CASE WHEN produto % 2 = 0 THEN 'https://official.example/a' ELSE 'https://official.example/b' END AS url FROM c WHERE produto % 7 = 0)
SELECT identity_key, url, s.campaign_id IS NULL AS created, CASE WHEN s.campaign_id IS NOT NULL THEN s.campaign_id ELSE 'tl_' || left(sha256(identity_key || chr(10) || url), 32) END AS campaign_id
FROM o LEFT JOIN s ON s.campaign_id = o.id AND o.url = 'https://official.example/a'"""))
def born_tier1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, _ = _tables(spark, sf_dir)
    product = F.split_part("id", F.lit("/"), F.lit(1)).cast("long")
    offers = c.filter(product % 7 == 0).select("identity_key", F.when(product % 2 == 0, "https://official.example/a").otherwise("https://official.example/b").alias("url"), "fim", "reliable")
    return born(c, s, offers, as_of()).outcome
