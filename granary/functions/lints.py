"""What may not stand in a published text, and whether a summary is one of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions.queries import _DOC, _RUNS, _TOKENS, docs, longest_runs, overlaps, shared_grams
from granary.registry import query
from granary.sources.tables import table

# What each list bans.  Lists are compared without regard to case; words of urgency stand between characters that are neither letters nor digits.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{FE0F}]"
URGENT = r"imperd[ií]vel|corra|corre|garanta j[áa]|[úu]ltima chance|milhas gr[áa]tis"
INTERNAL = r"(?iu)\b(CMI|dados?\s+internos?|m[ée]trica\s+interna|base\s+interna|churn\s+interno|receita\s+interna|margem\s+de\s+contribui[çc][ãa]o\s+interna|custo\s+interno\s+do\s+programa|nossos?\s+clientes|nossa\s+base)\b"
JARGON = {
    "conta computável": r"(?iu)conta comput[áa]ve(l|is)",
    "candidato vivo": r"(?iu)candidatos? vivos?",
    "TIER 1": r"(?iu)TIER ?1",
    "TIER 2": r"(?iu)tier ?2",
    "veredito da régua": r"(?iu)veredito da r[ée]gua",
    "recomputado": r"(?iu)recomputad",
    "tl_score_bruto": r"(?iu)tl_score_bruto",
    "veredito_bruto": r"(?iu)veredito_bruto",
    "estado vivo": r"(?iu)estado vivo",
    "três portões": r"(?iu)tr[êe]s port[õo]es|3 port[õo]es",
}
PROMISES = ("garantido", "lucro certo", "ganho certo", "sem risco", "dinheiro garantido")
# Limits of a summary.
LEAST_CHARS, MOST_WORDS, COPY_SHARE, COPY_RUN = 40, 45, 0.35, 8

_URGENT = rf"(?iu)(^|[^\p{{L}}\p{{N}}])({URGENT})($|[^\p{{L}}\p{{N}}])"
RULES = {"emoji": EMOJI, "urgency": _URGENT, "internal": INTERNAL, "promise": "(?iu)" + "|".join(PROMISES)} | {f"jargon: {term}": pattern for term, pattern in JARGON.items()}
#: For a pattern one that matches wherever it does and looks at the first characters of a match before anything else: most places of a long text fail there.
_QUICK = {
    EMOJI: rf"(?=[^\x{{0}}-\x{{25FF}}]){EMOJI}",
    _URGENT: rf"(?iu)(?=[icgúum][moali])(?<![\p{{L}}\p{{N}}])({URGENT})(?![\p{{L}}\p{{N}}])",
    INTERNAL: INTERNAL.replace("(?iu)", "(?iu)(?=[cdmbrn][maéehuo])", 1),
}


def breaks(text: Column, pattern: str) -> Column:
    """text.rlike(pattern), which decides where its quick form matches."""
    return text.rlike(_QUICK[pattern]) & text.rlike(pattern) if pattern in _QUICK else text.rlike(pattern)


def lints(text: Column, rules: dict[str, str] = RULES) -> Column:
    """The names of the rules that a text breaks, in order."""
    return F.array_compact(F.array(*[F.when(breaks(text, p), F.lit(n)) for n, p in rules.items()]))


_PHRASES = (
    "Promoção imperdível de hoje", "Corrampa nada aqui", "Última chance!", "Dados internos da CMI", "Nossos clientes ganham", "uma conta computável e o TIER 1", "TIER 2, estado vivo", "lucro certo", "Compre \U0001f680 agora", "Vence quinta-feira",
)
_LINTED = ("urgency", "", "urgency", "internal", "internal", "jargon: conta computável,jargon: TIER 1", "jargon: TIER 2,jargon: estado vivo", "promise", "emoji", "")


@query("q_text_lints", f"SELECT p_partkey, {list(_LINTED)}[(p_partkey % 10 + 1)::INTEGER] AS lints FROM part")
def text_lints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten phrases, between the names of parts."""
    text = F.concat_ws(" ", "p_brand", F.get(F.array(*map(F.lit, _PHRASES)), (F.col("p_partkey") % 10).cast("int")), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(lints(text), ",").alias("lints"))


_SUMMARY = {k: RULES[k] for k in ("emoji", "urgency", "internal")}


def own_faults(text: Column) -> Column:
    """Why a summary may not stand by its text alone, each as a boolean: empty, too short or long, or a banned word."""
    t = F.trim(text)
    own = {"empty": t == "", "too_short": F.length(t) < LEAST_CHARS, "too_long": t.rlike(rf"^\s*+(\S++\s++){{{MOST_WORDS}}}\S")}
    return F.struct(*[c.alias(k) for k, c in (own | {k: breaks(t, p) for k, p in _SUMMARY.items()}).items()])


def faults(own: Column, share: Column, run: Column) -> Column:
    """The names of a summary's own_faults and of those of a copy of its source, by share of 4-grams or by a run of words."""
    found = {k: own[k] for k in ("too_short", "too_long")} | {"overlap": share >= COPY_SHARE, "run": run >= COPY_RUN} | {k: own[k] for k in _SUMMARY}
    return F.when(own["empty"], F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()])))


_TRIM = "trim(coalesce(text, ''), ' ')"
_LIST = ", ".join([
    f"CASE WHEN length({_TRIM}) < {LEAST_CHARS} THEN 'too_short' END", f"CASE WHEN len(regexp_extract_all({_TRIM}, '\\S+')) > {MOST_WORDS} THEN 'too_long' END", f"CASE WHEN coalesce(share, 0) >= {COPY_SHARE} THEN 'overlap' END",
    f"CASE WHEN coalesce(run, 0) >= {COPY_RUN} THEN 'run' END", *[f"CASE WHEN regexp_matches({_TRIM}, '{p.replace('(?iu)', '(?i)')}') THEN '{n}' END" for n, p in _SUMMARY.items()],
])


@query("q_anticopy", _TOKENS + f""", {_RUNS.strip().split("," + chr(10), 1)[1]}
, o AS (SELECT doc_id, max(k::DOUBLE / n) AS share FROM (SELECT doc_id, item_id, count(*) AS k FROM dg JOIN bg USING (g) GROUP BY ALL) JOIN bn USING (item_id) GROUP BY doc_id),
r AS (SELECT doc_id, max(run) AS run FROM runs GROUP BY doc_id)
SELECT documents.doc_id, coalesce(share, 0) AS share, coalesce(run, 0) AS run,
       CASE WHEN {_TRIM} = '' THEN 'empty' ELSE array_to_string(list_filter([{_LIST}], lambda x: x IS NOT NULL), ',') END AS faults
FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN r USING (doc_id)""")
def anticopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents held to the rules of a summary, with the benchmark's items as their sources.

    A text is read once for its own faults and once for its n-grams; what is joined by document is short.
    """
    grams, held = shared_grams(spark, sf_dir)
    o = overlaps(grams, held).groupBy("doc_id").agg(F.max("share").alias("share"))
    r = longest_runs(grams, held).groupBy("doc_id").agg(F.max("run").alias("run"))
    rows = docs(spark, sf_dir).select("doc_id", own_faults(F.col("text")).alias("own")).join(o, "doc_id", "left").join(r, "doc_id", "left")
    share, run = F.coalesce("share", F.lit(0.0)), F.coalesce("run", F.lit(0))
    return rows.select("doc_id", share.alias("share"), run.alias("run"), F.array_join(faults(F.col("own"), share, run), ",").alias("faults"))
