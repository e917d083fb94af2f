"""The texts behind q_anticopy, q_shingle_overlap and q_longest_run: read in one pass for both results, compiled, never shuffled; the cheaper forms of words and patterns give what the plain ones give."""

import random
import re

from pyspark.sql import functions as F

from granary.functions import lints as L
from granary.functions import queries as Q
from granary.functions import text as X

SMOKE = "/root/testdata/sf0.001"


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_one_pass_and_no_text_joined(spark, monkeypatch):
    """Before: two passes for n-grams, and texts in both joins by document."""
    passes, real = [], Q.source_grams
    monkeypatch.setattr(Q, "source_grams", lambda *a: passes.append(real(*a)) or passes[-1])
    rows = L.anticopy(spark, SMOKE)
    assert len(passes) == 1
    joins = [n.output().mkString(",") for n in nodes(rows._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert joins and not any("text#" in o for o in joins)


def test_grams_are_compiled(spark):
    """Before: hashes and their tests in lambdas, which are interpreted a word at a time."""
    grams = Q.item_grams(Q.table(spark, SMOKE, "benchmark"), 4)
    plan = Q.source_grams(Q.docs(spark, SMOKE), grams, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "lambda" not in plan.split("Aggregate")[0]


def test_words(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "-a-", "Ação É ÜBER über", "K9 İx ſ ß", "a\nb\tc", "\U0001d400a b", "日本 x1"]
    texts += ["".join(rng.choices("aZ9 -\n" + X.ACCENTED + X.ACCENTED.upper() + "Kİſß\U0001f680", k=rng.randrange(40))) for _ in range(300)]
    folded = F.trim(F.regexp_replace(F.translate(F.lower("t"), X.ACCENTED, X.PLAIN), "[^a-z0-9]+", " "))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded.alias("f"), X.folded(F.col("t")).alias("g"), X.words(F.col("t")).alias("ws"))
    for r in rows.collect():
        assert r.g == r.f and r.ws == (None if r.f is None else r.f.split())


def test_quick_patterns(spark):
    rng = random.Random(7)
    hits = ["imperdível", "IMPERDIVEL", "corra", "Corre", "garanta já", "GARANTA JA", "última chance", "ÚLTIMA CHANCE", "ultima chance", "milhas grátis", "MİLHAS GRATIS", "milhaſ gratis", "mılhas gratis"]
    hits += ["CMI", "cmİ", "dados internos", "dado  interno", "métrica interna", "METRICA INTERNA", "base interna", "churn interno", "receita interna", "margem de contribuição interna", "custo interno do programa", "nossos clientes", "nosso clientes", "NOSSA BASE", "noſsa base"]
    hits += ["\U0001f680", "☀", "◿", "➿", "️", "\U0001f1e7", "\U0001faff", "\U0001fb00"]
    around = ["", " ", "a", "é", "9", "́", "\U0001d400", "\n", "_", "-", "İ"]
    texts = [a + h + b for h in hits for a in around for b in around] + [None, "", "nada"]
    texts += ["".join(rng.choices([*hits, *around, "corr", "nos"], k=6)) for _ in range(500)]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[f.alias(f"{k}_{i}") for k, p in L.RULES.items() for i, f in enumerate((t.rlike(p), L.breaks(t, p)))])
    found = rows.collect()
    for r in found:
        assert r[1::2] == r[2::2], r
    assert all(any(r[i] for r in found) and not all(r[i] for r in found) for i in (1, 3, 5))


def test_faults(spark):
    rng = random.Random(9)
    texts = ["", "   ", "\n", "x", "y" * 39, "y" * 40] + [rng.choice(["", " ", "\n", "\t "]) + rng.choice([" ", "  ", "\n "]).join(["palavra"] * n) + rng.choice(["", " ", "\n", "\r\n"]) for n in range(40, 52) for _ in range(8)]
    texts += ["Promoção imperdível para nossos clientes, com quarenta letras \U0001f680"]
    own = L.own_faults(F.col("t"))
    rows = spark.createDataFrame([(t, s, r) for t in texts for s, r in ((0.0, 0), (0.35, 8))], "t string, s double, r int").withColumn("faults", L.faults(own, F.col("s"), F.col("r")))
    for r in rows.collect():
        t = r.t.strip(" ")
        want = [k for k, c in (("too_short", len(t) < 40), ("too_long", len(re.findall(r"\S+", t)) > 45), ("overlap", r.s >= 0.35), ("run", r.r >= 8)) if c]
        want += ["emoji", "urgency", "internal"] if "imperd" in t else []
        assert r.faults == (want if t else ["empty"]), r
