"""The Bloom filter: nothing lost, few in vain, exact results behind it, and no n-gram without a source in the shuffle."""

import random

from pyspark.sql import functions as F

from granary.functions import queries as Q
from granary.functions.bloom import bloom, may_hold


def test_nothing_is_lost(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    for most, vain in ((1 << 26, 0.05), (1 << 10, 1.01)):
        words = bloom(keys, "h", most)
        assert words.count() == 1 and words.first()["words"].__len__() * 64 <= most
        tested = spark.range(9000).crossJoin(F.broadcast(words)).select("id", may_hold(F.col("words"), F.xxhash64("id")).alias("x"))
        assert tested.filter("id < 3000 AND NOT x").isEmpty()
        assert tested.filter("id >= 3000 AND x").count() <= 6000 * vain
    assert spark.range(5).crossJoin(bloom(keys.limit(0), "h")).filter(may_hold(F.col("words"), F.col("id"))).isEmpty()


def test_source_grams(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=30))) for i in range(20)] + [(20, None), (21, "too short")]
    hot = items[0][1]
    texts = [(i, " ".join(rng.choices(vocab, k=200)) + (f" {hot} " if i % 3 == 0 else "")) for i in range(90)] + [(90, ""), (91, "a b c")]
    grams = Q.item_grams(spark.createDataFrame(items, "item_id long, text string"), 4)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = {(d, i, " ".join(t.split()[i : i + 4])) for d, t in texts for i in range(len(t.split()) - 3)}
    real = {" ".join(t.split()[j : j + 4]) for _, t in items if t for j in range(len(t.split()) - 3)}
    for most in (1 << 26, 1 << 10):
        got = {tuple(r) for r in Q.source_grams(df, grams, 4, most).collect()}
        assert got <= want and {g for g in want if g[2] in real} <= got
    few = {tuple(r) for r in Q.source_grams(df, grams, 4).collect()}
    assert len(few) < len({g for g in want if g[2] in real}) + 0.05 * len(want)
