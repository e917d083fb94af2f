"""SimHash in the near-duplicate stage, and no broadcast of tables that grow with the input."""

import random

from pyspark.sql import functions as F

from granary.llm import near, simhash
from granary.llm.graph import components


def test_fingerprints_propose_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(900)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t + " tail") for i, t in enumerate(base)]
    data = spark.createDataFrame(rows, "id long, text string")
    sketch = data.select("id", near._text_key("text").alias("t"), "text").mapInArrow(near._sketch, "id long, t long, cls long, n long, bands array<long>, fp long")
    found = {r["cls"]: (r["id"], r["fp"]) for r in sketch.collect()}
    close = {(a, b) for a, x in found.items() for b, y in found.items() if a > b and bin((x[1] ^ y[1]) & (2**64 - 1)).count("1") <= simhash.RADIUS}
    assert close  # one word more moves few bits
    assert {(r["a"], r["b"]) for r in near.by_fingerprint(sketch.select("cls", "fp")).collect()} == close
    # without bands nothing but fingerprints proposes, and exact similarity decides
    classes = sketch.select("cls", "t", "n", F.array().cast("array<long>").alias("bands"), "fp")
    texts = data.select(near._text_key("text").alias("t"), "text")
    assert {(r["a"], r["b"]) for r in near._linked(classes, texts, 0.8, 32).collect()} == close


def test_nothing_is_broadcast(spark):
    """Small tables would be broadcast by their estimated size, as large ones are that compress well."""
    prints = spark.createDataFrame([(x,) for x in (0, 1, 3, 31 << 40, (31 << 40) + 1)], "fp long")
    linked = simhash.links(prints)
    for df in (linked, simhash.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x y z")], "doc_id long, text string"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["root"] for r in components(linked).collect()} == {0, 31 << 40}
