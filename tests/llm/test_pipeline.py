"""The stages in order on a small table; clean documents stay, planted ones go."""

import random

import corpus_pipeline as p


def prose(seed, n=120):
    rng = random.Random(seed)
    return ". ".join(" ".join(rng.choices("the of and to in that is for harbour winter letter stone river market engine valley garden window silver copper".split(), k=12)) + f" v{seed}x{k}" for k in range(n // 12))


def test_stages(spark):
    a = prose(1)
    passage = prose(77)
    rows = [(1, a), (2, a), (3, "too short"), (4, None), (5, f"{prose(5)}\n{passage}"), (6, f"{prose(6)}\nBut {passage}"), (7, prose(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in p.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 1 in left and 7 in left and 3 not in left and 4 not in left and left[7] == prose(7)
    assert not left.get(2)  # a copy: its lines went, or the document
    assert "v77x3" not in left[5] and "v77x3" not in left[6] and "v5x3" in left[5]
    assert dict(p.STAGES)["packing"](spark, docs, "").count() >= len(left)
