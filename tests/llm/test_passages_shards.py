"""Operator 1 over many blocks and shards, hot passages, clashing columns, and the spacing of the source."""

import random
import re
from collections import Counter

from granary.llm import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
W = passages.WINDOW


def rows():
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(500)]
    hot = " ".join(rng.choices(vocab, k=60))
    out = [(i, "  ".join([*rng.choices(vocab, k=rng.randrange(0, 200)), hot if i % 3 == 0 else "-", *rng.choices(vocab, k=50)]) + "\n") for i in range(150)]
    out += [(200, out[4][1]), (200, out[4][1]), (None, hot), (None, None), (201, ""), (202, (hot + " ") * 40)]
    return [(i, t, 9, "l") for i, t in out]


def removed(data):
    seen, split = Counter(), [WORD.findall(t or "") for _, t, *_ in data]
    for ws in split:
        seen.update(tuple(ws[k : k + W]) for k in range(len(ws) - W + 1))
    return [{k + o for k in range(len(ws) - W + 1) if seen[tuple(ws[k : k + W])] > 1 for o in range(W)} for ws in split]


def test_blocks_and_shards(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, N_Words int, lang string")
    plan = passages.Plan(sum(len(t or "") for _, t, *_ in data), W, (4_000, 4_000), (64, 64))
    assert plan.blocks > 20 and plan.shards > 20
    gone = removed(data)
    want = []
    for (i, t, *_), cut in zip(data, gone, strict=True):
        ws = WORD.findall(t or "")
        want.append((str(i), " ".join(x for k, x in enumerate(ws) if k not in cut), len(ws), len(cut), "l"))
    found = passages.without_repeats(df, block_bytes=(4_000, 4_000), shard_anchors=(64, 64))
    assert found.columns == ["doc_id", "text", "n_words", "n_removed", "lang"]
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == sorted(want)


def test_spacing_of_the_source(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, N_Words int, lang string")
    want = []
    for (i, t, *_), cut in zip(data, removed(data), strict=True):
        text, spans = t or "", list(WORD.finditer(t or ""))
        drop = set()
        for k in cut:  # a removed word goes with the white space after it
            drop.update(range(spans[k].start(), spans[k + 1].start() if k + 1 < len(spans) else len(text)))
        want.append((str(i), "".join(c for p, c in enumerate(text) if p not in drop)))
    found = passages.without_repeats(df, spacing="source", block_bytes=(4_000, 4_000), shard_anchors=(64, 64))
    assert sorted((str(r["doc_id"]), r["text"]) for r in found.collect()) == sorted(want)


def test_repeated_rows_spread_over_blocks(spark, monkeypatch):
    """A third of all rows is one row: no block is much over the median."""
    data = [(i, f"text {i} " * 20, 9, "l") for i in range(4_000)] + [(1, "the same row again " * 9, 9, "l")] * 2_000
    seen = []
    keep = passages.written
    monkeypatch.setattr(passages, "written", lambda df: seen.append(keep(df)) or seen[-1])
    df = spark.createDataFrame(data, "doc_id long, text string, N_Words int, lang string")
    passages.without_repeats(df, block_bytes=(20_000, 20_000)).count()
    sizes = sorted(r["count"] for r in seen[0].groupBy("block").count().collect())
    assert len(sizes) > 20 and sizes[-1] < 2 * sizes[len(sizes) // 2]
