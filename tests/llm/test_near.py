"""The pipeline's near-dedup stage against exact Jaccard similarity, and the rows that stay."""

import random

import corpus_pipeline as p


def grams(text):
    ws = (text or "").lower().split()
    return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def planted():
    """200 words with 1 to 4 changed words each: similarities of about 0.8 to 0.95, and some below 0.8."""
    rng = random.Random(11)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((10 * g, " ".join(base)))
        for c in range(1, 4):
            copy = list(base)
            for k in rng.sample(range(200), (1, 3, 7)[c - 1]):
                copy[k] = f"x{g}c{c}k{k}"
            rows.append((10 * g + c, " ".join(copy)))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_go(spark):
    rows = planted()
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = []
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            s = jaccard(a, b)
            seen.append(s)
            if s >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert sum(0.8 <= s < 0.96 for s in seen) > 50 and any(0.6 < s < 0.8 for s in seen)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = {r["doc_id"] for r in p.near_dedup(spark, docs, "").collect()}
    assert got == {i for i in parent if find(i) == i}


def test_short_and_dense(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base)), (500, "one two"), (501, "ONE two"), (502, "one two three")]
    for i in range(1, 120):
        copy = list(base)
        copy[rng.randrange(5, 145)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    assert {r["doc_id"] for r in p.near_dedup(spark, docs, "").collect()} == {0, 500, 502}


def test_null_and_shared_ids(spark):
    prose = [t for _, t in planted()[::4]][:8]
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (8, prose[4]), (8, prose[5]), (9, prose[4]), (None, prose[6]), (3, prose[6])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in p.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(None, prose[0]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (8, prose[4]), (8, prose[5]), (3, prose[6])], key=str)


def families():
    """Texts that share a long passage but little else, two families of near copies around it, and links that no hub sees."""
    rng = random.Random(17)
    shared = [f"s{i}" for i in range(120)]
    rows = [(i, " ".join([*shared, *[f"o{i}x{k}" for k in range(rng.randrange(10, 90))]])) for i in range(60)]
    for f in range(2):
        tail = [f"f{f}x{k}" for k in range(60)]
        for c in range(25):
            copy = [*shared, *tail]
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{f}c{c}{rng.randrange(99)}"
            rows.append((100 + 50 * f + c, " ".join(copy)))
    return rows


def test_dense_bands(spark):
    """Groups far beyond the dense limit: the same components as all pairs give."""
    from granary.llm import near

    rows = families()
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if jaccard(a, b) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = {}
    for i in parent:
        want.setdefault(find(i), set()).add(i)
    got = {}
    sizes, (near.BLOCK_GRAMS, near.SHARD_GRAMS) = (near.BLOCK_GRAMS, near.SHARD_GRAMS), (700, 500)  # several blocks and shards
    try:
        for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), dense=3).collect():
            got.setdefault(r["root"], set()).add(r["id"])
    finally:
        near.BLOCK_GRAMS, near.SHARD_GRAMS = sizes
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 20
