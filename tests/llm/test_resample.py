"""Operator 12 against a plain version over all rows, without collapsing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from granary.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, N_Features int"


def cut(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, longest, buckets, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    bags = [[bucket(f) for f in cut(t, longest)] for _, t in docs]
    s, t = Counter(b for bag in bags for b in bag), Counter(bucket(f) for x in target for f in cut(x, longest))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * all_s / (float(s[b] + 1) * all_t)))
    rows = []
    for (i, _), bag in zip(docs, bags, strict=True):
        weight = sum(map(gain, bag)) // len(bag) if bag else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((k for k, r in enumerate(rows) if r[1] >= least), key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: n for n, k in enumerate(order[: len(order) * percent // 100], 1)}
    return [(*r, rank.get(k)) for k, r in enumerate(rows)]


def given():
    rng = random.Random(11)
    vocab = [f"W{i}é" for i in range(60)] + ["Don't", "x1y2", "中文", "Ärger"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 60))) + rng.choice(["", ".", "\n"])) for i in range(200)]
    docs += [(500 + i, docs[3][1]) for i in range(90)] + [(700, docs[4][1])] * 30 + [(None, docs[5][1])] * 3
    docs += [(900, None), (901, ""), (902, "\x00 \x7f"), (903, "long " * 400_000), (904, "y" * 1_500_000 + " " + "z w " * 30)]
    return docs, [" ".join(rng.choices(vocab[:20], k=40)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("longest", "options"), [(1, {}), (3, {}), (1, {"run_rows": 4})])
def test_draw(spark, longest, options):
    docs, target = given()
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], DOCS).repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.drawn(df, aims, longest=longest, buckets=97, **options)
    assert got.columns == ["id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = plain(docs, target, longest, 97)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(r[4] is not None for r in want) > 10


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b " * 20, "s", 1), (2, None, "s", 1)], DOCS)
    none = df.select("text").limit(0)
    assert resample.drawn(df.limit(0), none).count() == 0
    assert {(r["id"], r["n_features"], r["rank"]) for r in resample.drawn(df, none, percent=100).collect()} == {(1, 40, 1), (2, 0, None)}
    assert resample.drawn(df, none).filter("rank IS NOT NULL").count() == 0
