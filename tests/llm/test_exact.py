"""Operator 13 against grouping by content, with hot groups in many runs."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from granary.llm import exact

DOCS = "doc_id long, text string, kept string, H int, Row int"


def given():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["a", "b", "é"], k=rng.randint(0, 4)))) for i in range(300)]
    rows += [(1_000 + i, "hot   text\n" if i % 2 else "hot\ttext ") for i in range(200)] + [(7_000, "repeated row")] * 150
    rows += [(None, "nobody"), (None, "nobody"), (None, "hot text "), (5, None), (6, ""), (8, " "), (9, "\n\t"), (2_000, "x" * 400_000), (2_001, "x" * 400_000), (2_002, "x" * 400_000 + "y")]
    rows += [(3_000 + i, "the same first thirty-two characters, then other ones " + str(i % 5)) for i in range(20)]
    return rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("options", [{}, {"run_rows": 7}, {"run_rows": 1}, {"run_bytes": 30}, {"run_rows": 3, "most": 2}])
def test_groups(spark, options):
    rows = given()
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], DOCS).repartition(6)
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = exact.duplicates(df, **options)
    assert got.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"]
    got = got.collect()
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in groups}
    assert sorted(map(str, ((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got))) == sorted(str((i, first[norm(t)], len(groups[norm(t)]), digest[norm(t)])) for i, t in rows)
    kept = [(r["text_sha256"], r["id"]) for r in got if r["kept"]]
    assert sorted(map(str, kept)) == sorted(str((digest[t], first[t])) for t in groups)


def test_one_of_each(spark):
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in given()], DOCS)
    for options in ({}, {"run_rows": 5}):
        left = exact.one_of_each(df, **options)
        assert left.schema == df.schema
        assert sorted(norm(r["text"]) for r in left.collect()) == sorted({norm(t) for _, t in given()})
    assert exact.one_of_each(df.limit(0)).count() == 0 and exact.duplicates(df.limit(0)).count() == 0


def test_no_python(spark):
    """Native: one exchange of texts, by ranges, and no Python node."""
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in given()], DOCS)
    plan = exact.runs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan
