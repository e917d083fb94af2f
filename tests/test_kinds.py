"""Rows that no score tells apart are compared once, with their number as weight; ids stay behind."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import tiles
from granary.plans import quality
from granary.sources.tables import ledger
from tests.test_ranges import LEDGER, ledger_rows, plain_score

COPIES = 5
DAY = dt.date(2020, 5, 1)


@pytest.fixture(scope="module")
def offers(spark):
    """Rows with copies that differ in id alone, one pair of them in the sign of a zero, and two rows whose copies give no points."""
    rows = [tuple(None if v == 40.0 and k == 5 else v for k, v in enumerate(r)) for r in ledger_rows(60)]
    bare = [(f"{n}", "a", "b", "k", 1, p, None, None, None, None, None, None) for n, p in (("q1", None), ("q2", None), ("z1", 0.0), ("z2", -0.0))]
    late = [("s1", "a", "d", "k", 1, None, None, DAY - dt.timedelta(400), DAY, DAY, None, None), ("s2", "a", "d", "k", 1, None, None, None, None, None, None, None)]
    made = [(f"{k}{r[0]}", *r[1:]) for r in rows + bare + late for k in "abcde"[:COPIES]]
    return spark.createDataFrame(made, LEDGER).repartition(7).persist()


@pytest.fixture(scope="module")
def plain(offers):
    """(rows, links, strong, best, root) by comparing all pairs."""
    rows = [r.asDict() for r in quality.temporal(offers).collect()]
    root, links, strong, best = {r["id"]: r["id"] for r in rows}, Counter(), Counter(), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if all(a[k] == b[k] for k in quality.BLOCK) and (s := plain_score(a, b)) >= 3:
                x, y = sorted((find(a["id"]), find(b["id"])))
                root[y] = x
                for r in (a["id"], b["id"]):
                    links[r], strong[r], best[r] = links[r] + 1, strong[r] + (s >= 5), max(best[r], s)
    return rows, links, strong, best, {i: find(i) for i in links}


@pytest.fixture
def compared_rows(monkeypatch):
    """How many rows each comparison takes in."""
    seen = []

    def counted(rows, *args):
        seen.append(rows.count())
        return tiles.linked_rows(rows, *args)

    monkeypatch.setattr(quality, "linked_rows", counted)
    return seen


@pytest.mark.parametrize("size", [1000, 9])
def test_copies_are_compared_once(offers, plain, compared_rows, size):
    """All copies used to be compared with one another, and moved with their ids."""
    rows, links, strong, best, root = plain
    found = {r["id"]: r for r in quality.compared(offers, size).collect()}
    assert compared_rows and 2 * compared_rows[0] < len(rows)
    assert {i: (r["links"], r["strong"], r["best"], r["root"]) for i, r in found.items()} == {i: (links[i], strong[i], best[i], root[i]) for i in links}


def test_clusters_of_copies(offers, plain, compared_rows):
    rows, links, _, best, root = plain
    n, top = Counter(root.values()), Counter()
    for i, r in root.items():
        top[r] = max(top[r], best[i])
    found = {r["id"]: (r["root"], r["n"], r["score"], r["status"]) for r in quality.clusters(offers, 9).collect()}
    assert found == {i: (r, n[r], top[r], "probable_duplicate" if top[r] >= 5 else "possible_duplicate") for i, r in root.items()}
    assert 2 * compared_rows[0] < len(rows)


def test_results_are_joined_without_a_broadcast_too(offers, monkeypatch):
    few = {tuple(r) for r in quality.compared(offers, 9).collect()}
    monkeypatch.setattr(quality, "BROADCAST_KINDS", 0)
    assert {tuple(r) for r in quality.compared(offers, 9).collect()} == few


def test_eligibility_by_kinds(offers, plain, compared_rows):
    """Copies used to be shuffled by id, whole."""
    rows, links, _, best, root = plain
    top = Counter()
    for i, r in root.items():
        top[r] = max(top[r], best[i])
    n, review = Counter(), Counter()
    for r in rows:
        probable = top[root.get(r["id"])] >= 5
        outcome = "placeholder_program" if r["origem"] == r["destino"] else "eligible" if r["include"] else r["status"] + "+probable_duplicate" * probable
        n[outcome] += 1
        review[outcome] += r["review"]
    assert {r["outcome"]: (r["n"], r["to_review"]) for r in quality.outcomes(offers, 9).collect()} == {k: (n[k], review[k]) for k in n}
    assert 2 * compared_rows[0] < len(rows)


def test_rows_without_copies_keep_their_ids(spark, compared_rows):
    df = spark.createDataFrame(ledger_rows(90), LEDGER)
    twice = quality.compared(df.union(df), 9)
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in quality.compared(df, 9, once=True).collect()} and compared_rows == [90, 90]


def test_heads_of_ids_are_in_their_order(spark):
    ids = ["", "a", "a\0", "ab", "abcdefg", "abcdefgh", "abcdefgg", "á", "zé", "z", "\U0001f600", "\uffee", "0-1", "10-1", "1-10"]
    heads = [r["h"] for r in spark.createDataFrame([(i,) for i in sorted(ids, key=str.encode)], "id string").select(quality._head().alias("h")).collect()]
    assert None not in heads and heads == sorted(heads) and len(set(heads)) == len(ids) - 3


def test_rounds_go_over_roots(spark, monkeypatch):
    """Each row of a block of several tiles used to go through the rounds, with all its roots."""
    sent = []
    monkeypatch.setattr(tiles, "components", lambda links: sent.append(links.count()) or tiles_components(links))
    found = quality.compared(spark.createDataFrame(ledger_rows(90), LEDGER), 9)
    assert found.count() > 80 and len(sent) == 1 and sent[0] < 45


tiles_components = tiles.components


def test_equal_lines_are_one_line(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("nation", "supplier", "customer", "orders"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    lines.union(lines.filter("l_linenumber < 4")).union(lines.filter("l_linenumber = 1").withColumn("l_partkey", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = ledger(spark, str(tmp_path))
    assert plain.count() > plain.select("id").distinct().count()
    once = ledger(spark, str(tmp_path), once=True)
    assert once.columns == plain.columns and once.exceptAll(plain).isEmpty()
    assert once.count() == once.select("id").distinct().count() == plain.select("id").distinct().count()
