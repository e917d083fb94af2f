"""Operator 5 against the plain definition: every line of a run with an earlier copy and enough words goes."""

import random

from granary.llm import lines

SCHEMA = "doc_id long, text string, N_LINES int, lang string"


def plain(rows, least=4):
    """{(id, text): what is left}; documents in order of id (null first), equal rows once."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    cut = {d: d[1].split("\n") for d in docs}
    seen, out = set(), {}
    runs = []
    for d in docs:
        ls = cut[d]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                runs.append((d, a, b))
    gone = {d: set() for d in docs}
    for d, a, b in runs:  # by place of the first line
        key = tuple(cut[d][a:b])
        if key in seen and sum(len(x.split()) for x in key) >= least:
            gone[d].update(range(a, b))
        seen.add(key)
    for d in docs:
        out[d] = "\n".join(x for k, x in enumerate(cut[d]) if k not in gone[d])
    return out


def cases():
    rng = random.Random(3)
    vocab = ["", "", "a", "b c", "one two three", "four five six seven", "x", "long line of some more words"] + [f"line {k} of its own" for k in range(40)]
    rows = [(k, "\n".join(rng.choices(vocab, k=rng.randrange(1, 14)))) for k in range(50)]
    run = "\n".join(rng.choices(vocab, k=9))
    rows += [(60 + k, f"head{k}\n{run}\ntail{k}") for k in range(5)]
    rows += [(70, "p0\na1\nb1\nc1 d1\nq0"), (71, "r0\na1\nb1\nc1 d1\ns0")]  # four words in three lines
    many = "\n".join(f"z{k}" if k % 20 == 0 else "" for k in range(80))
    rows += [(72, f"u0\n{many}\nu1"), (73, f"v0\n{many}\nv1")]  # four words in 80 lines
    rows += [(74, "solo wordy line here\nx9"), (75, "solo wordy line here\ny9"), (76, "solo wordy line here\ny9")]  # the longer copy has another original
    rows += [(80, None), (81, ""), (82, "\n\n\n"), (83, "same same same same\n" * 30), (None, rows[0][1]), (None, "nobody\nelse"), (84, rows[1][1]), (84, rows[1][1])]
    return rows


def test_against_the_definition(spark):
    rows = cases()
    want = plain(rows)
    df = spark.createDataFrame([(i, t, 5, f"l{k}") for k, (i, t) in enumerate(rows)], SCHEMA)
    found = lines.without_repeated_lines(df)
    assert found.columns == ["doc_id", "text", "n_lines", "n_deleted", "runs", "lang"]
    got = {r["lang"]: r for r in found.collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        r = got[f"l{k}"]
        assert (r["doc_id"], r["text"]) == (i, want[(i, t or "")]), k
        assert r["n_lines"] == len((t or "").split("\n")) and r["n_deleted"] == sum(b - a for a, b in r["runs"])
    by_id = {r["doc_id"]: r["text"] for r in got.values()}
    assert by_id[71] == "r0\ns0" and by_id[73] == "v0\nv1" and by_id[76] == "" and by_id[75] == "y9"


def test_empty_and_long(spark):
    assert lines.without_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "\n".join(f"line {k} of a very long text" for k in range(3_000))
    df = spark.createDataFrame([(1, text, 0, ""), (2, "own words stand here\n" + text, 0, "")], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(df).collect()}
    assert got[1] == text and got[2] == "own words stand here"
