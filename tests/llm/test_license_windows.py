"""Operator 8 finds notices inside lines, further licences and whole texts."""

from collections import Counter

from granary.llm import licenses


def brute(text, template, threshold=0.8):
    ws, t = licenses._words(text), Counter(licenses.Scanner._bigrams(licenses._words(template)))
    grams = licenses.Scanner._bigrams(ws)
    return max((2 * (Counter(grams[a:b]) & t).total() / (b - a + t.total()) for a in range(len(grams)) for b in range(a + 1, len(grams) + 1)), default=0)


def test_notices_in_lines(spark):
    filler = "the harbour of the town and the river in winter " * 30
    texts = {
        "MIT": ["Copyright 2020 Foo Inc. Released under the MIT License.", f"{filler}Released under the MIT License. {filler}", f"a\n{filler}released under\nthe MIT license {filler}"],
        "Apache-2.0": [f"{filler}Licensed under the Apache License, Version 2.0. {filler}"],
        "ISC": ["(c) 2021 x. Released under the ISC License. More words here"],
        "BSD-3-Clause": ["x y z licensed under the BSD 3-Clause License and others"],
        "MPL-2.0": ["Note that this Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"],
        "LGPL-2.1": ["well, this work is licensed under the GNU Lesser General Public License, version 2.1, and so on"],
    }
    texts |= {name: [f"{filler}\n{licenses.all_templates()[name]}\n{filler}"] for name in ("MIT-text", "ISC-text", "Apache-2.0-text", "GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "LGPL-3.0-text", "MPL-2.0-text", "BSD-3-Clause-text")}
    rows = [(f"{name}/{k}", t) for name, ts in texts.items() for k, t in enumerate(ts)] + [("none/0", filler * 20)]
    got = {r["doc_id"]: r["matches"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for id_, _ in rows:
        name = id_.split("/")[0]
        assert got[id_] == [] if name == "none" else any(m["license"] == name and m["dice"] == 1.0 for m in got[id_]), id_
    assert [(m["first_line"], m["n_lines"]) for m in got["MIT/2"] if m["license"] == "MIT"] == [(1, 2)]


def test_best_window_against_brute_force():
    template = "a b c a b d a b"
    scanner = licenses.Scanner({"t": template}, 0.8)
    for text in ("x a b c a b d a b y", "a b a b a b a b c a b", "a b c x a b d a b", "q a b c a b d", "a b c a b d d a b c a b d a"):
        want = brute(text, template)
        got = scanner.scan(text)
        assert (got[0][1] if got else None) == (want if want >= 0.8 else None)


def test_versions_are_told_apart():
    scanner = licenses.Scanner(licenses.all_templates(), 0.8)
    for name in licenses.ALIKE:
        assert [m[0] for m in scanner.scan(f"see: {licenses.all_templates()[name]}")] == [name]
    both = f"{licenses.all_templates()['GPL-2.0']}\nand\n{licenses.all_templates()['LGPL-3.0']}"
    assert [m[0] for m in scanner.scan(both)] == ["GPL-2.0", "LGPL-3.0"]


def test_sql_has_the_same_windows(spark, tmp_path):
    """The oracle compares all windows of all templates too: notices in lines, overlapping versions, whole texts."""
    import duckdb

    t, filler = licenses.all_templates(), "the harbour of the town and the river in winter "
    rows = [
        (1, f"{filler}Released under the MIT License. {filler}"), (2, f"a\n{filler}released under\nthe MIT license {filler}"), (3, f"{t['GPL-2.0']}\nand {t['LGPL-3.0']} {t['GPL-3.0']}"), (4, f"see {t['ISC-text']} x {t['ISC']}"),
        (5, None), (6, f"x {t['MIT-permission']} y"), (7, f"This work is licensed under the GNU General Public License {t['LGPL-2.1']}"), (8, f"{t['Apache-2.0-header']} {t['Apache-2.0']}\n{t['BSD-3-Clause']}"), (9, ""),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, n_matches, license, dice, first_line, n_lines"
    got = sorted(map(tuple, licenses.op8_license_scan(spark, str(tmp_path)).select(*names.split(", ")).collect()))
    assert got == sorted(con.execute(f"SELECT {names} FROM ({licenses.OP8_SQL})").fetchall())
    assert [r[1] > 0 for r in got] == [True] * 4 + [False] + [True] * 3 + [False]
