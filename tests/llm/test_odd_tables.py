"""Empty tables, repeated rows, clashing columns and very long texts for the operators that are not tested for them elsewhere."""

from granary.llm import bpe, chat, html, licenses, packing, quality, simhash

DOCS = "doc_id long, text string, ID int, matches string, fp string, component int, ids string, kept string, N_Words string"
EXTRA = (7, "m", "f", 1, "i", "k", "w")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], DOCS)


def test_empty(spark):
    empty = docs(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert licenses.scanned(empty).count() == 0
    assert bpe.encoded(empty, decode=True).count() == 0
    assert packing.packed(empty).count() == 0
    assert quality.judged(empty).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    text = "Released under the MIT License. " + "the harbour of the town and the river in winter " * 12
    df = docs(spark, [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "other words " * 3)])
    prints = simhash.near_duplicates(df)
    assert prints.columns == ["id", "fp", "component"]
    got = prints.collect()
    assert len(got) == 6 and len({r["fp"] for r in got if r["id"] in (1, None)}) == 1 and {r["component"] for r in got if r["id"] in (1, None)} == {1}
    assert {r["component"] for r in got if r["id"] in (2, 3)} == {2}  # no words: fingerprint zero, linked
    scans = licenses.scanned(df)
    assert scans.columns == ["doc_id", "matches"]
    assert sorted(str(r["doc_id"]) for r in scans.collect() if r["matches"]) == ["1", "1", "None"]
    assert bpe.encoded(df).columns == ["id", "ids"] and bpe.encoded(df).count() == 6
    assert packing.packed(df).columns == ["id", "start", "length", "crc", "tokens", "sequence", "offset"]
    judged = quality.judged(df)
    assert judged.columns[:2] == ["doc_id", "text"] and dict(judged.dtypes)["kept"] == "boolean" and dict(judged.dtypes)["n_words"] == "bigint" and "matches" in judged.columns
    assert [r["n_words"] for r in judged.collect() if r["doc_id"] == 4] == [6]


def test_very_long(spark):
    text = "Released under the MIT License.\n" * 3_000 + "the harbour of the town and the river " * 40_000
    df = docs(spark, [(1, text), (2, "x" * 3_000_000), (3, text + " end")])
    assert [r["matches"][0]["license"] for r in licenses.scanned(df).orderBy("doc_id").collect() if r["matches"]] == ["MIT", "MIT"]
    assert simhash.near_duplicates(df).count() == 3
    assert {r["doc_id"]: r["n_words"] for r in quality.judged(df).select("doc_id", "n_words").collect()} == {1: len(text.split()), 2: 1, 3: len(text.split()) + 1}


def test_repeated_turns_and_pages(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", 5)] * 2 + [(1, 1, "assistant", "b", 5)] * 2, "conv_id long, turn long, role string, text string, targets int")
    got = chat.digests(chat.formatted(turns)).first()
    assert got["n_turns"] == 4 and got["loss_chars"] == 2
    page = "<article><p>one story</p></article>"
    pages = spark.createDataFrame([(1, "u", page, 3)] * 2 + [(2, "u", page, 3)], "page_id long, url string, html string, Text int")
    assert sorted(map(tuple, html.main_text(pages).collect())) == [(1, "u", "one story"), (1, "u", "one story"), (2, "u", "one story")]
