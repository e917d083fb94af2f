"""Very long white space and words, and overlaps without a common boundary: operators 3 and 10."""

import zlib

import numpy as np
import regex

from granary.llm import bpe, packing
from granary.llm.tokens import JSON, PATTERN, RANKS, encoder, vocabulary

TEXTS = ["a b" + " " * 2_000_000 + "c", "x" * 300_000 + " y", "\n" * 400_000 + "z", "word " * 30_000 + " " * 200_000 + "é" * 50_000 + " tail 12 don't" * 2_000, None, ""]


def ids(text, name):
    enc = encoder(vocabulary(name))
    return [t for m in regex.findall(PATTERN, text or "") for t in enc._encode_single_piece(m)]


def test_byte_bpe(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in bpe.encoded(df, decode=True).collect():
        text = TEXTS[r["id"]] or ""
        assert np.frombuffer(r["ids"], np.uint32).tolist() == ids(text, RANKS) and bytes(r["decoded"]).decode() == text


def test_read_on_behind_a_long_pre_token(spark):
    """Only the part around the long pre-token becomes one piece; the rest is cut at the chunks."""
    text = "ab cd ef " * 40 + "q" * 500 + " gh ij" * 200
    parts = bpe.pieces(spark.createDataFrame([(1, text)], "id long, text string"), chunk=128, overlap=32).orderBy("piece").collect()
    assert "".join(p["text"] for p in parts) == text and len(parts) > 8
    assert max(len(p["text"]) for p in parts) < 128 + 500 + 3 * 160
    assert sum((ids(p["text"], RANKS) for p in parts), []) == ids(text, RANKS)


def test_packing(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = packing.pieces_of(df).collect()
    for i, text in enumerate(TEXTS):
        want = [*ids(text, JSON), 0]
        mine = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(want)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine)


def test_packers(spark):
    """Equal rows spread over several packers; the rule and the fill are those of a plain version."""
    rows = [(None, "same text again")] * 200 + [(i, "w " * (i % 700)) for i in range(300)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), window=64, packer_rows=100).collect()
    assert len({r["sequence"] >> 32 for r in out}) == 5
    assert len({r["sequence"] >> 32 for r in out if r["id"] is None}) == 5
    fill = {}
    for r in out:
        fill[r["sequence"]] = fill.get(r["sequence"], 0) + r["length"]
    assert max(fill.values()) <= 64 and sum(64 - n for n in fill.values()) < 0.1 * 64 * len(fill)
    sizes = [17, 30, 5, 60, 17, 40, 3, 22, 41, 30, 10, 5]
    sos, level = packing.SumOfSquares(64), [0] * 65
    for n in sizes:
        options = []
        for at in range(64 - n + 1):
            if at == 0 or level[at]:
                after = list(level)
                if at:
                    after[at] -= 1
                if at + n < 64:
                    after[at + n] += 1
                options.append((sum(x * x for x in after), after))
        seq, at = sos.place(n)
        best = min(o[0] for o in options)
        if at:
            level[at] -= 1
        if at + n < 64:
            level[at + n] += 1
        assert sum(x * x for x in level) == best
