"""Cuts of long texts never fall between a run of white space and the next word: operators 3 and 10."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from granary.llm import bpe, packing
from granary.llm.tokens import JSON, PATTERN, RANKS, encoder, ids_of, vocabulary

PARTS = ["a", "b", "word", "'ll", "'s", " ", "  ", "\n", "\n\n", "\r\n", "\t", ".", "!?", "1", "é", "中文", "\x1c", "　", "\xa0", "<|endoftext|>"]
PATH, JSON_PATH = vocabulary(RANKS), vocabulary(JSON)
LONG = ["\n" + "ab\n\n" * 10_000, " " + "word\n\n" * 30_000, "  x" * 60_000 + " " * 300_000 + "y\n\n\nz" * 30_000]


def random_texts(n, least, most, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(least, most))) for _ in range(n)]


@pytest.mark.parametrize("safe", [1, 3, 8, 17])
def test_parts(safe):
    whole, tokenizer = encoder(PATH), Tokenizer.from_file(JSON_PATH)
    mine, with_added = ids_of(PATH, safe=safe), ids_of(JSON_PATH, added_tokens=True, safe=safe)
    for t in random_texts(1500, 0, 60):
        assert mine(t).tolist() == whole.encode_ordinary(t)
        assert with_added(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_every_shift():
    whole, mine = encoder(PATH), ids_of(PATH, safe=16)
    for unit in ("ab\n\n", "double  space ", "line\r\n\r\n", "\tx\t\t", "a \n b"):
        for shift in range(20):
            t = "q" * shift + unit * 12
            assert mine(t).tolist() == whole.encode_ordinary(t)


@pytest.mark.parametrize(("chunk", "overlap"), [(16, 12), (32, 16), (50, 30)])
def test_stitches(chunk, overlap):
    whole = encoder(PATH)
    kind = pa.schema([("uid", pa.int64()), ("id", pa.int64()), ("text", pa.string())])
    for t in random_texts(600, 40, 300):
        chunks = list(bpe.chunks_of([pa.RecordBatch.from_pylist([{"uid": 0, "id": 0, "text": t}], schema=kind)], chunk, overlap))
        seen = [r for b in bpe.scan_chunks(chunks, PATTERN, chunk, overlap) for r in b.to_pylist()]
        cuts = bpe.boundaries(t, [r["head"] for r in seen], [r["tail"] for r in seen], PATTERN, chunk)
        assert sum((whole.encode_ordinary(t[a:b]) for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True)), []) == whole.encode_ordinary(t)


def test_spark(spark):
    texts = LONG + random_texts(40, 100, 900, 7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, tokenizer = encoder(PATH), Tokenizer.from_file(JSON_PATH)
    for got in (bpe.encoded(df, decode=True).collect(), bpe.encoded(df, chunk=256, overlap=32, decode=True).collect()):
        assert len(got) == len(texts)
        for r in got:
            assert np.frombuffer(r["ids"], np.uint32).tolist() == whole.encode_ordinary(texts[r["id"]]) and bytes(r["decoded"]).decode() == texts[r["id"]]
    lengths = {r["doc_id"]: r["doc_tokens"] for r in packing.pieces_of(df).collect()}
    assert all(lengths[i] == len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts))
