"""Operator 3 gives the ids of the tokenizers library for texts that hold an added token."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from granary.llm import packing
from granary.llm.tokens import JSON, vocabulary


def test_added_tokens(spark):
    t = Tokenizer.from_file(vocabulary(JSON))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext|", " <|ENDOFTEXT|> ", "é  <|endoftext|>\n\n don't"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = {r["doc_id"]: r for r in packing.pieces_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (got[i]["doc_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
