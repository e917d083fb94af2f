"""Vocabulary files and byte-level BPE encoders (operators 3 and 10).

Files are opened by path on each executor, where they are installed; the path
is a parameter.  An encoder is built once a Python worker.
"""

from __future__ import annotations

import base64
import functools
import json

import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
JSON = "byte_bpe_50k.json"
PATTERN = public_tokenizers.PATTERN
#: Characters that are handed to tiktoken's own splitter at once; a white-space run of some millions overflows its stack.
SAFE = 1 << 17


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE files: printable bytes stand for themselves, the others for code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id of a .tiktoken rank file or a tokenizers .json file, without special tokens."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
        byte = _byte_of_char()
        return {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def added(path: str) -> dict[str, int]:
    """The added tokens of a tokenizers .json file, which stand for themselves wherever a text holds them."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    for t in tokens:
        if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"):
            raise ValueError(f"unsupported flags of the added token {t['content']!r}")
    return {t["content"]: t["id"] for t in tokens}


@functools.lru_cache(maxsize=4)
def encoder_with_added(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The encoder of a tokenizers .json file; encode(text, allowed_special="all") gives the ids of Tokenizer.encode."""
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens=added(path))


def cuts_behind(text: str, end: int) -> bool:
    """Whether a text may be cut behind a match that ends there.

    The pattern looks ahead only to see whether white space ends, so without what follows
    a run of white space is matched otherwise (all of it, also its last character, which
    goes with the next word); no other match changes, nor any before it.
    """
    return not text[end - 1].isspace()


def ids_of(path: str, added_tokens: bool = False, pattern: str = PATTERN, safe: int = SAFE) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (uint32), for texts and pattern matches of any length.

    Texts of up to safe characters go to tiktoken whole.  Longer ones are cut behind
    matches of the pattern that do not end in white space (see ``cuts_behind``), into parts
    of at most safe characters.  Where none is in reach, the matches are merged one by one.
    """
    enc = encoder_with_added(path, pattern) if added_tokens else encoder(path, pattern)
    marks = added(path) if added_tokens else {}
    split = re.compile("|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))) if marks else None
    match = regex.compile(pattern)

    def plain(text: str):
        start = cut = 0  # what is not encoded yet, and where it can be cut
        behind: list[tuple[int, int]] = []  # the matches behind the cut
        for m in match.finditer(text):
            if m.end() - start > safe and cut > start:
                yield enc.encode_ordinary(text[start:cut])
                start = cut
            behind.append(m.span())
            if m.end() - start > safe:
                for a, b in behind:
                    yield enc._encode_single_piece(text[a:b])
                start = m.end()
            if start == m.end() or cuts_behind(text, m.end()):
                cut = m.end()
                behind.clear()
        if start < len(text):
            yield enc.encode_ordinary(text[start:])

    def parts(text: str):
        at = 0
        for m in split.finditer(text) if split else ():
            yield from plain(text[at : m.start()])
            yield [marks[m.group()]]
            at = m.end()
        yield from plain(text[at:] if at else text)

    def ids(text: str) -> np.ndarray:
        if len(text) <= safe:
            return np.array(enc.encode(text, allowed_special="all") if marks else enc.encode_ordinary(text), np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *[np.array(p, np.uint32) for p in parts(text)]])

    return ids


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(all token bytes end to end, n + 1 offsets by id); unused ids are empty."""
    table = ranks(path)
    parts = [b""] * (max(table.values()) + 1)
    for t, i in table.items():
        parts[i] = t
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
