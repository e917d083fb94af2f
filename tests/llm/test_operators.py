"""The dealt operators against brute force, and their defined results for nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import bpe, chat, html, licenses, lines, packing, passages, quality, search, simhash
from granary.llm.tokens import JSON, RANKS, PATTERN, ranks, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, N_Words int"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    passage = " ".join(rng.choices(vocab, k=50))
    rows = [(i, "\n".join(" ".join(rng.choices(vocab, k=rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8)))) for i in range(n)]
    rows += [(n + i, f"{rows[i][1]}\n{passage} tail{i}") for i in range(8)]
    rows += [(n + 10, rows[3][1]), (n + 11, rows[3][1] + " x"), (n + 12, None), (n + 13, ""), (n + 14, " \t\n"), (n + 15, "a b c a b c a b c " * 2000), (None, "alone " + rows[5][1])]
    return [(i, t, None, 7) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), DOCS)


def test_substring_dedup(spark, docs):
    w = 35
    seen = Counter()
    split = [(i, WORD.findall(t or "")) for i, t, *_ in texts()]
    for _, ws in split:
        seen.update(tuple(ws[k : k + w]) for k in range(len(ws) - w + 1))
    want = {}
    for i, ws in split:
        gone = {k + o for k in range(len(ws) - w + 1) if seen[tuple(ws[k : k + w])] > 1 for o in range(w)}
        want[i] = (len(ws), len(gone), " ".join(x for k, x in enumerate(ws) if k not in gone))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in passages.without_repeats(docs).collect()}
    assert got == want
    assert passages.without_repeats(docs.limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(330, 12)).astype(np.float32)
    x[40:80] = x[3]  # ties
    x[5, 2], x[150, 2], x[7, 0] = 600_000.0, -3e6, 1e9  # large components count like any other
    rows = [(i, [float(v) for v in x[i]], 1, 0.5) for i in range(330)] + [(400, None, 1, 0.5), (401, [1.0, None] + [0.0] * 10, 1, 0.5), (450, [float("nan")] * 12, 1, 0.5), (500, [float("inf")] * 12, 1, 0.5)]
    rows += [(300, [float(v) for v in x[0]], 1, 0.5), (300, [float(v) for v in x[0]], 1, 0.5), (None, [1.0] * 12, 1, 0.5)]  # rows that repeat or share an id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, Rank double")
    ids = [*range(330), 300, 300]
    q = np.floor(256 * np.vstack([x, x[:1], x[:1]]).astype(np.float64)).astype(np.int64).astype(object)
    want = []
    for r, i in enumerate(ids):
        if i % 50 == 0:
            s = q @ q[r]
            best = sorted((-int(s[j]), ids[j]) for j in range(len(ids)) if j != r)[:5]
            want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(best)]
    got = search.top_k(df, F.col("vec_id") % 50 == 0, block_rows=(64, 64), group_rows=(2, 2))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert search.top_k(df.limit(3), F.lit(True)).count() == 6  # all, if fewer than k
    too_large = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        search.top_k(too_large, F.lit(True)).collect()


def test_packing(spark, docs):
    t = Tokenizer.from_file(vocabulary(JSON))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in texts()}
    fill = defaultdict(list)
    seen = defaultdict(int)
    for r in packing.pieces_of(docs).collect():
        ids = want[r["doc_id"]]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes())
        seen[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: len(ids) for i, ids in want.items()}
    for spans in fill.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= 1024
    assert packing.pieces_of(docs.limit(0)).count() == 0


def test_quality_rules(spark, docs):
    got = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    for i, text, *_ in texts():
        t = text or ""
        ws = WORD.findall(t)
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        repeated = {k + o for k, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for o in range(3)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(ls) - len(set(ls)), len(repeated))
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)) and not (r["base_failed"] and r["kept"])
    assert quality.judged(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    block = "one two three four five\n\nsix seven eight nine"
    rows = [(1, f"head a b c\n{block}\ntail"), (2, f"other\n{block}\nend"), (3, None), (4, ""), (5, "short\nshort")]
    got = {r["doc_id"]: r for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "other\nend" and got[2]["n_deleted"] == 3
    assert [tuple(r) for r in got[2]["runs"]] == [(1, 4)]
    assert got[3]["text"] == "" and got[5]["text"] == "short\nshort"


def fingerprint(text):
    ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    grams = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    got = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: fingerprint(t) for i, t, *_ in texts()}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base) | {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)}
    fps |= {(7 << 32) | (1 << a) | (1 << b) for a in range(12) for b in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from granary.llm.graph import components

    for dense in (4, 1000):
        links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense)
        roots = {r["node"]: r["root"] for r in components(links).collect()}
        parent = {f: f for f in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in signed:
            for b in signed:
                if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        assert {f: roots.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_html(spark):
    menu = "Home News Sport Weather Travel Money Culture Shop Contact About"
    rows = [(1, "https://a.example/1", "<body><nav>x</nav><article><h1>T &amp; U</h1><p>one  two<br>three</p><script>no</script></article><footer>f</footer></body>"), (2, "u", None)]
    rows += [(10 + i, f"https://b.example/{i}", f"<body><div>{menu}</div><div>n{i} has its own unique words {i * 7}</div></body>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].startswith("T & U\n") and "no" not in got[1].split() and "f" not in got[1].split() and got[2] == ""
    assert all(got[10 + i] == f"n{i} has its own unique words {i * 7}" for i in range(4))


def test_licenses(spark):
    rows = [(1, "words\nReleased under the MIT License.\nmore"), (2, None), (3, "Licensed under the Apache License,\n\nVersion 2.0."), (4, "the license is under review"), (5, "released UNDER the mit license")]
    got = {r["doc_id"]: r["matches"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(m["license"], m["dice"], m["first_line"], m["n_lines"]) for m in got[1]] == [("MIT", 1.0, 1, 1)]
    assert got[2] == [] and got[4] == [] and got[3][0]["license"] == "Apache-2.0" and got[3][0]["n_lines"] == 3 and got[5][0]["dice"] == 1.0


def test_chat(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]) if t else "system", None if rng.random() < 0.1 else "<turn>\\b </turn> " + "é " * rng.randrange(200)) for c in range(6) for t in range(rng.randrange(1, 25))]
    rows += [(50, 0, None, "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_byte_bpe(spark, docs):
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary(RANKS)), special_tokens={})
    long = [(900, "x" * 700 + " 123 \n\n  don't " * 40 + "é\U0001f600" * 90), (901, " " * 900), (902, "z" * 900)]
    rows = [(i, t) for i, t, *_ in texts()] + long
    got = {r["id"]: r for r in bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string"), chunk=128, overlap=32, decode=True).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i]["ids"], np.uint32).tolist() == enc.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]).decode() == (t or "")
