"""The whole pipeline against a plain version of every stage."""

import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as p
from granary.llm import quality
from granary.llm.tokens import JSON, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(31)
    vocab = "the of and to in that is for harbour winter letter stone river market engine valley garden window silver copper".split() * 12 + [f"w{i}" for i in range(400)]
    prose = lambda n: "\n".join(" ".join(rng.choices(vocab, k=rng.randrange(6, 14))) for _ in range(n))
    passage, block = prose(6), prose(2)
    rows = [(i, prose(rng.randrange(8, 20))) for i in range(30)]
    rows += [(100 + i, f"{prose(9)}\n{passage.replace(chr(10), ' ')} {prose(8)}") for i in range(4)]  # a passage inside a line
    rows += [(110 + i, f"{prose(7)}\n{block}\n{prose(7)}") for i in range(4)]  # repeated lines
    for i in range(4):  # near copies, each line touched so that line dedup leaves them
        base = rows[i][1].split("\n")
        copy = [" ".join(w if k else w + "x" for k, w in enumerate(line.split(" "))) if j % 9 == 0 else line + " " for j, line in enumerate(base)]
        rows.append((120 + i, "\n".join(copy)))
    rows += [(130, rows[5][1]), (131, "too short"), (132, None), (133, ""), (134, "a b c " * 60), (135, "### $$$ %%% " * 40), (136, "ZZZZ QQQQ " + "XYXYX PLMOK " * 30), (137, " ".join(f"q{i}z" for i in range(200)))]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def kept(text):
    """The threshold table on one text."""
    t = text or ""
    ws = WORD.findall(t)
    n = len(ws)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    repeated = {k + o for k, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for o in range(3)}
    cases = Counter(unicodedata.category(c) for c in t)
    up, low = cases["Lu"], cases["Ll"]
    m = {
        "n_words": n, "repeat_share": len(repeated) / n if n else 0, "mean_word_chars": sum(map(len, ws)) / n if n else 0, "symbols_per_word": sum(c in quality.SYMBOLS for c in t) / n if n else 0,
        "stop_word_share": sum(w.lower() in quality.STOP_WORDS for w in ws) / n if n else 0, "lower_share": low / (up + low) if up + low else 1, "dup_line_share": (len(lines) - len(set(lines))) / len(lines) if lines else 0,
    }
    return all((r.low is None or m[r.measure] >= r.low) and (r.high is None or m[r.measure] <= r.high) for r in (*quality.BASE_RULES, *quality.RULES))


def without_lines(docs):
    seen, out = set(), []
    for i, t in sorted(docs):
        ls = t.split("\n")
        gone = set()
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                key = tuple(ls[a:b])
                if key in seen and sum(len(WORD.findall(x)) for x in key) >= 4:
                    gone.update(range(a, b))
                seen.add(key)
        out.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return out


def without_near_copies(docs):
    def grams(t):
        ws = [w.lower() for w in WORD.findall(t)]
        return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()

    sets, root = {i: grams(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, t) for i, t in docs if find(i) == i]


def without_passages(docs, w=35):
    seen, spans = Counter(), {i: list(WORD.finditer(t)) for i, t in docs}
    words = {i: [m.group() for m in s] for i, s in spans.items()}
    for ws in words.values():
        seen.update(tuple(ws[k : k + w]) for k in range(len(ws) - w + 1))
    out = []
    for i, t in docs:
        ws, s = words[i], spans[i]
        cut = {k + o for k in range(len(ws) - w + 1) if seen[tuple(ws[k : k + w])] > 1 for o in range(w)}
        drop = set()
        for k in cut:
            drop.update(range(s[k].start(), s[k + 1].start() if k + 1 < len(s) else len(t)))
        out.append((i, "".join(c for x, c in enumerate(t) if x not in drop)))
    return out


def test_every_stage(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = [(i, t or "") for i, t, *_ in rows if kept(t)]
    counts = [len(rows), len(want)]
    plain = (lambda d: d, without_lines, without_near_copies, without_passages)
    for (name, stage), step in zip(p.STAGES[:-1], plain, strict=True):
        docs = stage(spark, docs, "")
        before, want = want, step(want)
        got = docs.collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want), name
        assert all(r["n_chars"] == len(r["text"]) and r["lang"] == "en" for r in got), name
        assert name == "quality_rules" or before != want, name  # each stage has something to do
        docs = spark.createDataFrame([tuple(r) for r in got], SCHEMA)
        counts.append(len(want))
    assert counts[0] > counts[1] > counts[4]
    tokens = Tokenizer.from_file(vocabulary(JSON))
    ids = {i: [*tokens.encode(t, add_special_tokens=False).ids, 0] for i, t in want}
    length = Counter()
    for r in p.pack(spark, docs, "").collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        length[r["doc_id"]] += r["length"]
    assert length == {i: len(x) for i, x in ids.items()}


def test_clashing_columns_pass(spark):
    rows = [(i, t, "en", "s", n, f"kept{i}", i, f"runs{i}") for i, t, _, _, n in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept string, n_words long, runs string")
    for name, stage in p.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert all(r["kept"] == f"kept{r['doc_id']}" and r["n_words"] == r["doc_id"] and r["runs"] == f"runs{r['doc_id']}" for r in docs.collect()), name


def test_stages_take_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (None, "x " * 80, None, "s", None)], SCHEMA)
    for name, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        assert stage(spark, odd, "").columns == stage(spark, empty, "").columns, name
        assert stage(spark, odd, "").count() >= 0, name
