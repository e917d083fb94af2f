"""Operator 11 against a plain repair of each conversation: all edits tried, without signatures."""

import functools
import hashlib
import itertools
import random
import re

import pytest

from granary.llm import repair

TURNS = "conv_id long, turn long, role string, text string, cost int, Audit string"


def faults(rows):
    """rows in order -> (blank, duplicate, truncated) of each."""
    out, seen = [], set()
    for role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        blank, again = said == "", (role, text) in seen
        out.append((blank, not blank and again, not blank and not again and said[-1] not in ".!?"))
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, repaired) by trying all edits, the cheapest and then least first."""
    marks = faults(rows)

    @functools.cache
    def best(i, state):
        """What is left from row i on, after n nothing, s, u or a."""
        says = "a" if state == "u" else "u"
        ways = [(0, "", ())] if i == len(rows) and state in "na" else []
        if state != "a" or i < len(rows):  # insertions: two in a row at most are of use
            ways += [(5 + c, "I" + e, ({"u": "user:", "a": "assistant:"}[says], *out)) for c, e, out in [inserted(i, says, 1)] if c is not None]
        if i < len(rows):
            (role, text), (blank, again, short) = rows[i], marks[i]
            c, e, out = best(i + 1, state)
            ways.append((2 + c, "D" + e, out))
            if not blank and not again:
                for cost, edit, said, to in [(1, "R", {"u": "user", "a": "assistant"}[says], says), *([(0, "K", role, role[:1])] if role[:1] == says or role[:1] == "s" and state == "n" else [])]:
                    c, e, out = best(i + 1, to)
                    ways.append((cost + 5 * short + c, edit + e, (f"{said}:{text}", *out)))
        return min(ways, key=lambda w: w[:2])

    @functools.cache
    def inserted(i, state, n):
        says = "a" if state == "u" else "u"
        ways = [(0, "", ())] if i == len(rows) and state in "na" else []
        if n < 3:
            c, e, out = inserted(i, says, n + 1)
            if c is not None:
                ways.append((5 + c, "I" + e, ({"u": "user:", "a": "assistant:"}[says], *out)))
        if i < len(rows):
            (role, text), (blank, again, short) = rows[i], marks[i]
            c, e, out = best(i + 1, state)
            ways.append((2 + c, "D" + e, out))
            if not blank and not again:
                for cost, edit, said, to in [(1, "R", {"u": "user", "a": "assistant"}[says], says), *([(0, "K", role, role[:1])] if role[:1] == says else [])]:
                    c, e, out = best(i + 1, to)
                    ways.append((cost + 5 * short + c, edit + e, (f"{said}:{text}", *out)))
        return min(ways, key=lambda w: w[:2]) if ways else (None, "", ())

    return best(0, "n")


def row_of(rows):
    """rows (turn, role, text) of a conversation -> what the operator returns of it."""
    rows = [(t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    said = [(r, x) for _, r, x in rows]
    marks = faults(said)
    turns = {t for t, *_ in rows if t is not None}
    cost, audit, out = plain(said)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *[sum(m[k] for m in marks) for k in range(3)], illegal, cost, audit, "\n".join(out))


def conversations(seed, n, longest):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        at, rows = 0, []
        for _ in range(rng.randint(1, longest)):
            at += rng.choice([0, 1, 1, 1, 3])
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "sage"])
            rows.append((rng.choice([at] * 9 + [None]), role, rng.choice(["one.", "two!", "three", "four?  \n", "", " \t", None, "five. ", "cut é"])))
        out[c] = rows + rows[: rng.choice([0, 0, 0, 2])]
    out[None] = out[0]
    return out


@pytest.mark.parametrize(("rows", "size"), [(256, 1 << 22), (1, 1 << 22), (3, 1 << 22), (256, 10)])
def test_repairs(spark, rows, size):
    given = conversations(3, 150, 9)
    given[1_000] = [(i, ["user", "assistant", "tool"][i % 3], f"turn {i}" + "." * (i % 2)) for i in range(60)]
    given[1_001] = [(5, "user", "same.")] * 40 + [(6, "assistant", "x" * 300_000 + ".")]
    df = spark.createDataFrame([(c, t, r, x, 1, "z") for c, turns in given.items() for t, r, x in turns], TURNS).repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(df, rows=rows, size=size).collect()}
    assert got.keys() == given.keys()
    for c, turns in given.items():
        assert got[c] == row_of(turns), c


def test_audit_is_legal_and_cheapest():
    """Every signature of up to three turns and some of four, against all strings of edits."""
    moves = {"K": 0, "R": 1, "D": 2, "I": 5}
    some = random.Random(1).sample(list(itertools.product("suaoUAx", repeat=4)), 40)
    for n in range(5):
        for sig in some if n == 4 else itertools.product("suaoUAx", repeat=n):
            best = None
            for length in range(n, n + 3):
                for edits in itertools.product("DIKR", repeat=length):
                    if sum(e != "I" for e in edits) != n:
                        continue
                    cost, i, roles, ok = 0, 0, "", True
                    for e in edits:
                        if e != "I":
                            mark, i = sig[i], i + 1
                            ok = ok and (e == "D" or mark != "x")
                            cost += 5 * (e != "D" and mark.isupper())
                            roles += {"K": mark.lower(), "R": "*", "D": ""}[e]
                        else:
                            roles += "*"
                        cost += moves[e]
                    m = len(roles)
                    want = "s" * (m % 2) + "ua" * (m // 2)
                    fits = m != 1 and all(a == b or a == "*" and b != "s" for a, b in zip(roles, want, strict=True))
                    if ok and fits and (best is None or (cost, "".join(edits)) < best):
                        best = (cost, "".join(edits))
            found = repair.solved("".join(sig))
            pairs, closing, cost = repair.chosen([[found.get(p, (None, ""))[0] for p in repair.PAIRS]], [[found.get(p, (0, ""))[1] for p in repair.PAIRS]])
            assert (cost, found[repair.PAIRS[pairs[0]]][1] + closing) == best, sig


def test_query(spark):
    turns = spark.createDataFrame([(c, t, r, x, 1, "z") for c, rows in conversations(8, 80, 8).items() for t, r, x in rows], TURNS)
    lots = repair.damaged(turns)
    assert re.fullmatch(r"[0-9a-f]{64}", repair.EMPTY_SHA256) and repair.EMPTY_SHA256 == hashlib.sha256(b"").hexdigest()
    assert lots.columns == ["conv_id", "turn", "role", "text"]
    assert repair.repaired(turns.limit(0)).count() == 0
