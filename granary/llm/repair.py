"""Operator 11: conversation structure repair by signature deduplication.

Each turn is one symbol: its role's initial and its fault.  The symbols of a conversation
in order are its signature, and conversations with one signature are repaired by the same
edits, so each distinct signature is solved once and the edits are replayed on all that
bear it:

1. identical turns are counted, added up before the shuffle; the first turn of each role
   and text in a conversation is found by a minimum, and every later one is a duplicate;
2. one range exchange sorts the turns by conversation and turn.  Each range writes its
   conversations as *segments* of at most ``SEGMENT_ROWS`` turns and about
   ``SEGMENT_BYTES`` bytes, with a signature each.  All conversations but very long ones
   are one segment;
3. distinct signatures are solved by recursion on their halves, memoised, for every state
   that the roles before may have left and every one that they may leave behind;
4. costs and edits are joined back by signature.  Segments of one conversation are put
   together from their costs alone, 16 numbers a segment;
5. edits are replayed segment by segment, wherever they lie, and a conversation's audit and
   hash come from its repaired segments.

A turn is *blank* if its text has only white space, else a *duplicate* if its role and text
came earlier in the conversation, else *truncated* if its last character that is not white
space is none of ``.!?``.  Edits: K keeps a turn (0), R gives it the role user or
assistant (1), D deletes it (2; blank and duplicate turns must go), I inserts an empty turn
of user or assistant anywhere (5); a truncated turn that stays costs 5.  The roles that
result are none, or one system turn or none followed by pairs of user and assistant.  Of the
cheapest edits the ASCII-least initials count.  Given its initials a repair is unique: the
place of a turn decides its role.

Least initials can be put together from halves: of two repairs of a part that lead from one
state to another at equal cost, neither is the beginning of the other, as what is longer
would hold insertions at the end and cost more.

Null roles and texts count as one space, null turns come first and null conversation ids
are one conversation.  Turns of equal number are ordered by role and text; repeated rows are
turns of their own, duplicates of the first.  A role's initial is its first character; an
empty role has one that fits nowhere.  A very long text is one turn and a segment by
itself.  A conversation with one turn number only has no gap.  An empty table gives an empty
result; other columns are not passed through, so their names cannot clash.  A conversation's
audit and hash are one row by contract: its edits and its repaired text meet there, and
only there.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD, mark, release, row_slices, shared_dir, table, written

SEGMENT_ROWS, SEGMENT_BYTES = 256, 4 << 20
#: Characters of a text in the key that turns are dealt out by; it only tells turns of one number and role apart.
KEY_CHARS = 32
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: Signatures and parts of them that a Python worker remembers: some 5 KB each at most.
_MEMO = 1 << 13

#: States: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_SPEAKS = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_INITIAL = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
#: What closes a conversation: insertions until the last turn is an assistant's.
_CLOSING = {NOTHING: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}
PAIRS = [(p, q) for p in range(4) for q in range(4)]


# ------------------------------------------------------------------ signatures


def symbol(initial: Column, gone: Column, short: Column) -> Column:
    """x for a turn that must go; s, u, a or o (any other role), in capitals if truncated."""
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(gone, "x").when(short, F.upper(role)).otherwise(role)


def _one(mark: str) -> dict:
    """(from state, to state) -> (cost, edits) for insertions before one turn and the turn's edit."""
    best: dict = {}
    role, short = mark.lower(), CUT_SHORT if mark.isupper() else 0
    for p in range(4):
        state, cost, edits = p, 0, ""
        for _ in range(3):
            options = [(state, DELETE, "D")]
            if mark != "x":
                said = _SPEAKS[state]
                options += [(said, REROLE + short, "R")]
                if role == _INITIAL[said]:
                    options += [(said, KEEP + short, "K")]
                if role == "s" and state == NOTHING:
                    options += [(SYSTEM, KEEP + short, "K")]
            for q, c, e in options:
                found = (cost + c, edits + e)
                if (p, q) not in best or found < best[p, q]:
                    best[p, q] = found
            state, cost, edits = _SPEAKS[state], cost + INSERT, edits + "I"
    return best


@functools.lru_cache(maxsize=_MEMO)
def solved(signature: str) -> dict:
    """(from state, to state) -> (cost, ASCII-least cheapest edits) of a signature, by its halves."""
    if not signature:
        return {(p, p): (0, "") for p in range(4)}
    if len(signature) == 1:
        return _one(signature)
    half = len(signature) // 2
    left, right, best = solved(signature[:half]), solved(signature[half:]), {}
    for (p, m), (c, e) in left.items():
        for q in range(4):
            if (m, q) in right:
                found = (c + right[m, q][0], e + right[m, q][1])
                if (p, q) not in best or found < best[p, q]:
                    best[p, q] = found
    return best


def _solve_batches(batches):
    """(sig) -> (sig, costs, ranks, edits) over PAIRS, ranks being the places of the edits in ASCII order; null where no repair leads there."""
    for batch in batches:
        costs, ranks, edits = [], [], []
        for s in batch.column(0).to_pylist():
            found = solved(s)
            costs.append([found[k][0] if k in found else None for k in PAIRS])
            edits.append([found[k][1] if k in found else None for k in PAIRS])
            place = {e: i for i, e in enumerate(sorted({e for _, e in found.values()}))}
            ranks.append([place[found[k][1]] if k in found else None for k in PAIRS])
        numbers = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, numbers), pa.array(ranks, numbers), pa.array(edits, pa.list_(pa.string()))], names=["sig", "costs", "ranks", "edits"])


# -------------------------------------------------------------------- segments


def turns_of(rows: DataFrame) -> DataFrame:
    """(c, t, role, text) -> the distinct ones with their count n, fault and symbol."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    counted = written(rows.groupBy("c", "t", "role", "text").agg(F.count("*").alias("n")).withColumn("d", digest))
    when = F.struct(F.col("t").isNotNull().alias("some"), "t")
    first = written(counted.groupBy("c", "d").agg(F.min(when).alias("first")))
    blank = ~F.col("text").rlike(WORD)
    said = F.rtrim(F.col("text"), F.lit(SPACE_CHARS))
    joined = counted.alias("x").join(first.alias("y"), F.col("x.c").eqNullSafe(F.col("y.c")) & (F.col("x.d") == F.col("y.d"))).select("x.*", "first")
    marked = joined.withColumns({"blank": blank, "again": ~blank & (F.col("first") != when), "short": ~F.substring(said, -1, 1).isin(".", "!", "?")})
    return marked.select("c", "t", "role", "text", "n", "d", "blank", "again", symbol(F.substring("role", 1, 1), F.col("blank") | F.col("again"), F.col("short")).alias("sym"))


_SEGMENT = "c {c}, part int, k long, sig string, roles array<string>, texts array<string>, head string, tail string, low {t}, high {t}, first_turn {t}, last_turn {t}, turns long, blank long, duplicate long, truncated long, illegal long"
_LEGAL = {"su", "ua", "au"}


def _segments(batches, rows: int, size: int):
    """Sorted turns (part, c, t, role, text, n, blank, again, sym) of a range -> its segments; a turn of n copies is followed by n - 1 duplicates."""
    names = ["c", "part", "k", "sig", "roles", "texts", "head", "tail", "low", "high", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal"]
    now, k, held, waiting, out, types = None, 0, 0, 0, [], None

    def begun(c, part, t, role) -> dict:
        return dict.fromkeys(names) | dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0) | {"c": c, "part": part, "k": k, "sig": [], "roles": [], "texts": [], "first_turn": t, "head": role[:1]}

    def flushed() -> pa.RecordBatch:
        for s in out:
            s["sig"] = "".join(s["sig"])
        done = pa.RecordBatch.from_arrays([pa.array([s[x] for s in out], y) for x, y in zip(names, types, strict=True)], names=names)
        out.clear()
        return done

    for batch in batches:
        kinds, text, number = (batch.schema.field("c").type, batch.schema.field("t").type), pa.string(), pa.int64()
        types = [kinds[0], pa.int32(), number, text, pa.list_(text), pa.list_(text), text, text, *[kinds[1]] * 4, *[number] * 5]
        for a, b in row_slices(batch.column(4)):
            for part, c, t, role, text, n, blank, again, sym in zip(*[x.to_pylist() for x in batch.slice(a, b - a).columns], strict=True):
                for copy in range(n):
                    if now is None or now["c"] != c or len(now["sig"]) >= rows or held > size:
                        if now is not None:
                            out.append(now)
                            waiting += len(now["sig"]) + held // 1024
                        if waiting > 16 * rows:
                            yield flushed()
                            waiting = 0
                        now, held, k = begun(c, part, t, role), 0, k + 1
                    else:
                        now["illegal"] += now["tail"] + role[:1] not in _LEGAL
                    mark = sym if copy == 0 else "x"
                    now["sig"].append(mark)
                    now["roles"].append(None if mark == "x" else role)
                    now["texts"].append(None if mark == "x" else text)
                    held += 0 if mark == "x" else len(text)
                    now["tail"] = role[:1]
                    now["blank"] += blank
                    now["duplicate"] += not blank and (again or copy > 0)
                    now["truncated"] += mark.isupper()
                    if t is not None and t != now["high"]:
                        now["turns"] += 1
                        now["low"], now["high"] = t if now["low"] is None else now["low"], t
                    now["last_turn"] = t
    if now is not None:
        out.append(now)
    if out:
        yield flushed()


# ------------------------------------------------------------------- composing


def chosen(costs: list[list], ranks: list[list]) -> tuple[list[int], str, int]:
    """The pairs of states that the segments of one conversation take, what closes it and its cost: the least cost of the whole, then the least edits, segment by segment."""
    rest = [[_CLOSING[q][0] for q in range(4)]]
    for row in reversed(costs):
        rest.append([min((row[4 * p + q] + rest[-1][q] for q in range(4) if row[4 * p + q] is not None), default=math.inf) for p in range(4)])
    rest.reverse()
    state, pairs = NOTHING, []
    for i, (row, rank) in enumerate(zip(costs, ranks, strict=True)):
        ways = [4 * state + q for q in range(4) if row[4 * state + q] is not None and row[4 * state + q] + rest[i + 1][q] == rest[i][state]]
        pairs.append(min(ways, key=rank.__getitem__))
        state = pairs[-1] % 4
    return pairs, _CLOSING[state][1], rest[0][NOTHING]


def _choose_batches(batches):
    """(c, part, k, costs, ranks), sorted by conversation and place -> (part, k, pair, closing, cost); closing and cost stand with the last segment."""
    held, now, out = [], None, []

    def settle():
        if held:
            pairs, closing, cost = chosen([x[2] for x in held], [x[3] for x in held])
            last = len(held) - 1
            out.extend((part, k, pair, closing if i == last else "", cost if i == last else 0) for i, ((part, k, _, _), pair) in enumerate(zip(held, pairs, strict=True)))
            held.clear()

    def flushed():
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["part", "k", "pair", "closing", "cost"])

    for batch in batches:
        for c, *rest in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if held and c != now:
                settle()
            now = c
            held.append(rest)
        if out:
            yield flushed()
    settle()
    if out:
        yield flushed()


def _said(role: str, text: str) -> str:
    return f"{role}:{text}"


def _replay_batches(batches):
    """(.., sig, roles, texts, state, edits) -> audit of the segment and its repaired turns, one a line, or null if none."""
    names = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
    for batch in batches:
        audits, said = [], []
        for roles, texts, state, edits in zip(*[batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("roles", "texts", "state", "edits")], strict=True):
            lines, i = [], 0
            for e in edits:
                if e == "I":
                    state = _SPEAKS[state]
                    lines.append(_said(names[state], ""))
                    continue
                if e == "R":
                    state = _SPEAKS[state]
                    lines.append(_said(names[state], texts[i]))
                elif e == "K":
                    state = SYSTEM if state == NOTHING and roles[i][:1] == "s" else _SPEAKS[state]
                    lines.append(_said(roles[i], texts[i]))
                i += 1
            audits.append(edits)
            said.append("\n".join(lines) if lines else None)
        rest = [x for x in batch.schema.names if x not in ("roles", "texts", "state", "edits")]
        yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in rest], pa.array(audits, pa.string()), pa.array(said, pa.string())], names=[*rest, "audit", "said"])


COUNTS = ("blank", "duplicate", "truncated")


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rows: int = SEGMENT_ROWS, size: int = SEGMENT_BYTES) -> DataFrame:
    """One row a conversation: (id_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), repaired being its turns as role:text, one a line."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = turns.select(F.col(id_col).alias("c"), F.col(turn_col).alias("t"), space(role_col).alias("role"), space(text_col).alias("text"))
    c, t = (plain.schema[x].dataType.simpleString() for x in "ct")
    since, at = mark(), shared_dir(turns.sparkSession)
    marked = turns_of(plain)
    key = [F.col("c"), F.col("t").asc_nulls_first(), F.col("role"), F.substring("text", 1, KEY_CHARS)]
    ranged = marked.repartitionByRange(*key).sortWithinPartitions("c", F.col("t").asc_nulls_first(), "role", "text")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "c", "t", "role", "text", "n", "blank", "again", "sym")
    segments = written(ranged.mapInArrow(functools.partial(_segments, rows=rows, size=size), _SEGMENT.format(c=c, t=t)), at)
    release(turns.sparkSession, since, keep=(at,))  # the turns are in the segments now
    solutions = written(segments.select("sig").distinct().mapInArrow(_solve_batches, "sig string, costs array<long>, ranks array<long>, edits array<string>"))
    costed = written(segments.select("c", "part", "k", "sig").join(solutions, "sig"))
    together = costed.select("c", "part", "k", "costs", "ranks").repartition("c").sortWithinPartitions("c", "part", "k")
    pairs = written(together.mapInArrow(_choose_batches, "part int, k long, pair int, closing string, cost long"))
    edits = costed.select("part", "k", "edits").join(pairs, ["part", "k"]).select("part", "k", "cost", F.floor(F.col("pair") / 4).cast("int").alias("state"), F.concat(F.get("edits", F.col("pair")), "closing").alias("edits"))
    stats = ["head", "tail", "low", "high", "first_turn", "last_turn", "turns", *COUNTS, "illegal"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.select("c", "part", "k", *stats).schema)
    replayed = segments.join(edits, ["part", "k"]).select("c", "part", "k", *stats, "cost", "roles", "texts", "state", "edits").mapInArrow(_replay_batches, f"{kinds}, cost long, audit string, said string")
    order = F.array_sort(F.collect_list(F.struct("part", "k", "head", "tail", "first_turn", "last_turn", "audit", "said")))
    whole = replayed.groupBy("c").agg(
        order.alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"), *[F.sum(x).alias(x) for x in (*COUNTS, "illegal", "cost")]
    )
    borders = F.transform(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), lambda x, i: F.struct(F.get("s", i).alias("a"), x.alias("b")))
    broken = F.size(F.filter(borders, lambda p: ~F.concat(p["a"]["tail"], p["b"]["head"]).isin(*sorted(_LEGAL))))
    shared = F.size(F.filter(borders, lambda p: p["a"]["last_turn"] == p["b"]["first_turn"]))
    all_of = lambda x, gap: F.array_join(F.transform("s", lambda y: y[x]), gap)
    found = whole.select(
        F.col("c").alias("c2"),
        F.coalesce((F.col("high") - F.col("low") + 1 - (F.col("turns") - shared)).cast("long"), F.lit(0)).alias("gaps"),
        *COUNTS,
        (F.col("illegal") + broken).alias("illegal"),
        "cost",
        all_of("audit", "").alias("audit"),
        all_of("said", "\n").alias("repaired"),
    )
    return found.withColumnRenamed("c2", id_col)


# ------------------------------------------------------------------- the query


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults dealt out by a checksum of conversation and turn: a fifth or less of all turns is dropped, emptied, cut short, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), lot.alias("lot")).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = repaired(damaged(turns)).withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")
    ids = turns.select(F.col("conv_id").alias("id")).distinct()  # a conversation whose turns are all dropped has a row too
    whole = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("id", "conv_id")
    return whole.fillna(0, ["gaps", *COUNTS, "illegal", "cost"]).fillna("", ["audit"]).fillna(EMPTY_SHA256, ["repaired_sha256"])


EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations),
lots AS (
  SELECT *, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS lot FROM raw, crc),
dam AS (
  SELECT conv_id AS c, turn AS t, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
         CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy
  FROM lots WHERE lot <> 0),
num AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY c, role, text ORDER BY t NULLS FIRST, copy) > 1 AS again, left(role, 1) AS ini,
         regexp_replace(text, '[ 	-
]+$', '') AS body FROM dam),
flt AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS short,
         lag(ini) OVER (PARTITION BY c ORDER BY i) || ini AS pair FROM num),
cnt AS (
  SELECT c, max(i) AS n, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
         count(*) FILTER (WHERE short) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY c),
rep AS (
  SELECT c, 0::BIGINT AS i, 'n' AS s, 0::BIGINT AS cost, '' AS audit FROM cnt
  UNION ALL
  SELECT c, i, s, cost, audit FROM (
    SELECT c, i, CASE op WHEN 'D' THEN s ELSE next END AS s,
           cost + 5 * k + CASE op WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN short AND op <> 'D' THEN 5 ELSE 0 END AS cost, audit || repeat('I', k) || op AS audit
    FROM (
      SELECT *, CASE WHEN op = 'K' AND ini = 's' THEN 's' WHEN s = 'u' THEN 'a' ELSE 'u' END AS next FROM (
        SELECT r.c, f.i, f.ini, f.short, f.blank OR f.dup AS gone, k, op, r.cost, r.audit,
               CASE WHEN k = 0 THEN r.s WHEN (k = 1) = (r.s = 'u') THEN 'a' ELSE 'u' END AS s
        FROM rep r JOIN flt f ON f.c IS NOT DISTINCT FROM r.c AND f.i = r.i + 1, (VALUES (0), (1), (2)) v(k), (VALUES ('D'), ('K'), ('R')) w(op)))
    WHERE op = 'D' OR NOT gone AND (op = 'R' OR ini = next AND (ini <> 's' OR s = 'n')))
  QUALIFY row_number() OVER (PARTITION BY c, s ORDER BY cost, audit) = 1),
fin AS (
  SELECT * FROM (SELECT r.c, r.cost + CASE s WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END AS cost, r.audit || CASE s WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit
  FROM rep r JOIN cnt ON cnt.c IS NOT DISTINCT FROM r.c AND r.i = cnt.n)
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1),
chr1 AS (SELECT c, unnest(string_split(audit, '')) AS e, unnest(range(length(audit))) AS j, length(replace(audit, 'D', '')) AS n_out FROM fin WHERE audit <> ''),
chr2 AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS o FROM chr1 WINDOW w AS (PARTITION BY c ORDER BY j)),
said AS (
  SELECT x.c, string_agg(CASE WHEN e = 'K' THEN role WHEN (o + n_out) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS repaired
  FROM chr2 x JOIN flt f ON f.c IS NOT DISTINCT FROM x.c AND f.i = greatest(x.i, 1) WHERE e <> 'D' GROUP BY x.c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN cnt ON cnt.c IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin ON fin.c IS NOT DISTINCT FROM o.conv_id LEFT JOIN said ON said.c IS NOT DISTINCT FROM o.conv_id
"""
