"""Operator 9: chat formatting into budgeted windows.

A conversation longer than the budget becomes several windows.  Prefix sums of
turn tokens choose their spans: the room that the system turn leaves is cut in halves,
and a window takes the turns that begin in the same half, so with the one that reaches
over its end it holds a whole room at most; a turn longer than half a room is a window
by itself.  Spans begin and end at turns.  Each window opens with the system turn and
repeats whole turns of the window before it, the last ones that fit a quarter of the
room and what its own turns leave of the budget; what is repeated is masked, so each
assistant text is a target once.  No window is over the budget unless the system turn
and a single other turn alone are; turns are never cut.

Tokens are counted as runs of letters, digits or other characters, and ``TURN_TOKENS``
a turn for the marks.  A byte-level BPE makes more of the same text (README); give the
budget accordingly.

A turn is written ``<turn ROLE>\\nTEXT</turn>\\n``.  Inside roles and texts ``\\``,
``<`` and ``>`` become ``\\b``, ``\\l`` and ``\\g``, so that no text can look like a
mark and every text can be read back.

Everything is built-in Spark SQL.  Turns are put in order by ranges that Spark samples,
so a conversation of any length takes as many ranges as it needs: sums are taken inside
a range and added up over the ranges of a conversation (a row each), first over tokens,
then over windows.  Only a window's turns, bounded by the budget, meet in one group; a
system turn that many windows keep is joined to them as a key that Spark may split.
Copies of a turn lie in one range only where their text is longer than ``KEY_CHARS``.
``digests`` alone holds a conversation in a row, as its hashes ask for.  Null text and
null role count as empty; turns with equal numbers are ordered by role and text;
repeated rows are turns of their own; a conversation without assistant has no
targets.  A null conversation id is one conversation.  A very long text is one turn and
one window.  An empty table gives an empty result; other columns are not passed
through, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BUDGET, TURN_TOKENS = 512, 4
#: Characters of a text in the key of a range; sampled keys pass the driver, whole texts do not.
KEY_CHARS = 1024
#: Runs of letters, of digits and of other characters: what tokenisers split text into first.
TOKENS = r"\p{L}+|\p{N}+|[^ \t\n\x0B\f\r\p{L}\p{N}]+"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escaped(text: Column) -> Column:
    for raw, mark in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for raw, mark in reversed(_ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def _before(rows: DataFrame, weight: Column) -> DataFrame:
    """rows (c, part, id, ...) with before: the sum of weight over the rows of c with a smaller id; ids ascend with part."""
    rows = rows.withColumn("weight", weight.cast("long"))
    within = Window.partitionBy("part", "c").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(F.col("part").alias("p"), F.col("c").alias("k")).agg(F.sum("weight").alias("s"))
    sums = sums.withColumn("earlier", F.sum("s").over(Window.partitionBy("k").orderBy("p")) - F.col("s"))
    rows = rows.withColumn("here", F.sum("weight").over(within) - F.col("weight"))
    joined = rows.join(sums, (F.col("part") == F.col("p")) & F.col("c").eqNullSafe(F.col("k")))
    return joined.withColumn("before", F.col("here") + F.col("earlier")).drop("p", "k", "s", "earlier", "here", "weight")


def _ordered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, part, c, role, text, tokens): all turns in order, by sampled ranges; ids ascend, a part is one range."""
    rows = turns.select(
        F.col(id_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("head", F.left("text", F.lit(KEY_CHARS))).withColumn("longer", F.length("text") > KEY_CHARS)
    # copies of a turn may be cut apart where the key holds their whole text
    rows = rows.withColumn("copy", F.when(~F.col("longer"), F.monotonically_increasing_id()))
    keys = ["c", "t", "role", "head", "longer", "copy"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    tokens = F.regexp_count("text", F.lit(TOKENS)).cast("long") + TURN_TOKENS
    return written(rows.select(F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("part"), "c", "role", "text", tokens.alias("tokens")))


def _spans(ordered: DataFrame, budget: int) -> DataFrame:
    """(id, part, c, lead, lead_id, room, cost, at, span, big) of each turn: at is the cost before it, lead_id its conversation's system turn."""
    firsts = ordered.groupBy("c").agg(F.min(F.struct("id", "role", "tokens")).alias("f"))
    leads = written(firsts.filter("f.role = 'system'").select(F.col("c").alias("k"), F.col("f.id").alias("lead_id"), F.col("f.tokens").alias("lead_tokens")))
    rows = _before(ordered.select("id", "part", "c", "tokens"), F.col("tokens"))
    rows = written(rows).join(leads, F.col("c").eqNullSafe(F.col("k")), "left").drop("k")
    taken = F.coalesce("lead_tokens", F.lit(0))
    rows = rows.withColumn("lead", F.coalesce(F.col("id") == F.col("lead_id"), F.lit(False))).withColumn("room", F.greatest(F.lit(4), F.lit(budget) - taken))
    rows = rows.withColumn("cost", F.when(F.col("lead"), F.lit(0)).otherwise(F.col("tokens"))).withColumn("at", F.when(F.col("lead"), F.lit(0)).otherwise(F.col("before") - taken))
    half = F.floor(F.col("room") / 2)
    return rows.select("id", "part", "c", "lead", "lead_id", "room", "cost", "at", F.floor(F.col("at") / half).alias("span"), (F.col("cost") > half).alias("big"))


def _windows(spans: DataFrame) -> DataFrame:
    """(k, span_, big_, own, next_start, spare, lead_id): the windows, numbered from 1 in their conversation k.

    Turns of one half make a window; one over half a room is by itself, and what follows
    it begins in a later half.  spare is what the next window's own turns leave of the
    room, null in the last one.
    """
    found = spans.filter(~F.col("lead")).groupBy("c", "span", "big").agg(
        F.min(F.struct("id", "part")).alias("first"), F.sum("cost").alias("used"), F.max(F.col("at") + F.col("cost")).alias("next_start"), F.first("lead_id").alias("lead_id"), F.first("room").alias("room")
    )
    found = found.select("first.id", "first.part", "c", "span", "big", "used", "next_start", "lead_id", "room")
    numbered = written(_before(written(found), F.lit(1)).withColumn("own", F.col("before") + 1))
    following = numbered.select(F.col("c").alias("k"), (F.col("own") - 1).alias("o"), F.col("used").alias("next_used"))
    both = numbered.join(following, F.col("c").eqNullSafe(F.col("k")) & (F.col("own") == F.col("o")), "left")
    return written(both.select(F.col("c").alias("k"), F.col("span").alias("span_"), F.col("big").alias("big_"), "own", "next_start", (F.col("room") - F.col("next_used")).alias("spare"), F.col("lead_id").alias("system")))


def _places(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, w, context): the windows in which a turn stands, and whether it is repeated there."""
    own = spans.filter(~F.col("lead")).join(windows, F.col("c").eqNullSafe(F.col("k")) & (F.col("span") == F.col("span_")) & (F.col("big") == F.col("big_")))
    fits = F.col("next_start") - F.col("at") <= F.least(F.floor(F.col("room") / 4), F.col("spare"))
    again = F.col("spare").isNotNull() & fits
    place = lambda w, context: F.struct(w.cast("long").alias("w"), F.lit(context).alias("context"))
    here, next_ = place(F.col("own"), False), place(F.col("own") + 1, True)
    turns = own.select("id", F.explode(F.when(again, F.array(here, next_)).otherwise(F.array(here))).alias("x")).select("id", "x.w", "x.context")
    opening = spans.filter("lead").select("id", F.lit(1).cast("long").alias("w"), F.lit(False).alias("context"))
    kept = windows.filter("system IS NOT NULL AND own > 1").select(F.col("system").alias("id"), F.col("own").alias("w"), F.lit(True).alias("context"))
    return written(turns.union(opening).union(kept))


def formatted(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """(id_col, window, text, n_context, targets): windows numbered from 1.

    n_context turns at the head of a window are repeated; targets are the
    [from, to) code points of text that bear loss.
    """
    ordered = _ordered(turns, id_col, turn_col, role_col, text_col)
    spans = written(_spans(ordered, budget))
    places = _places(spans, _windows(spans))
    rows = places.join(ordered.select("id", "c", "role", "text"), "id")
    head = F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">\n"))
    rows = rows.select("c", "id", "role", "w", "context", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit("</turn>\n")))
    place = Window.partitionBy("c", "w").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.coalesce(F.sum(F.length("piece")).over(place), F.lit(0)) + F.length("head"))
    target = F.when((F.col("role") == "assistant") & ~F.col("context"), F.struct("from", (F.col("from") + F.length("body")).alias("to")))
    out = rows.groupBy("c", "w").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "piece"))), lambda x: x["piece"]), "").alias("text"),
        F.sum(F.col("context").cast("long")).alias("n_context"),
        F.array_sort(F.collect_list(target)).alias("targets"),
    )
    return out.select(F.col("c").alias(id_col), F.col("w").alias("window"), "text", "n_context", "targets")


def read_back(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, window, turns, losses, n_chars): the turns that a window adds and the texts under its loss mask, unescaped."""
    pieces = F.split(F.col("text"), "</turn>\n", -1)
    turn = lambda p: F.struct(unescaped(F.regexp_extract(p, r"\A<turn ([^>]*)>", 1)).alias("role"), unescaped(F.regexp_replace(p, r"\A<turn [^>]*>\n", "")).alias("text"))
    own = F.slice(F.transform(pieces, turn), F.col("n_context").cast("int") + 1, F.greatest(F.lit(0), F.size(pieces) - 1 - F.col("n_context").cast("int")))
    loss = F.transform("targets", lambda s: unescaped(F.substring(F.col("text"), (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    return windows.select(id_col, "window", own.alias("turns"), loss.alias("losses"), F.length("text").cast("long").alias("n_chars"))


def digests(windows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row a conversation, from the formatted windows alone."""
    parts = read_back(windows, id_col).select(
        id_col,
        "window",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("losses", "").alias("loss"),
        "n_chars",
    )
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", c))), lambda x: x[c]), "")
    whole = parts.groupBy(id_col).agg(F.sum("n").alias("n_turns"), joined("said").alias("said"), joined("loss").alias("loss"), F.sum("n_chars").alias("formatted_chars"))
    return whole.select(
        id_col, "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


PROBE = "\\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    """All conversations and conversation -7, whose texts look like marks; a conversation of that number in the table gets these turns too."""
    probe = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").union(probe)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(formatted(with_probe(table(spark, sf_dir, "conversations"))))


OP9_SQL = rf"""
WITH a AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
b AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
         len(regexp_extract_all(text, '{TOKENS}')) + {TURN_TOKENS} AS tokens FROM a),
c AS (SELECT *, n = 1 AND role = 'system' AS lead FROM b),
d AS (
  SELECT *, CASE WHEN lead THEN 0 ELSE tokens END AS cost,
         greatest(4, {BUDGET} - max(CASE WHEN lead THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) AS room FROM c),
e AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
f AS (SELECT *, before // (room // 2) AS span, cost > room // 2 AS big FROM e),
g AS (
  SELECT *, CASE WHEN span = lag(span) OVER (PARTITION BY conv_id ORDER BY n) AND NOT big AND NOT lag(big) OVER (PARTITION BY conv_id ORDER BY n) OR lag(lead) OVER (PARTITION BY conv_id ORDER BY n) THEN 0 ELSE 1 END AS begins
  FROM f),
h AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS own FROM g),
i AS (
  SELECT *, max(before + cost) OVER (PARTITION BY conv_id, own) AS next_start, max(own) OVER (PARTITION BY conv_id) AS last,
         room - max(used) OVER (PARTITION BY conv_id ORDER BY own RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS spare,
         20 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) - 4 AS chars
  FROM (SELECT *, sum(cost) OVER (PARTITION BY conv_id, own) AS used FROM h))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars * CASE WHEN lead THEN last WHEN own < last AND next_start - before <= least(room // 4, spare) THEN 2 ELSE 1 END)::BIGINT AS formatted_chars
FROM i GROUP BY conv_id
"""
