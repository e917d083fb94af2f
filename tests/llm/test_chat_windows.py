"""Operator 9: budget, the retained system turn, repeated history and the loss mask."""

import random

from pyspark.sql import functions as F

from granary.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window string"


def rows():
    rng = random.Random(12)
    out = [(1, 0, "system", "be brief"), (1, 1, "user", "w " * 250), (1, 2, "assistant", "w " * 300)]  # 254 and 304 tokens
    out += [(2, 0, "system", "s " * 40)] + [(2, t, ("user", "assistant")[t % 2 == 0], "x " * rng.randrange(1, 120)) for t in range(1, 60)]
    out += [(3, t, ("user", "assistant")[t % 2], "y " * rng.randrange(1, 700)) for t in range(40)]
    out += [(4, 0, "user", None), (4, 1, None, "z"), (4, 1, None, "z"), (5, 0, "assistant", "only one"), (6, 0, "user", "q " * 200_000), (6, 1, "assistant", "a")]
    return [(*r, "clash") for r in out]


def tokens(turn):
    return len((turn["text"] or "").split()) + chat.TURN_TOKENS


def test_windows(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    windows = chat.formatted(df)
    parts = windows.select("conv_id", "window", "n_context", "text", "targets", F.length("text").alias("n")).collect()
    whole = chat.read_back(windows.withColumn("n_context", F.lit(0))).select("conv_id", "window", "turns").collect()
    turns = {(r["conv_id"], r["window"]): r["turns"] for r in whole}
    repeated = 0
    for c in range(1, 7):
        mine = sorted((r for r in parts if r["conv_id"] == c), key=lambda r: r["window"])
        said, loss = [], []
        for r in mine:
            ts = turns[c, r["window"]]
            used = [tokens(t) for t in ts]
            lead = c in (1, 2)
            if lead:
                assert ts[0]["role"] == "system", (c, r["window"], ts)  # every window keeps it
            single = len(ts) - lead == 1
            assert sum(used) <= chat.BUDGET or single, (c, r["window"], used)
            history = used[lead : r["n_context"]] if r["window"] > 1 else []
            assert sum(history) <= chat.BUDGET / 4
            repeated += len(history)
            said += [(t["role"], t["text"]) for t in ts[r["n_context"] :]]
            loss += [r["text"][s["from"] : s["to"]] for s in r["targets"]]
            assert all(r["text"][: s["from"]].endswith("<turn assistant>\n") and r["text"][s["to"] :].startswith("</turn>") for s in r["targets"])
        want = [(r or "", t or "") for _, _, r, t, _ in sorted((x for x in data if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert said == want and loss == [t for r, t in want if r == "assistant"]
    assert repeated > 10
    assert len([r for r in parts if r["conv_id"] == 1]) == 2
    assert chat.formatted(df.limit(0)).count() == 0


def test_hot_conversation(spark, tmp_path):
    """A conversation (once a null one) with most turns and many copies lies in several ranges and comes out as in SQL."""
    duckdb = __import__("duckdb")
    rng = random.Random(13)
    said = lambda: "w" * rng.randrange(3) + " y<" * rng.randrange(200)
    data = [(c, t, ("user", "assistant")[t % 2], said()) for c in range(100, 140) for t in range(1, rng.randrange(3, 60))]
    for hot in (7, None):
        data += [(hot, 0, "system", "keep to it"), *[(hot, t, ("user", "assistant")[t % 2], said()) for t in range(1, 3000)]]
        data += [(hot, 3001, "assistant", "same")] * 2000
    data += [(None, None, "user", None)] * 3
    data += [(9, 0, "system", "alone"), (10, 1, "system", "s " * 600), (10, 2, "user", "a"), (10, 3, "assistant", "b " * 900)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table's ranges would be put together
    sizes = [r["count"] for r in chat._ordered(df, "conv_id", "turn", "role", "text").groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < len(data) / 3
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op9_chat_formatting(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    con = duckdb.connect()
    # in Spark a null turn comes first
    con.execute(f"SET default_null_order = 'nulls_first'; CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat.OP9_SQL).fetchall()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
