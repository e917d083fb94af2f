"""The live queue and rate limit as streams: several batches, disorder, lost workers, repeats and restarts."""

import random

import pytest

from granary.streaming import live

COMMAND = live.COMMAND


@pytest.fixture
def stateful(spark):
    """The session with the stores that timers need, few partitions, and as it was afterwards."""
    keys = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k, None) for k in keys}
    live.with_state(spark).conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def command(at, seq, op, job=None, chave=None, priority=None, worker=None, batch=None, lane="a"):
    return (lane, at, seq, op, job, chave, priority, worker, batch)


def worked(spark, tmp_path, name, **options):
    """Runs the queue's stream over what there is and returns all events so far."""
    stream = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.queue_stream(stream, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))
    out.trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "seq", "job").select("at", "event", "job", "worker", "attempts", "due").collect()]


def test_lost_worker_repeat_and_restart(stateful, tmp_path):
    spark, path = stateful, str(tmp_path / "in")
    first = [
        command(100, 1, "enqueue", 1, "k", 5), command(101, 2, "enqueue", 2, None, 1), command(102, 3, "enqueue", 3, "k", 0),
        command(110, 1, "claim", worker="w1", batch=2), command(120, 2, "complete", 2, worker="w1"),
    ]
    put(spark, path, first, COMMAND)
    events = worked(spark, tmp_path, "one", lease=60, most=2, late="10 seconds")
    assert events == [
        (100, "queued", 1, None, 0, 100), (101, "queued", 2, None, 0, 101), (102, "joined", 1, None, 0, None),
        (110, "claimed", 1, "w1", 1, 170), (110, "claimed", 2, "w1", 1, 170), (120, "success", 2, "w1", 1, None),
    ]
    # the same batch comes again, and w1 is not heard of any more: its lease on job 1 runs out by a timer
    put(spark, path, [command(125, *c[2:5], c[5], c[6], c[7], c[8]) for c in first], COMMAND)
    put(spark, path, [command(400, 9, "enqueue", 50, lane="other")], COMMAND)
    events = worked(spark, tmp_path, "two", lease=60, most=2, late="10 seconds")[6:]
    assert [e[1] for e in events if e[0] == 125] == ["repeated"] * 5
    assert (170, "expired", 1, "w1", 1, 230) in events and len(events) == 7
    # another worker takes it over after the pause; the lost one wakes up and is ignored; a second failure is the last
    later = [command(405, 1, "claim", worker="w2", batch=5), command(406, 3, "complete", 1, worker="w1"), command(407, 2, "fail", 1, worker="w2"), command(408, 3, "claim", worker="w2")]
    put(spark, path, later, COMMAND)
    events = worked(spark, tmp_path, "three", lease=60, most=2, late="10 seconds")[-3:]
    assert events == [(405, "claimed", 1, "w2", 2, 465), (406, "ignored", 1, "w1", None, None), (407, "dead_letter", 1, "w2", 2, None)]


def test_stream_equals_one_run(stateful, tmp_path):
    """Random commands of many lanes, out of order within a batch, over several batches."""
    rng, spark, rows, clock = random.Random(6), stateful, [], 1000
    for seq in range(1, 241):
        clock += rng.randrange(1, 40)
        op = rng.choice(["enqueue"] * 3 + ["claim"] * 2 + ["complete", "fail"])
        worker = None if op == "enqueue" else rng.choice(["w1", "w2"])
        rows.append(command(clock, seq, op, seq if op == "enqueue" else None, rng.choice([None, "x", "y", "z"]) if op == "enqueue" else None, rng.randrange(3), worker, 2, rng.choice("abc")))
    for k in range(0, 240, 60):
        part = rows[k : k + 60]
        put(spark, str(tmp_path / "in"), rng.sample(part, len(part)), COMMAND)
    events = worked(spark, tmp_path, "all", lease=300, most=2, late="1 day")
    seen = {}
    for _, event, job, *_ in events:
        if event not in ("joined", "repeated", "ignored"):
            seen[job] = event
    want = {r["job"]: r["status"] for r in live.queue_run(spark.createDataFrame(rows, COMMAND), 300, 2).collect()}
    names = {"queued": "pending", "claimed": "running", "expired": "retry"}
    assert {j: names.get(e, e) for j, e in seen.items()} == want and {"success", "dead_letter", "retry"} <= set(want.values())


def test_rate_limit(stateful, tmp_path):
    spark, rng, schema = stateful, random.Random(1), "user_id long, id long, ts_s long"
    hits = [(u, i, rng.randrange(1000, 1500)) for i, u in enumerate([1, 2, 3] * 40)]
    rng.shuffle(hits)
    path = str(tmp_path / "in")
    for k in range(3):
        put(spark, path, hits[k * 40 : k * 40 + 40], schema)
    put(spark, path, [(9, 999, 10_000)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = live.limit_stream(stream, 60, 2, "10 minutes").writeStream.format("memory").queryName("limit").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination()
    want, windows = {}, {}
    for user, i, s in sorted(hits, key=lambda h: (h[0], h[2], h[1])):
        if user not in windows or s >= windows[user][0] + 60:
            windows[user] = [s, 0]
        windows[user][1] += 1
        want[i] = (windows[user][1], windows[user][1] <= 2)
    assert {r["id"]: (r["hit"], r["allowed"]) for r in spark.table("limit").collect()} == want
    # only the user whose hit still waits is left: the hit, its timer by time and by key, and that timer's count
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
