"""Live job queue and live rate limit: state with event-time timers, one stream each.

Both need Spark's RocksDB state store (``with_state``).  Time is that of the rows: a row's
time must be the one at which it reached the log, and the watermark's delay must cover the
disorder there, since Spark drops what comes later.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.registry import query, using
from granary.sources.tables import CALLS, calls
from granary.streaming.queue import BACKOFF_MOST, BACKOFF_SECONDS, LIMIT_HITS, LIMIT_SECONDS, MAX_ATTEMPTS

LEASE_SECONDS = 600


def with_state(spark: SparkSession) -> SparkSession:
    """The session with the state store that state variables and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


# -------------------------------------------------------------------- job queue

#: What commands and events hold; times are whole seconds.
COMMAND = "lane string, at long, seq long, op string, job long, chave string, priority long, worker string, batch long"
EVENT = "lane string, at long, seq long, event string, job long, worker string, attempts long, due long"
_ORDERED = ("at", "seq", "op", "job", "chave", "priority", "worker", "batch")
JOB = "chave string, priority long, status string, attempts long, due long, worker string, lease long"


class Lane:
    """The open jobs of one lane, and what commands do to them.

    enqueue: a key that has an open job gets that one (``joined``).  claim: the due jobs of
    least priority number, then earliest due, then least number, for a lease.  complete and
    fail: by the worker that holds the job (of all that it holds, if none is named); by
    anyone else they are ``ignored``, as its lease has run out.  A failure or a lease that
    runs out costs the attempt: back after a pause that doubles, or a dead letter.  A
    command with a number that its sender has used already is a repeat and does nothing.
    """

    def __init__(self, jobs: dict[int, list], senders: dict[str, int], clock: int, lease: int = LEASE_SECONDS, most: int = MAX_ATTEMPTS):
        self.jobs, self.senders, self.clock, self.lease, self.most = jobs, senders, clock, lease, most
        self.keys = {j[0]: i for i, j in jobs.items() if j[0] is not None}
        self.changed: set[int] = set()

    def expired(self, now: int) -> Iterator[tuple]:
        """Ends the leases that have run out by now, in order."""
        for lease, job in sorted((j[6], i) for i, j in self.jobs.items() if j[2] == "running" and j[6] <= now):
            yield from self._back(job, lease, None, "expired")

    def _close(self, job: int) -> None:
        key = self.jobs.pop(job)[0]
        self.keys.pop(key, None)

    def _back(self, job: int, at: int, seq: int | None, why: str) -> Iterator[tuple]:
        chave, priority, _, attempts, due, worker, _ = self.jobs[job]
        self.changed.add(job)
        if attempts >= self.most:
            self._close(job)
            yield at, seq, "dead_letter", job, worker, attempts, None
        else:
            due = at + BACKOFF_SECONDS * 2 ** min(attempts, BACKOFF_MOST)
            self.jobs[job] = [chave, priority, "retry", attempts, due, None, None]
            yield at, seq, "retry" if why == "fail" else "expired", job, worker, attempts, due

    def run(self, commands: Iterable[tuple]) -> Iterator[tuple]:
        """Commands (at, seq, op, job, chave, priority, worker, batch), in any order -> events."""
        for at, seq, op, job, chave, priority, worker, batch in sorted(commands, key=lambda c: c[:2]):
            now = self.clock = max(self.clock, at)
            yield from self.expired(now)
            sender = worker or ""
            if self.senders.get(sender, -1) >= seq:
                yield now, seq, "repeated", job, worker, None, None
                continue
            self.senders[sender] = seq
            if op == "enqueue":
                if chave in self.keys or job in self.jobs:
                    standing = self.keys.get(chave, job)
                    yield now, seq, "joined", standing, worker, self.jobs[standing][3], None
                else:
                    self.jobs[job] = [chave, priority, "pending", 0, now, None, None]
                    if chave is not None:
                        self.keys[chave] = job
                    self.changed.add(job)
                    yield now, seq, "queued", job, worker, 0, now
            elif op == "claim":
                due = sorted((j[1], j[4], i) for i, j in self.jobs.items() if j[2] in ("pending", "retry") and j[4] <= now)
                for _, _, i in due[: max(batch or 1, 1)]:
                    j = self.jobs[i]
                    self.jobs[i] = [*j[:2], "running", j[3] + 1, j[4], worker, now + self.lease]
                    self.changed.add(i)
                    yield now, seq, "claimed", i, worker, j[3] + 1, now + self.lease
            else:
                held = sorted(i for i, j in self.jobs.items() if j[2] == "running" and j[5] == worker and job in (None, i))
                if not held and job is not None:
                    yield now, seq, "ignored", job, worker, None, None
                for i in held:
                    if op == "fail":
                        yield from self._back(i, now, seq, "fail")
                    else:
                        attempts = self.jobs[i][3]
                        self._close(i)
                        self.changed.add(i)
                        yield now, seq, "success", i, worker, attempts, None


class _Queue(StatefulProcessor):
    """A lane's state: its open jobs by number, the last command number of each sender and its clock."""

    def __init__(self, lease: int, most: int):
        self.lease, self.most = lease, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job long", JOB)
        self.senders = handle.getMapState("senders", "worker string", "seq long")
        self.clock = handle.getValueState("clock", "at long")

    def _lane(self) -> Lane:
        clock = self.clock.get()[0] if self.clock.exists() else 0
        return Lane({k[0]: list(v) for k, v in self.jobs.iterator()}, {k[0]: v[0] for k, v in self.senders.iterator()}, clock, self.lease, self.most)

    def _keep(self, lane: Lane, leases: set[int]) -> None:
        for job in lane.changed:
            if job not in lane.jobs:
                self.jobs.removeKey((job,))
                continue
            self.jobs.updateValue((job,), tuple(lane.jobs[job]))
            if lane.jobs[job][6] is not None and lane.jobs[job][6] not in leases:
                leases.add(lane.jobs[job][6])
                self.handle.registerTimer(lane.jobs[job][6] * 1000)
        self.clock.update((lane.clock,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lane = self._lane()
        before = dict(lane.senders)
        for e in lane.run((r.at, r.seq, r.op, r.job, r.chave, r.priority, r.worker, r.batch) for r in rows):
            yield Row(lane=key[0], at=e[0], seq=e[1], event=e[2], job=e[3], worker=e[4], attempts=e[5], due=e[6])
        for worker, seq in lane.senders.items():
            if before.get(worker) != seq:
                self.senders.updateValue((worker,), (seq,))
        self._keep(lane, set())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        lane = self._lane()
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        lane.clock = max(lane.clock, now)
        for e in lane.expired(now):
            yield Row(lane=key[0], at=e[0], seq=e[1], event=e[2], job=e[3], worker=e[4], attempts=e[5], due=e[6])
        self._keep(lane, set())

    def close(self) -> None:
        pass


def queue_stream(commands: DataFrame, lease: int = LEASE_SECONDS, most: int = MAX_ATTEMPTS, late: str = "10 minutes") -> DataFrame:
    """A stream of COMMAND rows -> the stream of EVENT rows.

    A lane is what claims order their jobs in: give a busy kind of work several, dealt out by
    a hash of the key, so that all commands of a key meet in one.  A lane's state
    is its open jobs and a number a worker; done and dead jobs leave it and are in the
    events.  A lease ends by a timer, or earlier by the first command behind it.  State goes
    with Spark's checkpoint, so a batch that is done again after a loss gives the same
    events under the same batch number.
    """
    timed = commands.withColumn("time", F.timestamp_seconds("at")).withWatermark("time", late)
    return timed.groupBy("lane").transformWithState(_Queue(lease, most), EVENT, "append", "eventTime")


def queue_run(commands: DataFrame, lease: int = LEASE_SECONDS, most: int = MAX_ATTEMPTS) -> DataFrame:
    """All commands of a table worked off -> (lane, job, status, attempts, due): every job as its lane leaves it."""

    def lane_of(rows: pa.Table) -> pa.Table:
        lane, ended = Lane({}, {}, 0, lease, most), {}
        for at, _, event, job, _, attempts, due in lane.run(zip(*[rows.column(c).to_pylist() for c in _ORDERED], strict=True)):
            if event in ("success", "dead_letter"):
                ended[job] = (event, attempts, due)
        ended |= {i: (j[2], j[3], j[4]) for i, j in lane.jobs.items()}
        name = rows.column("lane")[0].as_py()
        out = [dict(zip(("lane", "job", "status", "attempts", "due"), (name, i, *x), strict=True)) for i, x in ended.items()]
        return pa.Table.from_pylist(out, schema=pa.schema([("lane", pa.string()), ("job", pa.int64()), ("status", pa.string()), ("attempts", pa.int64()), ("due", pa.int64())]))

    return commands.groupBy("lane").applyInArrow(lane_of, "lane string, job long, status string, attempts long, due long")


_LEASE, _MOST = 43_200, 2


def commands_of(rows: DataFrame) -> DataFrame:
    """calls as the commands of a queue, a lane a user: two of five enqueue, the others claim, complete and fail by turns of two workers."""
    k = F.col("id") % 5
    work = k >= 2
    return rows.select(
        F.col("user_id").cast("string").alias("lane"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("at"),
        F.col("id").alias("seq"),
        F.when(~work, "enqueue").when(k == 2, "claim").when(k == 3, "complete").otherwise("fail").alias("op"),
        F.when(~work, F.col("id")).alias("job"),
        F.when(~work & (F.col("id") % 7 > 0), (F.col("id") % 7).cast("string")).alias("chave"),
        (F.col("id") % 3).alias("priority"),
        F.when(work, F.concat(F.lit("w"), (F.col("tokens") % 2).cast("string"))).alias("worker"),
        F.when(k == 2, F.lit(2)).cast("bigint").alias("batch"),
    )


@query("q_queue_run", using({"calls": CALLS}, f"""
WITH c AS (
  SELECT user_id::VARCHAR AS lane, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), id) AS n, floor(epoch(ts))::BIGINT AS s, id, id % 5 AS k, id % 3 AS pri,
         CASE WHEN id % 7 > 0 THEN (id % 7)::VARCHAR END AS chave, 'w' || (tokens % 2)::VARCHAR AS w,
         max(id) OVER (PARTITION BY user_id, CASE WHEN id % 5 >= 2 THEN tokens % 2 ELSE -1 END ORDER BY floor(epoch(ts)), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM calls),
r AS (
  SELECT lane, 0::BIGINT AS n, []::STRUCT(id BIGINT, chave VARCHAR, pri BIGINT, st VARCHAR, att BIGINT, due BIGINT, w VARCHAR, lease BIGINT)[] AS js FROM (SELECT DISTINCT lane FROM c)
  UNION ALL
  SELECT lane, n, CASE
    WHEN id <= top THEN x
    WHEN k < 2 AND len(list_filter(x, lambda j: j.chave = chave AND j.st IN ('pending', 'retry', 'running'))) > 0 THEN x
    WHEN k < 2 THEN list_append(x, {{'id': id, 'chave': chave, 'pri': pri, 'st': 'pending', 'att': 0::BIGINT, 'due': s, 'w': NULL::VARCHAR, 'lease': NULL::BIGINT}})
    WHEN k = 2 THEN list_transform(x, lambda j: CASE WHEN list_contains(pick, j.id) THEN {{'id': j.id, 'chave': j.chave, 'pri': j.pri, 'st': 'running', 'att': j.att + 1, 'due': j.due, 'w': w, 'lease': s + {_LEASE}}} ELSE j END)
    WHEN k = 3 THEN list_transform(x, lambda j: CASE WHEN j.st = 'running' AND j.w = w THEN {{'id': j.id, 'chave': j.chave, 'pri': j.pri, 'st': 'success', 'att': j.att, 'due': NULL::BIGINT, 'w': NULL::VARCHAR, 'lease': NULL::BIGINT}} ELSE j END)
    ELSE list_transform(x, lambda j: CASE WHEN j.st = 'running' AND j.w = w THEN {{'id': j.id, 'chave': j.chave, 'pri': j.pri, 'st': CASE WHEN j.att >= {_MOST} THEN 'dead_letter' ELSE 'retry' END, 'att': j.att,
      'due': CASE WHEN j.att < {_MOST} THEN s + {BACKOFF_SECONDS} * (2 ** least(j.att, {BACKOFF_MOST}))::BIGINT END, 'w': NULL::VARCHAR, 'lease': NULL::BIGINT}} ELSE j END) END AS js
  FROM (
    SELECT *, list_transform(list_sort(list_transform(list_filter(x, lambda j: j.st IN ('pending', 'retry') AND j.due <= s), lambda j: {{'p': j.pri, 'd': j.due, 'i': j.id}}))[1:2], lambda j: j.i) AS pick
    FROM (
      SELECT c.*, list_transform(js, lambda j: CASE WHEN j.st = 'running' AND j.lease <= s THEN {{'id': j.id, 'chave': j.chave, 'pri': j.pri, 'st': CASE WHEN j.att >= {_MOST} THEN 'dead_letter' ELSE 'retry' END, 'att': j.att,
        'due': CASE WHEN j.att < {_MOST} THEN j.lease + {BACKOFF_SECONDS} * (2 ** least(j.att, {BACKOFF_MOST}))::BIGINT END, 'w': NULL::VARCHAR, 'lease': NULL::BIGINT}} ELSE j END) AS x
      FROM r JOIN c ON c.lane = r.lane AND c.n = r.n + 1)))
SELECT lane, j.id AS job, j.st AS status, j.att AS attempts, j.due AS due
FROM (SELECT lane, unnest(js) AS j FROM r QUALIFY n = max(n) OVER (PARTITION BY lane))"""))
def queue_run_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue worked off over all calls of a user: leases of half a day, two attempts, as events are sparse.  Live it is queue_stream()."""
    return queue_run(commands_of(calls(spark, sf_dir)), _LEASE, _MOST)


# ------------------------------------------------------------------- rate limit


class _Limit(StatefulProcessor):
    """A user's state: hits that wait for the watermark, and the window that is open; it goes when the window has closed and none waits."""

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts_s long", "ids array<long>")
        self.window = handle.getValueState("window", "start long, hits long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list[int]] = {}
        for r in rows:
            new.setdefault(r.ts_s, []).append(r.id)
        for s, ids in new.items():
            held = self.waiting.getValue((s,)) if self.waiting.containsKey((s,)) else None
            self.waiting.updateValue((s,), ([*held[0], *ids] if held else ids,))
            if held is None:
                self.handle.registerTimer(s * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Timers come in order: that of a hit's second decides its hits, that of a window's end clears it."""
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        start, hits = self.window.get() if self.window.exists() else (None, 0)
        if self.waiting.containsKey((now,)):
            (ids,) = self.waiting.getValue((now,))
            self.waiting.removeKey((now,))
            for i in sorted(ids):
                if start is None or now >= start + self.seconds:
                    start, hits = now, 0
                    self.handle.registerTimer((now + self.seconds) * 1000)
                hits += 1
                yield Row(user_id=key[0], id=i, ts_s=now, hit=hits, allowed=hits <= self.most)
            self.window.update((start, hits))
        elif start is not None and now >= start + self.seconds:
            self.window.clear()

    def close(self) -> None:
        pass


def limit_stream(stream: DataFrame, seconds: int = LIMIT_SECONDS, most: int = LIMIT_HITS, late: str = "1 minute") -> DataFrame:
    """(user_id, id, ts_s, hit, allowed) of a stream with user_id, id and ts_s (whole seconds).

    A window opens at the first hit after the last one closed.  Hits are decided in the
    order of their time and number, whatever batch they come in, as soon as the watermark
    has passed them: late is what is waited for hits out of order.
    """
    timed = stream.withColumn("time", F.timestamp_seconds("ts_s")).withWatermark("time", late)
    return timed.groupBy("user_id").transformWithState(_Limit(seconds, most), "user_id long, id long, ts_s long, hit long, allowed boolean", "append", "eventTime")
