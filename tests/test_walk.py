"""Back-tests in one pass against predictions made anew from each prefix."""

import datetime as dt
import random
import statistics
import time

import numpy as np

from granary.plans import forecast

C = forecast.PREDICT


def plain(ev):
    errors, hits, exact, near = [], [], [], []
    for i in range(C["min_samples"], len(ev)):
        train, (day, value) = ev[:i], ev[i]
        gaps = [(b - a).days for (a, _), (b, _) in zip(train, train[1:])]
        low, mid, high = (float(np.quantile(gaps, p)) for p in (0.25, 0.5, 0.75))
        at = lambda x: train[-1][0] + dt.timedelta(int(np.floor(x + 0.5)))  # noqa: E731, B023
        errors.append(abs((at(mid) - day).days))
        hits.append(at(low) <= day <= at(max(high, low + 1)))
        weight = {}
        for j, (_, v) in enumerate(train):
            if v is not None:
                weight[v] = weight.get(v, 0) + 0.5 ** ((i - 1 - j) / C["half_life"])
        top = min(weight, key=lambda v: (-round(weight[v], 9), v)) if weight else None
        if top is not None and value is not None:
            exact.append(top == value)
            near.append(abs(top - value) <= 5)
    share = lambda x: float(np.floor(sum(x) / len(x) * 100 + 0.5) / 100) if x else None
    return (len(errors), float(statistics.median(errors)), share(hits), share(exact), share(near))


def series(rng, n):
    day, out = dt.date(1990, 1, 1), []
    for _ in range(n):
        day += dt.timedelta(rng.randrange(4, 90))
        out.append((day, rng.choice([10.0, 10.0, 20.0, 24.0, 60.0, None])))
    return out


def test_one_pass(spark):
    rng = random.Random(12)
    given = {f"r{n}-{k}": series(rng, n) for n in (1, 3, 4, 5, 9, 40, 120) for k in range(4)} | {"none": [(d, None) for d, _ in series(rng, 8)]}
    df = spark.createDataFrame([("route", k, ev) for k, ev in given.items()], "scope string, route string, ev array<struct<d:date,pct:double>>")
    got = {r["route"]: tuple(r)[2:] for r in forecast.backtests(df).collect()}
    assert got == {k: plain(ev) for k, ev in given.items() if len(ev) > C["min_samples"]}
    assert forecast.backtests(df.limit(0)).count() == 0


def test_time_grows_with_the_events(spark):
    """Eight times the events take nowhere near the 64 times that a prefix each would take."""

    def took(n):
        rng, walk, day = random.Random(1), forecast.Walk(4.0), 0
        start = time.process_time()
        for _ in range(n):
            day += rng.randrange(4, 90)
            walk.see(day, float(rng.randrange(12)))
            walk.window(), walk.heaviest()
        return time.process_time() - start

    took(500)
    assert took(16_000) < 24 * max(took(2_000), 1e-3)
