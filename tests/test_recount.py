"""Sums up to a check's time against counting one by one."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from evalanvil.operators.recount import as_of

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def test_as_of(spark):
    rng = random.Random(4)
    when = lambda: T0 + timedelta(seconds=rng.choice((0, 1, 3599, 3600, 7200, rng.randrange(400_000))))
    key = lambda: rng.choice(("hot", "hot", "a", "b", None))
    steps = [(key(), when() if rng.random() < 0.95 else None, rng.choice((1, 1, -1)), 1) for _ in range(600)]
    checks = [(i, key(), when() if rng.random() < 0.9 else None) for i in range(80)] + [(99, "nobody", T0)]
    got = as_of(
        spark.createDataFrame(steps, "k string, t timestamp, n long, m long"), spark.createDataFrame(checks, "c long, k string, t timestamp"), ["k"], ["n", "m"], "c"
    )
    want = {c: tuple(sum(s[j] for s in steps if s[0] == k and s[1] and t and s[1] <= t) for j in (2, 3)) for c, k, t in checks}
    assert {r["c"]: (r["n"], r["m"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # slices with checks, and the checks themselves: steps meet no check
    empty = as_of(spark.createDataFrame([], "k string, t timestamp, n long, m long"), spark.createDataFrame(checks, "c long, k string, t timestamp"), ["k"], ["n", "m"], "c")
    assert {(r["n"], r["m"]) for r in empty.collect()} == {(0, 0)}
