from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from evalanvil.operators.orphans import find_orphans, first_kind

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
REFS = "row_id long, a string, b string, at timestamp, begins string"
PARENTS = "a string, b string, begins timestamp, ends timestamp, at int"


def brute(refs, parents):
    out = {}
    for row_id, a, b, at, _ in refs:
        lives = [(s, e) for pa, pb, s, e, _ in parents if a is not None and b is not None and (pa, pb) == (a, b)]
        if not lives:
            out[row_id] = "missing"
        elif at is None or any((s is None or s <= at) and (e is None or e > at) for s, e in lives):
            continue
        elif any(e is not None and e <= at for s, e in lives):
            out[row_id] = "deleted"
        else:
            out[row_id] = "late"
    return out


def run(spark, refs, parents):
    found = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), ["a", "b"], "row_id", "at", "begins", "ends")
    return {r["ref_id"]: r["kind"] for r in found.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    rng = random.Random(seed)
    day = lambda: T0 + timedelta(days=rng.randint(0, 200), seconds=rng.randint(0, 9))
    keys = [(x, y) for x in "pqr" for y in "uvwxyz"]
    parents = []
    for a, b in rng.sample(keys, 13):
        for _ in range(rng.choice((1, 1, 1, 2))):
            start = rng.choice((day(), day(), None))
            parents.append((a, b, start, None if rng.random() < 0.5 else (start or T0) + timedelta(days=rng.randint(0, 90)), 1))
    parents += parents[:3] + [(None, "u", T0, None, 1)]
    refs = [(i, *(rng.choice(keys) if rng.random() < 0.9 else (None, "u")), day() if rng.random() < 0.95 else None, "x") for i in range(300)]
    refs += [(1000 + i, "p", "u", T0 + timedelta(days=i % 200), "x") for i in range(200)]  # a hot key
    assert run(spark, refs, parents) == brute(refs, parents)


def test_boundaries(spark):
    at = datetime(2025, 3, 1, tzinfo=timezone.utc)
    second = timedelta(seconds=1)
    refs = [(1, "a", "b", at, ""), (2, "a", "b", at - second, ""), (3, "c", "d", at, ""), (4, "c", "d", at - second, "")]
    parents = [("a", "b", at, None, 0), ("c", "d", T0, at, 0)]
    assert run(spark, refs, parents) == {2: "late", 3: "deleted"}


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, "a", "b", T0, "")], []) == {1: "missing"}
    assert run(spark, [], [("a", "b", T0, None, 0)]) == {}


def test_first_kind(spark):
    rows = [(1, 5, "late"), (1, 5, "missing"), (2, 5, "late"), (2, 5, "deleted")]
    found = first_kind(spark.createDataFrame(rows, "ref_id long, month int, kind string"))
    assert {r["ref_id"]: r["kind"] for r in found.collect()} == {1: "missing", 2: "deleted"}
