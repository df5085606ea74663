from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from evalanvil.operators.redelivery import drop_redelivered, keepers, surplus

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "row_id long, a string, b string, at timestamp, lane string, word int"


def rows_of(seed, n, days):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = "hot" if rng.random() < 0.33 else rng.choice("abcdefg") + str(rng.randint(0, n // 8)) if rng.random() < 0.95 else None
        out.append((i, a, rng.choice(("x", "y", None)), T0 + timedelta(days=rng.randint(0, days)) if rng.random() < 0.97 else None, "l", 1))
    rng.shuffle(out)
    return out


def first_of(rows):
    best = {}
    for r in rows:
        best[r[1], r[2]] = min(best.get((r[1], r[2]), r[0]), r[0])
    return set(best.values())


@pytest.mark.parametrize(("seed", "n", "days", "seconds"), [(1, 400, 30, 86_400), (2, 600, 2000, 86_400 * 7), (3, 300, 0, 86_400), (4, 500, 400, 86_400)])
def test_brute_force(spark, seed, n, days, seconds):
    rows = rows_of(seed, n, days)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r[0] for r in keepers(df, ["a", "b"], "row_id", "at", seconds).collect()}
    assert kept == first_of(rows)
    assert {r[0] for r in surplus(df, ["a", "b"], "row_id", "at", seconds).collect()} == {r[0] for r in rows} - kept


def test_whole_rows_and_layout(spark):
    rows = rows_of(5, 200, 50)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    out = drop_redelivered(df, ["a", "b"], "row_id", "at")
    assert out.columns == df.columns
    assert {r[0] for r in out.collect()} == first_of(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert keepers(df, ["a", "b"], "row_id", "at").count() == 0
    assert surplus(df, ["a", "b"], "row_id", "at").count() == 0
