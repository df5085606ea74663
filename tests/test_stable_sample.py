from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from evalanvil.operators.stable_sample import advance, chosen, threefry, uniform

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
RATE = lambda e: F.when(e % 2 == 0, 0.5).otherwise(0.2)


def samples(spark, n, days=0, extra=()):
    rows = [(f"{i:012x}", T0 + timedelta(days=i % 300 + days), i) for i in range(n)] + list(extra)
    return spark.createDataFrame(rows, "id string, added_at timestamp, epoch int")


def test_published_values(spark):
    zero = F.lit(0).cast("long")
    assert spark.range(1).select(threefry(zero, zero)).first()[0] == 0x6B200159
    ones = F.lit(0xFFFFFFFF).cast("long")
    assert 0 <= spark.range(1).select(threefry(ones, ones, 0xFFFFFFFF)).first()[0] < 2**32


def test_uniform(spark):
    u = [r[0] for r in spark.range(20_000).select(uniform(F.col("id").cast("string"))).collect()]
    assert abs(sum(u) / len(u) - 0.5) < 0.01 and 0 <= min(u) and max(u) < 1
    tenths = [sum(int(x * 10) == k for x in u) for k in range(10)]
    assert max(tenths) - min(tenths) < 300


def test_grows_and_layout(spark):
    small, large = samples(spark, 400), samples(spark, 900)
    a = {r["id"] for r in chosen(advance(None, small, "id", "added_at", RATE)).collect()}
    b = {r["id"] for r in chosen(advance(None, large.repartition(9), "id", "added_at", RATE)).collect()}
    assert a and a <= b
    again = advance(advance(None, small, "id", "added_at", RATE), large, "id", "added_at", lambda e: F.lit(0.0))
    kept = {r["id"] for r in chosen(again).collect()}
    assert kept == a  # frozen rates stay, new records get the new rate


def test_shared_and_odd_ids(spark):
    extra = [("  ABC ", T0 + timedelta(days=90), 1), ("abc", T0, 1), (None, T0, 1), ("x", None, 1)]
    registry = {r["id"]: r for r in advance(None, samples(spark, 0, extra=extra), "id", "added_at", RATE).collect()}
    assert set(registry) == {"abc", "x"} and registry["abc"]["epoch"] == 2025 * 12 and registry["x"]["epoch"] == -1
    assert advance(None, samples(spark, 0), "id", "added_at", RATE).count() == 0


def test_queries_keep_the_registry(spark, tmp_path):
    """Grow, run again, purge, and a late row with an earlier time: what was chosen stays chosen at its frozen rate."""
    from evalanvil.plans import problems

    when = lambda year: datetime(year, 3, 1, tzinfo=timezone.utc)
    ids = lambda a, b: [f"{i:012x}" for i in range(a, b)]

    def put(rows):
        spark.createDataFrame(rows, "id string, added_at timestamp").write.mode("overwrite").parquet(f"{tmp_path}/t/samples.parquet")

    rows = lambda q: {tuple(r) for r in q(spark, f"{tmp_path}/t").collect()}
    put([(i, when(2027)) for i in ids(0, 300)])
    first = rows(problems.p3_sample)
    assert first and rows(problems.p3_sample) == first and {r[1] for r in first} == {2027 * 12 + 2}
    put([(i, when(2025)) for i in ids(0, 100)] + [(i, when(2029)) for i in ids(0, 400)])
    again = rows(problems.p3_sample)
    assert first <= again and {r[1] for r in again - first} == {2029 * 12 + 2}
    shares = rows(problems.p3_shares)
    assert {(r[0], r[2]) for r in shares} == {(2027 * 12 + 2, 300), (2029 * 12 + 2, 100)} and sum(r[3] for r in shares) == len(again)
    put([(i, when(2029)) for i in ids(200, 400)])
    assert rows(problems.p3_sample) == {r for r in again if int(r[0], 16) >= 200}
    spark.conf.set(problems.REGISTRY, f"{tmp_path}/registry")
    try:
        put([(i, when(2025)) for i in ids(0, 50)])
        rows(problems.p3_sample)
        assert spark.read.parquet(f"{tmp_path}/registry").count() == 50
    finally:
        spark.conf.unset(problems.REGISTRY)
