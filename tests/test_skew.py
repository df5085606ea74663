"""A key that holds a third of all rows is split at run time, and the result is the same."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from evalanvil.operators.orphans import find_orphans
from evalanvil.operators.recount import as_of
from evalanvil.operators.redelivery import keepers

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "12",
}


def test_hot_key(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        n = 60_000
        at = datetime(2025, 5, 5, tzinfo=timezone.utc)
        key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
        refs = spark.range(0, n, 1, 12).select(F.col("id").alias("row_id"), key.alias("k"), F.lit(at).alias("at"))
        known = [(f"k{i}", at - timedelta(days=90), None) for i in range(0, 5000, 2)]
        parents = spark.createDataFrame(known, "k string, b timestamp, e timestamp")
        found = find_orphans(refs, parents, ["k"], "row_id", "at", "b", "e")
        got = found.toPandas()
        want = n // 3 + sum(1 for i in range(n) if i % 3 and (i % 5000) % 2)
        assert len(got) == want and set(got["kind"]) == {"missing"}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_message_and_hot_run(spark):
    """A message, and a run, with a third of all rows: pre-aggregated before they move, and counted right."""
    n, at = 30_000, F.lit(datetime(2025, 5, 5, tzinfo=timezone.utc))
    hot = F.col("id") % 3 == 0
    lines = spark.range(0, n, 1, 12).select(
        F.col("id").alias("row_id"), F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("m"), (F.col("id") % 4000).cast("string"))).alias("k"),
        (at + F.make_interval(days=(F.col("id") % 60).cast("int"))).alias("t"),
    )
    want = {}
    for i in range(n):
        want.setdefault("hot" if i % 3 == 0 else f"m{i % 4000}", i)
    assert {r["row_id"] for r in keepers(lines, ["k"], "row_id", "t").collect()} == set(want.values())
    runs = lines.select(F.when(F.col("k") == "hot", "hot").otherwise("rest").alias("run"), "t", F.lit(1).cast("long").alias("n"))
    checks = spark.createDataFrame([(i, ("hot", "rest")[i % 2], datetime(2025, 5, 5, tzinfo=timezone.utc) + timedelta(days=i)) for i in range(70)], "c long, run string, t timestamp")
    got = {r["c"]: r["n"] for r in as_of(runs, checks, ["run"], ["n"], "c").collect()}
    count = lambda i: sum(1 for x in range(n) if (x % 3 == 0) == (i % 2 == 0) and x % 60 <= i)
    assert all(got[i] == count(i) for i in (0, 1, 30, 31, 69))
