"""Recounting checks of completeness as of the moment they were made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalanvil.functions.keys import model_key, norm_id, present, py_strip


def expected_ids(samples: DataFrame, specs: DataFrame) -> DataFrame:
    """Every message id a run should have: (eval_id, dataset, id, added_at, removed_at).

    A sample appears `repeats` times with `#0`, `#1`, … or once, without suffix, if `repeats` is 1.
    Repeated samples collapse; null ids, and samples whose data set has no spec, are left out.
    """
    s = (
        samples.select("eval_id", "dataset", norm_id(F.col("id")).alias("sid"), "added_at", "removed_at")
        .dropna(subset=["sid"])
        .distinct()
    )
    r = specs.groupBy("eval_id", "dataset").agg(F.max("repeats").alias("repeats"))
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.col("repeats"), F.lit(1)) - 1))
    return (
        s.join(r.where(F.col("repeats") >= 1), ["eval_id", "dataset"])
        .select("eval_id", "dataset", "sid", "added_at", "removed_at", "repeats", k.alias("k"))
        .select(
            "eval_id",
            "dataset",
            F.when(F.col("repeats") == 1, F.col("sid")).otherwise(F.concat_ws("#", "sid", "k")).alias("id"),
            "added_at",
            "removed_at",
        )
    )


#: Seconds of a slice of time in which steps and checks are put in order together.
SLICE = 3600


def as_of(steps: DataFrame, checks: DataFrame, keys: list[str], counts: list[str], check_id: str) -> DataFrame:
    """(check_id, counts): the sums of all steps of a check's key at or before its time.

    steps: keys, t and counts; checks: keys, t and a unique check_id. Steps and checks are never joined:
    steps are summed per key and moment map-side, then put in order with the checks inside slices of
    time, and a running sum over slices (one row each) adds what came before. So a key that holds a
    third of all steps is spread over its slices. Steps without a time are left out; a check without
    a time, or whose key has no steps, gets zeros.
    """
    moments = steps.where(F.col("t").isNotNull()).groupBy(*keys, "t").agg(*(F.sum(c).alias(c) for c in counts))
    timed = checks.where(F.col("t").isNotNull()).select(*keys, "t", F.col(check_id).alias("__check"))
    zero = F.lit(0).cast("long")
    nobody = F.lit(None).cast(dict(checks.dtypes)[check_id])
    line = (
        moments.select(*keys, "t", *(F.col(c).cast("long").alias(c) for c in counts), nobody.alias("__check"))
        .unionByName(timed.select(*keys, "t", *(zero.alias(c) for c in counts), "__check"))
        .withColumn("__slice", F.floor(F.unix_micros("t") / (SLICE * 1_000_000)))
    )
    up_to = Window.partitionBy(*keys, "__slice").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    inside = line.select(*keys, "__slice", "__check", *(F.sum(c).over(up_to).alias(c) for c in counts)).where(F.col("__check").isNotNull())
    slices = line.groupBy(*keys, "__slice").agg(*(F.sum(c).alias(c) for c in counts))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select(*keys, "__slice", *(F.coalesce(F.sum(c).over(earlier), zero).alias(f"__{c}") for c in counts))
    on = [inside[k].eqNullSafe(before[k]) for k in (*keys, "__slice")]
    summed = inside.join(before, reduce(Column.__and__, on)).select("__check", *((F.col(c) + F.col(f"__{c}")).alias(c) for c in counts))
    out = checks.select(check_id).join(summed, F.col(check_id) == F.col("__check"), "left")
    return out.select(check_id, *(F.coalesce(F.col(c), zero).alias(c) for c in counts))


def recount(verifications: DataFrame, completions: DataFrame, samples: DataFrame, specs: DataFrame) -> DataFrame:
    """total, have, missing, extra, duplicates and empty of every check, as of its `verified_at`.

    Lines, first arrivals and terms of service become dated +1/-1 steps that are summed up to each
    check's time (see as_of). A check of a model without lines, or of a data set without samples,
    counts 0. Null `verified_at` or names give zeros; a null completion is empty.
    """
    run = ["eval_id", "dataset", "model"]
    lines = completions.select(
        "eval_id",
        "dataset",
        model_key(F.col("model")).alias("model"),
        present(norm_id(F.col("id"))).alias("id"),
        F.col("received_at").alias("t"),
        (F.trim(F.coalesce(py_strip(F.col("completion")), F.lit(""))) == "").cast("long").alias("empty"),
    )
    messages = lines.groupBy(*run, "id").agg(F.min("t").alias("t"))
    expected = expected_ids(samples, specs)
    begin = F.greatest(F.col("t"), F.col("added_at"))
    held = messages.join(expected, ["eval_id", "dataset", "id"]).select(
        *run, begin.alias("begin"), F.col("removed_at").alias("end")
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def steps(df: DataFrame, keys: list[str], t: str, names: tuple[str, ...], **deltas) -> DataFrame:
        return df.select(*keys, F.col(t).alias("t"), *(deltas.get(n, zero).alias(n) for n in names))

    counts = ("rows", "distinct", "have", "empty")
    of_run = (
        steps(lines, run, "t", counts, rows=one, empty=F.col("empty"))
        .unionByName(steps(messages, run, "t", counts, distinct=one))
        .unionByName(steps(held.where("end is null or end > begin"), run, "begin", counts, have=one))
        .unionByName(steps(held.where("end > begin"), run, "end", counts, have=-one))
    )
    live = expected.where("removed_at is null or removed_at > added_at")
    of_set = steps(live, run[:2], "added_at", ("total",), total=one).unionByName(
        steps(live.where("removed_at is not null"), run[:2], "removed_at", ("total",), total=-one)
    )
    checks = verifications.select(
        "verification_id", "eval_id", "dataset", model_key(F.col("model")).alias("model"), F.col("verified_at").alias("t")
    )
    counted = as_of(of_run, checks.dropna(subset=run), run, list(counts), "verification_id")
    totals = as_of(of_set, checks.dropna(subset=run[:2]).drop("model"), run[:2], ["total"], "verification_id")
    c = lambda name: F.coalesce(F.col(name), zero)
    return (
        checks.select("verification_id")
        .join(counted, "verification_id", "left")
        .join(totals, "verification_id", "left")
        .select(
            "verification_id",
            c("total").alias("total"),
            c("have").alias("have"),
            (c("total") - c("have")).alias("missing"),
            (c("distinct") - c("have")).alias("extra"),
            (c("rows") - c("distinct")).alias("duplicates"),
            c("empty").alias("empty"),
        )
    )
