"""Mixing sources to target weights, by a curriculum that varies over the run.

Every source has a schedule: relative weights at moments of the run, linear in between, scaled so
that their mean is the target share. Integrating it gives the tokens the source should have
delivered by any moment; inverting that at a document's cumulative tokens (in a fixed random order,
repeated as often as needed) gives the document's moment, and what all sources have delivered by
then its position in training order. Documents are then range-sorted by position.

The total is the largest at which no source is used more often than it may be. Only one row per
target (a fixed, small table) reaches the driver. Cumulative tokens are summed in ranges of the hash
that orders a source, so a source with a third of all documents is summed by many tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalanvil.llm.packing import last_at_or_below
from evalanvil.llm.tokens import token_counts
from evalanvil.plans.session import cut

#: How far a schedule moves from the start to the end of the run: weights go from 1 - TILT to 1 + TILT times the share at most.
TILT = 0.5
#: Documents summed by one task at most, about.
SUMMED_PER_TASK = 50_000

SCHEMA = "position double, doc_id long, source string, copy int, tokens long"


#: A schedule: (moment in 0..1, relative weight), linear in between and level before the first and after the last.
Schedule = list[tuple[float, float]]


def schedules(shares: dict[str, float]) -> dict[str, Schedule]:
    """The schedules used unless others are given: w(t) = 1 + slope * (2t - 1); the shares add up to 1 at any t.

    Large sources come early, small ones late, so what is repeated is spread over the end of the run.
    """
    names = sorted(shares, key=lambda s: (-shares[s], s))
    if len(names) < 2:
        return {s: [(0.0, 1.0)] for s in names}
    rank = {s: i / (len(names) - 1) for i, s in enumerate(names)}
    mean = sum(shares[s] * rank[s] for s in names) / sum(shares.values())
    spread = max(abs(rank[s] - mean) for s in names) or 1.0
    slope = {s: TILT * (rank[s] - mean) / spread for s in names}
    return {s: [(0.0, 1 - a), (1.0, 1 + a)] for s, a in slope.items()}


def integrated(plan: dict[str, Schedule], shares: dict[str, float]) -> tuple[list[float], dict[str, tuple[list[float], list[float]]]]:
    """(moments, per source: weights at them with a mean of 1, and their integral up to them); '' stands for all sources by share.

    Moments are those of all schedules. A source without a schedule is level. Weights below 0,
    moments outside 0..1 and a schedule without any weight raise.
    """
    for s, points in plan.items():
        if not points or any(not 0 <= t <= 1 or w < 0 for t, w in points):
            raise ValueError(f"the schedule of {s!r} needs moments in 0..1 and weights of at least 0")
    moments = sorted({0.0, 1.0, *(float(t) for points in plan.values() for t, _ in points)})
    out = {}
    for s in shares:
        points = sorted(plan.get(s, [(0.0, 1.0)]))
        w = np.interp(moments, [t for t, _ in points], [x for _, x in points])
        total = float(np.concatenate(([0.0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(moments))))[-1])
        if total <= 0:
            raise ValueError(f"the schedule of {s!r} has no weight")
        w = w / total
        out[s] = (w.tolist(), np.concatenate(([0.0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(moments)))).tolist())
    out[""] = tuple(np.sum([shares[s] * np.array(out[s][k]) for s in shares], axis=0).tolist() for k in (0, 1))
    return moments, out


def budget(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """(total tokens, share per source): the largest total at which no source exceeds its repeats.

    Sources without tokens, without a share or that may not be used take no part; the other shares are scaled to 1.
    """
    able = {s: p for s, (p, r) in targets.items() if tokens.get(s, 0) > 0 and p > 0 and r >= 1}
    total = sum(able.values())
    shares = {s: p / total for s, p in able.items()}
    return min((targets[s][1] * tokens[s] / p for s, p in shares.items()), default=0.0), shares


def draw(
    documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, tokenizer: str | None = None,
    curriculum: dict[str, Schedule] | None = None,
) -> DataFrame:
    """(position, doc_id, source, copy, tokens) in training order.

    `curriculum` gives each source's schedule; without it, `schedules` does.

    `copy` counts a document's uses from 1 and never exceeds the source's max_repeats. A document is
    used if at least half of it lies before its source's demand. Documents with a null or unlisted
    source, or without tokens, take no part; targets with nulls are left out.
    """
    spark = documents.sparkSession
    wanted = {
        r["source"]: (float(r["target_share"]), int(r["max_repeats"]))
        for r in targets.select("source", "target_share", "max_repeats").dropna().distinct().collect()
    }  # a handful of rows
    listed = documents.where(F.col("source").isin(sorted(wanted))) if wanted else documents.limit(0)
    sizes = cut(token_counts(listed.select(F.col(id_col).alias("doc_id"), "source", F.col(text_col).alias("text")), path=tokenizer))
    sizes = sizes.where("tokens > 0")
    held = {r["source"]: (r["tokens"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    total, shares = budget({s: t for s, (t, _) in held.items()}, wanted)
    if not shares:
        return spark.createDataFrame([], SCHEMA)
    moments, weights = integrated(schedules(shares) if curriculum is None else curriculum, shares)
    plan = spark.createDataFrame(
        [
            (s, p * total, held[s][0], min(wanted[s][1], math.ceil(p * total / held[s][0] - 1e-9)), *weights[s])
            for s, p in sorted(shares.items())
        ],
        "source string, demand double, held long, rounds int, weight array<double>, due array<double>",
    )
    bits = max(0, math.ceil(math.log2(max(1, max(n for _, n in held.values()) / SUMMED_PER_TASK))))
    h = F.xxhash64(F.lit(seed), "doc_id")
    ordered = sizes.withColumn("h", h).withColumn("range", F.floor((F.col("h").cast("double") + 2.0**63) / 2.0 ** (64 - bits)))
    ranges = ordered.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        ordered.withColumn("start", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(offsets, ["source", "range"])
        .withColumn("start", F.col("start") + F.col("offset"))
        .join(plan, "source")
    )
    drawn = summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rounds")))).withColumn(
        "middle", (F.col("copy") - 1) * F.col("held") + F.col("start") + F.col("tokens") / 2.0
    )
    # the stretch between moments, of which there is nothing to search if there is one; no document lies beyond the
    # last moment, so what is found there belongs to the stretch before it
    searched = last_at_or_below(F.col("due"), F.least(F.col("middle") / F.col("demand"), F.lit(1.0)), len(moments))
    at = F.least(searched, F.lit(len(moments) - 2)) if len(moments) > 2 else F.lit(0)
    located = drawn.where(F.col("middle") <= F.col("demand")).withColumn("__k", at)
    k = F.col("__k")
    of = lambda values, i: F.array(*map(F.lit, values))[i]
    long = of(moments, k + 1) - of(moments, k)
    left = F.col("middle") / F.col("demand") - F.col("due")[k]
    w, bend = F.col("weight")[k], (F.col("weight")[k + 1] - F.col("weight")[k]) / long
    # w * x + bend * x * x / 2 = left, solved for x without a division by a bend of 0
    into = F.when(left <= 0, F.lit(0.0)).otherwise(2 * left / (w + F.sqrt(F.greatest(w * w + 2 * bend * left, F.lit(0.0)))))
    all_weight, all_due = weights[""]
    all_bend = (of(all_weight, k + 1) - of(all_weight, k)) / long
    delivered = of(all_due, k) + of(all_weight, k) * into + all_bend * into * into / 2
    return (
        located.select((delivered * F.lit(total)).alias("position"), "doc_id", "source", F.col("copy").cast("int").alias("copy"), "tokens")
        .orderBy("position", "source", "doc_id", "copy")
    )


def draw_shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, documents, most_used) of a draw; zeros for a source that took no part."""
    per_doc = drawn.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
    by_source = per_doc.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_used")
    )
    joined = targets.select("source", "target_share", "max_repeats").join(by_source, "source", "left").na.fill(0, ["tokens", "documents", "most_used"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
    return joined.withColumn("share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)))
