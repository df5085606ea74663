"""Panels of models over samples: pass matrices, filters, strata, representative subsets, drift.

The matrix, filters, strata and accuracies are DataFrame operations over the tidy form
(sample_id, model, pass). The subset search is sequential by nature and runs as one task. It is given
strata, quotas and accuracies of the whole pool, but of the samples only those that it could ever
take: samples of a stratum with the same pass vector are interchangeable, so as many of them as the
stratum's quota are enough. What it holds is thus bounded by vectors and quotas, not by samples.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalanvil.functions.text import accuracy
from evalanvil.operators.attempts import positions
from evalanvil.plans.session import cut

#: Samples that one subset search accepts, after the reduction to interchangeable ones.
MOST = 200_000
BINS, ROUNDS, FOLDS = 3, 20, 5


def pass_matrix(tidy: DataFrame, sample: str = "sample_id", model: str = "model", flag: str = "pass") -> DataFrame:
    """(sample_id, pv): each sample's passes in the order of the names of all models.

    One row per (sample, model) is made first (a pass if any row is); nulls and missing results
    count as fails, so all arrays are as long as the panel. Its names come to the driver, a panel
    being small; a null model is none.
    """
    known = tidy.where(F.col(model).isNotNull())
    names = [r[0] for r in known.select(model).distinct().orderBy(model).collect()]
    one = known.groupBy(sample, model).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias(flag))
    passed = F.collect_list(F.when(F.col(flag), F.col(model)))
    every = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return one.groupBy(sample).agg(passed.alias("__p")).select(sample, F.transform(every, lambda m: F.array_contains("__p", m)).alias("pv"))


def not_unanimous(matrix: DataFrame) -> DataFrame:
    """Samples on which the models disagree."""
    return matrix.where(F.exists("pv", lambda x: x) & F.exists("pv", lambda x: ~x))


def distinct_behavior(matrix: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One sample, the lowest id, per pass vector. Combined map-side, so a vector that many samples share is cheap."""
    return matrix.groupBy("pv").agg(F.min(sample).alias(sample)).select(sample, "pv")


FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"not_unanimous": not_unanimous, "distinct_behavior": distinct_behavior}


def stage_counts(matrix: DataFrame, filters: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> list[dict]:
    """Rows before and after each filter."""
    out, before = [], matrix.count()
    for name, f in (FILTERS if filters is None else filters).items():
        matrix = matrix.transform(f)
        after = matrix.count()
        out.append({"stage": name.replace("_", "-"), "before": before, "after": after})
        before = after
    return out


def complete_models(tidy: DataFrame, samples: DataFrame, sample: str = "sample_id", model: str = "model", flag: str = "pass") -> DataFrame:
    """Every model with have, missing, total, passes and why it is left out (null if it is kept).

    Reasons in this order: 'scoring failed' (no result of any sample), 'incomplete' (samples missing),
    'zero accuracy'. Results for unknown samples are ignored.
    """
    known = tidy.join(samples.select(sample).distinct(), sample, "left_semi")
    one = known.groupBy(model, sample).agg(F.max(F.coalesce(F.col(flag), F.lit(False))).alias(flag))
    total = F.lit(samples.select(sample).distinct().count())
    per = one.groupBy(model).agg(F.count(F.lit(1)).alias("have"), F.count_if(F.col(flag)).alias("passes"))
    every = tidy.select(model).distinct().join(per, model, "left").na.fill(0, ["have", "passes"])
    missing = total - F.col("have")
    reason = F.when(F.col("have") == 0, "scoring failed").when(missing > 0, "incomplete").when(F.col("passes") == 0, "zero accuracy")
    return every.select(model, "have", missing.alias("missing"), total.alias("total"), "passes", reason.alias("reason"))


def model_accuracy(tidy: DataFrame, model: str = "model", flag: str = "pass") -> DataFrame:
    """(model, passes, samples, accuracy)."""
    per = tidy.groupBy(model).agg(F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("passes"), F.count(F.lit(1)).alias("samples"))
    return per.withColumn("accuracy", accuracy(F.col("passes"), F.col("samples")))


def drift(tidy: DataFrame, chosen: DataFrame, sample: str = "sample_id", model: str = "model", flag: str = "pass") -> DataFrame:
    """(model, full_accuracy, subset_accuracy, deviation) of a subset of samples against all."""
    full = model_accuracy(tidy, model, flag).select(model, F.col("accuracy").alias("full_accuracy"))
    part = model_accuracy(tidy.join(chosen.select(sample).distinct(), sample, "left_semi"), model, flag)
    joined = full.join(part.select(model, F.col("accuracy").alias("subset_accuracy")), model, "left")
    sub = F.coalesce("subset_accuracy", F.lit(0.0))
    return joined.select(model, "full_accuracy", sub.alias("subset_accuracy"), F.abs(sub - F.col("full_accuracy")).alias("deviation"))


def max_deviation(drifts: DataFrame) -> DataFrame:
    """One row: the largest deviation (infinite if nothing was chosen from anything)."""
    return drifts.agg(F.coalesce(F.max("deviation"), F.lit(float("inf"))).alias("max_deviation"), F.avg("deviation").alias("mean_deviation"))


def kendall_tau(scores: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One row: tau over all pairs of models, ties in the denominator. A panel is small by nature (its
    pairs are enumerated within one row's array of models, not by a join)."""
    listed = scores.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("a"))
    pairs = listed.select("a", F.posexplode("a").alias("i", "p")).select(
        F.explode(F.slice("a", F.col("i") + 2, F.greatest(F.size("a"), F.lit(1)))).alias("q"), "p"
    )
    sign = F.signum((F.col("p.x") - F.col("q.x")) * (F.col("p.y") - F.col("q.y")))
    return pairs.agg(accuracy(F.sum(sign), F.count(F.lit(1))).alias("kendall_tau"))


def top_models(scores: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """The n best models, ties by name."""
    return scores.orderBy(F.desc(value), F.asc(key)).limit(n).select(key)


def top_agreement(scores: DataFrame, key: str, x: str, y: str, n: int = 5) -> DataFrame:
    """One row: the share of the n best by x that are among the n best by y."""
    both = top_models(scores, key, x, n).join(top_models(scores, key, y, n), key, "left_semi")
    return both.agg((F.count(F.lit(1)) / F.lit(float(n))).alias("top_agreement"))


def difficulty_bins(samples: DataFrame, group: str, passes: str, sample: str = "sample_id", bins: int = BINS) -> DataFrame:
    """samples with `bin` 0 (hardest) to bins - 1 within their group; a remainder goes to the last bins.

    Samples are ordered by (group, passes, id) with Spark's range sort and numbered per partition, so a
    group with a third of all samples is spread over many tasks. Empty bins have no rows; a null group
    is a group of its own; null passes come first.
    """
    numbered = positions(samples.select(sample, group, passes), group, passes, sample)
    sizes = numbered.groupBy(group).agg(F.min("position").alias("__first"), F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumnRenamed(group, "__group")  # one row per group
    placed = numbered.join(sizes, numbered[group].eqNullSafe(F.col("__group")))
    rank, small = F.col("position") - F.col("__first"), F.floor(F.col("__n") / bins)
    plain = F.lit(bins) - F.col("__n") % bins  # bins without one of the remainder
    low = F.floor(F.try_divide(rank, small))
    high = plain + F.floor((rank - small * plain) / (small + 1))
    at = F.when(rank < small * plain, low).otherwise(high)
    return placed.select(sample, group, passes, at.cast("int").alias("bin"))


def allocate(sizes: dict[tuple, int], wanted: int) -> dict[tuple, int]:
    """Quota per cell: in proportion, at least 1, at most its size; what is left goes by largest remainder
    (ties: highest key), what is too much is taken by smallest remainder from cells above 1.

    May still exceed `wanted` if there are more cells than that, and fall short of it if they hold less.
    """
    total = sum(sizes.values())
    if not total:
        return {}
    share = {k: n / total * wanted for k, n in sizes.items()}
    quota = {k: min(n, max(1, int(share[k]))) for k, n in sizes.items()}
    ranked = sorted(sizes, key=lambda k: (share[k] - int(share[k]), k))
    while sum(quota.values()) < wanted:
        open_cells = [k for k in reversed(ranked) if quota[k] < sizes[k]]
        if not open_cells:
            break
        for k in open_cells[: wanted - sum(quota.values())]:
            quota[k] += 1
    while sum(quota.values()) > wanted:
        above = [k for k in ranked if quota[k] > 1]
        if not above:
            break
        for k in above[: sum(quota.values()) - wanted]:
            quota[k] -= 1
    return quota


def cell_quotas(cells: DataFrame, group: str, wanted: int) -> DataFrame:
    """(group, bin, size, quota); only cell sizes reach the driver (groups times bins)."""
    rows = cells.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("size")).collect()
    sizes = {(r[group], r["bin"]): r["size"] for r in rows}
    quota = allocate(sizes, wanted)
    schema = f"`{group}` {dict(cells.dtypes)[group]}, bin int, size long, quota long"
    return cells.sparkSession.createDataFrame([(g, b, sizes[g, b], q) for (g, b), q in sorted(quota.items())], schema)


def cells_of(ids: list[str], groups: list[str], passes: np.ndarray, bins: int) -> dict[tuple[str, int], list[int]]:
    """Positions of samples per (group, bin), hardest first; ids are sorted."""
    out: dict[tuple[str, int], list[int]] = {}
    by: dict[str, list[int]] = {}
    for i, g in enumerate(groups):
        by.setdefault(g, []).append(i)
    for g, members in by.items():
        members = sorted(members, key=lambda i: (passes[i], ids[i]))
        small, more = divmod(len(members), bins)
        at = 0
        for b in range(bins):
            size = small + (b >= bins - more)
            if size:
                out[g, b] = members[at : at + size]
            at += size
    return out


def _worst(correct: np.ndarray, n: int, full: np.ndarray) -> np.ndarray:
    """The largest deviation over models, for one or many candidate sums."""
    return np.abs(correct / n - full).max(axis=-1)


def choose(
    pv: np.ndarray, cells: dict[tuple[str, int], list[int]], wanted: int, seed: int, rounds: int = ROUNDS,
    full: np.ndarray | None = None, quota: dict[tuple[str, int], int] | None = None,
) -> list[int]:
    """Positions of a subset whose accuracy per model is close to the full one: cell by cell the sample
    that keeps the worst model's deviation lowest, then swaps inside cells while they help.

    full and quota are those of the whole pool, if what is given is only a part of it.
    """
    rng = random.Random(seed)
    x = pv.astype(np.float64)
    full = x.mean(axis=0) if full is None else full
    quota = allocate({k: len(v) for k, v in cells.items()}, wanted) if quota is None else quota
    order = list(cells)
    rng.shuffle(order)
    chosen: list[int] = []
    correct = np.zeros(x.shape[1])
    for cell in order:
        pool = list(cells[cell])
        rng.shuffle(pool)
        for _ in range(quota[cell]):
            worst = _worst(correct + x[pool], len(chosen) + 1, full)
            at = rng.choice(np.flatnonzero(worst == worst.min()).tolist())
            picked = pool.pop(at)
            chosen.append(picked)
            correct = correct + x[picked]
    home = {i: cell for cell, members in cells.items() for i in members}
    for _ in range(rounds):
        improved = False
        turns = list(range(len(chosen)))
        rng.shuffle(turns)
        taken = set(chosen)
        for t in turns:
            old = chosen[t]
            others = [i for i in cells[home[old]] if i not in taken]
            if not others:
                continue
            without = correct - x[old]
            worst = _worst(without + x[others], len(chosen), full)
            if worst.min() < _worst(correct, len(chosen), full) - 1e-12:
                new = others[rng.choice(np.flatnonzero(worst == worst.min()).tolist())]
                taken.remove(old)
                taken.add(new)
                chosen[t], correct, improved = new, without + x[new], True
        if not improved:
            break
    return chosen


#: A selector: pass vectors, positions per cell, samples wanted and a seed give the positions chosen.
Selector = Callable[[np.ndarray, dict[tuple[str, int], list[int]], int, int], list[int]]


def _bounded(pool: DataFrame, most: int) -> DataFrame:
    n = pool.count()
    if n > most:
        raise ValueError(f"{n} samples are more than one search accepts ({most}); filter the pool first")
    return pool


def representative_subset(
    matrix: DataFrame, group: str, wanted: int, bins: int = BINS, seed: int = 0, sample: str = "sample_id", most: int = MOST, selector: Selector = choose
) -> DataFrame:
    """(sample_id, grp, bin) of a representative subset of (sample_id, pv, group).

    Reproducible whatever the order of rows: samples are sorted by id. A null group is the group ''.
    Pools of any size are searched exactly (see the module); only one with more than `most` samples
    after the reduction raises. Another selector gets the whole pool, which `most` then bounds.
    """
    grp = F.coalesce(F.col(group).cast("string"), F.lit(""))
    pool = matrix.select(F.col(sample).cast("string").alias("sid"), "pv", grp.alias("grp"))
    passes = F.size(F.filter("pv", lambda x: x))
    binned = difficulty_bins(pool.select("sid", "grp", passes.alias("passes")), "grp", "passes", "sid", bins).select("sid", "bin")
    pool = cut(pool.join(binned, "sid"))
    sizes = {(r["grp"], r["bin"]): r["n"] for r in pool.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # groups times bins
    quota = allocate(sizes, wanted)
    full = np.array([r["a"] for r in pool.select(F.posexplode("pv").alias("m", "x")).groupBy("m").agg(F.avg(F.col("x").cast("int")).alias("a")).orderBy("m").collect()])
    reduced = selector is choose
    if reduced:  # pushed below the shuffle, so a vector that a third of all samples have costs its quota
        alike = Window.partitionBy("grp", "bin", "pv").orderBy("sid")
        pool = pool.withColumn("__r", F.row_number().over(alike)).where(F.col("__r") <= max(quota.values(), default=0)).drop("__r")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid", kind="stable").reset_index(drop=True)
        cells: dict[tuple[str, int], list[int]] = {}
        for i, k in enumerate(zip(pdf["grp"], pdf["bin"])):
            cells.setdefault((k[0], int(k[1])), []).append(i)
        cells = dict(sorted(cells.items()))
        pv = np.array(pdf["pv"].tolist(), dtype=bool)
        picked = sorted(choose(pv, cells, wanted, seed, full=full, quota=quota) if reduced else selector(pv, cells, wanted, seed))
        return pd.DataFrame({"sample_id": pdf["sid"][picked], "grp": pdf["grp"][picked], "bin": pdf["bin"][picked]})

    return _bounded(pool, most).groupBy(F.lit(0).alias("run")).applyInPandas(search, "sample_id string, grp string, bin int")


def model_folds(n_models: int, folds: int = FOLDS, seed: int = 0) -> list[list[int]]:
    """A seeded permutation of models in folds; a remainder goes to the last folds."""
    if not 2 <= folds <= n_models:
        raise ValueError("folds must be between 2 and the number of models")
    order = list(range(n_models))
    random.Random(seed).shuffle(order)
    small, more = divmod(n_models, folds)
    out, at = [], 0
    for f in range(folds):
        size = small + (f >= folds - more)
        out.append(order[at : at + size])
        at += size
    return out


def held_out(
    matrix: DataFrame, group: str, wanted: int, folds: int = FOLDS, seed: int = 0, bins: int = BINS, sample: str = "sample_id", most: int = MOST, selector: Selector = choose
) -> DataFrame:
    """(model_index, full, held): each model's accuracy in full and on the subset chosen without it.

    `seed` sets the folds only; `selector` is any function that chooses a subset. Each fold chooses
    on the models of the other folds; the accuracies are aggregations over all samples.
    """
    spark, schema = matrix.sparkSession, "model_index int, full double, held double"
    first = matrix.select(F.size("pv").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    pool = cut(matrix.select(F.col(sample).cast("string").alias("sid"), "pv", F.col(group).alias("grp")))
    out = []
    for test in model_folds(first["n"], folds, seed):
        train = [m for m in range(first["n"]) if m not in set(test)]
        seen = pool.select("sid", F.array(*(F.col("pv")[m] for m in train)).alias("pv"), "grp")
        chosen = cut(representative_subset(seen, "grp", wanted, bins, 0, "sid", most, selector)).select(F.col("sample_id").alias("sid"), F.lit(True).alias("chosen"))
        results = pool.join(chosen, "sid", "left").select("chosen", F.explode(F.array(*(F.struct(F.lit(m).alias("model_index"), F.col("pv")[m].cast("int").alias("x")) for m in test))).alias("r"))
        out.append(
            results.groupBy(F.col("r.model_index").alias("model_index"))
            .agg(F.avg("r.x").alias("full"), F.avg(F.when(F.col("chosen"), F.col("r.x"))).alias("held"))
        )
    return reduce(DataFrame.unionByName, out)


def cv_summary(held: DataFrame) -> dict:
    """Mean and largest drift, tau and top-5 agreement of `held_out`."""
    d = F.abs(F.col("held") - F.col("full"))
    m = held.agg(F.avg(d).alias("mean_deviation"), F.max(d).alias("max_deviation")).first().asDict()
    tau = kendall_tau(held, "model_index", "full", "held").first()[0]
    top = top_agreement(held, "model_index", "full", "held").first()[0]
    return {**m, "kendall_tau": tau, "top5_agreement": top}


def compact(tidy: DataFrame, groups: DataFrame, wanted: int | None, spark: SparkSession, group: str = "grp", seed: int = 0) -> tuple[DataFrame, dict]:
    """(chosen samples, report): exclusion of incomplete models, filters, cross-validation and selection
    on the filtered pool, drift against the unfiltered one."""
    models = complete_models(tidy, groups)
    kept = tidy.join(models.where("reason is null").select("model"), "model", "left_semi")
    matrix = cut(pass_matrix(kept))
    stages, pool = stage_counts(matrix), matrix
    for f in FILTERS.values():
        pool = pool.transform(f)
    pool = cut(pool.join(groups.select("sample_id", group), "sample_id"))
    names = [r[0] for r in models.where("reason is null").select("model").orderBy("model").collect()]
    report: dict = {"stages": stages, "models": names, "skipped": [r.asDict() for r in models.where("reason is not null").orderBy("model").collect()]}
    n = pool.count()
    if wanted and n > wanted:
        n_models = models.where("reason is null").count()
        if n_models >= FOLDS:
            report["held_out_cv"] = {"cv_folds": FOLDS, "cv_seed": seed, **cv_summary(cut(held_out(pool, group, wanted, seed=seed)))}
        chosen = representative_subset(pool, group, wanted, seed=seed).select("sample_id")
    else:
        chosen = pool.select(F.col("sample_id").cast("string").alias("sample_id"))
    chosen = cut(chosen)
    if not chosen.head(1):
        raise ValueError("no sample is left after the filters")
    report["max_deviation_in_sample"] = max_deviation(drift(kept.withColumn("sample_id", F.col("sample_id").cast("string")), chosen)).first()[0]
    return chosen, report


def group_key(eval_id: str) -> Column:
    """The stratum of a sample, by eval."""
    keys = {
        "ifbench": lambda: F.col("n_constraints").cast("string"),
        "ifstruct": lambda: F.col("entity_type"),
        "gpqa_diamond": lambda: F.col("answer"),
        "math_500": lambda: F.lit("all"),
    }
    if eval_id not in keys:
        raise KeyError(f"unknown eval {eval_id!r}")
    return keys[eval_id]()
