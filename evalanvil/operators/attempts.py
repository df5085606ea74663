"""Repeated attempts, completeness and pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalanvil.functions.keys import logical_id
from evalanvil.functions.text import accuracy, is_blank, stderr


def expand(samples: DataFrame, repeats: int, id_col: str = "id") -> DataFrame:
    """Each sample `repeats` times with `#0`, `#1`, … at its id; unchanged if repeats is 1. Below 1 raises."""
    if isinstance(repeats, bool) or not isinstance(repeats, int) or repeats < 1:
        raise ValueError(f"repeats must be a positive integer, not {repeats!r}")
    if repeats == 1:
        return samples
    k = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    return samples.withColumn("__k", k).withColumn(id_col, F.concat_ws("#", id_col, "__k")).drop("__k")


def duplicate_ids(completions: DataFrame, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """(by, id, n) of ids that occur more than once. Null ids are one value."""
    return completions.groupBy(*(by or []), id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_ids(completions: DataFrame, samples: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of completions that no sample has; null keys match nothing and are unknown."""
    return completions.select(*on).distinct().join(samples.select(*on).distinct(), on, "left_anti")


def offenders(ids: DataFrame, what: str, id_col: str = "id", shown: int = 10) -> str:
    """'' or a message naming the first ids and how many more there are."""
    n = ids.count()
    if not n:
        return ""
    first = [str(r[0]) for r in ids.select(id_col).orderBy(id_col).limit(shown).collect()]
    return f"{what}: {', '.join(first)}" + (f" (and {n - shown} more)" if n > shown else "")


def score_join(completions: DataFrame, samples: DataFrame, on: list[str]) -> DataFrame:
    """Completions with their sample's columns. Duplicated samples are reduced to the last first, so no row multiplies."""
    return completions.join(last_of(samples, on), on)


def last_of(rows: DataFrame, on: list[str]) -> DataFrame:
    """The last row of every key in the order in which the rows are stored."""
    rest = [c for c in rows.columns if c not in on]
    row = F.struct(*rest, F.lit(0).alias("__one"))
    kept = rows.withColumn("__at", F.monotonically_increasing_id()).groupBy(*on).agg(F.max_by(row, "__at").alias("__row"))
    return kept.select(*on, *(F.col(f"__row.`{c}`").alias(c) for c in rest)).select(*rows.columns)


def with_missing(samples: DataFrame, scores: DataFrame, on: list[str], flag: str = "is_correct") -> DataFrame:
    """Every expected attempt with whether it was correct; a missing one counts as wrong.

    Scores are reduced to one row per attempt (correct if any copy is).
    """
    best = scores.groupBy(*on).agg(F.max(F.col(flag).cast("boolean")).alias(flag))
    return samples.join(best, on, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def summary(scores: DataFrame, by: list[str] | None = None, flag: str = "is_correct") -> DataFrame:
    """correct, total and accuracy of the rows scored; nulls count as wrong. Without `by` one row, zeros if empty."""
    right = F.count_if(F.coalesce(F.col(flag), F.lit(False)))
    out = scores.groupBy(*(by or [])).agg(right.alias("correct"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("accuracy", accuracy(F.col("correct"), F.col("total")))


def pass_at_1(attempts: DataFrame, by: list[str] | None = None, flag: str = "is_correct") -> DataFrame:
    """pass@1 over all expected attempts, with its standard error."""
    out = attempts.groupBy(*(by or [])).agg(F.count_if(flag_of(flag)).alias("passed"), F.count(F.lit(1)).alias("attempts"))
    p = accuracy(F.col("passed"), F.col("attempts"))
    return out.withColumn("pass_at_1", p).withColumn("stderr", stderr(F.col("pass_at_1"), F.col("attempts")))


def flag_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def pass_per_sample(attempts: DataFrame, id_col: str = "id", by: list[str] | None = None, flag: str = "is_correct") -> DataFrame:
    """(by, logical_id, rate) over each sample's attempts."""
    grouped = attempts.withColumn("logical_id", logical_id(F.col(id_col))).groupBy(*(by or []), "logical_id")
    return grouped.agg(F.count_if(flag_of(flag)).alias("passed"), F.count(F.lit(1)).alias("attempts")).withColumn(
        "rate", accuracy(F.col("passed"), F.col("attempts"))
    )


def histogram(df: DataFrame, value: str, domain: tuple[str, ...], other: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, value, n) over a fixed domain, with zeros; nulls and values outside it count as `other` if named."""
    cols = [*domain, *([other] if other else [])]
    v = F.when(F.col(value).isin(*domain), F.col(value)).otherwise(F.lit(other))
    counts = df.groupBy(*(by or [])).agg(*(F.count_if(v == F.lit(c)).alias(c) for c in cols))
    stacked = ", ".join(f"'{c}', `{c}`" for c in cols)
    return counts.select(*(by or []), F.expr(f"stack({len(cols)}, {stacked}) as ({value}, n)"))


def verify(expected: DataFrame, completions: DataFrame, run: list[str], id_col: str = "id", text: str = "completion") -> DataFrame:
    """Completeness of every run: total, have, missing, extra, duplicates, empty, ok and status.

    expected: (run, id); completions: (run, id, text) — runs without any completions come out too.
    Both sides are reduced to one row per id before they meet, so a hot run or id is combined map-side.
    `ok` ignores empty answers; `status` ignores extra ones. Null ids count as one id.
    """
    key = F.coalesce(F.col(id_col), F.lit("\x00")).alias("__id")
    want = expected.select(*run, key).distinct().withColumn("__want", F.lit(1))
    have = completions.groupBy(*run, key).agg(F.count(F.lit(1)).alias("__rows"), F.count_if(is_blank(F.col(text))).alias("__empty"))
    both = want.join(have, [*run, "__id"], "full_outer")
    n = lambda c: F.count_if(c)
    w, h = F.col("__want").isNotNull(), F.col("__rows").isNotNull()
    zero = F.lit(0).cast("long")
    counted = both.groupBy(*run).agg(
        n(w).alias("total"),
        n(w & h).alias("have"),
        n(w & ~h).alias("missing"),
        n(~w).alias("extra"),
        F.coalesce(F.sum(F.col("__rows") - 1), zero).alias("duplicates"),
        F.coalesce(F.sum("__empty"), zero).alias("empty"),
    )
    return counted.withColumn("ok", _ok()).withColumn("status", status())


def _ok() -> Column:
    return (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicates") == 0)


def status() -> Column:
    """The first that applies: missing, incomplete, duplicates, zero-score, partial-empty, ok."""
    c = F.col
    return (
        F.when((c("have") == 0) & (c("missing") > 0), "missing")
        .when(c("missing") > 0, "incomplete")
        .when(c("duplicates") > 0, "duplicates")
        .when(c("empty") == c("total"), "zero-score")
        .when(c("empty") > 0, "partial-empty")
        .otherwise("ok")
    )


def registry_status(registry: DataFrame, verified: DataFrame, model: str = "model") -> DataFrame:
    """Every registered model with its status; 'missing' for one without any check."""
    return registry.join(verified, model, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def status_cell(has_check: Column | None = None) -> Column:
    """What a table of runs shows for one: its state and, below it, what is missing, repeated or empty."""
    c = F.col
    count = lambda name, word: F.when(c(name) > 0, F.concat(c(name).cast("string"), F.lit(f" {word}")))
    done = F.concat(c("have").cast("string"), F.lit("/"), c("total").cast("string"))
    text = F.concat_ws("\n", F.concat_ws(" ", c("status"), done), count("missing", "missing"), count("duplicates", "repeated"), count("empty", "empty"))
    return text if has_check is None else F.when(has_check, text).otherwise("-")


def stray_ids(scores: DataFrame, inputs: DataFrame, on: list[str]) -> DataFrame:
    """Keys that a scorer returned without having been given them; a correct scorer leaves this empty."""
    return unknown_ids(scores, inputs, on)


def answer_distribution(samples: DataFrame, answer: str, domain: tuple[str, ...] = ("A", "B", "C", "D"), by: list[str] | None = None) -> DataFrame:
    """(by, answer, n) of gold answers over a fixed domain, with zeros."""
    return histogram(samples, answer, domain, by=by)


def strided_shard(items: DataFrame, order: str, shards: int) -> DataFrame:
    """items with `shard`: every shards-th item in order. Positions are counted by range-sorted
    partitions, so no task sees all rows (see positions)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    return positions(items, order).withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).drop("position")


def positions(items: DataFrame, *order: str) -> DataFrame:
    """items with their `position` (from 0) in a total order: rows are ranged by Spark's sort, counted
    per partition, and numbered inside partitions only. Ties are broken arbitrarily but consistently."""
    from evalanvil.plans.session import cut

    ranged = cut(items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    inside = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)).cast("long") - 1)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return inside.join(offsets, "__p").withColumn("position", F.col("__r") + F.col("__o")).drop("__p", "__r", "__o")


def length_filter(prompts: DataFrame, tokens: str, limit: int) -> DataFrame:
    """Prompts of at most limit - 1 tokens; null counts are dropped."""
    return prompts.where(F.col(tokens) <= limit - 1)


def length_stats(prompts: DataFrame, tokens: str, cap: int) -> DataFrame:
    """One row: n, min, max, the upper median and the floored mean of token counts (each capped).

    The median comes from a histogram of at most cap + 1 lengths, not from a sorted list of rows.
    """
    x = F.least(F.col(tokens), F.lit(cap)).cast("long")
    counts = prompts.where(F.col(tokens).isNotNull()).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # at most cap + 1 rows
    ranked = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(1))))
    middle = F.floor(F.col("n") / 2) + 1
    return ranked.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        F.min("x").alias("min_tokens"),
        F.max("x").alias("max_tokens"),
        F.min(F.when(F.col("upto") >= middle, F.col("x"))).alias("median_tokens"),
        F.floor(F.try_divide(F.sum(F.col("x") * F.col("c")).cast("double"), F.max("n"))).cast("long").alias("mean_tokens"),
    )


def next_release(names: DataFrame, name: str, year_month: str) -> DataFrame:
    """The next release name of a month: `YYYY.MM.N`, N one more than the highest so far."""
    pattern = "^" + year_month.replace(".", r"\.") + r"\.(\d+)$"
    n = F.regexp_extract(F.col(name), pattern, 1).try_cast("int")
    return names.agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("n")).select(
        F.concat(F.lit(year_month + "."), F.col("n").cast("string")).alias("release")
    )
