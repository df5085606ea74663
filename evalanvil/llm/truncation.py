"""Texts cut off by field limits.

Per source and column, histograms of text lengths are tested for spikes: in characters and in bytes
(a field's width cuts all texts at the same length), and, where a limit in tokens is known, in
characters and bytes per token allowed (a limit in tokens cuts texts of one source at about the
same ratio, at the upper end of what occurs). What is counted are texts without an end; a length is a
spike if it holds significantly more of them than its neighbourhood explains. A text of such a
length without an end is flagged.

A cut in transfer leaves no spike. Those texts can be flagged by a second source, the probability of
the classifier of `pairs`; `via` tells which of the two named a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Significance of a spike (bound of a Poisson tail), and how many times what chance explains it must hold.
ALPHA, RATIO = 1e-6, 4.0
#: Lengths to either side that tell what chance explains at an exact length.
NEAR = 12
#: Bins per character (byte) and allowed token; what chance explains there are the bins BELOW the spike.
PER_TOKEN, BELOW = 5, (5, 2)
#: Such a spike lies at the maximum: at most BEYOND of the source's texts lie more than one bin above, and MOSTLY of its own lack an end.
BEYOND, MOSTLY = 0.005, 0.5
MEASURES = ("chars", "bytes", "token_chars", "token_bytes")


def measured(chars: Column, size: Column, limit: Column) -> list[Column]:
    """The length of a text in each of MEASURES; null where it is not known (no text, no limit)."""
    per = lambda n: F.when(limit > 0, F.floor(n * PER_TOKEN / limit)).cast("long")
    return [chars.cast("long"), size.cast("long"), per(chars), per(size)]


def length_spikes(texts: DataFrame) -> DataFrame:
    """(source, measure, length, texts, open_texts, expected) of every spike.

    texts: source, chars, bytes, max_tokens, stop (whether the text has an end). Null sources are a
    source of their own; null lengths are left out, and null limits from the measures per token; a
    null `stop` is no open text. Counts are combined map-side, so a hot source costs one row per
    length; the windows run over lengths, not texts. Empty input gives an empty result.
    """
    lengths = measured(F.col("chars"), F.col("bytes"), F.col("max_tokens"))
    each = texts.select(
        F.coalesce("source", F.lit("")).alias("source"),
        "stop",
        F.explode(F.create_map(*(x for name, n in zip(MEASURES, lengths) for x in (F.lit(name), n)))).alias("measure", "length"),
    ).where(F.col("length").isNotNull())
    histogram = each.groupBy("source", "measure", "length").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("stop")).alias("open_texts")
    )
    around = Window.partitionBy("source", "measure").orderBy("length")
    near = (F.sum("open_texts").over(around.rangeBetween(-NEAR, NEAR)) - F.col("open_texts")) / F.lit(2.0 * NEAR)
    far, close = BELOW
    below = F.coalesce(F.sum("open_texts").over(around.rangeBetween(-far, -close)), F.lit(0)) / F.lit(far - close + 1.0)
    above = F.coalesce(F.sum("texts").over(around.rangeBetween(2, Window.unboundedFollowing)), F.lit(0))
    every = F.sum("texts").over(Window.partitionBy("source", "measure"))
    per_token = F.col("measure").startswith("token")
    n = F.col("open_texts")
    chance = F.greatest("expected", F.lit(0.25))
    # a Poisson variable of mean m reaches n > m with a probability of at most exp(n - m - n ln(n / m))
    surprise = n * F.log(n / chance) - (n - chance)
    return (
        histogram.withColumns({"expected": F.when(per_token, below).otherwise(near), "above": above, "every": every})
        .where((n > RATIO * chance) & (surprise >= -F.log(F.lit(ALPHA))))
        .where(~per_token | ((F.col("above") <= BEYOND * F.col("every")) & (n >= MOSTLY * F.col("texts"))))
        .select("source", "measure", "length", "texts", "open_texts", "expected")
    )


def at_spikes(texts: DataFrame, spikes: DataFrame) -> DataFrame:
    """texts with `spike`: the first of MEASURES in which a text has the length of a spike of its source, else null.

    Spikes are gathered to one row per source, so there is one join; the planner broadcasts it by its size.
    """
    of = [F.collect_set(F.when(F.col("measure") == m, F.col("length"))).alias(f"__{m}") for m in MEASURES]
    sets = spikes.groupBy("source").agg(*of).withColumnRenamed("source", "__source")
    joined = texts.join(sets, F.coalesce("source", F.lit("")) == F.col("__source"), "left")
    lengths = measured(F.col("chars"), F.col("bytes"), F.col("max_tokens"))
    found = F.coalesce(*(F.when(F.array_contains(f"__{m}", n), F.lit(m)) for m, n in zip(MEASURES, lengths)))
    return joined.select(*texts.columns, found.alias("spike"))


def flag_truncated(scored: DataFrame, threshold: float) -> DataFrame:
    """scored rows (see pairs.score_pairs) with `via` (how a row was found cut: one of MEASURES, 'classifier', or null) and `is_truncated`.

    At a spike the missing end decides; elsewhere the classifier's probability, by its calibrated
    threshold. Blank answers are never cut; nor is what the classifier finds to be another defect.
    """
    placed = at_spikes(scored, length_spikes(scored.where(F.col("empty") < 0.5)))
    rest = F.greatest("empty", "refusal", "copy", "language")
    by_length = F.col("spike").isNotNull() & ~F.col("stop") & (rest < F.greatest(F.lit(0.5), F.col("truncated")))
    by_text = (F.col("truncated") >= threshold) & (F.col("truncated") >= rest * 0.6)
    via = F.when(by_length, F.col("spike")).when(by_text, F.lit("classifier"))
    return placed.withColumn("via", via).withColumn("is_truncated", F.col("via").isNotNull()).drop("spike")
