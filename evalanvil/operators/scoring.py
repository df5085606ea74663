"""Scorers by eval: completions and samples to scores and a long table of metrics.

A scorer is DataFrame -> DataFrame; its scores are meant to be cached (or checkpointed) once and
aggregated for metrics. Metrics are rows (metric, value), so their set doesn't depend on the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalanvil.functions.keys import logical_id
from evalanvil.functions.text import accuracy, mcq_answer, mcq_correct, stderr, strip_reasoning
from evalanvil.operators.attempts import score_join, with_missing
from evalanvil.operators.instructions import grade_instructions, tiers
from evalanvil.operators.mathgrade import METHODS, grade_math
from evalanvil.operators.structured import common_errors, grade_structured, structured_summary

CHOICES = ("A", "B", "C", "D")


@dataclass(frozen=True)
class Scorer:
    """score: joined completions to graded rows; metrics: graded rows and samples to (metric, value)."""

    score: Callable[[DataFrame], DataFrame]
    metrics: Callable[[DataFrame, DataFrame], DataFrame]


def _long(row: DataFrame) -> DataFrame:
    """A one-row frame of numbers as (metric, value)."""
    parts = ", ".join(f"'{c}', cast(`{c}` as double)" for c in row.columns)
    return row.select(F.expr(f"stack({len(row.columns)}, {parts}) as (metric, value)"))


def _pass_metrics(prefix: str, scores: DataFrame, samples: DataFrame) -> DataFrame:
    """pass@1 over all expected attempts, its standard error, and the rate per sample."""
    attempts = with_missing(samples.select("id").distinct(), scores, ["id"])
    one = attempts.agg(F.count_if(F.col("is_correct")).alias("c"), F.count(F.lit(1)).alias("n"))
    p = accuracy(F.col("c"), F.col("n"))
    total = _long(one.select(p.alias(f"{prefix}_pass_at_1"), stderr(p, F.col("n")).alias(f"{prefix}_pass_at_1_stderr")))
    per = attempts.groupBy(logical_id(F.col("id")).alias("lid")).agg(accuracy(F.count_if(F.col("is_correct")), F.count(F.lit(1))).alias("value"))
    return total.unionByName(per.select(F.concat(F.lit(f"{prefix}_pass_at_1_per_sample/"), "lid").alias("metric"), "value"))


def _score_choice(joined: DataFrame) -> DataFrame:
    stated = mcq_answer(strip_reasoning(F.col("completion")), "".join(CHOICES))
    out = joined.withColumn("__m", stated)
    return out.withColumns(
        {"choice": F.col("__m.extracted"), "pattern": F.col("__m.pattern"), "is_correct": mcq_correct(F.col("__m.extracted"), F.col("answer"))}
    ).drop("__m")


def _choice_metrics(scores: DataFrame, samples: DataFrame) -> DataFrame:
    counts = scores.agg(
        *(F.count_if(F.col("choice") == c).alias(f"gpqa_diamond_choice/{c}") for c in CHOICES),
        F.count_if(F.col("choice").isNull()).alias("gpqa_diamond_choice/none"),
        accuracy(F.count_if(F.col("choice").isNull()), F.count(F.lit(1))).alias("gpqa_diamond_unparsed_rate"),
    )
    return _long(counts).unionByName(_pass_metrics("gpqa_diamond", scores, samples))


def _score_math(joined: DataFrame) -> DataFrame:
    return grade_math(joined, strip_reasoning(F.col("completion")), F.col("answer"))


def _math_metrics(scores: DataFrame, samples: DataFrame) -> DataFrame:
    """As published, the unparsed rate counts wrong answers too; failed_rate counts only those without an answer."""
    counts = scores.agg(
        *(F.count_if(F.col("method") == m).alias(f"math_500_method/{m}") for m in METHODS),
        accuracy(F.count_if(F.col("method").isin("no_match", "failed")), F.count(F.lit(1))).alias("math_500_unparsed_rate"),
        accuracy(F.count_if(F.col("method") == "failed"), F.count(F.lit(1))).alias("math_500_failed_rate"),
    )
    return _long(counts).unionByName(_pass_metrics("math_500", scores, samples))


def _score_instructions(joined: DataFrame) -> DataFrame:
    return grade_instructions(joined, "completion", "instruction_id_list", "kwargs")


def _instruction_metrics(scores: DataFrame, samples: DataFrame) -> DataFrame:
    prompts = scores.agg(
        accuracy(F.count_if(F.col("strict_all")), F.count(F.lit(1))).alias("strict_prompt_accuracy"),
        accuracy(F.count_if(F.col("loose_all")), F.count(F.lit(1))).alias("loose_prompt_accuracy"),
    )
    flags = scores.select(F.explode("flags").alias("f")).select(F.col("f.id").alias("iid"), "f.strict", "f.loose")
    each = flags.agg(
        accuracy(F.count_if(F.col("strict")), F.count(F.lit(1))).alias("strict_instruction_accuracy"),
        accuracy(F.count_if(F.col("loose")), F.count(F.lit(1))).alias("loose_instruction_accuracy"),
    )
    levels = tiers(flags).select(F.concat_ws("/", "pass_kind", "name").alias("metric"), F.col("accuracy").alias("value"))
    return _long(prompts).unionByName(_long(each)).unionByName(levels).unionByName(_pass_metrics("ifbench", scores, samples))


def _score_structured(joined: DataFrame) -> DataFrame:
    return grade_structured(joined, "completion", "spec")


def _structured_metrics(scores: DataFrame, samples: DataFrame) -> DataFrame:
    summary = structured_summary(scores)
    name = F.concat_ws("/", "facet", F.nullif(F.col("value"), F.lit("")))
    parts = [summary.select(F.concat_ws("/", name, F.lit(k)).alias("metric"), F.col(k).cast("double").alias("value")) for k in ("passed", "total", "pass_rate")]
    errors = common_errors(scores).select(F.concat(F.lit("common_errors/"), "error").alias("metric"), F.col("n").cast("double").alias("value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(errors)


SCORERS: dict[str, Scorer] = {
    "gpqa_diamond": Scorer(_score_choice, _choice_metrics),
    "math_500": Scorer(_score_math, _math_metrics),
    "ifbench": Scorer(_score_instructions, _instruction_metrics),
    "ifstruct": Scorer(_score_structured, _structured_metrics),
}


def score(eval_id: str, completions: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, metrics) of completions (id, completion) against samples of an eval. An unknown eval raises."""
    if eval_id not in SCORERS:
        raise KeyError(f"unknown eval {eval_id!r}")
    scorer = SCORERS[eval_id]
    scores = scorer.score(score_join(completions.select("id", "completion"), samples, ["id"]))
    return scores, scorer.metrics(scores, samples)
