"""Producing completions with a model that a caller brings.

The model is a factory, called once per task, of a function from a list of prompts to a list of
texts; it runs in Arrow batches. Which prompts go to which job is `attempts.strided_shard`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Generator = Callable[[list[str]], list[str]]


def generate(prompts: DataFrame, make: Callable[[], Generator], prompt: str = "prompt", tokens: str | None = None, limit: int | None = None, choices: list[str] | None = None) -> DataFrame:
    """prompts with `completion`.

    A prompt that is null, or has more than `limit` - 1 tokens, is not given to the model; its
    completion is the empty string. With `choices` a completion is stripped and in upper case, and empty
    if it is none of them.
    """
    fits = _fits(prompt, tokens, limit)
    kept = prompts.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in prompts.dtypes), "completion string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None
        for pdf in batches:
            out = pdf[kept].copy()
            texts = [""] * len(pdf)
            asked = [i for i, ok in enumerate(pdf["__fits"]) if ok]
            if asked:
                ask = ask or make()
                for i, text in zip(asked, ask([pdf[prompt].iloc[i] for i in asked])):
                    texts[i] = text
            if choices:
                texts = [t.strip().upper() for t in texts]
                texts = [t if t in choices else "" for t in texts]
            out["completion"] = texts
            yield out

    return prompts.withColumn("__fits", fits).mapInPandas(run, schema)


def _fits(prompt: str, tokens: str | None, limit: int | None) -> Column:
    fits = F.col(prompt).isNotNull()
    return fits & F.coalesce(F.col(tokens) <= limit - 1, F.lit(False)) if tokens and limit else fits


def skipped(prompts: DataFrame, order: list[str], prompt: str = "prompt", tokens: str | None = None, limit: int | None = None, shown: int = 10) -> DataFrame:
    """What a log of a run says of the prompts that `generate` doesn't give to the model: the first `shown` by `order`,
    their tokens, and how many there are in all (`skipped`). Empty if none is left out."""
    left = prompts.where(~_fits(prompt, tokens, limit))
    n = left.count()
    size = F.col(tokens).cast("long") if tokens else F.lit(None).cast("long")
    return left.orderBy(*order).limit(shown).select(*order, size.alias("tokens"), F.lit(n).cast("long").alias("skipped"))


def pick_source(files: DataFrame, model: str, owner: str, quant: str, priority: list[str], wanted: list[str]) -> DataFrame:
    """(model, owner, covered) of the published copy to use: the first owner in `priority` that has all
    wanted quantisations, else the one that has most of them (ties by priority, then name)."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(owner)), F.lit(0))
    rank: Column = F.when(order == 0, F.lit(len(priority) + 1)).otherwise(order)
    have = files.where(F.col(quant).isin(wanted)).groupBy(model, owner).agg(F.countDistinct(quant).alias("covered"))
    best = Window.partitionBy(model).orderBy(F.desc("covered"), rank, F.col(owner))
    return have.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(model, owner, "covered")
