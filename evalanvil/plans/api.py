"""The public surface: serve samples, score completions, verify runs, compact data sets."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalanvil import __version__
from evalanvil.operators import panel
from evalanvil.operators.attempts import duplicate_ids, offenders, stray_ids, summary, unknown_ids, verify
from evalanvil.operators.scoring import SCORERS, score
from evalanvil.plans.session import cut
from evalanvil.sources import catalog


class NotFound(LookupError):
    """An eval or data set that does not exist (404)."""


class Rejected(ValueError):
    """Completions that cannot be scored (400)."""


def _known(eval_id: str) -> None:
    if eval_id not in SCORERS:
        raise NotFound(f"unknown eval {eval_id!r}")


def completions_of(spark: SparkSession, records: list[dict]) -> DataFrame:
    """(id, completion) of a request's list of records; one without an id, or whose values aren't text, is rejected."""
    rows = []
    for i, r in enumerate(records):
        if not isinstance(r, dict) or not isinstance(r.get("id"), str) or not isinstance(r.get("completion", ""), (str, type(None))):
            raise Rejected(f"record {i} needs an id and a completion, both text")
        rows.append((r["id"], r.get("completion")))
    return spark.createDataFrame(rows, "id string, completion string")


def samples(spark: SparkSession, eval_id: str, dataset: str, root: str | None = None) -> DataFrame:
    """(id, messages) of a data set."""
    _known(eval_id)
    try:
        return catalog.load_prompts(spark, eval_id, dataset, root)
    except FileNotFoundError as e:
        raise NotFound(str(e)) from e


def score_completions(spark: SparkSession, eval_id: str, dataset: str, completions: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored samples, metrics): duplicates are rejected first, then unknown ids; prompts are joined last.

    Scores are checkpointed once, so graders don't run again for the metrics.
    """
    _known(eval_id)
    message = offenders(duplicate_ids(completions), "duplicate completion ids")
    if message:
        raise Rejected(message)
    try:
        truth = catalog.load_samples(spark, eval_id, dataset, root)
    except FileNotFoundError as e:
        raise NotFound(str(e)) from e
    message = offenders(unknown_ids(completions, truth, ["id"]), "completions reference ids not in dataset")
    if message:
        raise Rejected(message)
    scores, _ = score(eval_id, completions, truth)
    scores = cut(scores)
    metrics = SCORERS[eval_id].metrics(scores, truth)
    prompts = catalog.load_prompts(spark, eval_id, dataset, root)
    stray = offenders(stray_ids(scores, prompts, ["id"]), "the scorer returned unknown ids")
    if stray:
        raise RuntimeError(stray)
    enriched = scores.select("id", "completion", "is_correct").join(prompts.dropDuplicates(["id"]), "id")
    return enriched.select("id", "messages", "completion", "is_correct"), metrics


def report(eval_id: str, dataset: str, scored: DataFrame, metrics: DataFrame) -> DataFrame:
    """(section, entry) rows of JSON: one 'summary', a 'context' row per metric, a 'scores' row per completion.

    No row grows with the data.
    """
    head = summary(scored).select(F.lit(eval_id).alias("eval_id"), F.lit(dataset).alias("dataset"), "total", "correct", "accuracy", F.lit(__version__).alias("runtime_version"))
    section = lambda df, name: df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("entry"))
    shown = scored.select("id", "completion", "is_correct")
    return section(head, "summary").unionByName(section(metrics.select("metric", "value"), "context")).unionByName(section(shown, "scores"))


def report_document(eval_id: str, dataset: str, scored: DataFrame, metrics: DataFrame) -> Iterator[str]:
    """The same as pieces of one JSON document {eval_id, dataset, total, correct, accuracy, context, scores}, streamed a partition at a time."""
    head = summary(scored).select("total", "correct", "accuracy").first().asDict()
    yield json.dumps({"eval_id": eval_id, "dataset": dataset, **head})[:-1] + ', "context": {'
    for i, r in enumerate(metrics.select("metric", "value").orderBy("metric").toLocalIterator()):
        yield (", " if i else "") + f"{json.dumps(r['metric'])}: {json.dumps(r['value'])}"
    yield '}, "scores": ['
    for i, r in enumerate(scored.select("id", "completion", "is_correct").orderBy("id").toLocalIterator()):
        yield (",\n" if i else "") + json.dumps(r.asDict())
    yield "]}\n"


def verify_runs(spark: SparkSession, eval_id: str, dataset: str, results: str, root: str | None = None) -> DataFrame:
    """Completeness of every model's run of a data set; a model whose folder holds nothing is 'missing'."""
    _known(eval_id)
    expected = catalog.load_prompts(spark, eval_id, dataset, root).select("id")
    names = [m.replace("--", "/") for m in catalog.list_runs(spark, results, eval_id, dataset, needed=False)]
    models = F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))
    wanted = expected.select("id", models.alias("model"))
    return verify(wanted, catalog.read_runs(spark, results, eval_id, dataset), ["model"])


def pass_table(spark: SparkSession, eval_id: str, dataset: str, results: str, root: str | None = None) -> DataFrame:
    """(sample_id, model, pass) of all models' runs, graded as one job."""
    truth = catalog.load_samples(spark, eval_id, dataset, root)
    runs = catalog.read_runs(spark, results, eval_id, dataset)
    joined = runs.join(truth.dropDuplicates(["id"]), "id")
    graded = SCORERS[eval_id].score(joined)
    return graded.select(F.col("id").alias("sample_id"), "model", F.col("is_correct").alias("pass"))


def compact_dataset(spark: SparkSession, eval_id: str, dataset: str, results: str, wanted: int | None, to: str, root: str | None = None, seed: int = 0) -> dict:
    """Writes the data set `to` with the rows of a representative subset and returns its metadata.

    Rows are joined by their logical id, never by position, and repeats and content hash are carried on.
    """
    from evalanvil.functions.keys import logical_id

    truth = catalog.load_samples(spark, eval_id, dataset, root)
    tidy = cut(pass_table(spark, eval_id, dataset, results, root))
    groups = truth.select(F.col("id").alias("sample_id"), panel.group_key(eval_id).alias("grp")).dropDuplicates(["sample_id"])
    chosen, found = panel.compact(tidy, groups, wanted, spark, seed=seed)
    rows, meta = catalog.checked_rows(spark, eval_id, dataset, root)
    keep = chosen.select(logical_id(F.col("sample_id")).alias("id")).distinct()
    kept = rows.withColumn("id", catalog._sample_id(eval_id)).join(keep, "id", "left_semi").drop("id")
    metadata = {**{k: meta[k] for k in ("repeats",) if k in meta}, "source_dataset": dataset, "compaction": found}
    catalog.save_rows(kept, eval_id, to, None, root, json.loads(json.dumps(metadata, default=str)))
    return metadata


def representative_dataset(
    spark: SparkSession, eval_id: str, dataset: str, results: str, wanted: int, to: str, root: str | None = None, seed: int = 0, selector: panel.Selector = panel.choose
) -> dict:
    """Writes the data set `to` with a representative subset of all samples and returns its metadata.

    All models' runs are graded, models with missing results or without any pass are left out, and
    the subset is chosen from the whole data set (no filters, no cross-validation). The metadata name
    the models, those left out and why, and what was generated with. Raises if no model is left.
    """
    from evalanvil.functions.keys import logical_id

    truth = catalog.load_samples(spark, eval_id, dataset, root)
    tidy = cut(pass_table(spark, eval_id, dataset, results, root))
    groups = truth.select(F.col("id").alias("sample_id"), panel.group_key(eval_id).alias("grp")).dropDuplicates(["sample_id"])
    models = cut(panel.complete_models(tidy, groups))
    names = [r[0] for r in models.where("reason is null").select("model").orderBy("model").collect()]
    if not names:
        raise RuntimeError("no model has complete results")
    kept = tidy.join(models.where("reason is null").select("model"), "model", "left_semi")
    pool = panel.pass_matrix(kept).join(groups, "sample_id")
    chosen = cut(panel.representative_subset(pool, "grp", wanted, seed=seed, selector=selector).select("sample_id"))
    rows, meta = catalog.checked_rows(spark, eval_id, dataset, root)
    keep = chosen.select(logical_id(F.col("sample_id")).alias("id")).distinct()
    picked = rows.withColumn("id", catalog._sample_id(eval_id)).join(keep, "id", "left_semi").drop("id")
    skipped = models.where("reason is not null").orderBy("model").select("model", "reason", "have", "missing", "total").collect()
    metadata = {
        **{k: meta[k] for k in ("repeats",) if k in meta}, "source_dataset": dataset, "models": names,
        "skipped": [r.asDict() for r in skipped], "generation_params": catalog.generation_spec(eval_id),
    }
    catalog.save_rows(picked, eval_id, to, None, root, metadata)
    return metadata
