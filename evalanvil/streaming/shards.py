"""Completions as a stream of shard files (an extension; shards arrive independently)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalanvil.functions.keys import model_key, norm_id

SHARD = "eval_id string, dataset string, model string, id string, completion string, received_at timestamp"


def shard_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as they appear."""
    return spark.readStream.schema(SHARD).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def first_deliveries(lines: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each message once, whatever batch repeats it. State is kept for `lateness` beyond the watermark;
    repeats that come later than that are for the batch operator."""
    keyed = lines.withColumns({"model": model_key(F.col("model")), "id": norm_id(F.col("id"))})
    return keyed.withWatermark("received_at", lateness).dropDuplicatesWithinWatermark(["eval_id", "dataset", "model", "id"])


def arrivals(lines: DataFrame, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Lines and blank lines per run and window of arrival."""
    blank = F.trim(F.coalesce("completion", F.lit(""))) == ""
    return (
        lines.withWatermark("received_at", lateness)
        .groupBy(F.window("received_at", window), "eval_id", "dataset", model_key(F.col("model")).alias("model"))
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("empty"))
        .select(F.col("window.start").alias("since"), "eval_id", "dataset", "model", "lines", "empty")
    )
