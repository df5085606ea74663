"""The queries of the general data problems (p1 to p3), with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalanvil.functions.keys import model_key, month_label, norm_id
from evalanvil.operators.orphans import find_orphans, first_kind
from evalanvil.operators.recount import expected_ids, recount
from evalanvil.operators.redelivery import keepers, surplus
from evalanvil.operators.stable_sample import advanced, chosen, present_in, threefry_sql
from evalanvil.plans.session import read_table, shared_dir

MESSAGE = ["eval_id", "dataset", "model", "id"]
#: Share of new prompts taken, and how much of it each later year keeps: the rate of an epoch is fixed by its year alone.
SAMPLE_RATE, SAMPLE_FIRST_YEAR, SAMPLE_DECAY = 0.25, 2025, 0.8


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "completions").select("row_id", "eval_id", "dataset", norm_id(F.col("id")).alias("id"), "received_at")
    specs = read_table(spark, d, "dataset_specs")
    expected = expected_ids(read_table(spark, d, "samples"), specs)
    found = find_orphans(lines, expected, ["eval_id", "dataset", "id"], "row_id", "received_at", "added_at", "removed_at")
    checks = read_table(spark, d, "verifications").select(
        "verification_id", "eval_id", "dataset", model_key(F.col("model")).alias("model"), "verified_at"
    )
    models = read_table(spark, d, "model_registry").select(model_key(F.col("hf_id")).alias("model"), "registered_at", "retired_at")
    by_model = find_orphans(checks, models, ["model"], "verification_id", "verified_at", "registered_at", "retired_at")
    by_set = find_orphans(checks, specs, ["eval_id", "dataset"], "verification_id", "verified_at", "created_at", "deleted_at")
    table = lambda name: F.lit(name).alias("table_name")
    return found.select(table("completions"), "ref_id", "month", "kind").unionByName(
        first_kind(by_model.unionByName(by_set)).select(table("verifications"), "ref_id", "month", "kind")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference of completions and verifications."""
    return _orphans(spark, d).select("table_name", F.col("ref_id").alias("row_id"), "kind")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, month and kind."""
    return (
        _orphans(spark, d)
        .groupBy("table_name", "month", "kind")
        .agg(F.count(F.lit(1)).alias("orphans"))
        .select("table_name", month_label(F.col("month")).alias("period"), "kind", "orphans")
    )


def p1_recount(spark: SparkSession, d: str) -> DataFrame:
    """The checks' missing and extra beside a recount as of their time."""
    checks = read_table(spark, d, "verifications")
    again = recount(checks, read_table(spark, d, "completions"), read_table(spark, d, "samples"), read_table(spark, d, "dataset_specs"))
    return checks.select("verification_id", F.col("missing").alias("said_missing"), F.col("extra").alias("said_extra")).join(
        again.select("verification_id", "total", "have", "missing", "extra"), "verification_id"
    )


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "completions").select(
        "row_id", "eval_id", "dataset", model_key(F.col("model")).alias("model"), norm_id(F.col("id")).alias("id"), "received_at"
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a message but its first."""
    return surplus(_messages(spark, d), MESSAGE, "row_id", "received_at")


def p2_surplus(spark: SparkSession, d: str) -> DataFrame:
    """Lines and surplus lines per model, beside the duplicates its latest checks name."""
    messages = _messages(spark, d)
    kept = keepers(messages, MESSAGE, "row_id", "received_at").select("row_id", F.lit(1).alias("kept"))
    checks = (
        read_table(spark, d, "verifications")
        .select("eval_id", "dataset", model_key(F.col("model")).alias("model"), "verified_at", "duplicates", "verification_id")
        .groupBy("eval_id", "dataset", "model")
        .agg(F.max_by("duplicates", F.struct("verified_at", "verification_id")).alias("duplicates"))
        .groupBy("model")
        .agg(F.sum("duplicates").alias("said_duplicates"))
    )
    return (
        messages.select("row_id", "model")
        .join(kept, "row_id", "left")
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("lines"), (F.count(F.lit(1)) - F.count("kept")).alias("surplus"))
        .join(checks, "model", "left")
    )


def p2_recount(spark: SparkSession, d: str) -> DataFrame:
    """The checks' duplicates and empties beside a recount as of their time."""
    checks = read_table(spark, d, "verifications")
    again = recount(checks, read_table(spark, d, "completions"), read_table(spark, d, "samples"), read_table(spark, d, "dataset_specs"))
    return checks.select("verification_id", F.col("duplicates").alias("said_duplicates"), F.col("empty").alias("said_empty")).join(
        again.select("verification_id", "duplicates", "empty"), "verification_id"
    )


def sample_rate(epoch: Column) -> Column:
    """The frozen rate of a month: SAMPLE_RATE, times SAMPLE_DECAY for every year after the first."""
    years = F.greatest(F.floor(epoch / 12) - SAMPLE_FIRST_YEAR, F.lit(0))
    return F.lit(SAMPLE_RATE) * F.pow(F.lit(SAMPLE_DECAY), years)


#: Setting with the path of the registry of first-seen months; without it, one per table lies in the shared folder.
REGISTRY = "spark.evalanvil.sampleRegistry"


def _registry(spark: SparkSession, d: str) -> DataFrame:
    samples = read_table(spark, d, "samples")
    own = f"{shared_dir(spark)}/sample-registry-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    registry = advanced(spark.conf.get(REGISTRY, None) or own, samples, "id", "added_at", sample_rate)
    return present_in(registry, samples, "id")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The prompts chosen, with the epoch and rate that decided."""
    return chosen(_registry(spark, d)).select(
        F.col("id"), F.col("epoch").cast("long").alias("epoch"), "rate", "u"
    )


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and prompts chosen per epoch."""
    registry = _registry(spark, d)
    some = chosen(registry).select("id", F.lit(1).alias("chosen"))
    return (
        registry.join(some, "id", "left")
        .groupBy("epoch", "rate")
        .agg(F.count(F.lit(1)).alias("prompts"), F.count("chosen").alias("chosen"))
        .select(F.col("epoch").cast("long").alias("epoch"), "rate", "prompts", "chosen")
    )


_STRIP = r"regexp_replace({c}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+|[\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]+$', '', 'g')"
_NORM = f"lower({_STRIP})"
_EXPECTED = f"""
expected AS (
  SELECT s.eval_id, s.dataset, CASE WHEN r.repeats = 1 THEN s.sid ELSE s.sid || '#' || k.k END AS id, s.added_at, s.removed_at
  FROM (SELECT DISTINCT eval_id, dataset, {_NORM.format(c='id')} AS sid, added_at, removed_at FROM samples) s
  JOIN dataset_specs r USING (eval_id, dataset)
  CROSS JOIN (SELECT range AS k FROM range(100)) k
  WHERE k.k < r.repeats
)"""
_ORPHANS = f"""
WITH {_EXPECTED},
lines AS (SELECT row_id, eval_id, dataset, {_NORM.format(c='id')} AS id, received_at FROM completions),
checks AS (SELECT *, replace(model, '--', '/') AS m FROM verifications),
found AS (
  SELECT 'completions' AS table_name, l.row_id, l.received_at AS t,
    CASE WHEN e.id IS NULL THEN 'missing' WHEN e.removed_at <= l.received_at THEN 'deleted'
         WHEN e.added_at > l.received_at THEN 'late' END AS kind
  FROM lines l LEFT JOIN expected e USING (eval_id, dataset, id)
  UNION ALL
  SELECT 'verifications', c.verification_id, c.verified_at,
    CASE WHEN r.hf_id IS NULL OR s.dataset IS NULL THEN 'missing'
         WHEN r.retired_at <= c.verified_at OR s.deleted_at <= c.verified_at THEN 'deleted'
         WHEN r.registered_at > c.verified_at OR s.created_at > c.verified_at THEN 'late' END
  FROM checks c LEFT JOIN model_registry r ON r.hf_id = c.m
  LEFT JOIN dataset_specs s ON s.eval_id = c.eval_id AND s.dataset = c.dataset
)"""
_KEYED = f"SELECT row_id, eval_id, dataset, replace(model, '--', '/') AS model, {_NORM.format(c='id')} AS id, received_at, completion FROM completions"
_RECOUNT = f"""
WITH {_EXPECTED}, keyed AS ({_KEYED}),
checks AS (SELECT *, replace(model, '--', '/') AS m FROM verifications),
lines AS (
  SELECT c.verification_id, k.id, count(*) AS n,
    sum(CASE WHEN {_STRIP.format(c="coalesce(k.completion, '')")} = '' THEN 1 ELSE 0 END) AS blank
  FROM checks c JOIN keyed k ON k.eval_id = c.eval_id AND k.dataset = c.dataset AND k.model = c.m AND k.received_at <= c.verified_at
  GROUP BY ALL
),
wanted AS (
  SELECT c.verification_id, e.id FROM checks c JOIN expected e USING (eval_id, dataset)
  WHERE e.added_at <= c.verified_at AND (e.removed_at IS NULL OR e.removed_at > c.verified_at)
),
counts AS (
  SELECT verification_id, count(w.id) AS total, count(CASE WHEN w.id IS NOT NULL AND l.id IS NOT NULL THEN 1 END) AS have,
    count(CASE WHEN w.id IS NULL THEN 1 END) AS extra, coalesce(sum(n) - count(n), 0) AS duplicates, coalesce(sum(blank), 0) AS blank
  FROM lines l FULL JOIN wanted w USING (verification_id, id) GROUP BY ALL
)"""
_RATE = f"{SAMPLE_RATE} * pow({SAMPLE_DECAY}, greatest((epoch // 12) - {SAMPLE_FIRST_YEAR}, 0))"
_SEEN = f"""(SELECT {_NORM.format(c='id')} AS id, min(year(added_at AT TIME ZONE 'UTC') * 12 + month(added_at AT TIME ZONE 'UTC') - 1) AS epoch
  FROM samples WHERE id IS NOT NULL GROUP BY ALL)"""
_DRAWN = threefry_sql(_SEEN, "sha256(id)", ["id", "epoch"])

QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_recount": p1_recount,
    "p2_found": p2_found,
    "p2_surplus": p2_surplus,
    "p2_recount": p2_recount,
    "p3_sample": p3_sample,
    "p3_shares": p3_shares,
}
ORACLES = {
    "p1_found": f"{_ORPHANS} SELECT table_name, row_id, kind FROM found WHERE kind IS NOT NULL",
    "p1_report": f"""{_ORPHANS} SELECT table_name, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period, kind, count(*) AS orphans
        FROM found WHERE kind IS NOT NULL GROUP BY ALL""",
    "p1_recount": f"""{_RECOUNT} SELECT v.verification_id, v.missing AS said_missing, v.extra AS said_extra,
        coalesce(c.total, 0) AS total, coalesce(c.have, 0) AS have, coalesce(c.total - c.have, 0) AS missing, coalesce(c.extra, 0) AS extra
        FROM verifications v LEFT JOIN counts c USING (verification_id)""",
    "p2_found": f"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY eval_id, dataset, model, id ORDER BY row_id) AS n
        FROM ({_KEYED})) WHERE n > 1""",
    "p2_surplus": f"""
        WITH keyed AS ({_KEYED}),
        n AS (SELECT model, count(*) AS lines, count(*) - count(DISTINCT (eval_id, dataset, id)) AS surplus FROM keyed GROUP BY model),
        c AS (SELECT m AS model, CAST(sum(duplicates) AS BIGINT) AS said_duplicates FROM (
            SELECT eval_id, dataset, replace(model, '--', '/') AS m, duplicates,
              row_number() OVER (PARTITION BY eval_id, dataset, m ORDER BY verified_at DESC, verification_id DESC) AS n FROM verifications
          ) WHERE n = 1 GROUP BY m)
        SELECT n.model, n.lines, n.surplus, c.said_duplicates FROM n LEFT JOIN c USING (model)""",
    "p2_recount": f"""{_RECOUNT} SELECT v.verification_id, v.duplicates AS said_duplicates, v.empty AS said_empty,
        CAST(coalesce(c.duplicates, 0) AS BIGINT) AS duplicates, CAST(coalesce(c.blank, 0) AS BIGINT) AS empty
        FROM verifications v LEFT JOIN counts c USING (verification_id)""",
    "p3_sample": f"""SELECT id, epoch, {_RATE} AS rate, x0 * pow(2.0, -32) AS u FROM ({_DRAWN})
        WHERE x0 * pow(2.0, -32) < {_RATE}""",
    "p3_shares": f"""SELECT epoch, {_RATE} AS rate, count(*) AS prompts,
        CAST(count(CASE WHEN x0 * pow(2.0, -32) < {_RATE} THEN 1 END) AS BIGINT) AS chosen FROM ({_DRAWN}) GROUP BY ALL""",
}
