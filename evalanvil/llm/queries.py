"""The queries of the text problems (p4 to p8), with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalanvil.functions.keys import logical_id, model_key, norm_id
from evalanvil.llm.mixing import draw, draw_shares
from evalanvil.llm.packing import containers, pack
from evalanvil.llm.pairs import LABELS, PairModel, sample_pairs, sampled, score_pairs
from evalanvil.llm.quality import QualityModel, familiar_of, judge, sample_texts
from evalanvil.llm.truncation import ALPHA, NEAR, RATIO, flag_truncated, length_spikes
from evalanvil.plans.session import cut, read_table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("completion")
    limits = read_table(spark, d, "dataset_specs").groupBy("eval_id", "dataset").agg(F.max("max_tokens").alias("max_tokens"))
    return read_table(spark, d, "completions").join(limits, ["eval_id", "dataset"], "left").select(
        "row_id",
        model_key(F.col("model")).alias("source"),
        F.concat_ws("/", "eval_id", "dataset").alias("dataset"),
        logical_id(norm_id(F.col("id"))).alias("sid"),
        text.alias("text"),
        F.length(text).cast("long").alias("chars"),
        F.octet_length(text).cast("long").alias("bytes"),
        "max_tokens",
    )


def with_prompts(lines: DataFrame, samples: DataFrame) -> DataFrame:
    """Completion lines with their sample's prompt (null if no table has the sample).

    The id is a hash of the prompt, so any data set's copy of a sample gives it. The prompt is the
    last message's content. A sample with a third of all lines makes one key hot on the side of the
    lines; AQE's skew join splits it.
    """
    last = F.try_element_at("messages", F.lit(-1))["content"]
    prompts = (
        samples.select(norm_id(F.col("id")).alias("sid"), last.alias("prompt"))
        .where(F.col("sid").isNotNull() & F.col("prompt").isNotNull())
        .groupBy("sid")
        .agg(F.max("prompt").alias("prompt"))
    )
    return lines.join(prompts, "sid", "left").drop("sid")


def _model(spark: SparkSession, d: str) -> PairModel:
    """The classifier, trained on a bounded sample of the tables' pairs."""
    return PairModel.fit(sample_pairs(with_prompts(sampled(_lines(spark, d)), read_table(spark, d, "samples"))))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, PairModel]:
    model = _model(spark, d)
    return cut(score_pairs(with_prompts(_lines(spark, d), read_table(spark, d, "samples")), model)), model


def _flagged(spark: SparkSession, d: str) -> tuple[DataFrame, PairModel]:
    scored, model = _scored(spark, d)
    return flag_truncated(scored, float(model.linear.threshold[LABELS.index("truncated")])), model


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every defective pair with its defect: the label whose probability exceeds its threshold the most."""
    flagged, model = _flagged(spark, d)
    limit = dict(zip(LABELS, map(float, model.linear.threshold)))
    ratio: dict[str, Column] = {x: F.col(x) / F.lit(limit[x]) for x in LABELS}
    ratio["truncated"] = F.when(F.col("is_truncated"), F.greatest(ratio["truncated"], F.lit(1.0))).otherwise(F.lit(0.0))
    ratio["language"] = F.when(ratio["refusal"] >= 1, F.lit(0.0)).otherwise(ratio["language"])  # no answer at all
    best = F.greatest(*(F.struct(ratio[x].alias("r"), F.lit(x).alias("x")) for x in LABELS))
    return flagged.select("row_id", best.alias("best")).where(F.col("best.r") >= 1).select("row_id", F.col("best.x").alias("defect"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every completion line whose text stops before its end."""
    return _flagged(spark, d)[0].where("is_truncated").select("row_id")


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Truncated rows and their share per model and data set."""
    return (
        _flagged(spark, d)[0]
        .groupBy("source", "dataset")
        .agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("is_truncated")).alias("truncated"))
        .withColumn("share", F.col("truncated") / F.col("lines"))
    )


def p5_spikes(spark: SparkSession, d: str) -> DataFrame:
    """The lengths at which a model's texts pile up without an end."""
    return length_spikes(_scored(spark, d)[0].where(F.col("empty") < 0.5))


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Rows of p5_found with what named them: a spike of lengths (and of which kind) or the classifier."""
    return _flagged(spark, d)[0].where("is_truncated").select("row_id", "source", "dataset", "via")


#: Fixed value: what may end a text, with closing marks and blanks after it.
STOP = r"""[.!?…。！？]["'”’»)\]}*_`>\s]*\z"""


def p5_widths(spark: SparkSession, d: str) -> DataFrame:
    """Spikes of lengths in every text column, by punctuation alone: completions by model, documents by source.

    Native throughout, for columns that no classifier was trained for.
    """
    columns = (("completions", "completion", model_key(F.col("model"))), ("documents", "text", F.coalesce("source", F.lit(""))))
    parts = []
    for table, text, source in columns:
        t = F.col(text)
        parts.append(
            read_table(spark, d, table).where(t.isNotNull()).select(
                F.concat(F.lit(f"{table}.{text}/"), source).alias("source"), F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"),
                F.lit(None).cast("int").alias("max_tokens"), t.rlike(STOP).alias("stop"),
            )
        )
    return length_spikes(parts[0].unionByName(parts[1]))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "documents")
    return judge(documents, QualityModel.fit(sample_texts(documents), familiar=familiar_of(documents)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document that is mostly not prose, with its kind."""
    return _judged(spark, d).where("kind <> 'prose'").select("doc_id", "kind")


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics, with the verdict and its probability."""
    return _judged(spark, d)


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plainest of the statistics, which SQL can repeat."""
    return _judged(spark, d).select("doc_id", "chars", "lines", "mean_line_length", "unique_lines")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Container, place and piece of every document, for each capacity."""
    return pack(read_table(spark, d, "documents"), read_table(spark, d, "pack_limits"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and room left over per capacity."""
    return containers(p6_pack(spark, d))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing, counted per limit: documents placed, and faults of six kinds (all 0)."""
    packed = cut(p6_pack(spark, d))
    by = ["limit_name", "capacity"]
    per_doc = packed.groupBy(*by, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"), F.countDistinct("piece").alias("distinct"), F.sum("tokens").alias("tokens"))
    docs = per_doc.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if((F.col("n") != F.col("distinct")) | (F.col("last") + 1 != F.col("n"))).alias("pieces_wrong"),
        F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut_needlessly"),
    )
    end = F.col("start") + F.col("tokens")
    per_container = packed.where("tokens > 0").groupBy(*by, "container").agg(
        F.sum("tokens").alias("tokens"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.countDistinct("place").alias("places")
    )
    containers_ = per_container.groupBy(*by).agg(
        F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"),
        F.count_if(F.col("end") != F.col("tokens")).alias("overlapping"),
        F.count_if((F.col("places") != F.col("n")) | (F.col("last") + 1 != F.col("n"))).alias("places_wrong"),
        (F.max("container") + 1 - F.count(F.lit(1))).alias("containers_missing"),
    )
    return docs.join(containers_, by)


def p7_draw(spark: SparkSession, d: str) -> DataFrame:
    """The draw: documents in training order."""
    return draw(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and real share of every source, and how often its documents were used."""
    return draw_shares(p7_draw(spark, d), read_table(spark, d, "mix_targets"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per source that can take part: its share of the whole, whether the draw comes within 0.01 of it, and keeps to the repeats."""
    shares = p7_shares(spark, d).where("tokens > 0")
    aimed = F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(1)))  # one row per target
    near = F.abs(F.col("share") - F.col("aimed")) < 0.01
    return shares.withColumn("aimed", aimed).select("source", "aimed", near.alias("near"), (F.col("most_used") <= F.col("max_repeats")).alias("within_repeats"))


QUERIES = {
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p7_draw": p7_draw,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_shares": p5_shares,
    "p5_spikes": p5_spikes,
    "p5_evidence": p5_evidence,
    "p5_widths": p5_widths,
    "p6_check": p6_check,
    "p7_check": p7_check,
    "p8_counts": p8_counts,
}
_STOP_SQL = STOP.replace("'", "''")
ORACLES: dict[str, str] = {
    "p5_widths": f"""
        WITH t AS (
          SELECT 'completions.completion/' || replace(model, '--', '/') AS source, length(completion) AS chars, strlen(completion) AS bytes, NOT regexp_matches(completion, '{_STOP_SQL}') AS o
          FROM completions WHERE completion IS NOT NULL
          UNION ALL SELECT 'documents.text/' || coalesce(source, ''), length(text), strlen(text), NOT regexp_matches(text, '{_STOP_SQL}') FROM documents WHERE text IS NOT NULL),
        h AS (SELECT source, measure, length, count(*) AS texts, sum(o::INT)::BIGINT AS open_texts FROM (
            SELECT source, 'chars' AS measure, chars AS length, o FROM t UNION ALL SELECT source, 'bytes', bytes, o FROM t) GROUP BY ALL),
        e AS (SELECT *, (sum(open_texts) OVER (PARTITION BY source, measure ORDER BY length RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING) - open_texts) / {2.0 * NEAR} AS expected FROM h)
        SELECT source, measure, length, texts, open_texts, expected FROM e WHERE open_texts > {RATIO} * greatest(expected, 0.25)
          AND open_texts * ln(open_texts / greatest(expected, 0.25)) - (open_texts - greatest(expected, 0.25)) >= -ln({ALPHA})""",
    "p6_check": """
        SELECT limit_name, capacity_tokens AS capacity, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS pieces_wrong, 0::BIGINT AS cut_needlessly,
          0::BIGINT AS overfull, 0::BIGINT AS overlapping, 0::BIGINT AS places_wrong, 0::BIGINT AS containers_missing FROM pack_limits""",
    "p7_check": """
        WITH able AS (SELECT * FROM mix_targets m WHERE target_share > 0 AND max_repeats >= 1 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = m.source AND length(d.text) > 0))
        SELECT source, target_share / (SELECT sum(target_share) FROM able) AS aimed, true AS near, true AS within_repeats FROM able""",
    "p8_counts": r"""
        WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN text END AS text FROM documents),
        l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM t)
        SELECT doc_id, coalesce(length(text), 0)::DOUBLE AS chars, coalesce(len(lines), 0)::DOUBLE AS lines, coalesce(list_sum(list_transform(lines, lambda x: length(x))) / len(lines)::DOUBLE, 0.0) AS mean_line_length,
          coalesce(len(list_distinct(lines)) / len(lines)::DOUBLE, 0.0) AS unique_lines FROM l""",
}
