"""Queries of the evaluation operators, over whole tables, with their SQL.

Completions are graded by their eval's grader: options against the letter that the sample's id gives
(the tables hold no key), sums against their value, data by how it begins, instructions by the one
that every prompt can be asked (no comma). A panel is made of users (samples) and event types
(models), right if the number of events is odd: the tables hold no complete panel of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalanvil.functions.fingerprint import content_fingerprints, line_of, md5_seed
from evalanvil.functions.keys import logical_id, model_key, norm_id, short_hash
from evalanvil.functions.text import (
    boxed_answer,
    category,
    choice_prompt,
    is_blank,
    job_slug,
    last_number,
    math_extract,
    mcq_answer,
    mcq_correct,
    model_slug,
    normalize_numeric,
    shown_number,
    shown_share,
    strip_reasoning,
    user_message,
    verdict,
)
from evalanvil.operators import panel
from evalanvil.operators.attempts import (
    answer_distribution,
    duplicate_ids,
    histogram,
    length_filter,
    length_stats,
    next_release,
    pass_at_1,
    pass_per_sample,
    registry_status,
    status_cell,
    stray_ids,
    strided_shard,
    summary,
    unknown_ids,
    verify,
    with_missing,
)
from evalanvil.operators.generate import generate
from evalanvil.operators.instructions import tiers
from evalanvil.operators.mathgrade import METHODS, grade_math
from evalanvil.operators.recount import expected_ids
from evalanvil.operators.structured import grade_structured, structured_summary
from evalanvil.plans.problems import _NORM, _STRIP, _EXPECTED
from evalanvil.plans.session import cut, read_table
from evalanvil.sources.catalog import shards_needed

RUN = ["eval_id", "dataset", "model"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "completions").select(
        "row_id", "eval_id", "dataset", model_key(F.col("model")).alias("model"), norm_id(F.col("id")).alias("id"), "completion"
    )


def _expected(spark: SparkSession, d: str) -> DataFrame:
    return expected_ids(read_table(spark, d, "samples"), read_table(spark, d, "dataset_specs")).select("eval_id", "dataset", "id")


def _answers(spark: SparkSession, d: str, eval_id: str) -> DataFrame:
    lines = _lines(spark, d).where(F.col("eval_id") == eval_id)
    return lines.withColumn("answer", strip_reasoning(F.col("completion")))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    last = F.try_element_at("messages", F.lit(-1))["content"]
    return read_table(spark, d, "samples").select("eval_id", "dataset", norm_id(F.col("id")).alias("sid"), last.alias("prompt")).distinct()


def _gold_letter() -> Column:
    return F.char(F.lit(65) + F.conv(F.substring("id", 1, 1), 16, 10).cast("int") % 4)


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """Every line with whether its eval's grader finds it right; nothing to grade against is wrong."""
    lines = _lines(spark, d).withColumn("answer", strip_reasoning(F.col("completion")))
    e, answer = F.col("eval_id"), F.col("answer")
    sums = _gold_sums(spark, d).withColumn("eval_id", F.lit("math_500"))
    joined = lines.withColumn("sid", logical_id(F.col("id"))).join(sums, ["eval_id", "dataset", "sid"], "left").drop("sid")
    graded = grade_math(joined, F.when(e == "math_500", answer), F.col("gold")).withColumnRenamed("is_correct", "__sum")
    right = (
        F.when(e == "gpqa_diamond", mcq_correct(mcq_answer(answer, "ABCD")["extracted"], _gold_letter()))
        .when(e == "math_500", F.col("__sum"))
        .when(e == "ifstruct", F.substring(answer, 1, 1).isin("{", "["))
        .otherwise((answer != "") & ~F.contains(answer, F.lit(",")))
    )
    return graded.select("row_id", *RUN, "id", "completion", F.coalesce(right, F.lit(False)).alias("is_correct"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).drop("completion")


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """Every expected attempt of every run that has lines; a missing one is wrong."""
    scored, expected = _scored(spark, d), _expected(spark, d)
    runs = scored.select(*RUN).distinct()
    return with_missing(expected.join(runs, ["eval_id", "dataset"]), scored, [*RUN, "id"])


def reasoning_strip(spark: SparkSession, d: str) -> DataFrame:
    answer = strip_reasoning(F.col("completion"))
    return read_table(spark, d, "completions").select("row_id", F.length(answer).cast("long").alias("chars"), F.sha2(answer, 256).alias("answer_hash"))


def mcq_choices(spark: SparkSession, d: str) -> DataFrame:
    stated = mcq_answer(F.col("answer"), "ABCD")
    return _answers(spark, d, "gpqa_diamond").select("row_id", stated["extracted"].alias("extracted"), stated["pattern"].alias("pattern"))


def mcq_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Gold letters are those of the sample's id: its first hex digit modulo 4."""
    graded = _answers(spark, d, "gpqa_diamond").select("model", mcq_correct(mcq_answer(F.col("answer"), "ABCD")["extracted"], _gold_letter()).alias("is_correct"))
    return summary(graded, ["model"])


def mcq_choice_histogram(spark: SparkSession, d: str) -> DataFrame:
    choices = _answers(spark, d, "gpqa_diamond").select("model", mcq_answer(F.col("answer"), "ABCD")["extracted"].alias("choice"))
    return histogram(choices, "choice", ("A", "B", "C", "D"), "none", ["model"])


def mcq_unparsed_rate(spark: SparkSession, d: str) -> DataFrame:
    choices = _answers(spark, d, "gpqa_diamond").select("model", mcq_answer(F.col("answer"), "ABCD")["extracted"].alias("choice"))
    counted = choices.groupBy("model").agg(F.count_if(F.col("choice").isNull()).alias("unparsed"), F.count(F.lit(1)).alias("received"))
    return counted.withColumn("unparsed_rate", F.col("unparsed") / F.col("received"))


def math_answers(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("answer")
    extracted = math_extract(a)
    return _answers(spark, d, "math_500").select(
        "row_id", boxed_answer(a).alias("boxed"), last_number(a).alias("last_number"), extracted.alias("extracted"), normalize_numeric(extracted).alias("normalized")
    )


def _gold_sums(spark: SparkSession, d: str) -> DataFrame:
    """The true value of every prompt that asks for `a + b - c`."""
    n = lambda i: F.regexp_extract("prompt", r"(\d+) \+ (\d+) - (\d+)", i).try_cast("long")
    asked = _prompts(spark, d).where(F.col("eval_id") == "math_500").where(F.col("prompt").rlike(r"\d+ \+ \d+ - \d+"))
    return asked.select("dataset", "sid", (n(1) + n(2) - n(3)).cast("string").alias("gold")).distinct()


def _sums(spark: SparkSession, d: str) -> DataFrame:
    """Answers to the prompts that ask for `a + b - c`, with the true value."""
    gold = _gold_sums(spark, d)
    return _answers(spark, d, "math_500").withColumn("sid", logical_id(F.col("id"))).join(gold, ["dataset", "sid"])


def math_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return summary(grade_math(_sums(spark, d), F.col("answer"), F.col("gold")), ["model"])


def math_methods(spark: SparkSession, d: str) -> DataFrame:
    return histogram(grade_math(_sums(spark, d), F.col("answer"), F.col("gold")), "method", METHODS, by=["model"])


def struct_validate(spark: SparkSession, d: str) -> DataFrame:
    """Answers to prompts for data in some format, checked against what the prompt says."""
    p = F.col("prompt")
    fmt = F.lower(F.regexp_extract(p, r"Return (\w+) with", 1))
    asked = _prompts(spark, d).where((F.col("eval_id") == "ifstruct") & fmt.isin("json", "yaml", "csv", "xml"))
    schema = F.lit('{"type":"object","required":["name","count"],"properties":{"name":{"type":"string"},"count":{"type":"integer"}}}')
    flag = lambda text: F.when(F.contains(p, F.lit(text)), "true").otherwise("false")
    spec = F.concat(
        F.lit('{"top_level_key":"items","top_level_count":'), F.regexp_extract(p, r"with (\d+) entries", 1),
        F.lit(',"require_wrapper_key":'), flag("Wrap the entries"), F.lit(',"require_code_block":'), flag("Use a code block"),
        F.lit(',"require_no_commentary":'), flag("Do not add commentary"), F.lit(',"output_format":"'), fmt, F.lit('","json_schema":'), schema, F.lit("}"),
    )
    samples = asked.select("dataset", F.col("sid").alias("id"), spec.alias("spec"), fmt.alias("output_format"), (flag("Wrap the entries") == "true").alias("require_wrapper_key"))
    joined = _lines(spark, d).where(F.col("eval_id") == "ifstruct").join(samples, ["dataset", "id"])
    graded = grade_structured(joined.select("row_id", "model", "completion", "spec", "output_format", "require_wrapper_key"), "completion", "spec")
    return graded.select("row_id", "model", "output_format", "require_wrapper_key", F.array_join("errors", ";").alias("errors"), "is_correct")


def struct_json(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts on answers to prompts for JSON, the one format that SQL can read too."""
    return struct_validate(spark, d).where("output_format = 'json'").drop("output_format", "require_wrapper_key")


def struct_summary(spark: SparkSession, d: str) -> DataFrame:
    return structured_summary(cut(struct_validate(spark, d)).withColumn("entity_type", F.col("model")))


def sample_ids(spark: SparkSession, d: str) -> DataFrame:
    """Prompts whose id is not the hash of their text, per data set."""
    p = _prompts(spark, d).where(F.col("prompt").isNotNull())
    wrong = F.count_if(short_hash(F.col("prompt")) != F.col("sid"))
    return p.groupBy("eval_id", "dataset").agg(F.count(F.lit(1)).alias("prompts"), wrong.alias("wrong_ids"))


def content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    p = _prompts(spark, d).where(F.col("prompt").isNotNull())
    return content_fingerprints(p, ["eval_id", "dataset"], line_of(F.col("prompt"), F.col("sid")))


def repeat_expand(spark: SparkSession, d: str) -> DataFrame:
    return _expected(spark, d)


def logical_ids(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(logical_id(F.col("id")).alias("logical_id")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("id").alias("attempts"))


def prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    turns = _prompts(spark, d).where(F.col("prompt").isNotNull()).select("eval_id", "dataset", "sid", F.explode(user_message(F.col("prompt"))).alias("m"))
    return turns.select("eval_id", "dataset", "sid", "m.role", F.length("m.content").cast("long").alias("chars"))


def choice_prompts(spark: SparkSession, d: str) -> DataFrame:
    options = F.array("p_brand", "p_type", F.col("p_size").cast("string"), F.lit("none of these"))
    text = choice_prompt("Choose one option.", F.concat(F.lit("What is "), "p_name", F.lit("?")), options)
    return read_table(spark, d, "part").select("p_partkey", short_hash(text).alias("id"), F.length(text).cast("long").alias("chars"))


def option_seeds(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", md5_seed(F.col("p_name")).alias("seed"))


def pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return pass_at_1(_attempts(spark, d), RUN)


def pass_rate_per_sample(spark: SparkSession, d: str) -> DataFrame:
    return pass_per_sample(_attempts(spark, d), "id", ["eval_id", "dataset"])


def duplicated_ids(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_ids(_lines(spark, d), "id", RUN)


def unknown_sample_ids(spark: SparkSession, d: str) -> DataFrame:
    return unknown_ids(_lines(spark, d), _expected(spark, d), ["eval_id", "dataset", "id"])


def _verified(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    expected = _expected(spark, d).join(lines.select(*RUN).distinct(), ["eval_id", "dataset"])
    return verify(expected, lines, RUN)


def verification_report(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d)


def status_totals(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def registered_status(spark: SparkSession, d: str) -> DataFrame:
    """Every registered model against its runs: 'ok' if all are, else the alphabetically first other status."""
    per = _verified(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.min(F.when(F.col("status") != "ok", F.col("status"))).alias("s"))
    per = per.select("model", "runs", F.coalesce("s", F.lit("ok")).alias("status"))
    registry = read_table(spark, d, "model_registry").select(F.col("hf_id").alias("model"))
    return registry_status(registry, per).select("model", "status", F.coalesce("runs", F.lit(0)).alias("runs"))


def enriched_scores(spark: SparkSession, d: str) -> DataFrame:
    prompts = _prompts(spark, d).groupBy("eval_id", "dataset", "sid").agg(F.max("prompt").alias("prompt"))
    joined = _graded(spark, d).withColumn("sid", logical_id(F.col("id"))).join(prompts, ["eval_id", "dataset", "sid"])
    return joined.select("row_id", F.length("prompt").cast("long").alias("prompt_chars"), F.length("completion").cast("long").alias("chars"), "is_correct")


def blank_answers(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(*RUN).agg(F.count_if(is_blank(F.col("completion"))).alias("blank"), F.sum(F.length("completion")).alias("chars"))


def model_slugs(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("hf_id")
    shards = shards_needed(F.lit("default"), F.col("base_shards"))
    return read_table(spark, d, "model_registry").select("hf_id", model_slug(m).alias("slug"), job_slug(m).alias("job"), shards.alias("shards"))


def release_name(spark: SparkSession, d: str) -> DataFrame:
    """The next release of every month that a data set's name holds."""
    names = read_table(spark, d, "dataset_specs").select(F.regexp_extract("dataset", r"(\d{4}\.\d{2}\.\d+)", 1).alias("name"))
    month = F.substring("name", 1, 7)
    n = F.element_at(F.split("name", r"\."), 3).cast("int")
    return names.groupBy(month.alias("month")).agg((F.max(n) + 1).alias("n")).select(F.concat_ws(".", "month", F.col("n").cast("string")).alias("release"))


def next_2025_10(spark: SparkSession, d: str) -> DataFrame:
    names = read_table(spark, d, "dataset_specs").select(F.regexp_extract("dataset", r"(\d{4}\.\d{2}\.\d+)", 1).alias("name"))
    return next_release(names, "name", "2025.10")


def prompt_shards(spark: SparkSession, d: str) -> DataFrame:
    shards = strided_shard(read_table(spark, d, "documents").select("doc_id"), "doc_id", 7)
    return shards.select("doc_id", F.col("shard").cast("long").alias("shard"))


def prompt_length_stats(spark: SparkSession, d: str) -> DataFrame:
    """Lengths in words of the prompts that fit into 64 words."""
    words = _prompts(spark, d).where(F.col("prompt").isNotNull()).select(F.size(F.split(F.trim("prompt"), r"[ \n]+")).cast("long").alias("tokens"))
    return length_stats(length_filter(words, "tokens", 64), "tokens", 64)


def _panel(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) % 2 == 1).alias("pass"))
    return e.select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("model"), "pass")


def _as_text(matrix: DataFrame) -> DataFrame:
    return matrix.select("sample_id", F.array_join(F.transform("pv", lambda x: x.cast("int").cast("string")), "").alias("pv"))


def pass_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _as_text(panel.pass_matrix(_panel(spark, d)))


def unanimous_filter(spark: SparkSession, d: str) -> DataFrame:
    return _as_text(panel.not_unanimous(panel.pass_matrix(_panel(spark, d))))


def dedup_behavior(spark: SparkSession, d: str) -> DataFrame:
    return _as_text(panel.distinct_behavior(panel.pass_matrix(_panel(spark, d))))


def full_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return panel.model_accuracy(_panel(spark, d))


def model_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Models over customers as samples: a model is a nation's order priority; most lack samples."""
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("model"), (F.col("o_orderstatus") == "F").alias("pass"))
    samples = read_table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"))
    return panel.complete_models(o, samples).select("model", "have", F.col("missing").cast("long").alias("missing"), F.col("total").cast("long").alias("total"), "passes", "reason")


def _strata(spark: SparkSession, d: str) -> DataFrame:
    m = panel.pass_matrix(_panel(spark, d))
    return m.select("sample_id", "pv", (F.col("sample_id") % 4).cast("string").alias("grp"), F.size(F.filter("pv", lambda x: x)).alias("passes"))


def difficulty_bins(spark: SparkSession, d: str) -> DataFrame:
    return panel.difficulty_bins(_strata(spark, d), "grp", "passes").select("sample_id", "grp", F.col("passes").cast("long").alias("passes"), F.col("bin").cast("long").alias("bin"))


def cell_quotas(spark: SparkSession, d: str) -> DataFrame:
    return panel.cell_quotas(panel.difficulty_bins(_strata(spark, d), "grp", "passes"), "grp", 40)


def subset_drift(spark: SparkSession, d: str) -> DataFrame:
    tidy = _panel(spark, d)
    return panel.drift(tidy, tidy.where("sample_id % 3 = 0").select("sample_id"))


def panel_tau(spark: SparkSession, d: str) -> DataFrame:
    return panel.kendall_tau(subset_drift(spark, d), "model", "full_accuracy", "subset_accuracy")


def top3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return panel.top_agreement(cut(subset_drift(spark, d)), "model", "full_accuracy", "subset_accuracy", 3)


def instruction_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Instructions are brand:type of line items; strict is a returned line, loose a returned or open one."""
    l = read_table(spark, d, "lineitem").join(read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    flags = l.select(
        F.concat_ws(":", F.substring_index("p_type", " ", 1), "p_brand").alias("iid"),
        (F.col("l_returnflag") == "R").alias("strict"),
        ((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O")).alias("loose"),
    )
    return tiers(flags).select("tier", "name", "pass_kind", "passed", "total", "accuracy")


def representative_subset(spark: SparkSession, d: str) -> DataFrame:
    return panel.representative_subset(_strata(spark, d), "grp", 40)


def held_out_cv(spark: SparkSession, d: str) -> DataFrame:
    return panel.held_out(_strata(spark, d), "grp", 40, folds=3)


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Per run: ids expected and received, expected only, received only."""
    lines = _lines(spark, d).select(*RUN, "id").distinct()
    want = _expected(spark, d).join(lines.select(*RUN).distinct(), ["eval_id", "dataset"]).select(*RUN, "id")
    tag = lambda df, name: df.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")).select(*RUN, F.lit(name).alias("side"), "n")
    return tag(want.intersect(lines), "both").unionByName(tag(want.subtract(lines), "expected")).unionByName(tag(lines.subtract(want), "received"))


def instruction_categories(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").groupBy(category(F.replace("p_type", F.lit(" "), F.lit(":"))).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def answer_letters(spark: SparkSession, d: str) -> DataFrame:
    """Letters stated in answers to multiple-choice prompts per data set, over the fixed domain."""
    stated = _answers(spark, d, "gpqa_diamond").select("dataset", mcq_answer(F.col("answer"), "ABCD")["extracted"].alias("answer"))
    return answer_distribution(stated, "answer", by=["dataset"])


def status_cells(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).select(*RUN, status_cell().alias("cell"))


def shown_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Shares and verdicts of the panel's models as they are shown."""
    a = F.col("accuracy")
    return panel.model_accuracy(_panel(spark, d)).select("model", shown_number(a).alias("accuracy"), shown_share(a).alias("share"), verdict(a > 0.5).alias("verdict"))


def stray_scores(spark: SparkSession, d: str) -> DataFrame:
    """Ids that scores name and no expected attempt has, counted per data set."""
    stray = stray_ids(_scored(spark, d), _expected(spark, d), ["eval_id", "dataset", "id"])
    return stray.groupBy("eval_id", "dataset").agg(F.count(F.lit(1)).alias("ids"))


def echoed_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Completions of a model that repeats its prompt, for prompts of at most 24 words; longer ones get none."""
    p = _prompts(spark, d).withColumn("words", F.size(F.split("prompt", " ")))
    out = generate(p, lambda: lambda texts: texts, "prompt", "words", 25)
    return out.select("eval_id", "dataset", "sid", F.length("completion").cast("long").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        reasoning_strip, mcq_choices, mcq_accuracy, mcq_choice_histogram, mcq_unparsed_rate, math_answers, math_accuracy, math_methods,
        struct_validate, struct_json, struct_summary, sample_ids, content_fingerprint, repeat_expand, logical_ids, prompt_messages, choice_prompts, option_seeds,
        pass_rate, pass_rate_per_sample, duplicated_ids, unknown_sample_ids, verification_report, status_totals, registered_status,
        enriched_scores, blank_answers, model_slugs, release_name, next_2025_10, prompt_shards, prompt_length_stats, pass_vectors,
        unanimous_filter, dedup_behavior, full_accuracy, model_exclusion, difficulty_bins, cell_quotas, subset_drift, panel_tau,
        top3_agreement, instruction_tiers, representative_subset, held_out_cv, set_operations, instruction_categories,
        answer_letters, status_cells, shown_verdicts, stray_scores, echoed_prompts,
    )
}

# ---- the same in DuckDB's SQL -------------------------------------------------------------------------

_LINES = f"SELECT row_id, eval_id, dataset, replace(model, '--', '/') AS model, {_NORM.format(c='id')} AS id, completion FROM completions"


def _answer_sql(text: str) -> str:
    """The answer without reasoning, by positions: pairs go first, then what lies before a closer and after an opener."""
    at = lambda tag: f"strpos(lower(x), '{tag}')"
    pairs = rf"regexp_replace({text}, '(?is)<think>.*?</think>|\[THINK\].*?\[/THINK\]', '', 'g')"
    closed = f"CASE WHEN {at('</think>')} > 0 THEN substr(x, {at('</think>')} + 8) WHEN {at('[/think]')} > 0 THEN substr(x, {at('[/think]')} + 8) ELSE x END"
    opened = f"CASE WHEN {at('<think>')} + {at('[think]')} = 0 THEN x ELSE left(x, least(coalesce(nullif({at('<think>')}, 0), 1000000000), coalesce(nullif({at('[think]')}, 0), 1000000000)) - 1) END"
    final = r"regexp_replace(x, '(?s)\A.*?(?:<\|start\|>)?assistant(?:<\|channel\|>)?final(?:<\|message\|>)?', '')"
    ended = r"regexp_replace(x, '<\|(?:end|return)\|>\s*\z', '')"
    sql = pairs
    for step in (closed, opened, final, ended):
        sql = f"(SELECT {step} FROM (SELECT {sql} AS x))"
    return _STRIP.format(c=sql)


_ANSWERS = f"SELECT *, {_answer_sql('completion')} AS answer FROM ({_LINES})"
_MCQ = (
    ("primary", r"(?i)[\*\_]{0,2}Answer[\*\_]{0,2}\s*:[\s\*\_]{0,2}\s*([A-Z])(?:[^a-zA-Z0-9]|\z)"),
    ("boxed", r"\\boxed\{[^}]*([A-Z])[^}]*\}"),
    ("answer_is", r"(?i)answer is ([A-Za-z])"),
    ("answer_is_paren", r"(?i)answer is \(([A-Za-z])"),
    ("choice_format", r"([A-Z])\)\s*[^A-Z]*"),
    ("explicit", r"(?i)([A-Z])\s+is\s+the\s+correct\s+answer"),
    ("standalone_end", r"([A-Z])\s*\z"),
    ("letter_period", r"([A-Z])\s*\."),
    ("letter_nonword", r"([A-Z])\s*[^\pL\pN_\pM]"),
)


def _mcq_sql() -> str:
    letter = {n: f"upper(regexp_extract_all(answer, '{p}', 1)[-1])" for n, p in _MCQ}
    when = lambda results: "".join(f" WHEN {e} IN ('A', 'B', 'C', 'D') THEN {r}" for e, r in zip(letter.values(), results))
    extracted, named = when(letter.values()), when(f"'{n}'" for n in letter)
    single = "WHEN length(answer) = 1 AND upper(answer) IN ('A', 'B', 'C', 'D') THEN"
    return (
        f"SELECT *, CASE {single} upper(answer){extracted} END AS extracted, CASE {single} 'single_letter'{named} END AS pattern "
        f"FROM ({_ANSWERS}) WHERE eval_id = 'gpqa_diamond'"
    )


_CHOICES = _mcq_sql()
_BOXED = r"\\(?:boxed|fbox|framebox)\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
_MATH = (
    "SELECT *, CASE WHEN length(boxed) > 0 THEN boxed ELSE last_number END AS extracted FROM (SELECT *, "
    + _STRIP.format(c="raw_boxed")
    + " AS boxed FROM (SELECT *, regexp_extract_all(answer, '"
    + _BOXED
    + r"', 1)[-1] AS raw_boxed, regexp_extract_all(answer, '(-?\d+(?:\.\d+)?)', 1)[-1] AS last_number FROM ("
    + _ANSWERS
    + ") WHERE eval_id = 'math_500'))"
)
_NUMERIC = "nullif(regexp_extract(replace(extracted, ',', ''), '^\\s*(-?\\d+)', 1), '')"
_SUMS = f"""
WITH p AS (SELECT DISTINCT dataset, {_NORM.format(c='id')} AS sid, messages[-1].content AS prompt FROM samples WHERE eval_id = 'math_500'),
gold AS (SELECT DISTINCT dataset, sid, CAST(CAST(regexp_extract(prompt, '(\\d+) \\+ (\\d+) - (\\d+)', 1) AS BIGINT) + CAST(regexp_extract(prompt, '(\\d+) \\+ (\\d+) - (\\d+)', 2) AS BIGINT)
    - CAST(regexp_extract(prompt, '(\\d+) \\+ (\\d+) - (\\d+)', 3) AS BIGINT) AS VARCHAR) AS gold FROM p WHERE regexp_matches(prompt, '\\d+ \\+ \\d+ - \\d+')),
graded AS (SELECT m.row_id, m.model, CASE WHEN extracted IS NULL THEN 'failed' WHEN {_NUMERIC} = gold THEN 'prm800k' ELSE 'no_match' END AS method
  FROM ({_MATH}) m JOIN gold g ON g.dataset = m.dataset AND g.sid = regexp_replace(m.id, '#[^#]*$', ''))"""
_GRADED = f"""
SELECT l.row_id, l.eval_id, l.dataset, l.model, l.id, l.completion, coalesce(CASE l.eval_id WHEN 'gpqa_diamond' THEN c.extracted = chr(65 + CAST('0x' || l.id[1] AS INT) % 4) WHEN 'math_500' THEN m.method = 'prm800k'
    WHEN 'ifstruct' THEN left(l.answer, 1) IN ('{{', '[') ELSE l.answer <> '' AND NOT contains(l.answer, ',') END, false) AS ok
  FROM ({_ANSWERS}) l LEFT JOIN ({_CHOICES}) c USING (row_id) LEFT JOIN ({_SUMS} SELECT row_id, method FROM graded) m USING (row_id)"""
_ATTEMPTS = f"""
WITH {_EXPECTED}, lines AS ({_GRADED}), runs AS (SELECT DISTINCT eval_id, dataset, model FROM lines),
want AS (SELECT DISTINCT r.model, e.eval_id, e.dataset, e.id FROM expected e JOIN runs r USING (eval_id, dataset)),
scored AS (SELECT eval_id, dataset, model, id, max(ok) AS ok, count(*) AS n,
  sum(CASE WHEN {_STRIP.format(c="coalesce(completion, '')")} = '' THEN 1 ELSE 0 END) AS blank FROM lines GROUP BY ALL),
attempts AS (SELECT w.*, coalesce(s.ok, false) AS ok FROM want w LEFT JOIN scored s USING (eval_id, dataset, model, id))"""
_VERIFIED = f"""{_ATTEMPTS},
counted AS (SELECT eval_id, dataset, model, count(w) AS total, count(CASE WHEN w AND n IS NOT NULL THEN 1 END) AS have, count(CASE WHEN w AND n IS NULL THEN 1 END) AS missing,
  count(CASE WHEN w IS NULL THEN 1 END) AS extra, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, CAST(coalesce(sum(blank), 0) AS BIGINT) AS empty
  FROM (SELECT *, true AS w FROM want) FULL JOIN scored USING (eval_id, dataset, model, id) GROUP BY ALL),
verified AS (SELECT *, missing = 0 AND extra = 0 AND duplicates = 0 AS ok, CASE WHEN have = 0 AND missing > 0 THEN 'missing' WHEN missing > 0 THEN 'incomplete'
  WHEN duplicates > 0 THEN 'duplicates' WHEN empty = total THEN 'zero-score' WHEN empty > 0 THEN 'partial-empty' ELSE 'ok' END AS status FROM counted)"""
_PROMPTS = f"SELECT DISTINCT eval_id, dataset, {_NORM.format(c='id')} AS sid, messages[-1].content AS prompt FROM samples"
_PANEL = "SELECT user_id AS sample_id, event_type AS model, count(*) % 2 = 1 AS pass FROM events GROUP BY ALL"
_VECTORS = f"""SELECT e.sample_id, string_agg(CASE WHEN p.pass THEN '1' ELSE '0' END, '' ORDER BY e.model) AS pv
  FROM (SELECT * FROM (SELECT DISTINCT sample_id FROM ({_PANEL})) CROSS JOIN (SELECT DISTINCT model FROM ({_PANEL}))) e LEFT JOIN ({_PANEL}) p USING (sample_id, model) GROUP BY ALL"""
_DRIFT = f"""
  SELECT f.model, f.a AS full_accuracy, coalesce(s.a, 0.0) AS subset_accuracy, abs(coalesce(s.a, 0.0) - f.a) AS deviation FROM
  (SELECT model, sum(CAST(pass AS INT)) / CAST(count(*) AS DOUBLE) AS a FROM ({_PANEL}) GROUP BY ALL) f LEFT JOIN
  (SELECT model, sum(CAST(pass AS INT)) / CAST(count(*) AS DOUBLE) AS a FROM ({_PANEL}) WHERE sample_id % 3 = 0 GROUP BY ALL) s USING (model)"""

_FENCED = r"(?s)```[\w+-]*[ \t]*\n(.*?)\n?[ \t]*```"
_STRUCT = rf"""
WITH asked AS (SELECT DISTINCT dataset, {_NORM.format(c='id')} AS id, messages[-1].content AS prompt FROM samples WHERE eval_id = 'ifstruct'),
j AS (SELECT l.row_id, l.model, coalesce(l.answer, '') AS a, contains(prompt, 'Use a code block') AS fence, contains(prompt, 'Do not add commentary') AS bare, contains(prompt, 'Wrap the entries') AS wrap,
    CAST(regexp_extract(prompt, 'with (\d+) entries', 1) AS BIGINT) AS n
  FROM ({_ANSWERS}) l JOIN asked USING (dataset, id) WHERE l.eval_id = 'ifstruct' AND lower(regexp_extract(prompt, 'Return (\w+) with', 1)) = 'json'),
f AS (SELECT *, regexp_matches(a, '{_FENCED}') AS has, regexp_extract(a, '{_FENCED}', 1) AS inside, {_STRIP.format(c=f"regexp_replace(a, '{_FENCED}', '')")} AS around, regexp_extract(a, '(?s)[\[{{].*[\]}}]', 0) AS span FROM j),
b AS (SELECT *, CASE WHEN has THEN inside WHEN NOT bare AND span <> '' THEN span ELSE a END AS body FROM f),
v AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS value FROM b),
i AS (SELECT *, CASE WHEN wrap THEN value->'items' WHEN json_type(value) = 'OBJECT' AND json_keys(value) = ['items'] THEN value->'items' ELSE value END AS items FROM v),
e AS (SELECT *, CASE WHEN json_type(items) = 'ARRAY' THEN json_extract(items, '$[*]') ELSE [items] END AS each FROM i),
x AS (SELECT row_id, model, wrap, CASE WHEN fence AND NOT has THEN 'no code block' END AS e1, CASE WHEN bare AND has AND around <> '' THEN 'commentary' END AS e2,
    CASE WHEN value IS NULL THEN 'no valid JSON' WHEN wrap AND items IS NULL THEN 'no wrapper key' END AS stop,
    CASE WHEN json_type(items) <> 'ARRAY' THEN 'not a list' WHEN json_array_length(items) <> n THEN 'wrong number of items' END AS e3,
    CASE WHEN len(list_filter(each, lambda o: NOT coalesce(json_type(o) = 'OBJECT' AND json_type(o->'name') = 'VARCHAR' AND (json_type(o->'count') IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT')
      OR json_type(o->'count') = 'DOUBLE' AND CAST(o->'count' AS DOUBLE) = floor(CAST(o->'count' AS DOUBLE))), false))) > 0 THEN 'schema' END AS e4 FROM e),
y AS (SELECT *, list_filter([e1, e2, stop, CASE WHEN stop IS NULL THEN e3 END, CASE WHEN stop IS NULL THEN e4 END], lambda z: z IS NOT NULL) AS errors FROM x)"""

ORACLES = {
    "struct_json": f"{_STRUCT} SELECT row_id, model, array_to_string(errors, ';') AS errors, len(errors) = 0 AS is_correct FROM y",
    "reasoning_strip": f"SELECT row_id, length(a) AS chars, sha256(a) AS answer_hash FROM (SELECT row_id, {_answer_sql('completion')} AS a FROM completions)",
    "mcq_choices": f"SELECT row_id, extracted, pattern FROM ({_CHOICES})",
    "mcq_accuracy": f"""SELECT model, CAST(sum(CAST(coalesce(extracted = chr(65 + CAST('0x' || id[1] AS INT) % 4), false) AS INT)) AS BIGINT) AS correct, count(*) AS total,
        sum(CAST(coalesce(extracted = chr(65 + CAST('0x' || id[1] AS INT) % 4), false) AS INT)) / CAST(count(*) AS DOUBLE) AS accuracy FROM ({_CHOICES}) GROUP BY ALL""",
    "mcq_choice_histogram": f"""WITH c AS ({_CHOICES}) SELECT m.model, d.choice, count(c.row_id) AS n FROM (SELECT DISTINCT model FROM c) m CROSS JOIN
        (SELECT unnest(['A', 'B', 'C', 'D', 'none']) AS choice) d LEFT JOIN c ON c.model = m.model AND coalesce(c.extracted, 'none') = d.choice GROUP BY ALL""",
    "mcq_unparsed_rate": f"""SELECT model, count(*) - count(extracted) AS unparsed, count(*) AS received, (count(*) - count(extracted)) / CAST(count(*) AS DOUBLE) AS unparsed_rate
        FROM ({_CHOICES}) GROUP BY ALL""",
    "math_answers": f"SELECT row_id, boxed, last_number, extracted, {_NUMERIC} AS normalized FROM ({_MATH})",
    "math_accuracy": f"""{_SUMS} SELECT model, CAST(sum(CASE WHEN method = 'prm800k' THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total,
        sum(CASE WHEN method = 'prm800k' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS accuracy FROM graded GROUP BY ALL""",
    "math_methods": f"""{_SUMS} SELECT m.model, d.method, count(g.method) AS n FROM (SELECT DISTINCT model FROM graded) m CROSS JOIN
        (SELECT unnest(['prm800k', 'robust_boxed', 'no_match', 'failed']) AS method) d LEFT JOIN graded g ON g.model = m.model AND g.method = d.method GROUP BY ALL""",
    "sample_ids": f"""SELECT eval_id, dataset, count(*) AS prompts, CAST(sum(CASE WHEN left(sha256(prompt), 12) <> sid THEN 1 ELSE 0 END) AS BIGINT) AS wrong_ids
        FROM ({_PROMPTS}) WHERE prompt IS NOT NULL GROUP BY ALL""",
    "content_fingerprint": f"""SELECT eval_id, dataset, sha256(string_agg(prompt || chr(31) || sid, chr(10) ORDER BY encode(prompt || chr(31) || sid))) AS content_sha256
        FROM ({_PROMPTS}) WHERE prompt IS NOT NULL GROUP BY ALL""",
    "repeat_expand": f"WITH {_EXPECTED} SELECT eval_id, dataset, id FROM expected",
    "logical_ids": f"SELECT regexp_replace(id, '#[^#]*$', '') AS logical_id, count(*) AS lines, count(DISTINCT id) AS attempts FROM ({_LINES}) GROUP BY ALL",
    "prompt_messages": f"SELECT eval_id, dataset, sid, 'user' AS role, length(prompt) AS chars FROM ({_PROMPTS}) WHERE prompt IS NOT NULL",
    "choice_prompts": """SELECT p_partkey, left(sha256(t), 12) AS id, length(t) AS chars FROM (SELECT p_partkey, 'Choose one option.' || chr(10) || chr(10) || 'What is ' || p_name || '?' || chr(10) || chr(10)
        || 'A) ' || p_brand || chr(10) || 'B) ' || p_type || chr(10) || 'C) ' || p_size || chr(10) || 'D) none of these' AS t FROM part)""",
    "option_seeds": "SELECT p_partkey, CAST('0x' || right(md5(p_name), 8) AS BIGINT) AS seed FROM part",
    "pass_rate": f"""{_ATTEMPTS} SELECT eval_id, dataset, model, passed, attempts, passed / CAST(attempts AS DOUBLE) AS pass_at_1,
        sqrt((passed / CAST(attempts AS DOUBLE)) * (1 - passed / CAST(attempts AS DOUBLE)) / attempts) AS stderr
        FROM (SELECT eval_id, dataset, model, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS passed, count(*) AS attempts FROM attempts GROUP BY ALL)""",
    "pass_rate_per_sample": f"""{_ATTEMPTS} SELECT eval_id, dataset, regexp_replace(id, '#[^#]*$', '') AS logical_id, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS passed, count(*) AS attempts,
        sum(CAST(ok AS INT)) / CAST(count(*) AS DOUBLE) AS rate FROM attempts GROUP BY ALL""",
    "duplicated_ids": f"SELECT eval_id, dataset, model, id, count(*) AS n FROM ({_LINES}) GROUP BY ALL HAVING count(*) > 1",
    "unknown_sample_ids": f"WITH {_EXPECTED} SELECT DISTINCT eval_id, dataset, id FROM ({_LINES}) l ANTI JOIN expected USING (eval_id, dataset, id)",
    "verification_report": f"{_VERIFIED} SELECT * FROM verified",
    "status_totals": f"{_VERIFIED} SELECT status, count(*) AS runs FROM verified GROUP BY ALL",
    "registered_status": f"""{_VERIFIED} SELECT r.hf_id AS model, coalesce(v.status, 'missing') AS status, coalesce(v.runs, 0) AS runs FROM model_registry r LEFT JOIN
        (SELECT model, count(*) AS runs, coalesce(min(CASE WHEN status <> 'ok' THEN status END), 'ok') AS status FROM verified GROUP BY ALL) v ON v.model = r.hf_id""",
    "enriched_scores": f"""SELECT l.row_id, length(p.prompt) AS prompt_chars, length(l.completion) AS chars, l.ok AS is_correct FROM ({_GRADED}) l JOIN
        (SELECT eval_id, dataset, sid, max(prompt) AS prompt FROM ({_PROMPTS}) GROUP BY ALL) p ON p.eval_id = l.eval_id AND p.dataset = l.dataset AND p.sid = regexp_replace(l.id, '#[^#]*$', '')""",
    "blank_answers": f"""SELECT eval_id, dataset, model, CAST(sum(CASE WHEN {_STRIP.format(c="coalesce(completion, '')")} = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank,
        CAST(sum(length(completion)) AS BIGINT) AS chars FROM ({_LINES}) GROUP BY ALL""",
    "model_slugs": "SELECT hf_id, replace(hf_id, '/', '--') AS slug, replace(hf_id, '/', '_') AS job, base_shards AS shards FROM model_registry",
    "release_name": r"""SELECT m || '.' || max(n) + 1 AS release FROM (SELECT regexp_extract(dataset, '(\d{4}\.\d{2})\.\d+', 1) AS m, CAST(regexp_extract(dataset, '\d{4}\.\d{2}\.(\d+)', 1) AS INT) AS n
        FROM dataset_specs) GROUP BY m""",
    "next_2025_10": r"""SELECT '2025.10.' || coalesce(max(CAST(nullif(regexp_extract(dataset, '2025\.10\.(\d+)', 1), '') AS INT)), 0) + 1 AS release FROM dataset_specs""",
    "prompt_shards": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 7 AS shard FROM documents",
    "prompt_length_stats": rf"""SELECT count(*) AS n, min(t) AS min_tokens, max(t) AS max_tokens, list_sort(list(t))[count(*) // 2 + 1] AS median_tokens, CAST(floor(sum(t) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS mean_tokens
        FROM (SELECT len(regexp_split_to_array(trim(prompt, ' '), '[ \n]+')) AS t FROM ({_PROMPTS}) WHERE prompt IS NOT NULL) WHERE t <= 63""",
    "pass_vectors": _VECTORS,
    "unanimous_filter": f"SELECT * FROM ({_VECTORS}) WHERE contains(pv, '0') AND contains(pv, '1')",
    "dedup_behavior": f"SELECT min(sample_id) AS sample_id, pv FROM ({_VECTORS}) GROUP BY pv",
    "full_accuracy": f"""SELECT model, CAST(sum(CAST(pass AS INT)) AS BIGINT) AS passes, count(*) AS samples, sum(CAST(pass AS INT)) / CAST(count(*) AS DOUBLE) AS accuracy
        FROM ({_PANEL}) GROUP BY ALL""",
    "model_exclusion": """WITH r AS (SELECT o_orderpriority AS model, o_custkey AS sample_id, max(o_orderstatus = 'F') AS pass FROM orders SEMI JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        t AS (SELECT count(DISTINCT c_custkey) AS total FROM customer)
        SELECT model, have, total - have AS missing, total, passes, CASE WHEN have = 0 THEN 'scoring failed' WHEN have < total THEN 'incomplete' WHEN passes = 0 THEN 'zero accuracy' END AS reason
        FROM (SELECT model, count(*) AS have, CAST(sum(CAST(pass AS INT)) AS BIGINT) AS passes FROM r GROUP BY ALL), t""",
    "difficulty_bins": f"""SELECT sample_id, grp, passes, 3 - ntile(3) OVER (PARTITION BY grp ORDER BY passes DESC, sample_id DESC) AS bin FROM (
        SELECT sample_id, CAST(sample_id % 4 AS VARCHAR) AS grp, length(replace(pv, '0', '')) AS passes FROM ({_VECTORS}))""",
    "cell_quotas": f"""WITH b AS (SELECT grp, 3 - ntile(3) OVER (PARTITION BY grp ORDER BY passes DESC, sample_id DESC) AS bin FROM (
          SELECT sample_id, CAST(sample_id % 4 AS VARCHAR) AS grp, length(replace(pv, '0', '')) AS passes FROM ({_VECTORS}))),
        c AS (SELECT grp, CAST(bin AS INT) AS bin, count(*) AS size, count(*) * 40.0::DOUBLE / sum(count(*)) OVER () AS share FROM b GROUP BY ALL),
        f AS (SELECT *, least(size, greatest(1, floor(share))) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, grp DESC, bin DESC) AS turn FROM c)
        SELECT grp, bin, size, CAST(CASE WHEN (SELECT sum(size) FROM f) <= 40 THEN size ELSE base + CASE WHEN turn <= 40 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM f""",
    "subset_drift": _DRIFT,
    "panel_tau": f"""WITH d AS ({_DRIFT}) SELECT sum(sign((a.full_accuracy - b.full_accuracy) * (a.subset_accuracy - b.subset_accuracy))) / CAST(count(*) AS DOUBLE) AS kendall_tau
        FROM d a JOIN d b ON a.model < b.model""",
    "top3_agreement": f"""WITH d AS ({_DRIFT}) SELECT count(*) / 3.0 AS top_agreement FROM (SELECT model FROM d ORDER BY full_accuracy DESC, model LIMIT 3)
        SEMI JOIN (SELECT model FROM d ORDER BY subset_accuracy DESC, model LIMIT 3) USING (model)""",
    "instruction_tiers": """WITH f AS (SELECT split_part(p_type, ' ', 1) AS cat, split_part(p_type, ' ', 1) || ':' || p_brand AS iid, l_returnflag = 'R' AS s, l_returnflag = 'R' OR l_linestatus = 'O' AS l
          FROM lineitem JOIN part ON l_partkey = p_partkey),
        g AS (SELECT CASE WHEN grouping(iid) = 0 THEN 1 ELSE 0 END AS tier, coalesce(iid, cat) AS name, sum(CAST(s AS INT)) AS s, sum(CAST(l AS INT)) AS l, count(*) AS total
          FROM f GROUP BY GROUPING SETS ((iid), (cat)))
        SELECT tier, name, k AS pass_kind, CAST(CASE WHEN k = 'strict' THEN s ELSE l END AS BIGINT) AS passed, total, CASE WHEN k = 'strict' THEN s ELSE l END / CAST(total AS DOUBLE) AS accuracy
        FROM g CROSS JOIN (SELECT unnest(['strict', 'loose']) AS k)""",
    "set_operations": f"""{_ATTEMPTS}, have AS (SELECT DISTINCT eval_id, dataset, model, id FROM lines),
        j AS (SELECT eval_id, dataset, model, CASE WHEN w AND h THEN 'both' WHEN w THEN 'expected' ELSE 'received' END AS side
          FROM (SELECT *, true AS w FROM want) FULL JOIN (SELECT *, true AS h FROM have) USING (eval_id, dataset, model, id))
        SELECT eval_id, dataset, model, side, count(*) AS n FROM j GROUP BY ALL""",
    "answer_letters": f"""WITH c AS ({_CHOICES}) SELECT m.dataset, d.answer, count(c.row_id) AS n FROM (SELECT DISTINCT dataset FROM c) m CROSS JOIN
        (SELECT unnest(['A', 'B', 'C', 'D']) AS answer) d LEFT JOIN c ON c.dataset = m.dataset AND c.extracted = d.answer GROUP BY ALL""",
    "status_cells": f"""{_VERIFIED} SELECT eval_id, dataset, model, concat_ws(chr(10), status || ' ' || have || '/' || total, CASE WHEN missing > 0 THEN missing || ' missing' END,
        CASE WHEN duplicates > 0 THEN duplicates || ' repeated' END, CASE WHEN empty > 0 THEN empty || ' empty' END) AS cell FROM verified""",
    "shown_verdicts": f"""SELECT model, CASE WHEN a = floor(a) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE printf('%.4f', a) END AS accuracy, printf('%.2f', a * 100) || '%' AS share,
        CASE WHEN a > 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT model, sum(CAST(pass AS INT)) / CAST(count(*) AS DOUBLE) AS a FROM ({_PANEL}) GROUP BY ALL)""",
    "stray_scores": f"""WITH {_EXPECTED} SELECT eval_id, dataset, count(*) AS ids FROM (SELECT DISTINCT eval_id, dataset, id FROM ({_LINES}) l ANTI JOIN expected USING (eval_id, dataset, id)) GROUP BY ALL""",
    "echoed_prompts": f"""SELECT eval_id, dataset, sid, CASE WHEN len(string_split(prompt, ' ')) <= 24 THEN length(prompt) ELSE 0 END AS chars FROM ({_PROMPTS})""",
    "instruction_categories": "SELECT split_part(p_type, ' ', 1) AS category, count(*) AS n FROM part GROUP BY ALL",
}
