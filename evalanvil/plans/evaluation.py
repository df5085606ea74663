"""Further queries of the evaluation operators: data sets and runs written and read again, graders, panels; with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalanvil.functions.keys import model_key, norm_id
from evalanvil.functions.text import allowed_tokens
from evalanvil.operators import panel
from evalanvil.operators.attempts import offenders, unknown_ids
from evalanvil.operators.generate import skipped
from evalanvil.operators.instructions import grade_instructions
from evalanvil.operators.mathgrade import grade_answers
from evalanvil.operators.scoring import SCORERS
from evalanvil.operators.structured import common_errors, structured_summary
from evalanvil.plans.problems import _EXPECTED, _NORM, _STRIP
from evalanvil.plans.reference import (
    _ANSWERS, _DRIFT, _LINES, _PANEL, _PROMPTS, _STRUCT, _SUMS, _VECTORS, _expected, _lines, _panel, _prompts, _strata, _sums, struct_validate, subset_drift,
)
from evalanvil.plans.session import cut, read_table, shared_dir
from evalanvil.sources import catalog
from evalanvil.sources.schemas import EVALS

REPEATS = 2


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _letter(prompt: Column) -> Column:
    return F.char(F.lit(65) + F.conv(F.substring(F.sha2(prompt, 256), 1, 1), 16, 10).cast("int") % 4)


def _catalogue(spark: SparkSession, d: str) -> str:
    """A catalogue with a data set 'all' per eval, made of every distinct prompt; answers derive from the prompt."""
    root, p = _folder(spark, "catalogue"), F.col("prompt")
    prompts = _prompts(spark, d).where(p.isNotNull()).select("eval_id", "prompt").distinct()
    size = F.length(p)
    columns = {
        "gpqa_diamond": [p, F.concat(F.lit(" "), F.lower(_letter(p))).alias("answer")],
        "math_500": [p, size.cast("string").alias("answer")],
        "ifbench": [F.sha2(p, 256).alias("key"), F.array(F.lit("punctuation:no_comma"), F.lit("keywords:existence")).alias("instruction_id_list"), p, F.lit('[{}, {"keywords": ["the"]}]').alias("kwargs"), (size % 3).cast("long").alias("n_constraints")],
        "ifstruct": [
            size.cast("long").alias("seed"), F.when(size % 2 == 0, "town").otherwise("river").alias("entity_type"), p, F.lit('{"type": "object"}').alias("json_schema"), F.lit("[1, 2]").alias("top_level_count"),
            F.lit("items").alias("top_level_key"), (size % 2 == 0).alias("require_wrapper_key"), F.lit(False).alias("require_code_block"), F.lit(True).alias("require_no_commentary"), F.lit("json").alias("output_format"),
        ],
    }
    for eval_id, made in columns.items():
        rows = prompts.where(F.col("eval_id") == eval_id).select(*made)
        catalog.save_rows(rows, eval_id, "all", None, root, {"repeats": REPEATS, "source_dataset": "samples"})
    return root


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def catalog_samples(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth of every eval, read through the catalogue: ids (one per attempt), answers, strata."""
    root, out = _catalogue(spark, d), []
    for eval_id in sorted(EVALS):
        truth = catalog.load_samples(spark, eval_id, "all", root)
        answer = F.col("answer") if "answer" in truth.columns else F.lit(None).cast("string")
        out.append(truth.select(F.lit(eval_id).alias("eval_id"), "id", answer.alias("answer"), F.length("prompt").cast("long").alias("chars"), panel.group_key(eval_id).alias("grp")))
    return _union(out)


def catalog_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The public view of every eval: the same ids, and one user message each."""
    root = _catalogue(spark, d)
    out = [catalog.load_prompts(spark, e, "all", root).select(F.lit(e).alias("eval_id"), "id", F.explode("messages").alias("m")) for e in sorted(EVALS)]
    return _union(out).select("eval_id", "id", "m.role", F.length("m.content").cast("long").alias("chars"))


def catalog_listing(spark: SparkSession, d: str) -> DataFrame:
    """Evals with their data sets and what their metadata say; content hashes of questions with answers."""
    root = _catalogue(spark, d)
    rows = []
    for e in sorted(EVALS):
        meta = catalog.read_metadata(spark, catalog.dataset_dir(e, "all", root), needed=True)
        rows.append((e, meta["num_samples"], meta["repeats"], meta.get("content_sha256") if e != "ifbench" else None))
    known = spark.createDataFrame(rows, "eval_id string, num_samples long, repeats long, content_sha256 string")
    return catalog.list_evals(spark, root).join(known, "eval_id")


def runs_written(spark: SparkSession, d: str) -> DataFrame:
    """Every completion laid out as runs in shards of JSON lines and read again, counted per run."""
    results = _folder(spark, "results")
    lines = read_table(spark, d, "completions").select("eval_id", model_key(F.col("model")).alias("model"), "dataset", "shard", "id", "completion")
    catalog.write_runs(lines, results)
    files, out = catalog.Files(spark, results), []
    for e in files.names(results, dirs=True):
        sets = sorted({s for m in files.names(f"{results}/{e}", dirs=True) for s in files.names(f"{results}/{e}/{m}", dirs=True)})
        out += [catalog.read_runs(spark, results, e, s).select(F.lit(e).alias("eval_id"), F.lit(s).alias("dataset"), "model", "id", "completion", "file") for s in sets]
    counts = (F.count(F.lit(1)).alias("lines"), F.countDistinct("id").alias("ids"), F.sum(F.length("completion")).alias("chars"), F.count_if(F.col("completion").isNull()).alias("nulls"))
    return _union(out).groupBy("eval_id", "dataset", "model").agg(*counts)


def jsonl_completions(spark: SparkSession, d: str) -> DataFrame:
    """Completions as JSON lines in folders by eval, read again from each folder."""
    folder = _folder(spark, "lines")
    catalog.write_completions(read_table(spark, d, "completions").select("eval_id", "id", "completion"), folder, by=("eval_id",))
    names = catalog.Files(spark, folder).names(folder, dirs=True)
    read = [catalog.read_jsonl(spark, f"{folder}/{n}").select(F.lit(n.split("=", 1)[1]).alias("eval_id"), "id", "completion") for n in names]
    return _union(read).groupBy("eval_id", "id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("completion")).alias("chars"))


def prompt_export(spark: SparkSession, d: str) -> DataFrame:
    """Prompts exported as JSON lines and read again."""
    path = _folder(spark, "prompts")
    catalog.export_prompts(_prompts(spark, d).where(F.col("prompt").isNotNull()).select("eval_id", "dataset", F.col("sid").alias("id"), "prompt"), path)
    read = spark.read.schema("eval_id string, dataset string, id string, prompt string").json(path)
    return read.select("eval_id", "dataset", "id", F.sha2("prompt", 256).alias("prompt_hash"))


def _constraints(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the instruction-following eval with four constraints each, which derive from the id."""
    lines = _lines(spark, d).where(F.col("eval_id") == "ifbench")
    n = F.length(F.coalesce("completion", F.lit("")))
    words = F.concat(F.lit('{"relation": "'), F.when(n % 2 == 0, "at least").otherwise("less than"), F.lit('", "num_words": '), (n % 40 + 5).cast("string"), F.lit("}"))
    often = F.concat(F.lit('{"relation": "at least", "keyword": "the", "frequency": '), (n % 4 + 1).cast("string"), F.lit("}"))
    args = F.concat(F.lit("[{}, "), words, F.lit(', {"keywords": ["the", "is"]}, '), often, F.lit("]"))
    ids = F.array(*map(F.lit, ("punctuation:no_comma", "length_constraints:number_words", "keywords:existence", "keywords:frequency")))
    return grade_instructions(lines.select("row_id", "model", F.col("id"), "completion", ids.alias("iids"), args.alias("args")), "completion", "iids", "args")


def instruction_flags(spark: SparkSession, d: str) -> DataFrame:
    """Strict and loose verdict of every constraint of every answer."""
    return _constraints(spark, d).select("row_id", F.explode("flags").alias("f")).select("row_id", F.col("f.id").alias("iid"), "f.strict", "f.loose")


def instruction_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracies of answers and of constraints, strict and loose, in total, by category and by instruction."""
    graded = cut(_constraints(spark, d))
    return SCORERS["ifbench"].metrics(graded, graded.select("id")).where(~F.col("metric").startswith("ifbench_"))


def math_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Methods and rates of the mathematics eval, without the rates per attempt."""
    graded = cut(SCORERS["math_500"].score(_sums(spark, d).withColumnRenamed("answer", "__stripped").withColumnRenamed("gold", "answer")))
    return SCORERS["math_500"].metrics(graded, graded.select("id")).where(~F.col("metric").contains("pass_at_1"))


def math_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Answers in ten spellings against gold answers whose equality is known from how both were made."""
    a, b, k = F.col("p_size"), F.col("p_partkey") % 7 + 2, F.col("p_partkey") % 10
    t = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    a_, b_ = a.cast("string"), b.cast("string")
    forms = [
        (t("\\frac{", a_, "}{", b_, "}"), t(a_, "/", b_)),
        (t("\\dfrac{", (2 * a).cast("string"), "}{", (2 * b).cast("string"), "}"), t(a_, "/", b_)),
        (t(a_, ",000"), t(a_, "000")),
        (t("\\sqrt{", (a * a * b).cast("string"), "}"), t(a_, "\\sqrt{", b_, "}")),
        (t("x + ", a_), t("x+", (a + 1).cast("string"))),
        (t("(", a_, ", ", b_, ")"), t("(", a_, ",", b_, "]")),
        (t("$", a_, "$ miles"), a_),
        (t("x = ", a_, " \\frac{1}{", b_, "}"), t((a * b + 1).cast("string"), "/", b_)),
        (t("(y+", a_, ")^2"), t("y^2+", (2 * a).cast("string"), "y+", (a * a).cast("string"))),
        (t(a_, ".5"), t((2 * a + 1).cast("string"), "/2")),
    ]
    pick = lambda i: reduce(lambda c, j: c.when(k == j, forms[j][i]), range(1, len(forms)), F.when(k == 0, forms[0][i]))
    return read_table(spark, d, "part").select("p_partkey", grade_answers(pick(0), pick(1)).alias("is_correct"))


def _json_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on answers to prompts for JSON, with their errors as an array; a model stands for the kind of entity."""
    errors = F.when(F.col("errors") == "", F.array().cast("array<string>")).otherwise(F.split("errors", ";"))
    found = struct_validate(spark, d).where("output_format = 'json'")
    return found.withColumns({"errors": errors, "entity_type": F.col("model")})


def struct_facets(spark: SparkSession, d: str) -> DataFrame:
    """The summary of answers to prompts for JSON: in total, by format, structure and entity."""
    return structured_summary(_json_verdicts(spark, d))


def struct_errors(spark: SparkSession, d: str) -> DataFrame:
    """How often each error occurs among answers to prompts for JSON."""
    return common_errors(_json_verdicts(spark, d))


def offending_ids(spark: SparkSession, d: str) -> DataFrame:
    """The message that names the first unknown ids and how many more there are."""
    unknown = unknown_ids(_lines(spark, d), _expected(spark, d), ["eval_id", "dataset", "id"])
    return spark.createDataFrame([(offenders(unknown.select("id").distinct(), "unknown ids"),)], "message string")


def skipped_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The first ten prompts of more than 40 words, which a model with a window of 41 isn't given."""
    words = _prompts(spark, d).withColumn("words", F.size(F.split("prompt", " ")))
    return skipped(words, ["eval_id", "dataset", "sid"], "prompt", "words", 41)


def token_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a set, each once and in order: the suppliers of every order."""
    ids = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("ids"))
    return ids.select("l_orderkey", F.array_join(allowed_tokens(F.col("ids")).cast("array<string>"), " ").alias("ids"))


def registered_subset(spark: SparkSession, d: str) -> DataFrame:
    """The registry's rows of named models (the first three names)."""
    registry = read_table(spark, d, "model_registry")
    names = [r[0] for r in registry.select("hf_id").orderBy("hf_id").limit(3).collect()]
    return catalog.pick_models(registry, names).select("hf_id", "mem", "base_shards")


def sparse_pass_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Pass vectors of a panel in which most results are missing: a missing one is no pass."""
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("model"), (F.col("o_orderstatus") == "F").alias("pass"))
    return panel.pass_matrix(o).select("sample_id", F.array_join(F.transform("pv", lambda x: x.cast("int").cast("string")), "").alias("pv"))


def filter_stages(spark: SparkSession, d: str) -> DataFrame:
    """Samples before and after each filter."""
    rows = panel.stage_counts(cut(panel.pass_matrix(_panel(spark, d))))
    return spark.createDataFrame([(r["stage"], r["before"], r["after"]) for r in rows], "stage string, before long, after long")


def max_drift(spark: SparkSession, d: str) -> DataFrame:
    return panel.max_deviation(subset_drift(spark, d))


def drift_summary(spark: SparkSession, d: str) -> DataFrame:
    """What cross-validation reports, of a fixed subset: mean and largest drift, tau, agreement of the best five."""
    held = cut(subset_drift(spark, d)).select(F.col("model").alias("model_index"), F.col("full_accuracy").alias("full"), F.col("subset_accuracy").alias("held"))
    found = panel.cv_summary(held)
    return spark.createDataFrame([tuple(float(found[k]) for k in sorted(found))], ", ".join(f"{k} double" for k in sorted(found)))


def fold_split(spark: SparkSession, d: str) -> DataFrame:
    """Every model of the panel with whether each fold trains on it: all but one fold do."""
    names = [r[0] for r in _panel(spark, d).select("model").distinct().orderBy("model").collect()]
    plan = panel.model_folds(len(names), 3)
    rows = [(n, sum(i not in fold for fold in plan), sum(i in fold for fold in plan)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "model string, trains long, tests long")


def subset_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a representative subset: its size, ids of the pool, no id twice, quotas kept, drift below a twentieth."""
    strata = cut(_strata(spark, d))
    chosen = cut(panel.representative_subset(strata, "grp", 40))
    quotas = panel.cell_quotas(panel.difficulty_bins(strata, "grp", "passes"), "grp", 40)
    filled = chosen.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))
    kept = quotas.join(filled, ["grp", "bin"], "left").where(F.coalesce("n", F.lit(0)) != F.col("quota")).count()
    tidy = _panel(spark, d).withColumn("sample_id", F.col("sample_id").cast("string"))
    drift = panel.max_deviation(panel.drift(tidy, chosen)).first()["max_deviation"]
    known = chosen.join(strata.select(F.col("sample_id").cast("string").alias("sample_id")), "sample_id", "left_semi").count()
    row = (chosen.count(), known, chosen.select("sample_id").distinct().count(), kept, drift < 0.05)
    return spark.createDataFrame([row], "samples long, in_pool long, distinct_samples long, quotas_missed long, small_drift boolean")


QUERIES = {
    f.__name__: f
    for f in (
        catalog_samples, catalog_prompts, catalog_listing, runs_written, jsonl_completions, prompt_export, instruction_flags, instruction_metrics, math_metrics, math_equivalence,
        struct_facets, struct_errors, offending_ids, skipped_prompts, token_ids, registered_subset, sparse_pass_vectors, filter_stages, max_drift, drift_summary, fold_split, subset_check,
    )
}

_SOURCE = f"""
p AS (SELECT DISTINCT eval_id, messages[-1].content AS prompt FROM samples WHERE messages[-1].content IS NOT NULL),
truth AS (SELECT *, sha256(prompt) AS h, length(prompt) AS n, chr(65 + CAST('0x' || left(sha256(prompt), 1) AS INT) % 4) AS letter FROM p),
ids AS (SELECT *, CASE WHEN eval_id = 'ifstruct' THEN left(sha256(prompt || '|{{"type":"object"}}|items|[1, 2]|' || CASE WHEN n % 2 = 0 THEN 'True' ELSE 'False' END || '|False|True|json|'
    || CASE WHEN n % 2 = 0 THEN 'town' ELSE 'river' END), 12) ELSE left(h, 12) END AS sid FROM truth),
attempts AS (SELECT *, sid || '#' || k AS id FROM ids CROSS JOIN (SELECT unnest(range({REPEATS})) AS k))"""
_VARIANTS = f"""
texts AS (SELECT row_id, answer AS x, length(coalesce(completion, '')) AS n FROM ({_ANSWERS}) WHERE eval_id = 'ifbench'),
cuts AS (
  SELECT row_id, n, x, CASE WHEN contains(x, chr(10)) THEN {_STRIP.format(c="substr(x, strpos(x, chr(10)) + 1)")} ELSE '' END AS no_first,
    CASE WHEN contains(x, chr(10)) THEN {_STRIP.format(c="regexp_replace(x, chr(10) || '[^' || chr(10) || ']*$', '')")} ELSE '' END AS no_last,
    CASE WHEN len(string_split(x, chr(10))) > 2 THEN {_STRIP.format(c="array_to_string(string_split(x, chr(10))[2:-2], chr(10))")} ELSE '' END AS neither FROM texts),
shown AS (SELECT row_id, n, true AS whole, x AS v FROM cuts UNION ALL SELECT row_id, n, false, unnest([x, no_first, no_last, neither, replace(x, '*', ''), replace(no_first, '*', ''), replace(no_last, '*', ''), replace(neither, '*', '')]) FROM cuts),
counted AS (SELECT *, len(regexp_extract_all(v, '[\\pL\\pN_]+')) AS words, (length(v) - length(replace(lower(v), 'the', ''))) // 3 AS the FROM shown WHERE v IS NOT NULL AND {_STRIP.format(c='v')} <> ''),
checked AS (
  SELECT row_id, whole, unnest(['punctuation:no_comma', 'length_constraints:number_words', 'keywords:existence', 'keywords:frequency']) AS iid,
    unnest([NOT contains(v, ','), CASE WHEN n % 2 = 0 THEN words >= n % 40 + 5 ELSE words < n % 40 + 5 END, contains(lower(v), 'the') AND contains(lower(v), 'is'), the >= n % 4 + 1]) AS ok FROM counted),
flags AS (SELECT t.row_id, i.iid, coalesce(bool_or(c.ok) FILTER (c.whole), false) AS strict, coalesce(bool_or(c.ok), false) AS loose
  FROM texts t CROSS JOIN (SELECT unnest(['punctuation:no_comma', 'length_constraints:number_words', 'keywords:existence', 'keywords:frequency']) AS iid) i
  LEFT JOIN checked c ON c.row_id = t.row_id AND c.iid = i.iid GROUP BY ALL)"""
_ORDERS = "SELECT o_custkey AS sample_id, o_orderpriority AS model, max(o_orderstatus = 'F') AS pass FROM orders GROUP BY ALL"

ORACLES = {
    "catalog_samples": f"""WITH {_SOURCE} SELECT eval_id, id, CASE eval_id WHEN 'gpqa_diamond' THEN letter WHEN 'math_500' THEN CAST(n AS VARCHAR) END AS answer, n AS chars,
        CASE eval_id WHEN 'gpqa_diamond' THEN letter WHEN 'math_500' THEN 'all' WHEN 'ifstruct' THEN CASE WHEN n % 2 = 0 THEN 'town' ELSE 'river' END
          ELSE CAST(CASE WHEN n % 3 = 0 THEN 2 ELSE n % 3 END AS VARCHAR) END AS grp FROM attempts""",
    "catalog_prompts": f"WITH {_SOURCE} SELECT eval_id, id, 'user' AS role, n AS chars FROM attempts",
    "catalog_listing": f"""WITH {_SOURCE}, lines AS (SELECT eval_id, CASE eval_id WHEN 'gpqa_diamond' THEN prompt || chr(31) || ' ' || lower(letter) WHEN 'math_500' THEN prompt || chr(31) || n END AS line FROM truth)
        SELECT eval_id, 'all' AS datasets, count(*) AS num_samples, {REPEATS}::BIGINT AS repeats,
          CASE WHEN eval_id IN ('gpqa_diamond', 'math_500') THEN sha256(string_agg(line, chr(10) ORDER BY encode(line))) END AS content_sha256 FROM lines GROUP BY eval_id""",
    "runs_written": """SELECT eval_id, dataset, replace(model, '--', '/') AS model, count(*) AS lines, count(DISTINCT id) AS ids, CAST(sum(length(completion)) AS BIGINT) AS chars,
        count(*) - count(completion) AS nulls FROM completions GROUP BY ALL""",
    "jsonl_completions": "SELECT eval_id, id, count(*) AS lines, CAST(sum(length(completion)) AS BIGINT) AS chars FROM completions GROUP BY ALL",
    "prompt_export": f"SELECT DISTINCT eval_id, dataset, {_NORM.format(c='id')} AS id, sha256(messages[-1].content) AS prompt_hash FROM samples WHERE messages[-1].content IS NOT NULL",
    "instruction_flags": f"WITH {_VARIANTS} SELECT row_id, iid, strict, loose FROM flags",
    "instruction_metrics": f"""WITH {_VARIANTS}, k AS (SELECT *, split_part(iid, ':', 1) AS cat FROM flags), per AS (SELECT row_id, bool_and(strict) AS s, bool_and(loose) AS l FROM k GROUP BY row_id)
        SELECT 'strict_prompt_accuracy' AS metric, avg(s::INT)::DOUBLE AS value FROM per UNION ALL SELECT 'loose_prompt_accuracy', avg(l::INT) FROM per
        UNION ALL SELECT 'strict_instruction_accuracy', avg(strict::INT) FROM k UNION ALL SELECT 'loose_instruction_accuracy', avg(loose::INT) FROM k
        UNION ALL SELECT 'strict/' || iid, avg(strict::INT) FROM k GROUP BY iid UNION ALL SELECT 'loose/' || iid, avg(loose::INT) FROM k GROUP BY iid
        UNION ALL SELECT 'strict/' || cat, avg(strict::INT) FROM k GROUP BY cat UNION ALL SELECT 'loose/' || cat, avg(loose::INT) FROM k GROUP BY cat""",
    "math_metrics": f"""{_SUMS} SELECT 'math_500_method/' || d.method AS metric, count(g.method)::DOUBLE AS value FROM (SELECT unnest(['prm800k', 'robust_boxed', 'no_match', 'failed']) AS method) d
        LEFT JOIN graded g ON g.method = d.method GROUP BY ALL
        UNION ALL SELECT 'math_500_unparsed_rate', coalesce(avg((method IN ('no_match', 'failed'))::INT), 0.0) FROM graded UNION ALL SELECT 'math_500_failed_rate', coalesce(avg((method = 'failed')::INT), 0.0) FROM graded""",
    "math_equivalence": "SELECT p_partkey, p_partkey % 10 IN (0, 2, 3, 6, 7, 8, 9) AS is_correct FROM part",
    "struct_facets": f"""{_STRUCT}, facets AS (SELECT len(errors) = 0 AS ok, unnest(['all', 'by_format', 'by_top_level_structure', 'by_entity_type']) AS facet,
          unnest(['', 'json', CASE WHEN wrap THEN 'wrapped' ELSE 'list' END, model]) AS value FROM y)
        SELECT facet, value, CAST(sum(ok::INT) AS BIGINT) AS passed, count(*) AS total, sum(ok::INT) / count(*)::DOUBLE AS pass_rate FROM facets GROUP BY ALL""",
    "struct_errors": f"{_STRUCT} SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM y) GROUP BY ALL",
    "offending_ids": f"""WITH {_EXPECTED}, u AS (SELECT DISTINCT id FROM ({_LINES}) l ANTI JOIN expected USING (eval_id, dataset, id)),
        f AS (SELECT string_agg(id, ', ' ORDER BY encode(id)) AS first FROM (SELECT id FROM u ORDER BY encode(id) LIMIT 10)), n AS (SELECT count(*) AS n FROM u)
        SELECT 'unknown ids: ' || first || CASE WHEN n > 10 THEN ' (and ' || (n - 10) || ' more)' ELSE '' END AS message FROM f, n""",
    "skipped_prompts": f"""WITH p AS ({_PROMPTS}), s AS (SELECT *, len(string_split(prompt, ' ')) AS tokens FROM p WHERE prompt IS NULL OR len(string_split(prompt, ' ')) > 40)
        SELECT eval_id, dataset, sid, tokens, (SELECT count(*) FROM s) AS skipped FROM s ORDER BY eval_id, dataset, sid LIMIT 10""",
    "token_ids": "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ' ' ORDER BY l_suppkey) AS ids FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY ALL",
    "registered_subset": "SELECT hf_id, mem, base_shards FROM model_registry ORDER BY hf_id LIMIT 3",
    "sparse_pass_vectors": f"""WITH o AS ({_ORDERS}), every AS (SELECT * FROM (SELECT DISTINCT sample_id FROM o) CROSS JOIN (SELECT DISTINCT model FROM o))
        SELECT e.sample_id, string_agg(CASE WHEN o.pass THEN '1' ELSE '0' END, '' ORDER BY e.model) AS pv FROM every e LEFT JOIN o USING (sample_id, model) GROUP BY ALL""",
    "filter_stages": f"""WITH v AS ({_VECTORS}), u AS (SELECT * FROM v WHERE contains(pv, '0') AND contains(pv, '1'))
        SELECT 'not-unanimous' AS stage, (SELECT count(*) FROM v) AS before, (SELECT count(*) FROM u) AS after
        UNION ALL SELECT 'distinct-behavior', (SELECT count(*) FROM u), (SELECT count(DISTINCT pv) FROM u)""",
    "max_drift": f"WITH d AS ({_DRIFT}) SELECT max(deviation) AS max_deviation, avg(deviation) AS mean_deviation FROM d",
    "drift_summary": f"""WITH d AS ({_DRIFT}), n AS (SELECT least(5, count(*)) AS n FROM d)
        SELECT max(deviation) AS max_deviation, avg(deviation) AS mean_deviation,
          (SELECT sum(sign((a.full_accuracy - b.full_accuracy) * (a.subset_accuracy - b.subset_accuracy))) / CAST(count(*) AS DOUBLE) FROM d a JOIN d b ON a.model < b.model) AS kendall_tau,
          (SELECT count(*) / 5.0 FROM (SELECT model FROM d ORDER BY full_accuracy DESC, model LIMIT 5) SEMI JOIN (SELECT model FROM d ORDER BY subset_accuracy DESC, model LIMIT 5) USING (model)) AS top5_agreement FROM d""",
    "fold_split": f"SELECT DISTINCT model, 2::BIGINT AS trains, 1::BIGINT AS tests FROM ({_PANEL})",
    "subset_check": "SELECT n AS samples, n AS in_pool, n AS distinct_samples, 0::BIGINT AS quotas_missed, true AS small_drift FROM (SELECT least(40, count(DISTINCT user_id)) AS n FROM events)",
}
