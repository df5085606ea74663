"""The catalogue of versioned data sets, and reading and writing of samples and completions.

Layout: `<root>/datasets/<eval>/<dataset>/` with one Parquet or JSON-lines file or folder per split and
`metadata.json`. Listing and metadata are driver work on a handful of files through Hadoop's file
system, so any store that Spark reads will do; rows are only ever read by Spark.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalanvil.functions.fingerprint import canonical_json, content_fingerprint, line_of, structured_ids
from evalanvil.functions.keys import py_strip, short_hash
from evalanvil.functions.text import user_message
from evalanvil.operators.attempts import expand
from evalanvil.sources.schemas import COMPLETIONS, EVALS, GENERATION, PAYLOAD

ROOT_VARIABLE = "EVALANVIL_DATA_DIR"


class Files:
    """Listing and small files through Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.spark, self._path = spark, jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def is_dir(self, path: str) -> bool:
        return self.exists(path) and self.fs.getFileStatus(self._path(path)).isDirectory()

    def names(self, path: str, dirs: bool | None = None) -> list[str]:
        """Sorted names in a folder; only folders or only files if `dirs` says so; none if it doesn't exist."""
        if not self.exists(path):
            return []
        found = self.fs.listStatus(self._path(path))
        return sorted(s.getPath().getName() for s in found if dirs is None or s.isDirectory() == dirs)

    def read(self, path: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(path, wholetext=True).collect())

    def move(self, path: str, to: str) -> None:
        """Renames a file or folder; the folder above its new name is made."""
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(path), self._path(to)):
            raise OSError(f"{path} can't be moved to {to}")

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()


def root_dir(root: str | None = None) -> str:
    """The catalogue's root: the argument, else the environment, else the working folder."""
    return root or os.environ.get(ROOT_VARIABLE) or os.getcwd()


def dataset_dir(eval_id: str, dataset: str, root: str | None = None) -> str:
    if eval_id not in EVALS:
        raise KeyError(f"unknown eval {eval_id!r}")
    return f"{root_dir(root)}/datasets/{eval_id}/{dataset}"


def list_datasets(spark: SparkSession, eval_id: str, root: str | None = None) -> list[str]:
    """Sorted data set names of an eval; none if it has no folder."""
    folder = f"{root_dir(root)}/datasets/{eval_id}"
    return Files(spark, folder).names(folder, dirs=True)


def list_evals(spark: SparkSession, root: str | None = None) -> DataFrame:
    """(eval_id, datasets): the names joined by commas, or (none)."""
    rows = [(e, ", ".join(list_datasets(spark, e, root)) or "(none)") for e in sorted(EVALS)]
    return spark.createDataFrame(rows, "eval_id string, datasets string")


def read_metadata(spark: SparkSession, folder: str, needed: bool = False) -> dict:
    """metadata.json of a data set; {} if it is absent and not needed."""
    files = Files(spark, folder)
    path = f"{folder}/metadata.json"
    if not files.exists(path):
        if needed:
            raise FileNotFoundError(path)
        return {}
    return json.loads(files.read(path))


def repeats_of(metadata: dict) -> int:
    """`repeats` of a data set, 1 unless it says otherwise; anything but a positive integer raises."""
    n = metadata.get("repeats", 1)
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"repeats must be a positive integer, not {n!r}")
    return n


def stored_rows(spark: SparkSession, eval_id: str, dataset: str, split: str | None = None, root: str | None = None) -> DataFrame:
    """The rows of a split as they are stored, all columns; a missing file raises before any plan is built."""
    primary, form, schema = EVALS[eval_id]
    folder = dataset_dir(eval_id, dataset, root)
    path = f"{folder}/{split or primary}.{'jsonl' if form == 'json' else form}"
    if not Files(spark, folder).exists(path):
        raise FileNotFoundError(f"{path} is missing; write the data set with save_rows, or set {ROOT_VARIABLE} to where it lies")
    if form == "json":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.parquet(path)


def read_rows(spark: SparkSession, eval_id: str, dataset: str, split: str | None = None, root: str | None = None) -> DataFrame:
    """The rows of a split with the columns of its eval."""
    return as_rows(eval_id, stored_rows(spark, eval_id, dataset, split, root))


def as_rows(eval_id: str, stored: DataFrame) -> DataFrame:
    """Stored rows with the columns of their eval; nested arguments become JSON text."""
    if EVALS[eval_id][1] == "json":
        return stored
    if eval_id == "ifbench":
        kwargs = F.col("kwargs") if dict(stored.dtypes)["kwargs"] == "string" else F.to_json("kwargs")
        n = F.col("n_constraints").cast("long") if "n_constraints" in stored.columns else F.lit(None).cast("long")
        return stored.select(F.col("key").cast("string").alias("key"), "instruction_id_list", "prompt", kwargs.alias("kwargs"), n.alias("n_constraints"))
    return stored.select("prompt", F.col("answer").cast("string").alias("answer"))


def dataset_fingerprint(eval_id: str, stored: DataFrame) -> str | None:
    """The order-insensitive content hash of a data set's stored rows; None where an eval has none.

    Questions with an answer are hashed field by field, nested rows as JSON with sorted keys, every
    stored column and null among them.
    """
    if eval_id in ("gpqa_diamond", "math_500"):
        return content_fingerprint(stored, line_of(F.col("prompt"), F.col("answer").cast("string")))
    if eval_id == "ifbench":
        return content_fingerprint(stored, canonical_json(F.to_json(F.struct(*stored.columns), {"ignoreNullFields": "false"})))
    return None


def checked_rows(spark: SparkSession, eval_id: str, dataset: str, root: str | None = None) -> tuple[DataFrame, dict]:
    """Rows and metadata, after the content hash was checked if metadata has one."""
    stored = stored_rows(spark, eval_id, dataset, None, root)
    rows = as_rows(eval_id, stored)
    meta = read_metadata(spark, dataset_dir(eval_id, dataset, root), needed=eval_id in ("gpqa_diamond", "math_500"))
    wanted = meta.get("content_sha256")
    if wanted:
        actual = dataset_fingerprint(eval_id, stored)
        if actual is not None and actual != wanted:
            raise ValueError(f"integrity check failed for {eval_id}/{dataset}: {actual} is not {wanted}")
    return rows, meta


def _sample_id(eval_id: str) -> Column:
    if eval_id != "ifstruct":
        return short_hash(F.col("prompt"))
    parts = {c: F.col(c) for c in ("prompt", "top_level_key", "require_wrapper_key", "require_code_block", "require_no_commentary", "output_format", "entity_type")}
    raw = F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())), {"ignoreNullFields": "false"})
    # free-form values are already JSON text: they are put in as they are
    extra = F.concat(F.lit(', "json_schema": '), F.coalesce("json_schema", F.lit("null")), F.lit(', "top_level_count": '), F.coalesce("top_level_count", F.lit("null")), F.lit("}"))
    return structured_ids(F.concat(F.regexp_replace(raw, r"\}\z", ""), extra))


def load_samples(spark: SparkSession, eval_id: str, dataset: str, root: str | None = None) -> DataFrame:
    """Ground truth: id (one per attempt), prompt and the eval's own columns."""
    rows, meta = checked_rows(spark, eval_id, dataset, root)
    out = rows.withColumn("id", _sample_id(eval_id))
    if eval_id == "gpqa_diamond":
        answer = F.upper(py_strip(F.col("answer")))
        bad = ~F.coalesce(answer.isin("A", "B", "C", "D"), F.lit(False))
        out = out.withColumn("answer", F.when(bad, F.raise_error(F.concat(F.lit("not an option: "), F.coalesce("answer", F.lit("null"))))).otherwise(answer))
    if eval_id == "ifbench":
        n = F.when(F.coalesce("n_constraints", F.lit(0)) == 0, F.size("instruction_id_list")).otherwise(F.col("n_constraints"))
        out = out.withColumn("n_constraints", n.cast("int"))
    if eval_id == "ifstruct":
        names = ("json_schema", "top_level_count")
        plain = F.regexp_replace(F.to_json(F.struct("top_level_key", "require_wrapper_key", "require_code_block", "require_no_commentary", "output_format")), r"\}\z", "")
        more = [F.concat(F.lit(f', "{k}": '), F.coalesce(k, F.lit("null"))) for k in names]
        sep = F.when(plain == "{", F.regexp_replace(F.concat(*more), r"\A, ", "")).otherwise(F.concat(*more))
        out = out.withColumn("spec", F.concat(plain, sep, F.lit("}")))
    return expand(out, repeats_of(meta))


def load_prompts(spark: SparkSession, eval_id: str, dataset: str, root: str | None = None) -> DataFrame:
    """The public view: id and messages, with the same ids as load_samples."""
    rows, meta = checked_rows(spark, eval_id, dataset, root)
    return expand(rows.select(_sample_id(eval_id).alias("id"), user_message(F.col("prompt")).alias("messages")), repeats_of(meta))


def save_rows(rows: DataFrame, eval_id: str, dataset: str, split: str | None = None, root: str | None = None, metadata: dict | None = None, files: int | None = None) -> str:
    """Writes a split (a folder of Parquet or JSON lines, `files` of them if given) and its metadata.

    `repeats` and the content hash are always carried forward, so derived data sets stay checked.
    """
    spark = rows.sparkSession
    primary, form, _ = EVALS[eval_id]
    folder = dataset_dir(eval_id, dataset, root)
    out = rows.coalesce(files) if files else rows
    path = f"{folder}/{split or primary}.{'jsonl' if form == 'json' else form}"
    getattr(out.write.mode("overwrite"), form)(path)
    if metadata is not None:
        meta = {"repeats": 1, **metadata, "eval_id": eval_id, "dataset": dataset, "num_samples": rows.count()}
        print_hash = dataset_fingerprint(eval_id, stored_rows(spark, eval_id, dataset, split, root))
        if print_hash:
            meta["content_sha256"] = print_hash
        Files(spark, folder).write(f"{folder}/metadata.json", json.dumps(meta, indent=2))
    return path


def read_upstream_instructions(spark: SparkSession, path: str) -> DataFrame:
    """Published instruction rows (JSON lines), reduced to the four stored columns."""
    schema = "key string, instruction_id_list array<string>, prompt string, kwargs array<map<string,string>>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select("key", "instruction_id_list", "prompt", F.to_json("kwargs").alias("kwargs"))


def ingest_initial(spark: SparkSession, eval_id: str, path: str, dataset: str, root: str | None = None) -> str:
    """Lands a first data set from JSON lines; only structured-output data sets begin like this."""
    if eval_id != "ifstruct":
        raise NotImplementedError(f"{eval_id} has no initial data set of this form")
    _, form, schema = EVALS[eval_id]
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return save_rows(rows, eval_id, dataset, None, root, {"source_dataset": "original"})


# ---- completions -------------------------------------------------------------------------------------


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, completion, file) of JSON lines; blank lines are skipped, other keys ignored, broken lines raise."""
    shard = F.col("_metadata.file_name").alias("file")
    return spark.read.schema(COMPLETIONS).option("mode", "FAILFAST").json(list(paths)).select("id", "completion", shard)


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """(id, completion, file) of a `{"completions": [...]}` document."""
    c = F.explode("completions").alias("c")
    return spark.read.schema(PAYLOAD).option("multiLine", True).option("mode", "FAILFAST").json(path).select(c, F.col("_metadata.file_name").alias("file")).select("c.*", "file")


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    """A .json file is a payload, another file JSON lines, a folder its payload.json or else all its *.jsonl."""
    files = Files(spark, path)
    if not files.exists(path):
        raise FileNotFoundError(path)
    if not files.is_dir(path):
        return read_payload(spark, path) if path.endswith(".json") else read_jsonl(spark, path)
    names = files.names(path)
    if "payload.json" in names:
        return read_payload(spark, f"{path}/payload.json")
    shards = [f"{path}/{n}" for n in names if n.endswith(".jsonl")]
    return read_jsonl(spark, *shards) if shards else spark.createDataFrame([], COMPLETIONS + ", file string")


def _shards(names: list[str]) -> list[str]:
    return [n for n in names if n.startswith("completions.shard") and n.endswith(".jsonl")]


def read_run(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame | None:
    """A run's completions: the merged file or the shards. Both together raise if strict, else shards win; None if neither."""
    names = Files(spark, folder).names(folder)
    shards, merged = _shards(names), "completions.jsonl" in names
    if strict and shards and merged:
        raise RuntimeError(f"{folder} has both a merged file and shards")
    if not shards and not merged:
        return None
    return read_jsonl(spark, *(f"{folder}/{n}" for n in (shards or ["completions.jsonl"])))


def list_runs(spark: SparkSession, results: str, eval_id: str, dataset: str, needed: bool = True) -> list[str]:
    """Sorted model folders below `<results>/<eval>` that have the data set."""
    folder = f"{results}/{eval_id}"
    files = Files(spark, results)
    if not files.exists(folder):
        raise FileNotFoundError(folder)
    found = [m for m in files.names(folder, dirs=True) if files.exists(f"{folder}/{m}/{dataset}")]
    if needed and not found:
        raise FileNotFoundError(f"no model in {folder} has {dataset}")
    return found


def read_runs(spark: SparkSession, results: str, eval_id: str, dataset: str) -> DataFrame:
    """(model, id, completion, file) of all models' runs, in one scan: the model comes from the path."""
    folder = f"{results}/{eval_id}"
    paths = []
    for m in list_runs(spark, results, eval_id, dataset):
        names = Files(spark, folder).names(f"{folder}/{m}/{dataset}")
        shards, merged = _shards(names), "completions.jsonl" in names
        if shards and merged:
            raise RuntimeError(f"{m} has both a merged file and shards")
        paths += [f"{folder}/{m}/{dataset}/{n}" for n in (shards or ["completions.jsonl"] * merged)]
    if not paths:
        return spark.createDataFrame([], "model string, id string, completion string, file string")
    # a shard is a file or a folder of files
    model = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+/completions[^/]*(?:/[^/]*)?\z", 1)
    return spark.read.schema(COMPLETIONS).option("mode", "FAILFAST").json(paths).select(
        F.replace(F.url_decode(model), F.lit("--"), F.lit("/")).alias("model"), "id", "completion", F.col("_metadata.file_name").alias("file")
    )


def write_completions(completions: DataFrame, folder: str, by: tuple[str, ...] = ("model", "shard")) -> None:
    """JSON lines in folders by model and shard."""
    completions.write.mode("append").partitionBy(*by).json(folder)


def write_runs(completions: DataFrame, results: str) -> int:
    """Lays (eval_id, model, dataset, shard, id, completion) out as runs and returns the number of shards.

    `<results>/<eval>/<model>/<dataset>/completions.shard<k>.jsonl`, each a folder of JSON lines. One
    job writes all; moving the folders to their names touches metadata only. A null shard is shard 0.
    """
    parts = ["eval_id", "model", "dataset", "shard"]
    raw = f"{results}/_unsorted"
    slug = F.replace("model", F.lit("/"), F.lit("--"))
    out = completions.select("eval_id", slug.alias("model"), "dataset", F.coalesce("shard", F.lit(0)).alias("shard"), "id", "completion")
    out.repartition(*parts).write.partitionBy(*parts).json(raw)
    files, n = Files(out.sparkSession, results), 0

    def leaves(folder: str, depth: int) -> list[str]:
        found = [f"{folder}/{x}" for x in files.names(folder, dirs=True)]
        return found if depth == 1 else [y for x in found for y in leaves(x, depth - 1)]

    for leaf in leaves(raw, len(parts)):
        eval_id, model, dataset, shard = (x.split("=", 1)[1] for x in leaf.split("/")[-len(parts) :])
        files.move(leaf, f"{results}/{eval_id}/{model}/{dataset}/completions.shard{shard}.jsonl")
        n += 1
    files.fs.delete(files._path(raw), True)
    return n


def export_prompts(prompts: DataFrame, path: str, limit: int = 0, order: str | None = None) -> None:
    """Prompts as JSON lines; the first `limit` of them if it isn't 0, in the data set's own order or by a column."""
    if limit:
        prompts = (prompts.orderBy(order) if order else in_order(prompts)).limit(limit)
    out = prompts
    out.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of a scan in the order in which they are stored (file by file, row by row)."""
    return rows.withColumn("__at", F.monotonically_increasing_id()).orderBy("__at").drop("__at")


def generation_specs(spark: SparkSession) -> DataFrame:
    """What is generated per eval; nulls are left out where this is written as JSON."""
    rows = [(e, g["max_tokens"], g["temperature"], g["mcq_choices"]) for e, g in sorted(GENERATION.items())]
    return spark.createDataFrame(rows, "eval_id string, max_tokens int, temperature double, mcq_choices array<string>")


def generation_spec(eval_id: str) -> dict:
    """An eval's generation parameters without those that are not set."""
    return {k: v for k, v in GENERATION[eval_id].items() if v is not None}


def shards_needed(dataset: Column, base_shards: Column) -> Column:
    """Shards of a generation job: the model's own number for the default data set, else one."""
    return F.when(dataset != "default", F.lit(1)).otherwise(base_shards)


def pick_models(registry: DataFrame, names: list[str], key: str = "hf_id") -> DataFrame:
    """The named models; an unknown name raises."""
    wanted = registry.sparkSession.createDataFrame([(n,) for n in names], f"`{key}` string")
    unknown = [r[0] for r in wanted.join(registry, key, "left_anti").orderBy(key).collect()]
    if unknown:
        raise KeyError(f"not registered: {', '.join(unknown)}")
    return registry.join(wanted, key, "left_semi")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of several frames by column name."""
    return reduce(DataFrame.unionByName, frames)
