from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from evalanvil.__main__ import main
from evalanvil.functions import fingerprint
from evalanvil.functions.keys import short_hash
from evalanvil.plans import api
from evalanvil.sources import catalog


@pytest.fixture()
def root(spark, tmp_path):
    r = str(tmp_path)
    gpqa = spark.createDataFrame([("Which? A) x B) y", " b"), ("Who?", "D")], "prompt string, answer string")
    catalog.save_rows(gpqa, "gpqa_diamond", "default", None, r, {"repeats": 2})
    catalog.save_rows(gpqa.withColumn("answer", F.lit("4")), "math_500", "default", None, r, {})
    inst = spark.createDataFrame(
        [("1", ["punctuation:no_comma"], "Write.", "[{}]", 0), ("2", ["punctuation:no_comma"], "Speak.", "[{}]", 3)],
        "key string, instruction_id_list array<string>, prompt string, kwargs string, n_constraints long",
    )
    catalog.save_rows(inst, "ifbench", "default", None, r, {})
    struct = [(1, "person", "List.", '{"type": "object"}', "[1, 2]", None, False, False, False, "json"), (2, "town", "List!", '{"type": "object"}', None, "items", True, False, True, "json")]
    schema = "seed long, entity_type string, prompt string, json_schema string, top_level_count string, top_level_key string, require_wrapper_key boolean, require_code_block boolean, require_no_commentary boolean, output_format string"
    catalog.save_rows(spark.createDataFrame(struct, schema), "ifstruct", "v1", None, r, {})
    return r


def test_listing(spark, root):
    os.makedirs(f"{root}/datasets/math_500/a-first")
    assert catalog.list_datasets(spark, "math_500", root) == ["a-first", "default"] and catalog.list_datasets(spark, "math_500", root + "/no") == []
    listed = {r["eval_id"]: r["datasets"] for r in catalog.list_evals(spark, root).collect()}
    assert listed["ifstruct"] == "v1" and {r["datasets"] for r in catalog.list_evals(spark, root + "/no").collect()} == {"(none)"}


@pytest.mark.parametrize(("eval_id", "dataset", "n"), [("gpqa_diamond", "default", 4), ("math_500", "default", 2), ("ifbench", "default", 2), ("ifstruct", "v1", 2)])
def test_views_share_ids(spark, root, eval_id, dataset, n):
    truth = sorted(r["id"] for r in catalog.load_samples(spark, eval_id, dataset, root).collect())
    assert truth == sorted(r["id"] for r in catalog.load_prompts(spark, eval_id, dataset, root).collect()) and len(truth) == len(set(truth)) == n


def test_columns(spark, root):
    gpqa = {r["id"]: r["answer"] for r in catalog.load_samples(spark, "gpqa_diamond", "default", root).collect()}
    assert sorted(gpqa.values()) == ["B", "B", "D", "D"] and all("#" in k for k in gpqa)
    assert {r["key"]: r["n_constraints"] for r in catalog.load_samples(spark, "ifbench", "default", root).collect()} == {"1": 1, "2": 3}
    spec = {r["entity_type"]: json.loads(r["spec"]) for r in catalog.load_samples(spark, "ifstruct", "v1", root).collect()}
    assert spec["person"]["top_level_count"] == [1, 2] and spec["town"]["top_level_key"] == "items" and spec["town"]["top_level_count"] is None


def test_structured_id(spark, root):
    row = catalog.read_rows(spark, "ifstruct", "v1", None, root).where("seed = 1").first()
    want = fingerprint.structured_id("List.", {"type": "object"}, None, [1, 2], (False, False, False), "json", "person")
    assert want in {r["id"] for r in catalog.load_samples(spark, "ifstruct", "v1", root).collect()} and row["prompt"] == "List."


def test_integrity(spark, root):
    folder = f"{root}/datasets/math_500/default"
    meta = json.loads(open(f"{folder}/metadata.json").read())
    rows = catalog.read_rows(spark, "math_500", "default", None, root)
    assert meta["content_sha256"] == catalog.dataset_fingerprint("math_500", rows.repartition(3).orderBy(F.desc("prompt"))) and meta["num_samples"] == 2
    one = fingerprint.content_fingerprints(rows.withColumn("k", F.lit(1)), ["k"], fingerprint.line_of(F.col("prompt"), F.col("answer"))).first()
    assert one["content_sha256"] == meta["content_sha256"]
    with open(f"{folder}/metadata.json", "w") as f:
        f.write(json.dumps({**meta, "content_sha256": "0"}))
    if os.path.exists(f"{folder}/.metadata.json.crc"):
        os.remove(f"{folder}/.metadata.json.crc")
    with pytest.raises(ValueError, match="integrity"):
        catalog.load_samples(spark, "math_500", "default", root)
    with pytest.raises(FileNotFoundError):
        catalog.load_samples(spark, "math_500", "absent", root)
    with pytest.raises(ValueError):
        catalog.repeats_of({"repeats": 0})
    with pytest.raises(KeyError):
        catalog.dataset_dir("nothing", "x", root)


def test_completions(spark, tmp_path):
    d = str(tmp_path)
    line = lambda i, t: json.dumps({"id": i, "completion": t, "extra": 1}) + "\n"
    os.makedirs(f"{d}/run")
    open(f"{d}/run/completions.shard0.jsonl", "w").write(line("a", "x") + "\n" + line("b", None))
    open(f"{d}/run/completions.shard1.jsonl", "w").write(line("c", "z"))
    open(f"{d}/payload.json", "w").write(json.dumps({"completions": [{"id": "p", "completion": "q"}]}))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(catalog.read_completions(spark, f"{d}/run")) == ["a", "b", "c"] and ids(catalog.read_completions(spark, f"{d}/payload.json")) == ["p"]
    assert ids(catalog.read_completions(spark, f"{d}/run/completions.shard1.jsonl")) == ["c"] and ids(catalog.read_completions(spark, d)) == ["p"]
    assert ids(catalog.read_run(spark, f"{d}/run")) == ["a", "b", "c"] and catalog.read_run(spark, d) is None
    open(f"{d}/run/completions.jsonl", "w").write(line("m", "m"))
    with pytest.raises(RuntimeError):
        catalog.read_run(spark, f"{d}/run")
    assert ids(catalog.read_run(spark, f"{d}/run", strict=False)) == ["a", "b", "c"]
    with pytest.raises(FileNotFoundError):
        catalog.read_completions(spark, f"{d}/absent")
    out = spark.createDataFrame([("m/x", 0, "a", "t"), ("m/x", 1, "b", None)], "model string, shard int, id string, completion string")
    catalog.write_completions(out.withColumn("model", F.replace("model", F.lit("/"), F.lit("--"))), f"{d}/out")
    assert sorted(os.listdir(f"{d}/out/model=m--x"))[:2] == ["shard=0", "shard=1"]


def test_score_and_verify(spark, root, capsys):
    ids = [r["id"] for r in catalog.load_samples(spark, "gpqa_diamond", "default", root).orderBy("id").collect()]
    done = spark.createDataFrame([(i, "Answer: B") for i in ids], "id string, completion string")
    scored, metrics = api.score_completions(spark, "gpqa_diamond", "default", done, root)
    assert scored.columns == ["id", "messages", "completion", "is_correct"] and scored.where("is_correct").count() == 2
    assert {r["metric"]: r["value"] for r in metrics.collect()}["gpqa_diamond_pass_at_1"] == 0.5
    rows = [(r["section"], json.loads(r["entry"])) for r in api.report("gpqa_diamond", "default", scored, metrics).collect()]
    assert [e["accuracy"] for s, e in rows if s == "summary"] == [0.5] and sum(s == "scores" for s, _ in rows) == 4
    document = json.loads("".join(api.report_document("gpqa_diamond", "default", scored, metrics)))
    assert document["accuracy"] == 0.5 and document["context"]["gpqa_diamond_pass_at_1"] == 0.5 and [x["id"] for x in document["scores"]] == ids
    with pytest.raises(api.Rejected, match="duplicate"):
        api.score_completions(spark, "gpqa_diamond", "default", done.union(done), root)
    with pytest.raises(api.Rejected, match="not in dataset: zzz"):
        api.score_completions(spark, "gpqa_diamond", "default", spark.createDataFrame([("zzz", "A")], "id string, completion string"), root)
    with pytest.raises(api.NotFound):
        api.samples(spark, "nothing", "x", root)
    with pytest.raises(api.NotFound):
        api.samples(spark, "math_500", "absent", root)
    for model, text, some in (("org--one", "Answer: B", ids), ("org--two", "Answer: D", ids[:3]), ("org--three", "x", [])):
        folder = f"{root}/results/gpqa_diamond/{model}/default"
        os.makedirs(folder)
        if some:
            open(f"{folder}/completions.shard0.jsonl", "w").write("".join(json.dumps({"id": i, "completion": text}) + "\n" for i in some))
    found = {r["model"]: r["status"] for r in api.verify_runs(spark, "gpqa_diamond", "default", f"{root}/results", root).collect()}
    assert found == {"org/one": "ok", "org/two": "incomplete", "org/three": "missing"}
    table = api.pass_table(spark, "gpqa_diamond", "default", f"{root}/results", root)
    assert table.where("pass").count() in (3, 4) and table.count() == 7
    main(["--root", root, "list"])
    assert "gpqa_diamond" in capsys.readouterr().out


def test_representative_dataset(spark, root):
    """Models with missing results or without a pass are left out and named; repeats and parameters are carried on."""
    ids = [r["id"] for r in catalog.load_samples(spark, "gpqa_diamond", "default", root).orderBy("id").collect()]
    for model, text, some in (("m--a", "Answer: B", ids), ("m--b", "Answer: D", ids), ("m--c", "Answer: D", ids[:2]), ("m--d", "Answer: C", ids)):
        folder = f"{root}/results/gpqa_diamond/{model}/default"
        os.makedirs(folder)
        open(f"{folder}/completions.jsonl", "w").write("".join(json.dumps({"id": i, "completion": text}) + "\n" for i in some))
    args = (spark, "gpqa_diamond", "default", f"{root}/results", 2)
    meta = api.representative_dataset(*args, "rep", root, selector=lambda pv, cells, wanted, seed: list(range(wanted)))
    assert meta["models"] == ["m/a", "m/b"] and {(x["model"], x["reason"]) for x in meta["skipped"]} == {("m/c", "incomplete"), ("m/d", "zero accuracy")}
    stored = catalog.read_metadata(spark, f"{root}/datasets/gpqa_diamond/rep")
    assert stored["generation_params"]["max_tokens"] == 2048 and stored["repeats"] == 2 and stored["source_dataset"] == "default"
    assert {r["id"] for r in catalog.load_samples(spark, "gpqa_diamond", "rep", root).collect()} <= set(ids)
    assert main(["--root", root, "represent", "gpqa_diamond", "default", f"{root}/results", "rep2", "--samples", "2"]) == 0
    for model in ("m--a", "m--b", "m--d"):
        os.remove(f"{root}/results/gpqa_diamond/{model}/default/completions.jsonl")
    with pytest.raises(RuntimeError, match="no model"):
        api.representative_dataset(*args, "rep3", root)


def test_nested_rows_are_hashed_as_stored(spark, root, tmp_path):
    """Sorted JSON of whole rows, arguments nested as they are stored, nulls among them."""
    import hashlib

    folder = f"{root}/datasets/ifbench/nested"
    schema = "key string, instruction_id_list array<string>, prompt string, kwargs array<struct<n:int,word:string>>"
    rows = spark.createDataFrame([("2", ["a:b"], "Größe?", [(None, "x")]), ("1", ["a:b", "c:d"], "Go.", [(3, None), None])], schema)
    rows.coalesce(1).write.parquet(f"{folder}/train.parquet")
    plain = [r.asDict(recursive=True) for r in rows.collect()]
    want = hashlib.sha256("\n".join(sorted(json.dumps(r, sort_keys=True) for r in plain)).encode()).hexdigest()
    assert catalog.dataset_fingerprint("ifbench", catalog.stored_rows(spark, "ifbench", "nested", None, root)) == want
    open(f"{folder}/metadata.json", "w").write(json.dumps({"content_sha256": want}))
    assert catalog.load_samples(spark, "ifbench", "nested", root).count() == 2


def test_the_last_of_repeated_samples_counts(spark, tmp_path):
    from evalanvil.operators.attempts import score_join

    spark.createDataFrame([("a", "1", 7), ("a", "2", None), ("b", "3", 1), (None, "4", 1)], "id string, answer string, n int").coalesce(1).write.parquet(f"{tmp_path}/s")
    done = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), (None, "w")], "id string, completion string")
    got = {(r["id"], r["completion"], r["answer"], r["n"]) for r in score_join(done, spark.read.parquet(f"{tmp_path}/s"), ["id"]).collect()}
    assert got == {("a", "x", "2", None), ("a", "y", "2", None), ("b", "z", "3", 1)}


def test_limit_takes_the_order_of_the_data_set(spark, tmp_path):
    spark.createDataFrame([(x,) for x in "zyxab"], "id string").coalesce(1).write.parquet(f"{tmp_path}/p")
    catalog.export_prompts(spark.read.parquet(f"{tmp_path}/p"), f"{tmp_path}/out", limit=3)
    assert sorted(r["id"] for r in spark.read.json(f"{tmp_path}/out").collect()) == ["x", "y", "z"]


def test_compact_carries_repeats(spark, root):
    ids = [r["id"] for r in catalog.load_samples(spark, "gpqa_diamond", "default", root).collect()]
    for model, text in (("m--a", "Answer: B"), ("m--b", "Answer: D")):
        folder = f"{root}/results/gpqa_diamond/{model}/default"
        os.makedirs(folder)
        open(f"{folder}/completions.jsonl", "w").write("".join(json.dumps({"id": i, "completion": text}) + "\n" for i in ids))
    meta = api.compact_dataset(spark, "gpqa_diamond", "default", f"{root}/results", None, "small", root)
    assert meta["repeats"] == 2 and meta["compaction"]["stages"][0]["before"] == 4
    assert catalog.load_samples(spark, "gpqa_diamond", "small", root).count() in (2, 4)
    assert catalog.read_metadata(spark, f"{root}/datasets/gpqa_diamond/small")["content_sha256"]


def test_small_helpers(spark):
    assert catalog.generation_spec("math_500") == {"max_tokens": 4096, "temperature": 0.0} and catalog.generation_specs(spark).count() == 4
    reg = spark.createDataFrame([("a/b", 3), ("c/d", 5)], "hf_id string, base_shards int")
    assert [r[0] for r in reg.select(catalog.shards_needed(F.lit("default"), F.col("base_shards"))).collect()] == [3, 5]
    assert catalog.pick_models(reg, ["c/d"]).count() == 1
    with pytest.raises(KeyError):
        catalog.pick_models(reg, ["x"])
    row = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("no",), (None,)], "j string").select(fingerprint.canonical_json("j")).collect()
    assert [r[0] for r in row] == ['{"a": "\\u00e9", "b": 1}', None, None]
    assert spark.range(1).select(short_hash(F.lit("x"), 6)).first()[0] == "2d7116"
    got = spark.createDataFrame([(["a", "b", "c"], 7), (None, 7)], "o array<string>, s long").select(fingerprint.shuffled("o", "s")).collect()
    assert sorted(got[0][0]) == ["a", "b", "c"] and got[1][0] is None


def test_fingerprints_of_large_sets(spark):
    rows = [(k, f"line {i * 7919 % 101}") for k, n in (("a", 40), (None, 30), ("b", 5), ("c", 0)) for i in range(n)] + [("b", None)]
    df = spark.createDataFrame(rows, "k string, line string")
    got = {r["k"]: r["content_sha256"] for r in fingerprint.content_fingerprints(df.repartition(4), ["k"], F.col("line"), most=10).collect()}
    assert got == {k: fingerprint.fingerprint_lines(sorted(x for g, x in rows if g == k and x)) for k in ("a", None, "b")}
