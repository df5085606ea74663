from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalanvil.functions.text import shown_number, shown_share, verdict
from evalanvil.operators.generate import generate, pick_source
from evalanvil.operators.recount import recount
from evalanvil.plans.session import drop_stored, read_table, stored
from evalanvil.sources import catalog


def test_generate(spark):
    rows = [(1, " b", 3, "x"), (2, None, 3, "x"), (3, "c", 9, "x"), (4, "e", None, "x"), (5, "d", 4, "x")]
    p = spark.createDataFrame(rows, "id int, prompt string, n int, completion_ string")
    got = {r["id"]: r["completion"] for r in generate(p, lambda: lambda texts: [t * 2 for t in texts], "prompt", "n", 5).collect()}
    assert got == {1: " b b", 2: "", 3: "", 4: "", 5: "dd"}
    picked = {r["id"]: r["completion"] for r in generate(p, lambda: lambda texts: texts, choices=["A", "B", "C"]).collect()}
    assert picked == {1: "B", 2: "", 3: "C", 4: "", 5: ""}
    assert generate(p.limit(0), lambda: lambda texts: texts).count() == 0


def test_pick_source(spark):
    rows = [("m", "x", q) for q in "ab"] + [("m", "y", q) for q in "abc"] + [("m", "z", q) for q in "abc"] + [("k", "q", "a"), ("k", "z", "a"), ("j", "z", "other")]
    got = pick_source(spark.createDataFrame(rows, "model string, owner string, quant string"), "model", "owner", "quant", ["x", "z", "y"], ["a", "b", "c"])
    assert {(r["model"], r["owner"], r["covered"]) for r in got.collect()} == {("m", "z", 3), ("k", "z", 1)}


def test_shown(spark):
    df = spark.createDataFrame([(1, 0.5, True), (2, 3.0, False), (3, None, None)], "i int, v double, b boolean").orderBy("i")
    rows = df.select(shown_number(F.col("v")).alias("n"), shown_share(F.col("v")).alias("s"), verdict(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [("0.5000", "50.00%", "PASS"), ("3", "300.00%", "FAIL"), ("", "", "FAIL")]


def test_recount_edges(spark, sf):
    v, c, s, d = (read_table(spark, sf, n) for n in ("verifications", "completions", "samples", "dataset_specs"))
    assert recount(v.limit(0), c, s, d).count() == 0
    bare = recount(v, c.limit(0), s, d)
    assert bare.count() == v.count() and bare.where("have + extra + duplicates + empty > 0").count() == 0
    assert recount(v, c, s.limit(0), d.limit(0)).where("total <> 0 or have <> 0").count() == 0


def test_stored(spark):
    df = stored(spark.range(5).withColumn("k", F.col("id") % 2), "k")
    assert df.where("k = 1").count() == 2
    assert drop_stored(spark) >= 1 and drop_stored(spark) == 0


def test_ingest(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"seed": 1, "prompt": "List.", "json_schema": {"type": "object"}, "top_level_count": [1, 2], "output_format": "json", "entity_type": "x"}\n')
    catalog.ingest_initial(spark, "ifstruct", str(tmp_path / "rows.jsonl"), "first", str(tmp_path))
    assert catalog.load_samples(spark, "ifstruct", "first", str(tmp_path)).count() == 1
    with pytest.raises(NotImplementedError):
        catalog.ingest_initial(spark, "math_500", "x", "y", str(tmp_path))
    (tmp_path / "up.jsonl").write_text('{"key": "7", "prompt": "p", "instruction_id_list": ["punctuation:no_comma"], "kwargs": [{"n": 3}], "other": 1}\n')
    row = catalog.read_upstream_instructions(spark, str(tmp_path / "up.jsonl")).first()
    assert row.asDict() == {"key": "7", "instruction_id_list": ["punctuation:no_comma"], "prompt": "p", "kwargs": '[{"n":"3"}]'}


def test_skipped_and_records(spark):
    from evalanvil.operators.generate import skipped
    from evalanvil.plans import api

    df = spark.createDataFrame([(i, "p" if i else None, i) for i in range(30)], "id int, prompt string, n int")
    rows = skipped(df, ["id"], "prompt", "n", 11, shown=5).collect()
    assert [r["id"] for r in rows] == [0, 11, 12, 13, 14] and {r["skipped"] for r in rows} == {20}
    assert skipped(df.limit(0), ["id"], "prompt", "n", 11).count() == 0
    assert api.completions_of(spark, [{"id": "a", "completion": None}, {"id": "b"}, {"id": "c", "completion": "x", "more": 1}]).count() == 3
    for bad in ([{"completion": "x"}], [{"id": 3, "completion": "x"}], ["x"], [{"id": "a", "completion": 1}]):
        with pytest.raises(api.Rejected):
            api.completions_of(spark, bad)
    assert api.completions_of(spark, []).count() == 0
