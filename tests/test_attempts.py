from __future__ import annotations

import pytest

from evalanvil.operators import attempts as a


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_expand(spark):
    s = df(spark, [("a", 1), ("b", 2)], "id string, k int")
    assert [r["id"] for r in a.expand(s, 3).orderBy("id").collect()] == ["a#0", "a#1", "a#2", "b#0", "b#1", "b#2"]
    assert a.expand(s, 1) is s and a.expand(s, 2).columns == ["id", "k"]
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            a.expand(s, bad)


def test_verify(spark):
    expected = df(spark, [(m, i) for m in ("ok", "part", "dup", "none", "blank", "some", "null") for i in ("x", "y")], "model string, id string")
    done = [("ok", "x", "1"), ("ok", "y", "1"), ("part", "x", "1"), ("part", "z", ""), ("dup", "x", "1"), ("dup", "x", "1"), ("dup", "y", "1")]
    done += [("blank", "x", " \n"), ("blank", "y", None), ("some", "x", ""), ("some", "y", "1"), ("null", None, "1"), ("only", "q", "1")]
    got = {r["model"]: r for r in a.verify(expected, df(spark, done, "model string, id string, completion string"), ["model"]).collect()}
    assert {m: r["status"] for m, r in got.items()} == {
        "ok": "ok", "part": "incomplete", "dup": "duplicates", "none": "missing", "blank": "zero-score", "some": "partial-empty", "null": "missing", "only": "zero-score",
    }
    assert (got["part"]["missing"], got["part"]["extra"], got["part"]["empty"]) == (1, 1, 1) and got["dup"]["duplicates"] == 1
    assert got["some"]["ok"] and not got["dup"]["ok"] and not got["only"]["ok"] and got["only"]["extra"] == 1
    assert a.verify(expected.limit(0), df(spark, [], "model string, id string, completion string"), ["model"]).count() == 0


def test_gates(spark):
    done = df(spark, [("b", "1"), ("a", "1"), ("b", "2"), (None, "3"), (None, "4")], "id string, completion string")
    assert {r["id"]: r["n"] for r in a.duplicate_ids(done).collect()} == {"b": 2, None: 2}
    unknown = a.unknown_ids(done, df(spark, [("a",)], "id string"), ["id"])
    assert {r["id"] for r in unknown.collect()} == {"b", None}
    many = df(spark, [(f"{i:02d}",) for i in range(12)], "id string")
    assert a.offenders(many, "bad") == "bad: 00, 01, 02, 03, 04, 05, 06, 07, 08, 09 (and 2 more)" and a.offenders(many.limit(0), "bad") == ""


def test_rates(spark):
    samples = df(spark, [("a#0",), ("a#1",), ("b#0",), ("b#1",)], "id string")
    scores = df(spark, [("a#0", True), ("b#0", True), ("b#1", True), ("b#1", None)], "id string, is_correct boolean")
    full = a.with_missing(samples, scores, ["id"])
    assert a.pass_at_1(full).first()["pass_at_1"] == 0.75
    assert {r["logical_id"]: r["rate"] for r in a.pass_per_sample(full).collect()} == {"a": 0.5, "b": 1.0}
    assert a.summary(scores.limit(0)).first().asDict() == {"correct": 0, "total": 0, "accuracy": 0.0}


def test_positions_and_shards(spark):
    n = 1000
    items = spark.range(n).repartition(5)
    got = {r["id"]: r["shard"] for r in a.strided_shard(items, "id", 7).collect()}
    assert got == {i: i % 7 for i in range(n)}
    assert a.strided_shard(items.limit(0), "id", 7).count() == 0
    with pytest.raises(ValueError):
        a.strided_shard(items, "id", 0)


def test_lengths_and_releases(spark):
    x = df(spark, [(v,) for v in (3, 1, 9, 4, None)], "n int")
    assert a.length_stats(x, "n", 8).first().asDict() == {"n": 4, "min_tokens": 1, "max_tokens": 8, "median_tokens": 4, "mean_tokens": 4}
    assert a.length_filter(x, "n", 5).count() == 3 and a.length_stats(x.limit(0), "n", 8).first()["n"] == 0
    names = df(spark, [("2025.10.3",), ("2025.10.11",), ("2025.1.99",), (None,)], "name string")
    assert a.next_release(names, "name", "2025.10").first()[0] == "2025.10.12" and a.next_release(names, "name", "2026.01").first()[0] == "2026.01.1"
