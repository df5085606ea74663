from __future__ import annotations

import random

import pytest

from evalanvil.llm import mixing
from evalanvil.llm.mixing import budget, draw, draw_shares, integrated, schedules

DOCS = "doc_id long, text string, source string, tokens long, copy int"
TARGETS = "source string, target_share double, max_repeats int"


def test_schedules():
    shares = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    given = schedules(shares)
    moments, found = integrated(given, shares)
    assert moments == [0.0, 1.0] and found[""][0] == pytest.approx([1.0, 1.0]) and found[""][1] == pytest.approx([0.0, 1.0])
    assert given["a"][0][1] > 1 > given["d"][0][1] and max(abs(w - 1) for points in given.values() for _, w in points) <= mixing.TILT + 1e-12
    assert schedules({"a": 1.0}) == {"a": [(0.0, 1.0)]}
    for odd in ({"a": []}, {"a": [(0.2, -1.0)]}, {"a": [(1.5, 1.0)]}, {"a": [(0.0, 0.0), (1.0, 0.0)]}):
        with pytest.raises(ValueError):
            integrated(odd, shares)


def test_a_given_curriculum(spark):
    """One source only in the second half, one only in the first quarter, one level; shares stay as they are."""
    curriculum = {"mid": [(0.5, 0.0), (0.5001, 1.0), (1.0, 1.0)], "small": [(0.0, 1.0), (0.25, 0.0)]}
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 3), ("small", 0.1, 4)], TARGETS)
    rows = draw(documents(spark), targets, curriculum=curriculum).collect()
    total = sum(r["tokens"] for r in rows)
    done, seen = 0, {"mid": [], "small": [], "big": []}
    for r in rows:
        assert abs(r["position"] - done) < 0.03 * total  # a position is what was delivered before
        done += r["tokens"]
        seen[r["source"]].append(r["position"] / total)
    share = {s: sum(r["tokens"] for r in rows if r["source"] == s) / total for s in seen}
    assert all(abs(share[s] - p) < 0.01 for s, p in (("big", 0.5), ("mid", 0.4), ("small", 0.1)))
    # by the middle of the run 0.25 of big and 0.1 of small are due; by a quarter of it 0.125 and 0.1
    assert min(seen["mid"]) > 0.33 and max(seen["small"]) < 0.25
    level = [p for p in seen["big"]]
    assert 0 < min(level) < 0.02 and max(level) > 0.97


def test_budget():
    total, shares = budget({"a": 100, "b": 10, "x": 5}, {"a": (0.5, 1), "b": (0.4, 3), "c": (0.1, 9)})
    assert shares == {"a": 0.5 / 0.9, "b": 0.4 / 0.9} and abs(total - 30 / (0.4 / 0.9)) < 1e-9
    assert budget({}, {"a": (1.0, 1)}) == (0.0, {})


def documents(spark, n=1500, seed=2):
    rng = random.Random(seed)
    source = lambda: "big" if rng.random() < 0.6 else rng.choice(("mid", "mid", "small", "unlisted", None))
    rows = [(i, rng.choice(("", None, "a b c ")) if rng.random() < 0.04 else "word " * rng.randint(1, 40), source(), 1, 1) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("per_task", [50_000, 60])
def test_draw(spark, monkeypatch, per_task):
    monkeypatch.setattr(mixing, "SUMMED_PER_TASK", per_task)
    targets = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.2, 4), ("absent", 0.1, 2), (None, 0.5, 1)], TARGETS)
    drawn = draw(documents(spark), targets)
    rows = drawn.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and all(r["tokens"] > 0 for r in rows)
    shares = {r["source"]: r for r in draw_shares(drawn, targets.where("source is not null")).collect()}
    for s, want, most in (("big", 0.3, 1), ("mid", 0.4, 3), ("small", 0.2, 4)):
        assert abs(shares[s]["share"] - want / 0.9) < 0.004 and shares[s]["most_used"] <= most
    assert shares["absent"]["tokens"] == 0 and max(r["most_used"] - r["max_repeats"] for r in shares.values()) <= 0
    # a curriculum: the large shares lead at first
    half = rows[: len(rows) // 2]
    part = lambda some, s: sum(r["tokens"] for r in some if r["source"] == s) / sum(r["tokens"] for r in some)
    assert part(half, "mid") > part(rows, "mid") and part(half, "small") < part(rows, "small")


def test_reruns_and_layouts(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2)], TARGETS)
    docs = documents(spark)
    a, b = draw(docs, targets).collect(), draw(docs.repartition(7), targets).collect()
    assert a == b


def test_empty(spark):
    docs, targets = documents(spark), spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert draw(docs.limit(0), targets).count() == 0 and draw(docs, targets.limit(0)).count() == 0
    got = draw_shares(draw(docs.limit(0), targets), targets).first()
    assert (got["tokens"], got["share"]) == (0, 0.0)
