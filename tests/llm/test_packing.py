from __future__ import annotations

import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalanvil.llm.packing import best_fill, containers, last_at_or_below, pack, plan_containers
from evalanvil.llm.tokens import encoding, token_counts

DOCS = "doc_id long, text string, container int, tokens string"
LIMITS = "limit_name string, capacity_tokens int"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 40))
def test_best_fill(counts, room):
    got = best_fill(counts, sorted(counts, reverse=True), room)
    assert all(0 < n <= counts[x] for x, n in got.items()) and sum(x * n for x, n in got.items()) <= room
    every = product(*(range(n + 1) for n in counts.values()))
    best = max(s for s in (sum(x * n for x, n in zip(counts, take)) for take in every) if s <= room)
    assert sum(x * n for x, n in got.items()) == best


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=25))
def test_plan_uses_everything(histogram):
    used: dict[int, int] = {}
    for pattern, times in plan_containers(histogram, 64):
        assert times >= 1 and 0 < sum(x * n for x, n in pattern.items()) <= 64
        for x, n in pattern.items():
            used[x] = used.get(x, 0) + n * times
    assert used == histogram


def test_size_of_plan_follows_capacity_not_documents():
    rng = random.Random(1)
    histogram = {x: rng.randint(1, 9) for x in range(1, 257)}
    small, large = plan_containers(histogram, 256), plan_containers({x: n * 100_000 for x, n in histogram.items()}, 256)
    assert len(large) < 3 * 256 and len(large) < 2 * len(small) + 256


def check(rows, sizes, limits):
    """Every document once and in order; containers neither overfull nor overlapping."""
    for name, capacity in limits.items():
        mine = [r for r in rows if r["limit_name"] == name]
        pieces: dict[int, dict[int, int]] = {}
        for r in mine:
            assert r["piece"] not in pieces.setdefault(r["doc_id"], {})
            pieces[r["doc_id"]][r["piece"]] = r["tokens"]
        assert {d: sum(p.values()) for d, p in pieces.items()} == sizes
        for d, p in pieces.items():
            assert sorted(p) == list(range(max(1, -(-sizes[d] // capacity)))) and all(p[i] == capacity for i in range(len(p) - 1))
        by: dict[int, list] = {}
        for r in mine:
            if r["tokens"]:
                by.setdefault(r["container"], []).append(r)
        for held in by.values():
            held.sort(key=lambda r: r["place"])
            assert [r["place"] for r in held] == list(range(len(held)))
            at = 0
            for r in held:
                assert r["start"] == at
                at += r["tokens"]
            assert at <= capacity
        assert sorted(by) == list(range(len(by)))


def least_containers(sizes, capacity):
    """A bound that no packing beats (Martello and Toth's second)."""
    best = -(-sum(sizes) // capacity)
    for a in {s for s in sizes if 0 < s <= capacity // 2}:
        large = [s for s in sizes if s > capacity - a]
        middle = [s for s in sizes if capacity / 2 < s <= capacity - a]
        rest = sum(s for s in sizes if a <= s <= capacity / 2)
        best = max(best, len(large) + len(middle) + max(0, -(-(rest - (len(middle) * capacity - sum(middle))) // capacity)))
    return best


def test_pack(spark, monkeypatch):
    from evalanvil.llm import packing

    monkeypatch.setattr(packing, "RANKED_PER_TASK", 40)  # several buckets per length
    rng = random.Random(3)
    texts = ["word " * rng.choice((1, 2, 3, 5, 9, 9, 9, 9, 14, 70)) for _ in range(400)] + [None, "", "same", "same", "x" * 3000]
    docs = spark.createDataFrame([(i, t, 5, "t") for i, t in enumerate(texts)], DOCS)
    limits = {"a": 16, "b": 64}
    out = pack(docs, spark.createDataFrame([*limits.items(), (None, None), ("zero", 0)], LIMITS))
    encode = encoding("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary
    check(out.collect(), {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}, limits)
    for r in containers(out).collect():
        mine = [x["tokens"] for x in out.where(f"limit_name = '{r['limit_name']}'").collect()]
        assert r["containers"] <= 1.03 * least_containers(mine, limits[r["limit_name"]]) + 1
    moved = pack(docs.repartition(6), spark.createDataFrame([*limits.items()], LIMITS))
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, out.collect()))


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    limits = spark.createDataFrame([("a", 8)], LIMITS)
    assert pack(none, limits).count() == 0 and containers(pack(none, limits)).count() == 0
    assert pack(none, limits.limit(0)).count() == 0


def test_tokens(spark):
    texts = ["Hello, world!", "<|endoftext|>", "", None, "naïve über 東京 🙂", " " * 50 + "\n\n"]
    got = [r["tokens"] for r in token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    assert got == [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]


@pytest.mark.parametrize("capacity", [1, 2])
def test_tiny_capacity(spark, capacity):
    out = pack(spark.createDataFrame([(1, "one two three", 0, "")], DOCS), spark.createDataFrame([("a", capacity)], LIMITS))
    check(out.collect(), {1: 3}, {"a": capacity})


def test_one_row_for_each_length(spark):
    """A document meets one row of slots, however many its length has; the search finds every slot's first and last rank."""
    values = [0, 1, 5, 6, 40, 41, 42, 300]
    df = spark.createDataFrame([(values[:n], x, n) for n in range(1, len(values) + 1) for x in range(0, 310, 1 if n == 8 else 37)], "v array<long>, x long, n int")
    for r in df.select("v", "x", last_at_or_below(df["v"], df["x"], 8).alias("i")).collect():
        assert r["i"] == max(i for i, v in enumerate(r["v"]) if v <= r["x"])
    docs = spark.createDataFrame([(i, "word " * (1 + i % 7), 0, "") for i in range(900)], DOCS)
    plan = pack(docs, spark.createDataFrame([("a", 16)], LIMITS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2
