"""Filling containers of fixed capacity with documents (minimum bin slack).

Only a histogram of lengths reaches the driver: at most one count per length up to the capacity,
however many documents there are. There, containers are planned as patterns, multisets of lengths
with a number of repetitions: the longest length left opens a container, and a subset-sum dynamic
program over bitsets (one big integer per length, bounded counts by binary splitting) picks the
multiset of remaining lengths that comes closest to the room left; its counts are backtracked, and
the pattern is repeated as often as the histogram allows. Each repetition uses up a length, so the
number of patterns depends on the capacity and not on the documents.

Documents then take the slots of their length by rank: the slots of a length are one row with a
sorted array, in which a binary search finds the slot, so a document meets one row however many
slots its length has. Ranks are counted in buckets of a hash, so a length that a third of all
documents have is ranked by many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalanvil.llm.tokens import token_counts
from evalanvil.plans.session import cut

#: Documents ranked by one task at most, about.
RANKED_PER_TASK = 50_000


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most counts[x] times each) whose sum is closest to, and not above, room.

    lengths: the candidates, in the order in which they are tried; longer ones first keeps short ones
    for later windows. Stops early at a sum that leaves no room.
    """
    if room <= 0:
        return {}
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        left, part = min(counts[x], room // x), 1
        while left > 0:
            take = min(part, left)
            steps.append((reach, x, take))
            reach |= (reach << (x * take)) & mask
            left -= take
            part *= 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, x, take in reversed(steps):
        if total and not before >> total & 1:  # reached only with this step
            total -= x * take
            chosen[x] = chosen.get(x, 0) + take
    return chosen


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, repetitions) that use up a histogram of lengths in 1..capacity exactly."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    plan = []
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        pattern = best_fill(counts, lengths if counts[top] else lengths[1:], capacity - top)
        counts[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        times = min(counts[x] // n for x, n in pattern.items())
        for x, n in pattern.items():
            counts[x] -= n * times
        if any(not counts[x] for x in pattern):
            lengths = [x for x in lengths if counts[x]]
        plan.append((pattern, times))
    return plan


def slots(name: str, plan: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(limit_name, tokens, lo, hi, base, per, first_place, first_start): which ranks of a length go where."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in plan:
        place = start = 0
        for x in sorted(pattern, reverse=True):
            per = pattern[x]
            lo = used.get(x, 0)
            used[x] = lo + per * times
            rows.append((name, x, lo, used[x], base, per, place, start))
            place += per
            start += per * x
        base += times
    return rows


def ranked(items: DataFrame, keys: list[str], order: list[str], n_rows: int) -> DataFrame:
    """items with `rank` (from 0) within keys, counted without bringing a group into one task."""
    buckets = max(1, math.ceil(n_rows / RANKED_PER_TASK))
    h = F.xxhash64(*order)
    items = items.withColumn("__h", h).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    inside = items.withColumn(
        "__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", *order)).cast("long") - 1
    )
    if buckets == 1:
        return inside.withColumnRenamed("__r", "rank").drop("__h", "__b")
    sizes = items.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return inside.join(offsets, [*keys, "__b"]).withColumn("rank", F.col("__r") + F.col("__o")).drop("__h", "__b", "__r", "__o")


def last_at_or_below(sorted_values: Column, x: Column, longest: int) -> Column:
    """The index of the last value of a sorted array that is at or below x (the first is): a binary search as a fold."""
    steps = max(1, math.ceil(math.log2(max(2, longest))) + 1)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        low = sorted_values[middle] <= x
        return F.struct(F.when(low, middle).otherwise(s["a"]).alias("a"), F.when(low, s["b"]).otherwise(middle).alias("b"))

    start = F.struct(F.lit(0).alias("a"), F.size(sorted_values).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["a"])


def pack(documents: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(limit_name, capacity, doc_id, piece, container, place, start, tokens): where every piece of a document lies.

    A document larger than the capacity is cut into whole containers and a remainder that is packed
    like any other document; no other document is cut. A null or empty text takes no room: it is
    piece 0 of container 0 at place 0, with 0 tokens. Limits that are null or below 1 are left out.
    """
    spark = documents.sparkSession
    sizes = cut(token_counts(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path=tokenizer))
    wanted = [
        (r["limit_name"], int(r["capacity_tokens"]))
        for r in limits.select("limit_name", "capacity_tokens").where("capacity_tokens >= 1").distinct().collect()
    ]  # a handful of rows
    schema = "limit_name string, capacity int, doc_id long, piece int, container long, place int, start long, tokens long"
    if not wanted:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("limit_name"), F.lit(c).alias("capacity")) for n, c in sorted(wanted))))
    tokens, capacity = F.col("size"), F.col("capacity")
    pieces = (
        sizes.withColumnRenamed("tokens", "size")
        .select("doc_id", "size", each.alias("e"))
        .select("doc_id", "size", "e.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(tokens / capacity).cast("int") - 1, F.lit(0)))))
        .select("limit_name", "capacity", "doc_id", "piece", F.least(capacity.cast("long"), tokens - F.col("piece").cast("long") * capacity).alias("tokens"))
    )
    counted = pieces.where("tokens > 0").groupBy("limit_name", "tokens").count().collect()  # at most the sum of the capacities
    rows = []
    for name, size in sorted(wanted):
        rows += slots(name, plan_containers({r["tokens"]: r["count"] for r in counted if r["limit_name"] == name}, size))
    by_length: dict[tuple[str, int], list[tuple]] = {}
    for name, size, lo, _, *where in rows:  # ranks lo and above, in the order in which they were given out
        by_length.setdefault((name, size), []).append((lo, *where))
    columns = ("lo", "base", "per", "first_place", "first_start")
    table = spark.createDataFrame(
        [(*key, *(list(c) for c in zip(*found))) for key, found in by_length.items()],
        "limit_name string, tokens long, " + ", ".join(f"`{c}` array<long>" for c in columns),
    )
    n_rows = sum(r["count"] for r in counted)
    placed = ranked(pieces.where("tokens > 0"), ["limit_name", "tokens"], ["doc_id", "piece"], n_rows).join(table, ["limit_name", "tokens"])
    slot = last_at_or_below(F.col("lo"), F.col("rank"), max(map(len, by_length.values()), default=1))
    found = placed.withColumn("__slot", slot)
    of = lambda c: F.col(c)[F.col("__slot")]
    at = F.col("rank") - of("lo")
    turn = at % of("per")
    full = found.select(
        "limit_name",
        "capacity",
        "doc_id",
        "piece",
        (of("base") + F.floor(at / of("per"))).cast("long").alias("container"),
        (of("first_place") + turn).cast("int").alias("place"),
        (of("first_start") + turn * F.col("tokens")).alias("start"),
        "tokens",
    )
    zero = F.lit(0)
    nothing = pieces.where("tokens <= 0").select(
        "limit_name", "capacity", "doc_id", "piece", zero.cast("long").alias("container"), zero.cast("int").alias("place"), zero.cast("long").alias("start"), zero.cast("long").alias("tokens")
    )
    return full.unionByName(nothing)


def containers(packed: DataFrame) -> DataFrame:
    """(limit_name, capacity, containers, tokens, room_left, filled) of a packing."""
    used = packed.where("tokens > 0").groupBy("limit_name", "capacity").agg(
        (F.max("container") + 1).alias("containers"), F.sum("tokens").alias("tokens")
    )
    room = F.col("containers") * F.col("capacity") - F.col("tokens")
    return used.withColumn("room_left", room).withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity")))
