"""References to records that do not exist, by compressed key-range bitmaps.

Keys become integers (a dictionary kept in the shared folder): a hash names the key's range, its
rank there the place, so ranges are filled evenly however the rows are laid out. Every range of
32,768 codes gets one compressed bitmap (sorted array, runs or dense, whichever is smallest) of
referenced keys per month, and bitmaps of the keys that begin and end in a month; they are stored by
range and month. Within a range the parents that are in service for a whole month are a running OR
of the beginnings AND-NOT the ends; `referenced AND-NOT in service` leaves the orphans and the keys
whose state changes inside the month. Only the decoded survivors meet the rows again, and their
exact kind is settled by timestamps.

Scale: the bitmap stage sees each key once a month, however many rows name it (map-side
pre-aggregation), a range holds at most 4 KB a month, the survivors join the rows by
(key, month), where the row side may be skewed and is split by AQE's skew join. Nothing is
collected or broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalanvil.functions.keys import month_index, present
from evalanvil.operators.containers import BITS, WIDTH, compress, dense, positions_of
from evalanvil.plans.session import stored

#: Keys that a range is to hold on average; the rest of its places takes what the hash gives it beyond that.
FILLED = 24_576
#: Places set apart for a range in the codes: a range that is too full spills into the bitmaps after its own.
RANGE_STRIDE = 20
KINDS = ("missing", "deleted", "late")


def _compressed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists of places as compressed bitmaps."""
    for pdf in batches:
        made = [compress(x) for x in pdf["places"]]
        out = pdf.drop(columns="places")
        out["form"], out["bits"] = [f for f, _ in made], [b for _, b in made]
        yield out


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """referenced AND-NOT in service, for one key range."""
    of: dict[str, dict[int, np.ndarray]] = {"ref": {}, "begin": {}, "end": {}}
    for side, month, form, bits in zip(pdf["side"], pdf["month"], pdf["form"], pdf["bits"]):
        of[side][int(month)] = dense(form, bits)
    ever = np.zeros(WIDTH // 8, np.uint8)
    for bits in of["begin"].values():
        ever = ever | bits
    begun, ended = np.zeros(WIDTH // 8, np.uint8), np.zeros(WIDTH // 8, np.uint8)
    begins, ends = sorted(of["begin"]), sorted(of["end"])
    codes, months = [], []
    i = j = 0
    for month in sorted(of["ref"]):
        if month < 0:  # no time: only a key that never was there is an orphan
            left = of["ref"][month] & ~ever
        else:
            while i < len(begins) and begins[i] < month:
                begun = begun | of["begin"][begins[i]]
                i += 1
            while j < len(ends) and ends[j] <= month:
                ended = ended | of["end"][ends[j]]
                j += 1
            left = of["ref"][month] & ~(begun & ~ended)
        at = positions_of(left)
        codes.append(at)
        months.append(np.full(len(at), month))
    start = int(pdf["key_range"].iloc[0]) << BITS
    return pd.DataFrame(
        {
            "code": (np.concatenate(codes) if codes else np.zeros(0, np.int64)).astype(np.int64) + start,
            "month": (np.concatenate(months) if months else np.zeros(0)).astype(np.int32),
        }
    )


def _ranges(refs: DataFrame, parents: DataFrame, ks: list[str]) -> int:
    """How many key ranges there are to be: about one per FILLED distinct keys."""
    h = F.approx_count_distinct(F.xxhash64(*ks))
    n = sum(df.agg(h).first()[0] for df in (refs, parents))
    return max(1, -(-n // FILLED))


def find_orphans(
    refs: DataFrame,
    parents: DataFrame,
    keys: list[str],
    ref_id: str,
    ref_time: str,
    begins: str,
    ends: str,
) -> DataFrame:
    """Rows of `refs` whose key has no record in service at `ref_time`: (ref_id, month, kind).

    kind is 'missing' (no record under the key), else 'deleted' (all records of the key that had
    begun have `ends` at or before the time), else 'late' (`begins` after the time).

    Nulls: a null part of a key is a value that no parent has, so 'missing'; a parent with a null
    part is left out. A null `ref_time` can only be 'missing' (month -1). A null `begins` counts as
    "always there", a null `ends` as "never ended". Several parents under one key: the reference
    is no orphan if any was in service. Repeated rows are judged one by one; empty inputs give an
    empty result. Columns besides the named ones are ignored, so clashing names do no harm.
    """
    r = refs.select(
        F.col(ref_id).alias("ref_id"),
        F.col(ref_time).alias("ref_time"),
        month_index(F.col(ref_time)).alias("month"),
        *(present(F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)),
    )
    ks = [f"k{i}" for i in range(len(keys))]
    p = parents.dropna(subset=keys).select(
        *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)),
        F.col(begins).cast("timestamp").alias("begins"),
        F.col(ends).cast("timestamp").alias("ends"),
    )
    life = F.struct("begins", "ends")
    nothing = F.lit(None)
    sides = (
        r.select(*ks, "month")
        .distinct()
        .select(*ks, "month", nothing.cast("struct<begins:timestamp,ends:timestamp>").alias("life"))
        .unionByName(p.select(*ks, F.lit(None).cast("int").alias("month"), life.alias("life")).distinct())
    )
    keyed = sides.groupBy(*ks).agg(F.collect_set("month").alias("months"), F.collect_set("life").alias("lives"))
    home = F.pmod(F.xxhash64(*ks), F.lit(_ranges(r, p, ks)))
    place = F.row_number().over(Window.partitionBy("home").orderBy(*ks)) - 1
    dictionary = stored(
        keyed.withColumn("home", home)
        .select(*ks, "months", "lives", (F.shiftleft("home", RANGE_STRIDE) + place).alias("code"))
    )
    # A key is in service for a whole month after the month it begins and before the month it ends;
    # a key with several lives counts from its first beginning to its first end and meets the exact check.
    first = F.array_min(F.transform("lives", lambda x: F.coalesce(month_index_or(x["begins"], 0), F.lit(0))))
    last = F.array_min(F.transform("lives", lambda x: month_index_or(x["ends"], 2**31 - 1)))
    bits = (
        dictionary.select("code", F.lit("ref").alias("side"), F.explode("months").alias("month"))
        .unionByName(
            dictionary.where(F.size("lives") > 0).select("code", F.lit("begin").alias("side"), first.alias("month"))
        )
        .unionByName(
            dictionary.where(F.size("lives") > 0)
            .select("code", F.lit("end").alias("side"), last.alias("month"))
            .where(F.col("month") < 2**31 - 1)
        )
    )
    places = F.collect_list(F.col("code").bitwiseAND(F.lit(WIDTH - 1)).cast("int")).alias("places")  # at most WIDTH of them
    listed = bits.groupBy(F.shiftright("code", BITS).alias("key_range"), "side", "month").agg(places)
    bitmaps = stored(listed.mapInPandas(_compressed, "key_range long, side string, month int, form string, bits binary"))
    left = bitmaps.groupBy("key_range").applyInPandas(_survivors, "code long, month int")
    suspects = left.join(dictionary.select("code", "lives", *ks), "code").drop("code")
    t = F.col("ref_time")
    begun = lambda x: x["begins"].isNull() | (x["begins"] <= t)
    over = lambda x: x["ends"].isNotNull() & (x["ends"] <= t)
    kind = (
        F.when(F.size("lives") == 0, "missing")
        .when(F.exists("lives", lambda x: begun(x) & ~over(x)) | t.isNull(), None)
        .when(F.exists("lives", over), "deleted")
        .otherwise("late")
    )
    return (
        r.join(suspects, [*ks, "month"])
        .select(F.col("ref_id"), "month", kind.alias("kind"))
        .where(F.col("kind").isNotNull())
    )


def month_index_or(ts: Column, other: int) -> Column:
    """month_index of a timestamp, `other` for null."""
    return F.when(ts.isNull(), F.lit(other)).otherwise(month_index(ts))


def first_kind(orphans: DataFrame) -> DataFrame:
    """One row per ref_id, with the first of KINDS that any of its references has."""
    rank = F.min(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    return (
        orphans.groupBy("ref_id", "month")
        .agg(rank.alias("rank"))
        .select("ref_id", "month", F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank").cast("int")).alias("kind"))
    )
