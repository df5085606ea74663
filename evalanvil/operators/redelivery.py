"""One copy of every message that was delivered at least once.

Bloom filters per time bucket, kept bit-sliced: a message hashes to one block and to HASHES of the
block's 64 positions, and each position holds one 63-bit word whose bits are time buckets ("lane"
= a run of 63 buckets). AND-ing a message's words gives at once every bucket that may have seen it.
A message that no other bucket may have seen is definitely new. The rest is verified exactly, by
its whole identity, against the stored identities of the matching buckets only.

Scale: rows are reduced to one per (bucket, message) before anything else moves, which also takes
the heat out of a message that holds a third of all rows; probes meet filters in an equi-join on
(lane, block), both evenly hashed; the filter has about BITS_PER_KEY bits per message of the
fullest lane, so a 63-bucket lane costs about eight bytes a position and is never broadcast or
collected. The surplus is what an anti-join on the unique row id leaves, so it cannot be skewed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalanvil.functions.keys import present
from evalanvil.plans.session import stored

LANE = 63
POSITIONS = 64
HASHES = 4
KEYS_PER_BLOCK = 6  # of a bucket: 64 positions / 6 keys = 10.7 bits a key
BUCKET_SECONDS = 7 * 86_400
#: Buckets for which the tasks of one shuffle are enough without splitting any.
BUCKETS_AT_ONCE = 16


def _positions(keys: list[str]) -> list[Column]:
    """HASHES positions in 0..63 from one hash of the identity."""
    h = F.xxhash64(F.lit(17), *keys)
    return [F.shiftright(h, 6 * i).bitwiseAND(F.lit(POSITIONS - 1)).cast("int") for i in range(HASHES)]


def bucket_firsts(messages: DataFrame, keys: list[str], row_id: str, time: str, seconds: int) -> DataFrame:
    """One row per (bucket, identity): the lowest row id. Null times share bucket -1."""
    bucket = F.coalesce(F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds), F.lit(-1)).cast("int")
    return (
        messages.select(F.col(row_id).alias("row_id"), bucket.alias("bucket"), *(present(F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)))
        .groupBy("bucket", *(f"k{i}" for i in range(len(keys))))
        .agg(F.min("row_id").alias("row_id"))
    )


def keepers(messages: DataFrame, keys: list[str], row_id: str, time: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The row id of the one copy to keep of each message: the lowest.

    messages: any table with a unique `row_id`; `keys` identify a message; `time` sets the bucket.
    Nulls in keys are a value of their own (two nulls are equal); null times form a bucket; empty
    input gives an empty result; other columns are ignored. The result depends neither on the
    bucket width nor on how row ids and times are ordered.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    firsts = bucket_firsts(messages, keys, row_id, time, seconds)
    # few files a bucket, whatever the number of tasks; a bucket with a third of all rows is spread over the salts
    salts = max(1, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS_AT_ONCE)
    store = stored(firsts.repartition(F.col("bucket"), F.pmod(F.xxhash64(*ks), F.lit(salts))), "bucket")
    by_bucket = store.groupBy("bucket").count()  # one row a time bucket
    top = by_bucket.agg(F.max("count").alias("n"), F.min("bucket").alias("first")).first()
    if top["n"] is None:
        return store.select("row_id")
    blocks = max(1, -(-top["n"] // KEYS_PER_BLOCK))
    since = F.col("bucket") - F.lit(top["first"])
    hashed = store.select(
        "row_id",
        "bucket",
        F.floor(since / LANE).cast("int").alias("lane"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (since % LANE).cast("int")).alias("bit"),
        F.pmod(F.xxhash64(F.lit(3), *ks), F.lit(blocks)).alias("block"),
        F.array(*_positions(ks)).alias("at"),
        *ks,
    )
    filters = (
        hashed.select("lane", "block", "bit", F.explode("at").alias("position"))
        .groupBy("lane", "block", "position")
        .agg(F.bit_or("bit").alias("word"))
        .groupBy("lane", "block")
        .agg(F.map_from_entries(F.collect_list(F.struct("position", "word"))).alias("words"))
    )
    lanes = int(lanes_of(by_bucket, top["first"]))
    probes = hashed.select("row_id", "block", F.col("lane").alias("own_lane"), "bit", "at").withColumn(
        "lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    )
    word = reduce(
        lambda a, b: a.bitwiseAND(b),
        [F.coalesce(F.col("words")[F.col("at")[i]], F.lit(0).cast("long")) for i in range(HASHES)],
    )
    others = F.when(F.col("lane") == F.col("own_lane"), word.bitwiseAND(F.bitwise_not("bit"))).otherwise(word)
    screened = (
        probes.join(filters, ["lane", "block"])
        .select("row_id", "lane", others.alias("hits"))
        .where(F.col("hits") != 0)
        .select(
            "row_id",
            F.explode(
                F.filter(
                    F.transform(
                        F.sequence(F.lit(0), F.lit(LANE - 1)),
                        lambda i: F.when(
                            F.getbit("hits", i) == 1, F.col("lane") * LANE + i + F.lit(top["first"])
                        ),
                    ),
                    lambda b: b.isNotNull(),
                )
            ).alias("bucket"),
        )
    )
    # The screen's own row ids, with their identity, against the matching buckets of the storage.
    suspects = store.select(F.col("row_id").alias("suspect"), *ks).join(
        screened.select(F.col("row_id").alias("suspect"), "bucket"), "suspect"
    )
    repeats = (
        suspects.join(store, ["bucket", *ks])
        .where(F.col("row_id") < F.col("suspect"))
        .select(F.col("suspect").alias("row_id"))
        .distinct()
    )
    return store.select("row_id").join(repeats, "row_id", "left_anti")


def lanes_of(by_bucket: DataFrame, first: int) -> int:
    """How many runs of LANE buckets there are."""
    last = by_bucket.agg(F.max("bucket")).first()[0]
    return (last - first) // LANE + 1


def surplus(messages: DataFrame, keys: list[str], row_id: str, time: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The row id of every copy except the one kept; see `keepers`."""
    kept = keepers(messages, keys, row_id, time, seconds)
    return messages.select(F.col(row_id).alias("row_id")).join(kept, "row_id", "left_anti")


def drop_redelivered(messages: DataFrame, keys: list[str], row_id: str, time: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """The whole rows of the copies kept, all columns as they were."""
    kept = keepers(messages, keys, row_id, time, seconds).withColumnRenamed("row_id", "__kept")
    return messages.join(kept, messages[row_id] == F.col("__kept"), "left_semi")
