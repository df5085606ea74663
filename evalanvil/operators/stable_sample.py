"""A sample that stays as it is when rows move or are added.

Each record's first-seen epoch is persisted with the rate that was frozen for that epoch. A
record is chosen if a counter-based random number keyed by its identifier (Threefry-2x32, 20
rounds, counter 0) is below that rate. Neither order, layout nor later rows enter, so every rerun
chooses the same records, copies of an id share their fate, and no chosen record is ever dropped.

Everything is a column expression; the only shuffle is the minimum per id (map-side combined, so
a hot id costs nothing). The registry grows with the ids and is joined, never broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalanvil.functions.keys import month_index, norm_id

# Fixed values of the published generator (Salmon et al., 2011): rotations and key parity.
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
PARITY = 0x1BD11BDA
MASK = 0xFFFFFFFF
ROUNDS = 20


def threefry(k0: Column, k1: Column, counter: int = 0) -> Column:
    """The first 32-bit word of Threefry-2x32-20 for key (k0, k1), as a BIGINT fold over the rounds.

    32-bit words live in BIGINT, so no step overflows; the fold keeps the expression small.
    """
    word = lambda c: c.bitwiseAND(F.lit(MASK))
    zero = F.lit(0).cast("long")
    keys = (k0, k1, F.lit(PARITY).cast("long").bitwiseXOR(k0).bitwiseXOR(k1))
    rounds = []
    for i in range(ROUNDS):
        j, inject = i // 4 + 1, i % 4 == 3
        rounds.append(
            F.struct(
                F.lit(ROTATIONS[i % 8]).alias("r"),
                F.lit(32 - ROTATIONS[i % 8]).alias("l"),
                (keys[j % 3] if inject else zero).alias("a"),
                (keys[(j + 1) % 3] + F.lit(j) if inject else zero).alias("b"),
            )
        )

    def step(x: Column, s: Column) -> Column:
        total = word(x["x0"] + x["x1"])
        turned = word(F.call_function("shiftleft", x["x1"], s["r"]).bitwiseOR(F.call_function("shiftright", x["x1"], s["l"])))
        return F.struct(word(total + s["a"]).alias("x0"), word(turned.bitwiseXOR(total) + s["b"]).alias("x1"))

    start = F.struct(word(F.lit(counter).cast("long") + k0).alias("x0"), word(k1).alias("x1"))
    return F.aggregate(F.array(*rounds), start, step, lambda x: x["x0"])


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key's text and the seed only (null for null)."""
    digest = F.sha2(key, 256)
    word = lambda i: F.conv(F.substring(digest, i, 8), 16, 10).cast("long")
    return threefry(word(1), word(9), seed) * F.lit(2.0**-32)


def threefry_sql(source: str, key_hex: str, keep: list[str], counter: int = 0) -> str:
    """The same word as DuckDB SQL, one nested SELECT a round: `keep` columns and x0 of `source`.

    `key_hex` is an SQL expression for at least 16 hex digits.
    """
    cols = ", ".join([*keep, "k0", "k1"])
    sql = (
        f"SELECT {', '.join(keep)}, CAST('0x' || substr({key_hex}, 1, 8) AS BIGINT) AS k0, "
        f"CAST('0x' || substr({key_hex}, 9, 8) AS BIGINT) AS k1 FROM {source}"
    )
    ks = ("k0", "k1", f"xor(xor(CAST({PARITY} AS BIGINT), k0), k1)")
    sql = f"SELECT {cols}, ({counter} + k0) & {MASK} AS x0, k1 & {MASK} AS x1 FROM ({sql})"
    for i in range(ROUNDS):
        r, j, inject = ROTATIONS[i % 8], i // 4 + 1, i % 4 == 3
        a, b = (ks[j % 3], f"{ks[(j + 1) % 3]} + {j}") if inject else ("0", "0")
        total = f"((x0 + x1) & {MASK})"
        turned = f"(((x1 << {r}) | (x1 >> {32 - r})) & {MASK})"
        sql = f"SELECT {cols}, ({total} + {a}) & {MASK} AS x0, (xor({turned}, {total}) + {b}) & {MASK} AS x1 FROM ({sql})"
    return f"SELECT {', '.join(keep)}, x0 FROM ({sql})"


def first_seen(samples: DataFrame, id_col: str, time: str) -> DataFrame:
    """(id, epoch): the month in which each id was first seen, over all data sets. Null ids are left out."""
    return (
        samples.select(norm_id(F.col(id_col)).alias("id"), month_index(F.col(time)).alias("epoch"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("epoch").alias("epoch"))
    )


def advance(registry: DataFrame | None, samples: DataFrame, id_col: str, time: str, rate: Callable[[Column], Column]) -> DataFrame:
    """The registry (id, epoch, rate) after some more samples; rows it already holds never change.

    `rate` gives the rate for an epoch and is read for new ids only. Persist the result and pass
    it back the next time. Null ids are left out; an id with a null time gets epoch -1.
    """
    seen = first_seen(samples, id_col, time)
    if registry is not None:
        seen = seen.join(registry.select("id"), "id", "left_anti")
    new = seen.select("id", "epoch", rate(F.col("epoch")).cast("double").alias("rate"))
    return new if registry is None else registry.select("id", "epoch", "rate").unionByName(new)


def advanced(path: str, samples: DataFrame, id_col: str, time: str, rate: Callable[[Column], Column]) -> DataFrame:
    """The registry kept as Parquet at `path`, advanced by samples and written back: (id, epoch, rate).

    Only new rows are appended, so a row once written is never written again; a late row with an
    earlier time doesn't change a rate. Should two jobs append the same id, the earlier epoch counts.
    """
    spark = samples.sparkSession
    schema = "id string, epoch bigint, rate double"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ready = files.exists(where)
    old = spark.read.schema(schema).parquet(path) if ready else None
    new = advance(None, samples if old is None else _unknown(samples, id_col, old), id_col, time, rate)
    new.select("id", F.col("epoch").cast("long").alias("epoch"), "rate").write.mode("append").parquet(path)
    kept = spark.read.schema(schema).parquet(path).groupBy("id").agg(F.min(F.struct("epoch", "rate")).alias("first"))
    return kept.select("id", "first.epoch", "first.rate")


def present_in(registry: DataFrame, samples: DataFrame, id_col: str) -> DataFrame:
    """The registry's rows whose id the samples hold (a registry outlives what is taken out of the table)."""
    ids = samples.select(norm_id(F.col(id_col)).alias("id")).where(F.col("id").isNotNull()).distinct()
    return registry.join(ids, "id", "left_semi")


def _unknown(samples: DataFrame, id_col: str, registry: DataFrame) -> DataFrame:
    """Samples whose id no registry row has."""
    return samples.join(registry.select(F.col("id").alias("_known")), norm_id(F.col(id_col)) == F.col("_known"), "left_anti")


def chosen(registry: DataFrame, seed: int = 0) -> DataFrame:
    """The registry's rows whose random number is below their frozen rate: (id, epoch, rate, u)."""
    return registry.select("id", "epoch", "rate", uniform(F.col("id"), seed).alias("u")).where(F.col("u") < F.col("rate"))
