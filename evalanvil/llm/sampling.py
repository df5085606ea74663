"""Bounded samples for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bound of a training sample in bytes, besides its bound in rows: texts may be very long.
SAMPLE_BYTES = 128 << 20


def lowest(df: DataFrame, order: list[str], texts: list[str], rows: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """The first `rows` rows by `order` that together hold at most `size` bytes of text, in no particular order.

    The window runs over what the limit leaves, at most `rows` rows. Whoever collects them sorts
    them: another sort here would read the table once more for its ranges.
    """
    some = df.orderBy(*order).limit(rows)
    each = sum((F.coalesce(F.octet_length(t), F.lit(0)).cast("long") for t in texts), F.lit(0).cast("long"))
    so_far = F.sum(each).over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("__bytes", so_far).where(F.col("__bytes") <= size).drop("__bytes")


def hash_share(df: DataFrame, h: Column, rows: int) -> Column:
    """Whether a row's 64-bit hash is among about the lowest `rows` (and a quarter more) of df's.

    A filter on the hash before the final order and limit: what reaches the driver is then bounded
    by `rows`, not by `rows` per task.
    """
    total = max(1, df.count())
    share = min(1.0, (1.25 * rows + 200) / total)
    return h <= F.lit(int(-(2**63) + share * (2**64 - 1))) if share < 1 else F.lit(True)

