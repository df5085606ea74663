"""Column functions for record identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a null part of a key, so that null keys group and join like any other; cannot occur in text ids.
NULL_KEY = "\x00"

#: Unicode white space at either end (str.strip), without which ids are compared.
_ENDS = r"(?U)\A\s+|\s+\z"


def py_strip(c: Column) -> Column:
    """Text without Unicode white space at its ends (null stays null)."""
    return F.regexp_replace(c, _ENDS, "")


def norm_id(c: Column) -> Column:
    """An id as it is compared: without surrounding white space and letter case."""
    return F.lower(py_strip(c))


def model_key(c: Column) -> Column:
    """A model name as it is compared: `--` and `/` mean the same."""
    return F.replace(c, F.lit("--"), F.lit("/"))


def short_hash(c: Column, length: int = 12) -> Column:
    """The first hex digits of the text's SHA-256 (null stays null)."""
    return F.substring(F.sha2(c, 256), 1, length)


def logical_id(c: Column) -> Column:
    """The sample's id: what comes before the last `#` of an attempt's id."""
    return F.regexp_replace(c, r"(?s)#[^#]*\z", "")


def month_index(ts: Column) -> Column:
    """Months since year 0 of a timestamp; -1 for null."""
    return F.coalesce(F.year(ts) * 12 + F.month(ts) - 1, F.lit(-1)).cast("int")


def month_label(index: Column) -> Column:
    """`yyyy-MM` of a month_index; 'unknown' for -1."""
    return F.when(index < 0, F.lit("unknown")).otherwise(
        F.format_string("%04d-%02d", F.floor(index / 12), index % 12 + 1)
    )


def present(c: Column) -> Column:
    """A key part with NULL_KEY in the place of null."""
    return F.coalesce(c, F.lit(NULL_KEY))
