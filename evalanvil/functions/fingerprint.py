"""Order-insensitive content hashes, content-derived ids and seeds."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Fixed value: what separates the fields of a fingerprinted line.
FIELD_SEPARATOR = "\x1f"


def line_of(*fields: Column) -> Column:
    """The fields of a row as one line; a null field is left out."""
    return F.concat_ws(FIELD_SEPARATOR, *fields)


def fingerprint_lines(lines: Iterator[str]) -> str:
    """SHA-256 over sorted lines, joined by newlines."""
    digest = hashlib.sha256()
    for i, line in enumerate(lines):
        digest.update((b"\n" if i else b"") + line.encode("utf-8"))
    return digest.hexdigest()


def content_fingerprint(df: DataFrame, line: Column) -> str:
    """The hash of a data set's lines whatever their order.

    Lines are range-sorted by Spark and streamed through one incremental digest on the driver, a
    partition at a time: SHA-256 over a sequence has no parallel form, and holding all lines in one
    value (an array aggregate) would bound the data set's size. Null lines are left out.
    """
    ordered = df.select(line.alias("line")).where(F.col("line").isNotNull()).orderBy("line")
    return fingerprint_lines(r["line"] for r in ordered.toLocalIterator(prefetchPartitions=True))


def content_fingerprints(df: DataFrame, by: list[str], line: Column, most: int = 1_000_000) -> DataFrame:
    """(by, content_sha256) for many data sets; one of more than `most` lines is sorted by Spark and streamed."""
    lines = df.select(*by, line.alias("line")).where(F.col("line").isNotNull())
    joined = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    large = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n").collect()
    streamed, rest = [], lines
    for key in large:
        same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(by, key)))
        streamed.append((*key, content_fingerprint(lines.where(same), F.col("line"))))
        rest = rest.where(~same)
    small = rest.groupBy(*by).agg(F.sha2(joined, 256).alias("content_sha256"))
    if not streamed:
        return small
    schema = StructType([*(StructField(k, lines.schema[k].dataType) for k in by), StructField("content_sha256", StringType())])
    return small.unionByName(df.sparkSession.createDataFrame(streamed, schema))


def nested_line(row: dict) -> str:
    """A nested row as JSON with sorted keys (ASCII, default separators)."""
    return json.dumps(row, sort_keys=True)


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys, default separators and ASCII escapes; null for null or invalid text."""

    def one(t):
        try:
            return None if t is None else nested_line(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def python_text(value) -> str:
    """A value as it appears in a structured sample's identity: None, True, 3, [1, 2]."""
    return str(value)


def structured_id(prompt: str, schema, top_level_key, top_level_count, flags: tuple, output_format, entity_type, length: int = 12) -> str:
    """The id of a structured-output sample: a hash of its nine fields; the seed doesn't count."""
    compact = json.dumps(schema, sort_keys=True, separators=(",", ":"))
    parts = [prompt, compact, top_level_key, top_level_count, *flags, output_format, entity_type]
    return hashlib.sha256("|".join(map(python_text, parts)).encode("utf-8")).hexdigest()[:length]


@pandas_udf(StringType())
def structured_ids(rows: pd.Series) -> pd.Series:
    """structured_id of rows given as JSON objects; null for null."""

    def one(t):
        if t is None:
            return None
        r = json.loads(t)
        flags = tuple(r.get(k) for k in ("require_wrapper_key", "require_code_block", "require_no_commentary"))
        return structured_id(r.get("prompt"), r.get("json_schema"), r.get("top_level_key"), r.get("top_level_count"), flags, r.get("output_format"), r.get("entity_type"))

    return rows.map(one)


def md5_seed(c: Column) -> Column:
    """A 32-bit seed from a text: the last eight hex digits of its MD5."""
    return F.conv(F.right(F.md5(c), F.lit(8)), 16, 10).cast("long")


@pandas_udf(ArrayType(StringType()))
def shuffled(options: pd.Series, seed: pd.Series) -> pd.Series:
    """Options in the order of Python's generator for that seed; null for null."""

    def one(o, s):
        if o is None or pd.isna(s):
            return None
        out = list(o)
        random.Random(int(s)).shuffle(out)
        return out

    return pd.Series([one(o, s) for o, s in zip(options, seed)])
