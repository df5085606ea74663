"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies and the one used unless another is named (a tiktoken rank file).
TOKENIZER_DIR = os.environ.get("EVALANVIL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: how the byte-level vocabularies split a text into words before merging (published with them).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """texts without `text_col` and with `tokens`; a null text has 0. Whole texts are counted.

    Special tokens' strings in a text are ordinary text. The vocabulary must lie at the same path on
    every executor.
    """
    path = path or os.path.join(TOKENIZER_DIR, VOCABULARY)
    kept = [c for c in texts.columns if c != text_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for pdf in batches:
            out = pdf[kept].copy()
            out["tokens"] = [len(encode(t)) if isinstance(t, str) else 0 for t in pdf[text_col]]
            yield out

    schema = ", ".join([f"`{c}` {dict(texts.dtypes)[c]}" for c in kept] + ["tokens long"])
    return texts.select(*kept, F.col(text_col)).mapInPandas(run, schema)
