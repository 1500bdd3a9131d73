"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text before the merges of a byte-level rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = VOCABULARY, folder: str = "/opt/tokenizers") -> str:
    """Place of a vocabulary file, the same on every machine."""
    if os.path.isabs(name):
        return name
    if not os.path.exists(os.path.join(folder, name)):
        spec = importlib.util.find_spec("public_tokenizers")
        if spec and spec.origin:
            folder = os.path.dirname(spec.origin)
    return os.path.join(folder, name)


@lru_cache(4)
def encoding(path: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of the whole text; 0 for null."""
    place = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        encode = encoding(place).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return run(text)
