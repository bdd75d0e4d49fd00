"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once per worker; strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def count(texts: list[str], path: str) -> list[int]:
    return [len(e.ids) for e in load(path).encode_batch(texts, add_special_tokens=False)]


def n_tokens(text: Column, path: str = DEFAULT_TOKENIZER) -> Column:
    """The number of tokens of a text column; null and empty texts have none."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        out = [0] * len(texts)
        there = [(i, t) for i, t in enumerate(texts) if t]
        for at in range(0, len(there), 512):
            part = there[at : at + 512]
            for (i, _), n in zip(part, count([t for _, t in part], path)):
                out[i] = n
        return pd.Series(out, dtype="int32")

    return counted(text)
