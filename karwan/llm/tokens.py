"""Token counts by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of the byte-level tokenizer; KARWAN_TOKENIZER names another file on all hosts.
TOKENIZER = os.environ.get("KARWAN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how the tokenizer splits a text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """texts with an n_tokens column instead of the text; null texts have null, blank ones what the tokenizer says."""
    rest = [c for c in texts.columns if c != text_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != text_col) + ", n_tokens long"
    get = encoding

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = get(path)
        for b in batches:
            n = [None if t is None else len(e.encode_ordinary(t)) for t in b["text__"]]
            yield b.drop(columns="text__").assign(n_tokens=pd.array(n, dtype="Int64"))

    return texts.select(*rest, F.col(text_col).alias("text__")).mapInPandas(count, schema)
