"""Token counts under a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tokenizer:
    """A tiktoken rank file and the pattern that splits texts before merging.

    Without a pattern, that of the ``public_tokenizers`` package is used.
    """

    path: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    pattern: str | None = None


@lru_cache(maxsize=2)
def _encoder(tokenizer: Tokenizer):
    import tiktoken

    pattern = tokenizer.pattern
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(tokenizer.path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(texts: list[str | None], tokenizer: Tokenizer = Tokenizer()) -> list[int]:
    """Tokens of each text; null and empty texts have none. Strings of special tokens are ordinary text."""
    encode = _encoder(tokenizer).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def sizes(df: DataFrame, key: str, keep: list[str], text: str = "text", tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(key, keep..., tokens) of every row."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [key, *keep])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = count(pdf["__text"].tolist(), tokenizer)
            yield pdf.drop(columns="__text").assign(tokens=pd.Series(n, dtype="int64", index=pdf.index))

    return df.select(key, *keep, df[text].alias("__text")).mapInPandas(run, f"{schema}, tokens bigint")
