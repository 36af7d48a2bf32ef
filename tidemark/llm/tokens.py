"""Sizes of texts in tokens of a public tokenizer; its file is a parameter.

A ``.tiktoken`` file holds byte pairs by rank and is split by ``SPLIT``; a ``.json`` file says itself how to split.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import spread

TOKENIZER = os.environ.get("TIDEMARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how texts are split before byte pairs are merged, as the public vocabulary was made.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to their numbers of tokens."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return lambda texts: [len(e.ids) for k in range(0, len(texts), 256) for e in made.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for null and empty ones."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path)([t or "" for t in texts]), dtype="int64")

    return count(text)


def document_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; spellings of a source are one."""
    source = F.regexp_replace(F.lower(F.regexp_replace("source", r"^\s+|\s+$", "")), r"[\s_]+", "-")
    return spread(documents.select("doc_id", "source", "text")).select("doc_id", source.alias("source"), token_count(F.col("text"), path).alias("n_tokens"))
