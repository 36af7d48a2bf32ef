"""Vector search: exact top-k under a metric, per project or over all, and two-stage reranking.

Embedders and rerankers are protocols: a model plugs in as an object with these methods. Built in are an embedder that
hashes words and a scorer of shared words, both deterministic.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Vectors of documents as a column, and the vector of one query on the driver."""

    def documents(self, text: Column) -> Column: ...

    def query(self, text: str) -> list[float]: ...


class Reranker(Protocol):
    """Scores of pairs of a query and texts, of a bounded number of candidates at a time; may raise."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """``cosine``, or ``l2sq`` for one minus the squared distance; null for the cosine of a vector of zeros."""
    if metric == "cosine":
        return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if metric == "l2sq":
        return 1 - (dot(a, a) + dot(b, b) - 2 * dot(a, b))
    raise ValueError(f"unknown metric {metric}")


def relevance(a: Column, b: Column, metric: str = "cosine", digits: int = 4) -> Column:
    return F.round(similarity(a, b, metric), digits)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def scored(vectors: DataFrame, query: list[float], metric: str = "cosine", digits: int = 4) -> DataFrame:
    """Vectors with their relevance to one query vector, which stands in the plan as a constant."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where("embedding is not null").withColumn("relevance", relevance(F.col("embedding"), q, metric, digits))


def top_k(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k most relevant rows, ties by the given keys, rows without relevance last."""
    return rows.orderBy(F.desc_nulls_last("relevance"), *keys).limit(k)


def top_k_per(rows: DataFrame, k: int, group: str, *keys: str) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last("relevance"), *keys)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_score(text: Column, query: str) -> Column:
    """Share of the query's words that the text has."""
    words = sorted(set(query.lower().split()))
    own = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.round(F.size(F.array_intersect(own, F.array(*map(F.lit, words)))) / F.lit(len(words)), 4)


def rerank(first: DataFrame, score: Column, k: int, factor: int = 4, *keys: str) -> DataFrame:
    """The scorer sees only ``k * factor`` (at most 100) rows of the first stage; null scores keep the first stage's."""
    fetched = top_k(first, min(k * factor, 100), *keys)
    return top_k(fetched.withColumn("relevance", F.coalesce(score, F.col("relevance"))), k, *keys)


def rerank_by(first: DataFrame, reranker: Reranker, query: str, text: str, k: int, factor: int = 4, *keys: str) -> DataFrame:
    """Like ``rerank`` with scores of a model; where it fails for any reason, the order of the first stage stays."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scores(candidates: pd.Series) -> pd.Series:
        out = []
        for texts in candidates:
            try:
                made = [round(float(x), 4) for x in reranker.score(query, ["" if t is None else t for t in texts])]
                out.append(made if len(made) == len(texts) else None)
            except Exception:  # a failing model must not fail the search
                out.append(None)
        return pd.Series(out, dtype=object)

    fetched = top_k(first, min(k * factor, 100), *keys)
    # at most 100 candidates, so one row holds them
    together = fetched.agg(F.collect_list(F.struct("*")).alias("rows")).withColumn("scores", scores(F.transform("rows", lambda r: r[text])))
    each = together.select(F.posexplode("rows").alias("_at", "_row"), "scores").select("_row.*", F.try_element_at("scores", F.col("_at") + 1).alias("_score"))
    return top_k(each.withColumn("relevance", F.coalesce("_score", "relevance")).drop("_score"), k, *keys)


class WordScorer:
    """The share of the query's words that a text has, as a reranker."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / len(words) if words else 0.0 for t in texts]


_HASH_BITS = 32


def _word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)


class HashEmbedder:
    """Deterministic embedding of words by signed hashing, unit length; zeros for blank text.

    Words are split and hashed in the JVM; a batch of them becomes vectors in one pass. Queries may carry an
    instruction, documents never do.
    """

    def __init__(self, dims: int = 64, instruction: str = "") -> None:
        self.dims, self.instruction = dims, instruction

    def _vectors(self, hashes: list[np.ndarray]) -> np.ndarray:
        rows = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        flat = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64)
        out = np.zeros((len(hashes), self.dims))
        np.add.at(out, (rows, flat % self.dims), np.where(flat >> (_HASH_BITS - 1), 1.0, -1.0))
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(length > 0, length, 1)

    def documents(self, text: Column) -> Column:
        vectors = self._vectors

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embed(hashes: pd.Series) -> pd.Series:
            return pd.Series(list(vectors([np.asarray(h if h is not None else [], np.int64) for h in hashes])))

        words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
        return embed(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")))

    def query(self, text: str) -> list[float]:
        words = f"{self.instruction} {text}".lower().split()
        return self._vectors([np.array([_word_hash(w) for w in words], np.int64)])[0].tolist()


def hash_embedding(text: Column, dims: int = 64) -> Column:
    return HashEmbedder(dims).documents(text)
