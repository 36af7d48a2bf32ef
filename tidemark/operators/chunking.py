"""Recursive chunking with overlap as one Column expression; separators are known when the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import is_blank, strip

# Separators from coarse to fine.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def force_split(text: Column, size: int) -> Column:
    last = F.greatest(F.length(text) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(size)), lambda i: F.substring(text, i + 1, F.lit(size)))


def split_pieces(text: Column, size: int, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does it."""
    if not separators:
        return force_split(text, size)
    sep, finer = separators[0], separators[1:]

    def piece(p: Column, i: Column) -> Column:
        whole = F.when(i > 0, F.concat(F.lit(sep), p)).otherwise(p) if sep.strip() else p
        return bind(strip(whole), lambda q: F.when(q == "", F.array().cast("array<string>")).when(F.length(q) <= size, F.array(q)).otherwise(split_pieces(q, size, finer)))

    parts = lambda t: F.split(t, re.escape(sep), -1)
    return bind(text, lambda t: F.when(F.locate(sep, t) == 0, split_pieces(t, size, finer)).otherwise(F.flatten(F.transform(parts(t), piece))))


def merge_pieces(pieces: Column, size: int) -> Column:
    """Neighbours joined by a line feed while they fit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(p) + 1 <= size
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n"), p).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def overlap_pieces(chunks: Column, overlap: int) -> Column:
    """Each chunk after the tail of the one before, cut at its first line feed or else its first space."""
    if overlap <= 0:
        return chunks

    def tail(previous: Column) -> Column:
        def cut(t: Column) -> Column:
            at = F.when(F.locate("\n", t) > 0, F.locate("\n", t)).otherwise(F.locate(" ", t))
            return F.when(at > 1, F.substring(t, at + 1, F.length(t))).otherwise(t)

        return bind(F.substring(previous, F.greatest(F.length(previous) - overlap, F.lit(0)) + 1, F.lit(overlap)), cut)

    def join(x: Column, i: Column) -> Column:
        return F.when(i == 0, x).otherwise(
            bind(tail(F.try_element_at(chunks, F.greatest(i, F.lit(1)))), lambda t: F.when(is_blank(t), x).otherwise(F.concat(t, F.lit("\n"), x)))
        )

    return F.transform(chunks, join)


def chunk_text(text: Column, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Chunks of a text: none for null and blank ones, the text as it is where it fits."""
    merged = lambda t: merge_pieces(split_pieces(t, size, separators), size)
    return (
        F.when(text.isNull() | is_blank(text), F.array().cast("array<string>"))
        .when(F.length(text) <= size, F.array(text))
        .otherwise(bind(merged(text), lambda m: overlap_pieces(m, overlap)))
    )


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, total_chunks, content)."""
    made = docs.select(key, chunk_text(F.col(text), size, overlap).alias("_chunks"))
    return made.select(key, F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "content"))
