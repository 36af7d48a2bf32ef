"""The search and listing tools as table functions: each returns rows, formatting comes last and elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import clamp_k, validate_query, validate_severity
from tidemark.functions.text import snippet
from tidemark.operators.vectors import Embedder, Reranker, clamp, rerank_by, scored, top_k, top_k_per

KINDS = ("header", "source", "documentation", "config")


def filter_events(events: DataFrame, severity: str | None = None, device: str | None = None, event_type: str | None = None, since: str | None = None, until: str | None = None, code: str | None = None) -> DataFrame:
    """Conjunction of the given conditions; times compare as ISO strings, both ends included; codes by prefix."""
    for column, value in (("severity", severity and severity.lower()), ("device_id", device), ("event_type", event_type)):
        if value is not None:
            events = events.where(F.col(column) == value)
    if since is not None:
        events = events.where(F.col("timestamp_iso") >= since)
    if until is not None:
        events = events.where(F.col("timestamp_iso") <= until)
    return events if code is None else events.where(F.col("error_code").startswith(code))


def time_range(groups: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Groups that lie within a range of ISO strings, both ends included."""
    if since is not None:
        groups = groups.where(F.col("timestamp_start") >= since)
    return groups if until is None else groups.where(F.col("timestamp_end") <= until)


def time_of_day(rows: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows whose instant falls between two times of day, both included."""
    return rows.where(F.date_format(column, "HH:mm:ss").between(first, last))


def search_docs(
    chunks: DataFrame, query: str, embedder: Embedder, k: int = 5, project: str | None = None, file_type: str | None = None,
    reranker: Reranker | None = None, factor: int = 4, key: str = "chunk_id", text: str = "content",
) -> DataFrame:
    """The k chunks nearest to a query in words: the best of each project, then of all, reranked where a reranker is given.

    Rows that carry an ``embedding`` keep it, the others are embedded. An unknown project or file type gives no rows.
    """
    query, k = validate_query(query), clamp_k(k)
    rows = chunks.where(F.col(text).isNotNull())
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if file_type is not None:
        rows = rows.where(F.col("file_type") == file_type)
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", embedder.documents(F.col(text)))
    fetched = min(k * factor, 100) if reranker is not None else k
    near = top_k_per(scored(rows, embedder.query(query)), fetched, "project", key)
    pool = top_k(near.select(key, "project", "file_path", "file_type", text, "relevance"), fetched, key)
    return rerank_by(pool, reranker, query, text, k, factor, key) if reranker is not None else pool


def search_specs(chunks: DataFrame, query: str, embedder: Embedder, k: int = 5, **more) -> DataFrame:
    return search_docs(chunks, query, embedder, k, file_type="documentation", **more)


def search_logs(events: DataFrame, k: int, query: str | None = None, embedder: Embedder | None = None, text: str = "message", **conditions) -> DataFrame:
    """Events that fulfil all conditions, with a score: the k nearest to a query in words, or without one the k newest."""
    conditions = {name: v for name, v in conditions.items() if v}
    if not (query and query.strip()) and not conditions:
        raise ValueError("a query or a condition is required")
    if "severity" in conditions:
        validate_severity(conditions["severity"])
    if len(conditions.get("code", "")) > 32:
        raise ValueError("a code has at most 32 characters")
    k, found = clamp_k(k, 50), filter_events(events, **conditions)
    if not (query and query.strip()):
        return found.withColumn("score", F.lit(1.0)).orderBy(F.desc_nulls_last("timestamp_iso"), "event_id").limit(k)
    rows = found.where(F.col(text).isNotNull()).withColumn("embedding", embedder.documents(F.col(text)))
    near = scored(rows, embedder.query(validate_query(query, 512)), digits=6).withColumn("relevance", clamp(F.col("relevance")))
    return top_k(near, k, "event_id").withColumnRenamed("relevance", "score").drop("embedding")


def list_files(chunks: DataFrame, project: str) -> DataFrame:
    """Files of a project with the type of their first chunk, and their total, in order."""
    per = _files_of(chunks, project)
    return per.withColumn("n_files", F.lit(per.count())).orderBy("file_path")


def _files_of(chunks: DataFrame, project: str) -> DataFrame:
    return chunks.where(F.col("project") == project).groupBy("file_path").agg(F.min_by("file_type", "chunk_index").alias("file_type"))


def search_code(hits: DataFrame, k: int) -> DataFrame:
    """Headers first, then sources, k of each."""
    part = lambda kind, branch: top_k(hits.where(F.col("file_type") == kind), k, "chunk_id").select(F.lit(branch).alias("branch"), "chunk_id", "file_path", "relevance")
    return part("header", 0).unionByName(part("source", 1))


def find_function(hits: DataFrame, chunks: DataFrame, name: str) -> DataFrame:
    """Declarations, implementations, and up to 15 files that mention the name."""
    part = lambda kind, label, k: top_k(hits.where(F.col("file_type") == kind), k, "chunk_id").select(F.lit(label).alias("part"), "file_path", "chunk_id")
    mentions = chunks.where(F.col("content").contains(name)).select(F.lit("mention").alias("part"), "file_path", F.lit(None).cast("bigint").alias("chunk_id"))
    return part("header", "declaration", 3).unionByName(part("source", "implementation", 5)).unionByName(mentions.distinct().orderBy("file_path").limit(15))


def hex_variants(pattern: str) -> list[str]:
    """Spellings of a hexadecimal value in the order they are tried."""
    raw = pattern.strip()
    term = raw.lower().replace("0x", "").replace(" ", "")
    return [raw, term, raw.upper(), f"0x{term}", f"0x{term.upper()}", f"${term.upper()}"]


def search_hex(chunks: DataFrame, pattern: str, k: int) -> DataFrame:
    """Chunks with the first spelling that each of them has, variant by variant within projects."""
    variant = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(hex_variants(pattern)))):
        variant = F.when(F.col("content").contains(v), i).otherwise(variant)
    found = chunks.withColumn("variant", variant).where("variant is not null").orderBy("project", "variant", "chunk_id").limit(k)
    spelling = F.element_at(F.array(*map(F.lit, hex_variants(pattern))), F.col("variant") + 1)
    return found.select("chunk_id", "project", "variant", snippet(F.col("content"), spelling, 200).alias("snippet"))


def find_variable(chunks: DataFrame, name: str, k: int) -> DataFrame:
    """The first chunk of each file that has the name."""
    first = Window.partitionBy("project", "file_path").orderBy("chunk_index", "chunk_id")
    found = chunks.where(F.col("content").contains(name)).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return found.orderBy("project", "file_path").limit(k).select("project", "file_path", "chunk_index", snippet(F.col("content"), name, 150).alias("snippet"))


def compare_projects(hits: DataFrame, left: str, right: str, k: int) -> DataFrame:
    side = lambda p: top_k(hits.where(F.col("project") == p), k, "doc_id").select(F.lit(p).alias("side"), "doc_id", "relevance")
    return side(left).unionByName(side(right))


def get_document(chunks: DataFrame) -> DataFrame:
    """Chunks of each file put together in order; overlap stays."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content")))
    return chunks.where("content is not null").groupBy("file_id").agg(parts.alias("parts")).select("file_id", F.array_join(F.col("parts.content"), "\n").alias("text"))


def list_projects(chunks: DataFrame, config: DataFrame, removed: list[str]) -> DataFrame:
    counts = chunks.where(~F.col("project").isin(*removed)).groupBy("project").agg(F.count("*").alias("n_chunks"))
    return counts.join(config.select("project", "chunk_size"), "project", "left")
