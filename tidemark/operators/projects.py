"""Projects and their index: what a user adds, removes, clears and indexes.

Configurations are values: each verb returns a new one, so a verb that fails changes nothing. The index is a snapshot of
chunk rows; verbs return the snapshot after them, and the caller decides where it is kept.
"""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config, Project, Source, validate_path
from tidemark.operators import catalog, chunking
from tidemark.sources import files as fs

ROW = ["row_key", "project", "file_path", "file_type", "chunk_index", "total_chunks", "content", "file_hash"]


def _with(config: Config, project: Project) -> Config:
    others = [p for p in config.projects if p.name != project.name]
    at = next((i for i, p in enumerate(config.projects) if p.name == project.name), len(others))
    return replace(config, projects=(*others[:at], project, *others[at:]))


def project(config: Config, name: str) -> Project:
    """The active project of a name; raises KeyError for none."""
    for p in config.active():
        if p.name == name:
            return p
    raise KeyError(f"no project {name}")


def add_project(config: Config, name: str, base_path: str, description: str = "", sources: tuple[Source, ...] = ()) -> Config:
    """With the project; a removed one of that name comes back, with its sources unless others are given."""
    if not name or not name.strip():
        raise ValueError("a name is required")
    if not os.path.isdir(base_path):
        raise ValueError(f"no folder {base_path}")
    known = next((p for p in config.projects if p.name == name), None)
    if known is not None and not known.removed:
        raise ValueError(f"project {name} is there already")
    kept = sources or (known.sources if known is not None else ())
    return _with(config, Project(name, base_path, description or (known.description if known is not None else ""), kept))


def remove_project(config: Config, name: str) -> Config:
    """The project stays in the configuration as removed."""
    return _with(config, replace(project(config, name), removed=True))


def add_pattern(config: Config, name: str, pattern: str, kind: str = "documentation") -> Config:
    """With a source pattern, which is kept once."""
    p = project(config, name)
    validate_path(pattern)
    if any(s.pattern == pattern for s in p.sources):
        return config
    return _with(config, replace(p, sources=(*p.sources, Source(pattern, kind))))


def clear_project(index: DataFrame, name: str) -> DataFrame:
    """The index without the rows of a project; its configuration stays."""
    return index.where(~F.col("project").eqNullSafe(F.lit(name)))


def drop_project(config: Config, index: DataFrame, name: str) -> tuple[Config, DataFrame]:
    """Neither the configuration nor the index knows the project any more."""
    return replace(config, projects=tuple(p for p in config.projects if p.name != name)), clear_project(index, name)


def large_logs(listing: DataFrame, limit: int, kind: str = "file_type", size: str = "n_bytes") -> DataFrame:
    """Files that general indexing leaves to the log verbs: logs beyond a size."""
    return listing.where((F.col(kind) == "log") & (F.col(size) > limit))


def without_large_logs(listing: DataFrame, limit: int, kind: str = "file_type", size: str = "n_bytes") -> DataFrame:
    return listing.where(~F.coalesce((F.col(kind) == "log") & (F.col(size) > limit), F.lit(False)))


def chunk_rows(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunk rows of files (relative_path, content, file_hash, project); blank files give none."""
    made = chunking.chunk_documents(files.where(F.col("content").isNotNull()), "relative_path", "content", size, overlap)
    about = files.select("relative_path", "project", "file_hash", catalog.file_type(F.col("relative_path"), fs.EXTENSIONS, "source").alias("file_type"))
    rows = made.join(about, "relative_path")
    key = F.concat("relative_path", F.lit("::chunk_"), F.col("chunk_index").cast("string"))
    return rows.withColumn("row_key", key).withColumnRenamed("relative_path", "file_path").select(*ROW)


def read_pattern(spark: SparkSession, config: Config, name: str, pattern: str) -> DataFrame:
    """Texts of the files of a project that match a pattern, outside excluded folders."""
    validate_path(pattern)
    p = project(config, name)
    found = fs.scan(spark, p.base_path, pattern, tuple(config.excluded_dirs), with_content=True)
    return fs.read_texts(found).withColumn("project", F.lit(name))


def index_files(index: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """The index with these files read anew: all their former rows go, whatever their number."""
    new = chunk_rows(files, config.chunk_size, config.chunk_overlap)
    read = files.select("project", F.col("relative_path").alias("file_path")).distinct()
    return index.join(read, ["project", "file_path"], "left_anti").select(*ROW).unionByName(new)


def index_project(spark: SparkSession, config: Config, index: DataFrame, name: str) -> DataFrame:
    """All patterns of a project: changed and new files are read, files that are gone are pruned."""
    p = project(config, name)
    texts = None
    for source in p.sources:
        found = read_pattern(spark, config, name, source.pattern)
        texts = found if texts is None else texts.unionByName(found)
    if texts is None:
        return index.select(*ROW)
    texts = texts.dropDuplicates(["relative_path"])
    mine = index.where(F.col("project") == name)
    stored = mine.groupBy(F.col("file_path").alias("relative_path")).agg(F.max("file_hash").alias("file_hash"))
    fresh = catalog.changed(texts, stored, "relative_path", "file_hash").drop("is_new")
    there = texts.select(F.col("relative_path").alias("file_path"), F.lit(name).alias("project"))
    kept = index.where(~F.col("project").eqNullSafe(F.lit(name))).select(*ROW).unionByName(mine.join(there, ["project", "file_path"], "left_semi").select(*ROW))
    return index_files(kept, fresh, config)


def discover_roots(listing: DataFrame, curated: DataFrame, ignored: tuple[str, ...] = ("arch",), chosen: str = "all") -> DataFrame:
    """(project, root): first folders of paths, but hidden and ignored ones and those of curated projects.

    ``chosen``: ``all``, ``none`` or the numbers of roots in order, such as ``1,3``.
    """
    first = listing.where(F.col("relative_path").contains("/")).select("project", F.substring_index("relative_path", "/", 1).alias("root")).distinct()
    out = F.col("root").startswith(".")
    for prefix in ignored:
        out = out | F.col("root").startswith(prefix)
    found = first.where(~out & F.col("project").isNotNull()).join(curated.select("project").where("project is not null").distinct(), "project", "left_anti")
    if chosen == "all":
        return found
    if chosen == "none":
        return found.limit(0)
    wanted = {int(x) for x in chosen.split(",") if x.strip()}
    ordered = found.orderBy("project", "root").collect()  # a list of folders that a person chooses from
    picked = [r for i, r in enumerate(ordered, 1) if i in wanted]
    return found.sparkSession.createDataFrame(picked, found.schema)
