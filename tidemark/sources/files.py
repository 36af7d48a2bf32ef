"""Listing and reading of project files, and what decides which are read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import decode_text, excluded, glob_regex, is_binary, strip

# Extensions in order of discovery with the type of their files.
EXTENSIONS = {
    ".c": "source", ".h": "header", ".cpp": "source", ".cc": "source", ".cxx": "source", ".hpp": "header", ".hh": "header", ".hxx": "header",
    ".py": "source", ".cs": "source", ".go": "source", ".kt": "source", ".kts": "source", ".js": "source", ".jsx": "source", ".ts": "source",
    ".tsx": "source", ".md": "documentation", ".pdf": "documentation", ".txt": "documentation", ".ini": "config", ".json": "config",
    ".yaml": "config", ".yml": "config",
}


def scan(spark: SparkSession, root: str, pattern: str = "**/*", excluded_dirs: tuple[str, ...] = (), with_content: bool = False) -> DataFrame:
    """Files under a folder that match a glob, outside excluded folders; contents only on demand."""
    base = root.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.lstrip("/")) + "/", "")
    rows = listed.withColumn("relative_path", relative).where(F.col("relative_path").rlike(glob_regex(pattern)))
    if excluded_dirs:
        rows = rows.where(~excluded(F.col("relative_path"), list(excluded_dirs)))
    columns = ["relative_path", "length", "modificationTime"]
    return rows.select(*columns, "content") if with_content else rows.select(*columns)


def read_texts(files: DataFrame) -> DataFrame:
    """Decoded text and hash of the raw bytes of files that are not binary."""
    return files.where(~is_binary(F.col("content"))).select("relative_path", decode_text(F.col("content")).alias("content"), F.md5("content").alias("file_hash"))


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def without_fresh_sibling(files: DataFrame, path: str, read_at: str, extension: str = ".pdf", sibling: str = ".md") -> DataFrame:
    """Files but those of ``extension`` next to a sibling of the same stem that is at least as new."""
    fresh = files.where(F.col(path).endswith(sibling)).groupBy(stem(F.col(path)).alias("_stem")).agg(F.max(read_at).alias("_fresh"))
    rows = files.withColumn("_stem", F.when(F.col(path).endswith(extension), stem(F.col(path))))
    kept = rows.join(fresh, "_stem", "left").where(F.col("_fresh").isNull() | (F.col("_fresh") < F.col(read_at)))
    return kept.drop("_stem", "_fresh")


def clean_page(text: Column) -> Column:
    """Runs of blank lines become one, page numbers go, short capitalised lines without full stop become bold."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: ~x.rlike(r"^[0-9]{1,4}$"))
    blanks = F.filter(kept, lambda x, i: (x != "") | ((i > 0) & (F.try_element_at(kept, F.greatest(i, F.lit(1))) != "")))
    heading = lambda x: (F.length(x) < 80) & ~x.rlike(r"[.,]$") & x.rlike(r"^[A-Z]") & (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) < 10)
    return F.array_join(F.transform(blanks, lambda x: F.when(heading(x), F.concat(F.lit("**"), x, F.lit("**"))).otherwise(x)), "\n")


def raw_pages(pages: Column) -> Column:
    """Pages that are not blank, stripped, a blank line between them; null without any."""
    kept = F.filter(F.transform(pages, strip), lambda x: x != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n\n"))


def pages_markdown(pages: Column) -> Column:
    """Pages cleaned, each under a heading with its number; pages without text are left out, their numbers stay."""
    headed = F.transform(pages, lambda x, i: F.when(strip(x) != "", F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"), strip(clean_page(x)))))
    return F.array_join(F.array_compact(headed), "\n\n")


def markdown_table(rows: DataFrame, sheet: str, columns: list[str]) -> DataFrame:
    """One Markdown table per sheet: rows without any cell are left out, trailing empty columns trimmed, cells stripped."""
    cells = F.array(*[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"^\s+|\s+$", ""), F.lit("")) for c in columns])
    used = F.array_max(F.transform(cells, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    flat = rows.select(F.col(sheet).alias("sheet"), cells.alias("cells"), used.alias("used")).where("used > 0")
    per = flat.groupBy("sheet").agg(F.max("used").alias("width"), F.array_sort(F.collect_list("cells")).alias("rows"))
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.slice(c, F.lit(1), F.col("width")), " | "), F.lit(" |"))
    head = line(F.array(*map(F.lit, columns)))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    return per.select("sheet", F.concat_ws("\n", F.concat(F.lit("## Sheet: "), F.col("sheet")), head, rule, F.array_join(F.transform("rows", line), "\n")).alias("text"))


def stacks(listing: DataFrame, path: str, group: str, rules: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(group, stack): stacks with a marker file, or else a marker folder, among the paths of a group."""
    found = []
    for stack, rule in rules.items():
        files = [F.col(path).rlike(glob_regex("**/" + m)) for m in rule.get("markers", [])]
        folders = [F.array_contains(F.split(F.col(path), "/"), d) & ~F.col(path).endswith("/" + d) for d in rule.get("marker_dirs", [])]
        hit = files[0] if files else F.lit(False)
        for h in [*files[1:], *folders]:
            hit = hit | h
        found.append(F.when(hit, stack))
    rows = listing.select(F.col(group).alias("group"), F.explode(F.array_compact(F.array(*found))).alias("stack"))
    return rows.distinct()
