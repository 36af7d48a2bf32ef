"""Oversized items cut at natural boundaries, by ranges, without any worker loading a whole item.

1. Items are cut into ranges. A worker finds the boundaries whose separator begins in its range, with a halo behind it
   that holds a separator's length, and hands over their offsets and the range's length: a boundary table.
2. The tables of an item are stitched in order: a running sum of lengths turns offsets within ranges into offsets within
   the item, and one pass over these numbers, holding no more than the boundaries within a piece's reach, decides all
   cuts. It sees the item as if it were whole, so the length of ranges changes no cut.
3. Pieces are emitted by offset from the range in which they begin, with a halo of a piece's length.

The same steps run on texts in a table and on files by byte ranges; only the reading of a range differs.

Defined results: null and blank items give no piece; an item within its limit is one piece, as it is; overlap is held
below the limit; without any separator in reach a piece is cut at the limit itself; lengths are in code points and
white space counts. Rows repeated under one id with the same content give their pieces once.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE = 1 << 20
# Settings where not even the default row gives any.
DEFAULT_SIZE, DEFAULT_OVERLAP, DEFAULT_SEPARATORS = 1000, 200, ["\n## ", "\n### ", "\n\n", "\n"]


def boundaries(text: str, separator: str, own: int | None = None) -> list[int]:
    """Cut offsets at a separator that begins within the first ``own`` characters: after it, or before its first visible
    character where that follows a line break."""
    if not separator:
        return []
    own = len(text) if own is None else own
    lead = len(separator) - len(separator.lstrip()) if separator[0] == "\n" and separator.strip() else len(separator)
    out, at = [], text.find(separator)
    while 0 <= at < own:
        out.append(at + lead)
        at = text.find(separator, at + 1)
    return out


class Cutter:
    """The pass over the stitched boundary tables of one item; tables come range by range."""

    def __init__(self, size: int, overlap: int) -> None:
        self.size, self.overlap = size, overlap
        self.tables: list[list[int]] = []
        self.at, self.known, self.blank = 0, 0, True
        self.ranges: list[tuple[int, int]] = []  # (range, offset of its start) still in reach
        self.rows = array("q")  # start, start of new text, stop, range, start within the range

    def add(self, range_no: int, tables: list, length: int, blank: bool) -> None:
        """The next range, with offsets within it."""
        self.tables.extend([] for _ in range(len(tables) - len(self.tables)))
        for known, more in zip(self.tables, tables):
            known.extend(self.known + int(x) for x in more)
        self.ranges.append((range_no, self.known))
        self.known += length
        self.blank &= blank
        self._cut(None)

    def end(self) -> array:
        """All cuts, once no more ranges come; none for a blank item."""
        if self.blank:
            return array("q")
        self._cut(self.known)
        return self.rows

    def _cut(self, total: int | None) -> None:
        while total is None or self.at < total:
            start = max(0, self.at - self.overlap)
            limit = start + self.size
            if total is None and limit >= self.known:
                break  # a boundary within reach may still come
            stop = total if total is not None and limit >= total else self._best(limit) or limit
            while len(self.ranges) > 1 and self.ranges[1][1] <= start:
                self.ranges.pop(0)
            self.rows.extend((start, self.at, stop, self.ranges[0][0], start - self.ranges[0][1]))
            self.at = stop
        for table in self.tables:
            if len(table) > 10_000:
                del table[: bisect_right(table, self.at)]

    def _best(self, high: int) -> int | None:
        """The last boundary in reach of the first separator that has one in the later half, else the last of any."""
        middle = self.at + (high - self.at) // 2
        for least in (middle, self.at):
            for table in self.tables:
                k = bisect_right(table, high) - 1
                if k >= 0 and table[k] > least:
                    return table[k]
        return None


_TABLE = "range_no bigint, size int, overlap int, tables array<array<int>>, length bigint, blank boolean"
_CUTS = "piece_no int, total_pieces int, start bigint, new_start bigint, stop bigint, range_no bigint, local_start bigint"


def stitched_cuts(tables: DataFrame, *keys: str) -> DataFrame:
    """Cuts of every item from its boundary tables, each item's in order; numbers only."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tables.select(*keys).schema)
    columns = [*keys, "piece_no", "total_pieces", "start", "new_start", "stop", "range_no", "local_start"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cutter, last, out = None, None, None, []

        def close() -> None:
            if cutter is not None:
                rows = cutter.end()
                total = len(rows) // 5
                out.extend((*key, k, total, *rows[5 * k : 5 * k + 5]) for k in range(total))

        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                mine, (range_no, size, overlap, found, length, blank) = row[: len(keys)], row[len(keys) :]
                if mine != key:
                    close()
                    key, cutter, last = mine, Cutter(size, overlap), None
                if range_no != last:  # else a repeated row
                    cutter.add(range_no, found, length, blank)
                last = range_no
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        close()
        yield pd.DataFrame(out, columns=columns)

    order = [*keys, "range_no"]
    slim = tables.select(*order, "size", "overlap", "tables", "length", "blank")
    return slim.repartition(*keys).sortWithinPartitions(*order).mapInPandas(work, f"{kinds}, {_CUTS}")


# -- texts in a table ---------------------------------------------------------------------------------------------------


def ranges(items: DataFrame, span: int = RANGE, halo: str = "widest") -> DataFrame:
    """``items`` has item_id, content, size, overlap, separators; one row per range with its stretch and a halo behind."""
    length = F.length("content")
    widest = F.coalesce(F.array_max(F.transform("separators", lambda s: F.length(s))), F.lit(0))
    rows = items.where("content is not null").select(
        "item_id", F.xxhash64("content").alias("part"), "content", "size", "overlap", "separators", length.alias("total"), widest.alias("widest"),
        F.explode(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(span))).alias("range_start"),
    )
    stretch = F.when((F.col("range_start") == 0) & (F.col("total") <= span), F.col("content")).otherwise(F.substring("content", F.col("range_start") + 1, F.lit(span) + F.col(halo)))
    return rows.select("item_id", "part", "size", "overlap", "separators", "total", (F.col("range_start") / span).cast("bigint").alias("range_no"), F.least(F.lit(span), F.col("total") - F.col("range_start")).alias("own"), stretch.alias("stretch"))


def boundary_tables(items: DataFrame, span: int = RANGE) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tables, blank = [], []
            for text, own, separators in zip(batch["stretch"], batch["own"], batch["separators"]):
                tables.append([boundaries(text, s, own) for s in (separators if separators is not None else ()) if s])
                mine = text[:own]
                blank.append(not mine or mine.isspace())
            yield batch[["item_id", "part", "range_no", "size", "overlap"]].assign(tables=tables, length=batch["own"], blank=blank)

    return ranges(items, span).mapInPandas(work, f"item_id bigint, part bigint, {_TABLE}")


def with_settings(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """Items with the settings in force: those of the project, those of ``default`` where it has none."""
    known = config.groupBy("project").agg(F.max(F.struct("chunk_size", "chunk_overlap", "separators")).alias("c")).where("project is not null")
    row = known.where("project = 'default'").select("c.*").first()  # one row at most
    given = lambda i, other: other if row is None or row[i] is None else row[i]
    default_size, default_overlap, default_separators = given(0, DEFAULT_SIZE), given(1, DEFAULT_OVERLAP), given(2, DEFAULT_SEPARATORS)
    own = known.select(F.col("project").alias("_project"), "c")
    joined = chunks.select(F.col("chunk_id").alias("item_id"), F.col("project").alias("_project"), "content").join(own, "_project", "left")
    size = F.greatest(F.coalesce("c.chunk_size", F.lit(default_size)), F.lit(1)).cast("int")
    overlap = F.coalesce("c.chunk_overlap", F.lit(default_overlap)).cast("int")
    return joined.select(
        "item_id", "content", size.alias("size"), F.greatest(F.lit(0), F.least(overlap, size - 1)).alias("overlap"),
        F.coalesce("c.separators", F.array(*map(F.lit, default_separators)).cast("array<string>")).alias("separators"),
    )


def emitted(items: DataFrame, span: int = RANGE) -> DataFrame:
    """All pieces of all items, by the hash of their content too: one id may have several contents."""
    cuts = stitched_cuts(boundary_tables(items, span), "item_id", "part")
    texts = ranges(items, span, "size").select("item_id", "part", "range_no", "stretch").dropDuplicates(["item_id", "part", "range_no"])
    joined = cuts.join(texts.hint("merge"), ["item_id", "part", "range_no"])
    content = F.substring("stretch", (F.col("local_start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    return joined.select("item_id", "part", "piece_no", "total_pieces", "start", "stop", (F.col("new_start") - F.col("start")).alias("overlap"), content.alias("content"))


def oversized(items: DataFrame, span: int = RANGE) -> DataFrame:
    """Ids of items that are not blank and longer than their limit: those that come out as more than one piece of text."""
    per = emitted(items, span).where(F.length("content") > F.col("overlap")).groupBy("item_id", "part").agg(F.count("*").alias("n"))
    return per.where("n > 1").select("item_id").distinct()


def pieces(items: DataFrame, span: int = RANGE) -> DataFrame:
    """All pieces of all items that are not blank, in their place: piece_no, offsets, overlap and content."""
    return emitted(items, span).drop("part")


def found_oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    return oversized(with_settings(chunks, config)).select(F.col("item_id").alias("chunk_id"))


def chunk_pieces(chunks: DataFrame, config: DataFrame) -> DataFrame:
    return pieces(with_settings(chunks, config)).withColumnRenamed("item_id", "chunk_id")


# -- files too large to load, by byte range -----------------------------------------------------------------------------

_FILE_PIECES = "path string, piece_no int, total_pieces int, start bigint, stop bigint, overlap int, byte_start bigint, byte_stop bigint, content string"


def _char_start(data: bytes, at: int) -> int:
    """The first byte at or after ``at`` that begins a UTF-8 character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _read_range(path: str, n_bytes: int, at: int, span: int, after: int) -> tuple[int, str, int]:
    """First byte, text and number of own characters of a byte range; own are those that begin in it."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        data = f.read_at(min(n_bytes, at + span + after) - at, at)
    own, end = _char_start(data, 0) if at else 0, _char_start(data, min(span, len(data)))
    mine = data[own:end].decode("utf-8", "replace")
    # a character cut off at the end of the halo is left out
    last = len(data)
    while last > end and data[last - 1] & 0xC0 == 0x80:
        last -= 1
    if last > end and data[last - 1] >= 0xC0 and at + len(data) < n_bytes:
        last -= 1
    else:
        last = len(data)
    return at + own, mine + data[end:last].decode("utf-8", "replace"), len(mine)


def file_ranges(files: DataFrame, span: int) -> DataFrame:
    step = F.lit(span).cast("bigint")
    known = files.where("n_bytes > 0").select("path", F.col("n_bytes").cast("bigint").alias("n_bytes")).distinct()
    return known.select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bytes") - 1, step)).alias("at"))


def file_pieces(files: DataFrame, size: int, overlap: int, separators: list[str], span: int = 16 << 20) -> DataFrame:
    """Pieces of UTF-8 files; ``files`` has path and n_bytes. A worker reads its byte range and the halo only."""
    overlap = max(0, min(overlap, size - 1))
    separators = [s for s in separators if s]
    widest = 4 * max([len(s) for s in separators], default=0) + 8

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, n_bytes, at in batch.itertuples(index=False, name=None):
                _, text, own = _read_range(path, n_bytes, at, span, widest)
                out.append((path, n_bytes, at // span, size, overlap, [boundaries(text, s, own) for s in separators], own, not text[:own] or text[:own].isspace()))
            yield pd.DataFrame(out, columns=["path", "n_bytes", "range_no", "size", "overlap", "tables", "length", "blank"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, n_bytes, range_no, cuts in batch.itertuples(index=False, name=None):
                first, text, _ = _read_range(path, n_bytes, range_no * span, span, 4 * size + 8)
                out, seen, byte = [], 0, first
                for c in sorted(cuts, key=lambda c: c["piece_no"]):
                    low, high, new = c["local_start"], c["local_start"] + c["stop"] - c["start"], c["local_start"] + c["new_start"] - c["start"]
                    byte += len(text[seen:new].encode("utf-8", "surrogatepass"))
                    seen = new
                    out.append((path, c["piece_no"], c["total_pieces"], c["start"], c["stop"], new - low, byte, byte + len(text[new:high].encode("utf-8", "surrogatepass")), text[low:high]))
                yield pd.DataFrame(out, columns=["path", "piece_no", "total_pieces", "start", "stop", "overlap", "byte_start", "byte_stop", "content"])

    found = file_ranges(files, span).repartition("path", "at").mapInPandas(tables, f"path string, n_bytes bigint, {_TABLE}")
    cuts = stitched_cuts(found, "path", "n_bytes")
    # pieces that begin in one range are as many as the range holds
    per = cuts.groupBy("path", "n_bytes", "range_no").agg(F.collect_list(F.struct("piece_no", "total_pieces", "start", "new_start", "stop", "local_start")).alias("cuts"))
    return per.mapInPandas(emit, _FILE_PIECES)
