"""Streaming source of log lines by byte offset: only what was appended is read, whole lines only.

Options: ``path`` (a folder that driver and executors share), ``suffix`` (of file names, ``.log``), ``stretchBytes`` (what
one task reads, 16 MB), ``maxBytesPerFile`` (what one batch takes of a file at most, 0 for no bound; a bounded batch
leaves the rest to the next trigger). Rows: file, byte_offset, line, stretch (where the task's part begins), replaced.

The driver looks at sizes only; executors find lines. A line belongs to the stretch in which it ends, so stretches of
any size give the same lines, and a line without its end waits for it. Offsets hold each file's end and its identity: a
file that is shorter than before, or another file under the same name, is read anew, whether that happened while the
stream ran or while it was down, and a row without a line, marked ``replaced``, goes before its lines. A file that was
cut and has grown beyond its former size between two looks can't be told from one that was appended to.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, byte_offset bigint, line string, stretch bigint, replaced boolean"
CHUNK = 1 << 16


class Stretch(InputPartition):
    def __init__(self, file: str, start: int, stop: int, replaced: bool) -> None:
        self.file, self.start, self.stop, self.replaced = file, start, stop, replaced


def line_begin(f, at: int) -> int:
    """Where the line that holds the byte before ``at`` begins, or ``at`` itself if that byte ends a line."""
    while at > 0:
        low = max(0, at - CHUNK)
        f.seek(low)
        k = f.read(at - low).rfind(b"\n")
        if k >= 0:
            return low + k + 1
        at = low
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".log")
        self.step, self.most = int(options.get("stretchBytes", 16 << 20)), int(options.get("maxBytesPerFile", 0))
        self.seen: dict[str, list[int]] = {}  # only to bound a batch; what is read comes from the offsets

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        out: dict[str, list[int]] = {}
        for folder, _, names in os.walk(self.path):
            for name in names:
                if name.endswith(self.suffix):
                    path = os.path.join(folder, name)
                    found = os.stat(path)
                    before, identity = self.seen.get(path, [0, found.st_ino])
                    start = before if identity == found.st_ino and before <= found.st_size else 0
                    out[path] = [min(found.st_size, start + self.most) if self.most else found.st_size, found.st_ino]
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.seen = after
        made = []
        for path, (stop, identity) in after.items():
            was, known = before.get(path, [0, identity])
            replaced = identity != known or stop < was
            if replaced:
                was = 0
                made.append(Stretch(path, 0, 0, True))
            made.extend(Stretch(path, at, min(at + self.step, stop), False) for at in range(was, stop, self.step))
        return made or [Stretch("", 0, 0, False)]

    def read(self, part: Stretch) -> Iterator[tuple]:
        if not part.file:
            return
        name = os.path.relpath(part.file, self.path)
        if part.replaced:
            yield name, None, None, part.start, True
        if part.stop <= part.start:
            return
        with open(part.file, "rb") as f:
            at = line_begin(f, part.start)
            f.seek(at)
            data = f.read(part.stop - at)
        here = 0
        while (k := data.find(b"\n", here)) >= 0:
            yield name, at + here, data[here:k].decode("utf-8", "replace").rstrip("\r"), part.start, False
            here = k + 1


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str | StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TailReader(dict(self.options))
