"""Text expressions shared by the operators: stripping, snippets, decoding, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind, not only spaces."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(f"^{SPACE}*$")


def snippet(text: Column, term: str | Column, around: int) -> Column:
    """The first hit whatever its case with ``around`` characters on both sides; the head of the text without one."""
    term = F.lit(term) if isinstance(term, str) else term
    at = F.position(F.lower(term), F.lower(text)) - 1
    start = F.greatest(at - around, F.lit(0))
    end = F.least(F.length(text), at + F.length(term) + around)
    cut = strip(F.substring(text, start + 1, end - start))
    marked = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at < 0, F.substring(text, 1, 400)).otherwise(marked)


def decode_text(data: Column) -> Column:
    """UTF-8 where the bytes are valid, Latin-1 otherwise; line ends become line feeds."""
    text = F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def is_binary(data: Column) -> Column:
    """A NUL among the first 8192 bytes; unreadable data counts as binary."""
    return F.coalesce(F.contains(F.substring(data, 1, 8192), F.lit(bytearray(b"\x00"))), F.lit(True))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression both engines read: ``**/`` any folders, ``*`` and ``?`` within one."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
            i += 1
    return f"^{''.join(out)}$"


def excluded(path: Column, folders: list[str]) -> Column:
    """Any component of the path is an excluded folder."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))
