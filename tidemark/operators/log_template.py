"""Semi-structured log lines to entries with timestamp, level, component, message and continuation lines.

1. Every line is lexed once: terminal colours, byte order marks and carriage returns go, the rest becomes tokens, each
   with a mask (time stamps, levels, numbers and quoted texts are variables, punctuation and words stay).
2. Distinct masked lines pass a template tree of fixed depth: routed by token count and leading tokens, then merged
   within the leaf where enough words agree; differing words become wildcards, structure (keys too) never does.
3. Each template is mapped to fields by position once; lines take their fields from those positions.
4. Lines without a header belong to the last header before them in their file. A file is cut into blocks of lines, each
   solved for itself; a small table of block ends carries the open entry from block to block, so no task holds a file.

Defined results: null and blank lines belong to an entry only when a later line of it follows; lines before the first
entry of a file belong to none; of lines delivered more than once under one (file, line_no) the greatest text counts; a
label before a bar counts as a collector's only where every non-blank line of the file bears one. An opening brace alone
in the first column starts an entry, whose fields are the members below it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored

BLOCK_LINES = 8192

# Spellings of levels and what they count as.
LEVELS = {
    "debug": "debug", "dbg": "debug", "trace": "debug", "trc": "debug", "verbose": "debug", "fine": "debug",
    "info": "info", "inf": "info", "notice": "info", "information": "info",
    "warning": "warning", "warn": "warning", "wrn": "warning",
    "error": "error", "err": "error", "severe": "error",
    "critical": "critical", "crit": "critical", "fatal": "critical", "ftl": "critical", "emerg": "critical", "alert": "critical", "panic": "critical",
}
# Keys under which structured lines carry their fields.
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "@t", "t", "date", "datetime")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "log_level", "@l", "levelname")
COMPONENT_KEYS = ("component", "module", "logger", "source", "service", "name", "program", "app")
MESSAGE_KEYS = ("msg", "message", "@m", "text")

_DATE = r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d(?::\d\d(?:[.,]\d{1,9})?)?(?: ?Z| ?[+-]\d\d:?\d\d)?"
_NOISE = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]|\x1b[()][A-Z0-9]|[\ufeff\r\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f]")
_LABEL = re.compile(r"[\w.\-]+ *\| ?(?:(?<= )|$)")
_DUMP = re.compile(r"[0-9a-fA-F]{4,8}:? (?: ?[0-9a-fA-F]{2}){2,}")
_TOKEN = re.compile(
    rf"""(?P<DUMP>^[0-9a-fA-F]{{4,8}}:?\ (?:\ ?[0-9a-fA-F]{{2}}){{2,}}.*$)
    |(?P<IND>^[ \t]+)
    |(?P<PRI>^<\d{{1,3}}>\d?(?=[\ \w]))
    |(?P<GLOG>^[DIWEF]\d{{4}}\ \d\d:\d\d:\d\d\.\d+)
    |(?P<EPOCH>^\d{{10}}(?:\.\d+|\d{{3}}|\d{{6}})?(?=[\ ;|]))
    |(?P<QTS>"{_DATE.replace(" ", chr(92) + " ")}")
    |(?P<TS>{_DATE.replace(" ", chr(92) + " ")}|\d\d/[A-Z][a-z]{{2}}/\d{{4}}:\d\d:\d\d:\d\d\ [+-]\d{{4}})
    |(?P<SYSLOG>(?<![A-Za-z])(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\ [\ \d]\d\ \d\d:\d\d:\d\d)
    |(?P<TOD>(?<!\d)\d\d:\d\d:\d\d(?:[:.,]\d{{1,6}})?(?!\d))
    |(?P<Q>"(?:[^"\\]|\\.)*")
    |(?P<W>[\w.\-/@$\#]*\w)
    |(?P<P>\S)""",
    re.VERBOSE,
)
_PLAIN = re.compile(r"[A-Za-z_./@$#\-]+")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+")

_LEXED = T.StructType(
    [
        T.StructField("mask", T.StringType()),
        T.StructField("tokens", T.StringType()),
        T.StructField("blank", T.BooleanType()),
        T.StructField("labelled", T.BooleanType()),
    ]
)


@lru_cache(maxsize=100_000)
def word_mask(token: str) -> str:
    if _PLAIN.fullmatch(token):
        return "<LVL>" if token.lower() in LEVELS and (token.islower() or token.isupper() or token.istitle()) else token
    return "<N>" if _HEX.fullmatch(token) else "<A>"


def lex(line: str | None) -> tuple[str, list[str], bool, bool]:
    """Masked line, tokens, whether it is blank, whether a collector's label may stand before it."""
    text = _NOISE.sub("", line or "")
    labelled = False
    if found := _LABEL.match(text):
        labelled, text = True, text[found.end() :]
    if not text or text.isspace():
        return "", [], True, labelled
    masks, tokens = [], []
    for found in _TOKEN.finditer(text):
        kind, token = found.lastgroup, found.group()
        if kind == "W":
            kind = word_mask(token)
        elif kind == "Q":
            inner = token[1:-1]
            after = text[found.end() : found.end() + 2].lstrip()
            kind = token if after.startswith(":") and re.fullmatch(r"[\w@.\-]{1,24}", inner) else "<QLVL>" if inner.lower() in LEVELS else "<Q>"
        elif kind == "P":
            kind = token
        else:
            kind = f"<{kind}>"
        masks.append(kind)
        tokens.append(token)
    return " ".join(masks), tokens, False, labelled


BETWEEN = "\x1f"  # stands between tokens on their way to the JVM, where they are split; no line keeps this character


@F.pandas_udf(_LEXED)
def _lex_udf(lines: pd.Series) -> pd.DataFrame:
    found = [lex(x) for x in lines]
    masks, tokens, blank, labelled = zip(*found) if found else ((), (), (), ())
    return pd.DataFrame({"mask": masks, "tokens": [BETWEEN.join(t) for t in tokens], "blank": blank, "labelled": labelled})


def _is_word(token: str) -> bool:
    return token[0] not in '<"' and token[-1].isalnum() and token.replace(".", "").replace("-", "").replace("_", "").replace("/", "").isalnum()


def merge_templates(masks: list[str], similarity: float = 0.5) -> list[str]:
    """The template of each masked line of one leaf: same structure, and at least ``similarity`` of the tokens agree."""
    clusters: dict[tuple[str, ...], list[list[str]]] = {}
    belongs: list[tuple[tuple[str, ...], int]] = []
    for mask in masks:
        tokens = mask.split(" ")
        # the word before an equals sign is a key: it says what the value is, so it is structure
        shape = tuple("w" if _is_word(t) and after != "=" else t for t, after in zip(tokens, [*tokens[1:], ""]))
        best, most = -1, similarity
        known = clusters.setdefault(shape, [])
        for i, template in enumerate(known):
            same = sum(a == b for a, b in zip(template, tokens)) / len(tokens)
            if same >= most:
                best, most = i, same
                if same == 1:
                    break
        if best < 0:
            known.append(tokens)
            best = len(known) - 1
        else:
            known[best] = [a if a == b else "<*>" for a, b in zip(known[best], tokens)]
        belongs.append((shape, best))
    return [" ".join(clusters[shape][i]) for shape, i in belongs]


_ROLE = T.StructType(
    [
        T.StructField("mask", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("ts_at", T.IntegerType()),
        T.StructField("level_at", T.IntegerType()),
        T.StructField("component_at", T.IntegerType()),
        T.StructField("message_at", T.IntegerType()),
    ]
)


def map_fields(template: str) -> tuple[str, int | None, int | None, int | None, int | None]:
    """Kind of line and the positions of timestamp, level, component and first message token in this template."""
    t = template.split(" ") if template else []
    none = ("text", None, None, None, None)
    n = len(t)
    at = lambda i: t[i] if i < n else ""
    name = lambda i: i < n and (at(i) in ("<*>", "<A>", "<N>", "<LVL>") or _is_word(at(i)))
    if not t:
        return none
    if t[0] == "<IND>":
        if n >= 4 and t[1].startswith('"') and t[2] == ":":
            key = t[1].strip('"').lower()
            for kind, keys in (("ts", TIME_KEYS), ("level", LEVEL_KEYS), ("component", COMPONENT_KEYS), ("message", MESSAGE_KEYS)):
                if key in keys:
                    return (f"member_{kind}", 3, 3, 3, 3)
        return none
    if t[0] == "{":
        if n == 1:
            return ("open", None, None, None, None)
        where: dict[str, int] = {}
        for i in range(1, n - 1):
            if t[i].startswith('"') and t[i + 1] == ":" and i + 2 < n:
                key = t[i].strip('"').lower()
                for kind, keys in (("ts", TIME_KEYS), ("level", LEVEL_KEYS), ("component", COMPONENT_KEYS), ("message", MESSAGE_KEYS)):
                    if key in keys:
                        where.setdefault(kind, i + 2)
        if "ts" in where and at(where["ts"]) in ("<QTS>", "<N>", "<A>"):
            return ("entry", where["ts"], where.get("level"), where.get("component"), where.get("message"))
        return none
    if name(0) and at(1) == "=":
        where = {}
        i = 0
        while i + 2 < n and name(i) and at(i + 1) == "=":
            for kind, keys in (("ts", TIME_KEYS), ("level", LEVEL_KEYS), ("component", COMPONENT_KEYS), ("message", MESSAGE_KEYS)):
                if at(i) in keys:
                    where.setdefault(kind, i + 2)
            i += 3
        if where.get("ts") == 2 and at(2) in ("<TS>", "<QTS>", "<EPOCH>"):
            return ("entry", 2, where.get("level"), where.get("component"), where.get("message"))
        return none
    if t[0] == "<GLOG>":
        if n >= 6 and at(3) == ":" and at(5) == "]":
            return ("entry", 0, 0, 2, 6)
        return ("entry", 0, 0, None, 1)
    if t[0] == "<PRI>":
        if at(1) == "<TS>":
            return ("entry", 1, 0, 3, 7 if (at(5), at(6)) == ("-", "-") else 5)
        if at(1) == "<SYSLOG>":
            i = 4
            if at(4) == "[":
                i = 7
            return ("entry", 1, 0, 3, i + 1)
        return none
    if t[0] == "<SYSLOG>":
        for i in (2, 1):
            if name(i):
                end = i + 1
                if at(end) == "[" and at(end + 2) == "]":
                    end += 3
                if at(end) == ":":
                    level = end + 1 if at(end + 1) == "<LVL>" else None
                    return ("entry", 0, level, i, end + 1 + (level is not None))
        return ("entry", 0, None, None, 2)
    if t[0] == "<LVL>" and at(1) == ":" and at(2) in ("<TOD>", "<TS>") and at(3) == "|":
        if name(4) and at(5) == "|":
            return ("entry", 2, 0, 4, 6)
        return ("entry", 2, 0, None, 4)
    if t[0] == "[" and at(1) in ("<TS>", "<TOD>") and at(2) == "]":
        i, level, component = 3, None, None
        if at(i) == "[" and at(i + 1) == "<LVL>" and at(i + 2) == "]":
            level, i = i + 1, i + 3
        elif at(i) == "<LVL>":
            level, i = i, i + 1
        if at(i) == "[" and name(i + 1) and at(i + 2) == "]":
            component, i = i + 1, i + 3
        return ("entry", 1, level, component, i)
    if t[0] in ("<TS>", "<TOD>", "<EPOCH>"):
        if at(1) == "-" and name(2) and at(3) == "-" and at(4) == "<LVL>" and at(5) == "-":
            return ("entry", 0, 4, 2, 6)
        if at(1) == ";" and at(2) == "<LVL>" and at(3) == ";":
            return ("entry", 0, 2, 4 if name(4) and at(5) == ";" else None, 6 if name(4) and at(5) == ";" else 4)
        i, level, component = 1, None, None
        if at(1) == "[":
            close = t.index("]", 1) if "]" in t[1:] else 0
            if close and at(close + 1) == "<LVL>":
                i = close + 1
                if name(i + 1) and at(i + 2) == "-":
                    return ("entry", 0, i, i + 1, i + 3)
        if at(i) == "<LVL>":
            level, i = i, i + 1
        if name(i) and at(i + 1) == ":":
            component, i = i, i + 2
        return ("entry", 0, level, component, i)
    return none


def _grow_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaf after leaf of a partition sorted by route, the most frequent lines of a leaf first."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from batch.itertuples(index=False, name=None)

    out: list[tuple] = []

    def frame() -> pd.DataFrame:
        made = pd.DataFrame(out, columns=_ROLE.names)
        for c in _ROLE.names[3:]:
            made[c] = made[c].astype("Int32")
        out.clear()
        return made

    for _, leaf in groupby(rows(), key=lambda r: r[:3]):
        masks = [r[4] for r in leaf]
        out.extend((m, x, *map_fields(x)) for m, x in zip(masks, merge_templates(masks)))
        if len(out) > 20_000:
            yield frame()
    if out:
        yield frame()


def lexed_lines(lines: DataFrame, block_lines: int = BLOCK_LINES, with_line: bool = True) -> DataFrame:
    """Each line once, lexed, held together by (file, block)."""
    slim = lines.select("file", "line_no", "line").withColumn("_block", F.floor(F.col("line_no") / block_lines)).repartition("file", "_block")
    once = slim.groupBy("file", "_block", "line_no").agg(F.max("line").alias("line"))
    return once.withColumn("lex", _lex_udf(F.coalesce("line", F.lit("")))).select("file", "_block", "line_no", *(["line"] if with_line else []), "lex.*")


def template_roles(lexed: DataFrame) -> DataFrame:
    """Distinct masked lines with their template and field positions, from a tree grown on all lines."""
    counts = lexed.where("not blank").groupBy("mask").agg(F.count("*").alias("n"))
    parts = F.split("mask", " ")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    routed = counts.select(F.size(parts).alias("width"), part(1).alias("first"), part(2).alias("second"), "n", "mask")
    route = ["width", "first", "second"]
    return routed.repartition(*route).sortWithinPartitions(*route, F.desc("n"), "mask").mapInPandas(_grow_leaves, _ROLE)


def _level(raw: Column) -> Column:
    levels = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    letter = F.create_map(*[F.lit(x) for pair in (("D", "debug"), ("I", "info"), ("W", "warning"), ("E", "error"), ("F", "critical")) for x in pair])
    priority = F.regexp_extract(raw, r"^<(\d+)>", 1).try_cast("int") % 8
    from_priority = F.when(priority <= 2, "critical").when(priority == 3, "error").when(priority == 4, "warning").when(priority <= 6, "info").otherwise("debug")
    return (
        F.when(raw.startswith("<"), from_priority)
        .when(raw.rlike(r"^[DIWEF]\d{4} "), F.try_element_at(letter, F.substring(raw, 1, 1)))
        .otherwise(F.coalesce(F.try_element_at(levels, F.lower(F.translate(raw, '"', ""))), F.lit("info")))
    )


def parsed_lines(lines: DataFrame, block_lines: int = BLOCK_LINES, full: bool = True) -> DataFrame:
    """Per line its role and fields, before lines are joined to entries; line, template and message only in ``full``."""
    lexed = stored(lexed_lines(lines, block_lines, full))
    roles = template_roles(lexed)
    # blank lines have no mask; so that they do not meet in one task, each takes one of many names that no mask has
    lexed = lexed.withColumn("mask", F.when(F.col("blank"), F.concat(F.lit(" "), (F.col("line_no") % 256).cast("string"))).otherwise(F.col("mask")))
    field = lambda at: F.when(F.col(at).isNotNull(), F.try_element_at(F.col("tokens"), F.col(at) + 1))
    joined = lexed.join(roles, "mask", "left").withColumn("tokens", F.when(F.col("kind") != "text", F.split("tokens", BETWEEN)))
    more = [] if not full else ["line", "template", F.array_join(F.slice("tokens", F.coalesce(F.col("message_at"), F.lit(0)) + 1, F.size("tokens")), " ").alias("message_tokens")]
    return joined.select(
        "file", "_block", "line_no", "blank", "labelled",
        F.coalesce(F.when(~F.col("blank"), F.col("kind")), F.lit("text")).alias("kind"),
        field("ts_at").alias("ts_raw"),
        field("level_at").alias("level_raw"),
        F.regexp_replace(field("component_at"), '^"|"$', "").alias("component"),
        *more,
    )


def owned_lines(once: DataFrame) -> DataFrame:
    """Adds ``line_start`` of the entry that each line belongs to; null before a file's first entry."""
    header = F.col("kind").isin("entry", "open")
    once = once.repartition("file", "_block")
    in_block = Window.partitionBy("file", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = once.select(
        "*",
        F.last(F.when(header & ~F.col("labelled"), F.col("line_no")), ignorenulls=True).over(in_block).alias("_plain"),
        F.last(F.when(header, F.col("line_no")), ignorenulls=True).over(in_block).alias("_any"),
    )
    ends = marked.groupBy("file", "_block").agg(
        F.max("_plain").alias("plain_end"),
        F.max("_any").alias("any_end"),
        F.count_if(~F.col("blank")).alias("texts"),
        F.count_if(~F.col("blank") & F.col("labelled")).alias("labels"),
    )
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    carried = ends.select(
        "file",
        "_block",
        F.max("plain_end").over(before).alias("_plain_before"),
        F.max("any_end").over(before).alias("_any_before"),
        (F.sum("texts").over(whole) == F.sum("labels").over(whole)).alias("_collected"),
    )
    start = F.when(F.col("_collected"), F.coalesce("_any", "_any_before")).otherwise(F.coalesce("_plain", "_plain_before"))
    return marked.join(carried, ["file", "_block"]).withColumn("line_start", start)


def log_entries(lines: DataFrame, block_lines: int = BLOCK_LINES, full: bool = True) -> DataFrame:
    """One row per entry: file, line_start, line_end, timestamp_raw, severity_raw, severity, component, message, template
    and the number of continuation lines; message and template only in ``full``."""
    owned = owned_lines(parsed_lines(lines, block_lines, full)).where("line_start is not null")
    own = F.col("line_no") == F.col("line_start")
    words = ["message_tokens"] if full else []
    member = lambda kind: F.min(F.when(F.col("kind") == f"member_{kind}", F.struct("line_no", "level_raw", "ts_raw", "component", *words)))
    per = owned.groupBy("file", "line_start").agg(
        F.max(F.when(~F.col("blank"), F.col("line_no"))).alias("line_end"),
        F.count_if(~F.col("blank") & ~own).alias("continuation_count"),
        F.max(F.when(own, F.struct("kind", "ts_raw", "level_raw", "component", *words, *(["template"] if full else [])))).alias("h"),
        member("level").alias("ml"),
        member("component").alias("mc"),
        member("ts").alias("mt"),
        *([member("message").alias("mm")] if full else []),
    )
    is_open = F.col("h.kind") == "open"
    level = F.when(is_open, F.col("ml.level_raw")).otherwise(F.col("h.level_raw"))
    bare = lambda c: F.regexp_replace(c, '^"|"$', "")
    return per.select(
        "file",
        "line_start",
        "line_end",
        bare(F.when(is_open, F.col("mt.ts_raw")).otherwise(F.col("h.ts_raw"))).alias("timestamp_raw"),
        bare(level).alias("severity_raw"),
        _level(F.coalesce(level, F.lit(""))).alias("severity"),
        F.coalesce(F.when(is_open, F.col("mc.component")).otherwise(F.col("h.component")), F.lit("")).alias("component"),
        *([F.when(is_open, F.col("mm.message_tokens")).otherwise(F.col("h.message_tokens")).alias("message"), F.col("h.template").alias("template")] if full else []),
        "continuation_count",
    )


def found_entries(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    return log_entries(lines, block_lines, full=False).select("file", "line_start", "line_end", "severity", "component")


def continuation_lines(lines: DataFrame, block_lines: int = BLOCK_LINES, segment: int = 1000) -> DataFrame:
    """Continuation lines of entries as arrays of at most ``segment`` lines, so that no entry is gathered in one row."""
    owned = owned_lines(parsed_lines(lines, block_lines)).where("line_start is not null and line_no > line_start and not blank")
    part = F.floor((F.col("line_no") - F.col("line_start") - 1) / segment)
    gathered = owned.groupBy("file", "line_start", part.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("c"))
    return gathered.select("file", "line_start", "segment", F.col("c.line").alias("continuation_lines"))
