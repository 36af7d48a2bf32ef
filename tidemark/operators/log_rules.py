"""Rule-driven log processing: line filters, prioritised patterns, continuation lines, transforms, runs and groups.

Rules compile to Column expressions when the plan is built; only grouping by rules folds events in Python, segment by
segment. Null lines and messages count as empty; lines that match no pattern continue the event before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FilterRule, GroupRule, LogPattern, LogSettings, Source, Transform
from tidemark.functions.levels import rank, severity
from tidemark.functions.rx import replacement, translate
from tidemark.functions.text import is_blank
from tidemark.operators.ordered import with_last, with_previous
from tidemark.operators.timestamps import OPENING_STAMP, file_date, utc_micros

FIELDS = ("timestamp", "severity", "message", "device_id", "command_name", "error_code")


def line_filter(line: Column, rules: list[FilterRule], default: bool = True) -> Column:
    """Whether a line is kept: the first rule by priority that matches decides."""
    out = F.lit(default)
    for rule in reversed(sorted(rules, key=lambda r: r.priority)):
        out = F.when(line.rlike(translate(rule.regex).java), F.lit(rule.include)).otherwise(out)
    return out


def severity_gate(line: Column, allowed: list[str]) -> Column:
    """The text before the first colon is one of these; lines without one are out; no set lets all pass."""
    if not allowed:
        return F.lit(True)
    return (F.locate(":", line) > 1) & F.substring_index(line, ":", 1).isin(allowed)


def match_pattern(line: Column, patterns: list[LogPattern]) -> Column:
    """Name of the first pattern by priority that matches; null for none."""
    out = F.lit(None).cast("string")
    for p in reversed(sorted(patterns, key=lambda p: p.priority)):
        out = F.when(line.rlike(translate(p.regex).java), p.name).otherwise(out)
    return out


def extract_fields(lines: DataFrame, patterns: list[LogPattern], line: str = "line") -> DataFrame:
    """Adds pattern_name, event_type and the named fields; groups a pattern lacks are empty."""
    matched = lines.withColumn("pattern_name", match_pattern(F.col(line), patterns))
    columns = {}
    for name in FIELDS:
        value = F.lit(None).cast("string")
        for p in patterns:
            java, groups = translate(p.regex)
            got = F.regexp_extract(line, java, groups[name]) if name in groups else F.lit("")
            value = F.when(F.col("pattern_name") == p.name, got).otherwise(value)
        columns["timestamp_raw" if name == "timestamp" else "severity_raw" if name == "severity" else name] = value
    kind = F.lit(None).cast("string")
    for p in patterns:
        kind = F.when(F.col("pattern_name") == p.name, p.event_type).otherwise(kind)
    return matched.withColumns(columns | {"event_type": kind})


def attach_continuations(lines: DataFrame, most: int = 500) -> DataFrame:
    """(file, line_no of the event, continuation_count) over lines with ``pattern_name``; blank lines are skipped.

    Lines before the first event are dropped, and so are lines beyond ``most`` for one event.
    """
    live = lines.where(F.col("pattern_name").isNotNull() | ~is_blank(F.coalesce("line", F.lit(""))))
    owned = with_last(live.withColumn("_event", F.col("pattern_name").isNotNull()), "file", "line_no", "_event", "owner")
    per = owned.where("owner is not null").groupBy("file", "owner").agg(F.count_if(~F.col("_event")).alias("n"))
    return per.select("file", F.col("owner").alias("line_no"), F.least("n", F.lit(most)).alias("continuation_count"))


def continuation_lines(lines: DataFrame, most: int = 500) -> DataFrame:
    """(file, line_no of the event, continuation_lines) over lines with ``pattern_name``, the first ``most`` of each event.

    Blank lines are skipped, lines before the first event dropped; events without such lines have an empty array.
    """
    live = lines.where(F.col("pattern_name").isNotNull() | ~is_blank(F.coalesce("line", F.lit(""))))
    owned = with_last(live.withColumn("_event", F.col("pattern_name").isNotNull()), "file", "line_no", "_event", "owner").where("owner is not null")
    place = F.row_number().over(Window.partitionBy("file", "owner").orderBy("line_no"))
    near = owned.select("file", "owner", "line_no", "line", "_event", place.alias("_n")).where(F.col("_n") <= most + 1)
    per = near.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.when(~F.col("_event"), F.struct("line_no", "line")))).alias("c"))
    return per.select("file", F.col("owner").alias("line_no"), F.col("c.line").alias("continuation_lines"))


def full_text(message: Column, continuation: Column) -> Column:
    """A message with its continuation lines below it, as transforms see it."""
    below = F.when(F.size(continuation) > 0, F.concat(F.lit("\n"), F.array_join(continuation, "\n")))
    return F.concat(F.coalesce(message, F.lit("")), F.coalesce(below, F.lit("")))


def fallback_filter(lines: DataFrame, detect: str, rules: list[FilterRule], more: list[FilterRule], default: bool = True) -> DataFrame:
    """Lines kept by the rules, and in files no line of which matches ``detect`` by the further rules as well."""
    known = lines.groupBy("file").agg(F.max(F.coalesce(F.col("line"), F.lit("")).rlike(translate(detect).java)).alias("_known"))
    line = F.coalesce(F.col("line"), F.lit(""))
    kept = F.when(F.col("_known"), line_filter(line, rules, default)).otherwise(line_filter(line, [*rules, *more], default))
    return lines.join(known, "file").where(kept).drop("_known")


def parse_events(lines: DataFrame, patterns: list[LogPattern], settings: LogSettings = LogSettings(), rules: list[FilterRule] = (), levels: dict[str, str] | None = None) -> DataFrame:
    """Lines to events: filtered, matched, their fields extracted, continuation lines attached, level normalised."""
    kept = lines.where(line_filter(F.coalesce("line", F.lit("")), list(rules))) if rules else lines
    matched = extract_fields(kept, patterns)
    with_lines = continuation_lines(matched, settings.max_continuation_lines)
    events = matched.where("pattern_name is not null").join(with_lines, ["file", "line_no"])
    return events.withColumn("severity", severity(F.col("severity_raw"), levels)).drop("line")


def normalized_stamp(raw: Column, file: Column, now: Column) -> Column:
    """Instant of a stamp at second precision; stamps without zone are UTC, unreadable ones take ``now``."""
    micros = utc_micros(raw, None, file_date(file), now)["earliest"]
    return F.coalesce(F.timestamp_seconds(F.floor(micros / 1_000_000)), now)


def apply_transform(text: Column, t: Transform) -> Column:
    java, groups = translate(t.regex)
    hit = text.rlike(java)
    if t.kind == "extract":
        wanted = [F.regexp_extract(text, java, groups[f]) for f in t.fields if f in groups]
        parts = F.filter(F.array(*wanted), lambda x: x != "") if wanted else F.array().cast("array<string>")
        return F.when(hit, F.array_join(parts, " ")).otherwise(text)
    if t.kind == "replace":
        return F.when(hit, F.regexp_replace(text, java, replacement(t.replacement, groups))).otherwise(text)
    if t.kind == "strip":
        return F.regexp_replace(text, java, "")
    if t.kind == "collapse" and t.max_length is not None:
        found = F.regexp_substr(text, F.lit(java))
        at = F.regexp_instr(text, F.lit(java))
        gone = F.length(found) - t.max_length
        head, _, tail = t.annotation.partition("{byte_count}")
        note = F.concat(F.lit(head), gone.cast("string"), F.lit(tail)) if "{byte_count}" in t.annotation else F.lit(t.annotation)
        short = F.concat(F.substring(text, F.lit(1), at - 1 + t.max_length), note, F.substring(text, at + F.length(found), F.length(text)))
        return F.when(hit & (gone > 0), short).otherwise(text)
    return text


def apply_chain(text: Column, transforms: list[Transform]) -> Column:
    for t in sorted(transforms, key=lambda t: t.priority):
        text = apply_transform(text, t)
    return text


def comparable(message: Column) -> Column:
    """A message without one leading stamp."""
    return F.regexp_replace(F.coalesce(message, F.lit("")), OPENING_STAMP, "")


def runs(events: DataFrame) -> DataFrame:
    """Adds ``run_start``, the line of the first event of each run of comparable messages in a file."""
    keyed = with_previous(events.withColumn("_key", comparable(F.col("message"))), "file", "line_no", "_key", "_previous")
    flagged = keyed.withColumn("_first", F.col("_previous").isNull() | (F.col("_previous") != F.col("_key")))
    return with_last(flagged, "file", "line_no", "_first", "run_start").drop("_previous", "_first", "_key")


def deduplicated(events: DataFrame, threshold: int = 3) -> DataFrame:
    """(file, line_no, message, n): the first event of runs of at least ``threshold``, every other event singly."""
    marked = runs(events)
    sizes = marked.groupBy("file", "run_start").agg(F.count("*").alias("_size"))
    joined = marked.join(sizes, ["file", "run_start"])
    long_run = F.col("_size") >= threshold
    kept = joined.where(~long_run | (F.col("line_no") == F.col("run_start")))
    return kept.withColumn("n", F.when(long_run, F.col("_size")).otherwise(1).cast("int")).drop("_size", "run_start")


def group_events(events: DataFrame, rules: list[GroupRule], settings: LogSettings = LogSettings()) -> DataFrame:
    """(file, line_start, line_end, rule, n_events) of deduplicated events that carry file, line_no, second, and text.

    Without rules every event is its own group and no Python runs. With rules an event no continuation matches is a
    hard boundary; segments between boundaries are folded one by one.
    """
    if not rules:
        return events.select("file", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.lit(None).cast("string").alias("rule"), F.lit(1).alias("n_events"))
    opened = lambda r: F.col("text").rlike(translate(r.start).java)
    goes_on = [(i, c) for i, r in enumerate(rules) for c in (r.continuation or ("",))]
    flags = events.withColumns(
        {"_rule": F.coalesce(*[F.when(opened(r), F.lit(i)) for i, r in enumerate(rules)], F.lit(-1)), "_on": F.array(*[F.when(F.col("text").rlike(translate(c).java) if c else F.lit(True), F.lit(i)) for i, c in goes_on])}
    )
    anywhere = F.exists("_on", lambda x: x.isNotNull())
    widest = max(r.time_window_ms or settings.time_window_ms for r in rules)
    spaced = with_previous(flags, "file", "line_no", "second", "_second_before")
    boundary = ~anywhere | F.col("_second_before").isNull() | ((F.col("second") - F.col("_second_before")) * 1000 > widest)
    segments = with_last(spaced.withColumn("_boundary", boundary), "file", "line_no", "_boundary", "segment")
    windows = [r.time_window_ms or settings.time_window_ms for r in rules]
    names = [r.name for r in rules]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: list | None = None
        where: tuple | None = None
        out: list[tuple] = []
        for batch in batches:
            for file, segment, line, second, rule, on in batch.itertuples(index=False, name=None):
                joins = group is not None and where == (file, segment) and group[3] >= 0 and group[4] < settings.max_group_lines
                if joins and not (pd.isna(second) or pd.isna(group[5])) and (second - group[5]) * 1000 > windows[group[3]]:
                    joins = False
                if joins and group[3] in [x for x in on if x is not None]:
                    group[2], group[4] = line, group[4] + 1
                    continue
                if group is not None:
                    out.append((group[0], group[1], group[2], names[group[3]] if group[3] >= 0 else None, group[4]))
                group, where = [file, line, line, rule, 1, second], (file, segment)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["file", "line_start", "line_end", "rule", "n_events"])
                out = []
        if group is not None:
            out.append((group[0], group[1], group[2], names[group[3]] if group[3] >= 0 else None, group[4]))
        yield pd.DataFrame(out, columns=["file", "line_start", "line_end", "rule", "n_events"])

    slim = segments.select("file", "segment", "line_no", "second", "_rule", "_on").repartition("file", "segment").sortWithinPartitions("file", "segment", "line_no")
    return slim.mapInPandas(fold, "file string, line_start int, line_end int, rule string, n_events int")


def with_groups(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Events with ``line_start`` of the group that each belongs to; groups are consecutive stretches of a file."""
    starts = groups.select("file", F.col("line_start").cast("int").alias("line_no"), F.lit(True).alias("_start"))
    return with_last(events.join(starts, ["file", "line_no"], "left").withColumn("_start", F.coalesce("_start", F.lit(False))), "file", "line_no", "_start", "line_start").drop("_start")


def group_rows(events: DataFrame) -> DataFrame:
    """One row per (file, line_start) of events with line_no, message, n, continuation_lines, timestamp_iso, severity,
    device_id, error_code and event_type.

    The worst level counts, the first of equals; code and device are the first that are not empty; the type is that of
    the first event; a repeated message shows its count; ``line_end`` takes in the continuation lines of the last event.
    """
    filled = lambda c: F.min_by(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("line_no")))
    size = F.greatest(F.lit(0), F.coalesce(F.size("continuation_lines"), F.lit(0)))
    message = F.coalesce("message", F.lit(""))
    per = events.groupBy("file", "line_start").agg(
        F.max_by(F.col("line_no") + size, "line_no").alias("line_end"),
        F.min("timestamp_iso").alias("timestamp_start"),
        F.max("timestamp_iso").alias("timestamp_end"),
        F.max_by("severity", F.struct(rank(F.col("severity")), -F.col("line_no"))).alias("severity"),
        F.coalesce(filled("device_id"), F.lit("")).alias("device_id"),
        F.coalesce(filled("error_code"), F.lit("")).alias("error_code"),
        F.min_by("event_type", "line_no").alias("event_type"),
        F.array_sort(F.collect_list(F.struct("line_no", message.alias("message"), "n", F.coalesce("continuation_lines", F.array().cast("array<string>")).alias("below")))).alias("_e"),
    )
    repeated = F.filter("_e", lambda e: e["n"] > 1)
    counts = F.map_from_entries(F.transform(F.array_distinct(F.transform(repeated, lambda e: e["message"])), lambda m: F.struct(m, F.element_at(F.filter(repeated, lambda e: e["message"] == m), -1)["n"].cast("int"))))
    said = F.transform("_e", lambda e: full_text(F.concat(e["message"], F.coalesce(F.concat(F.lit(" [repeated "), F.try_element_at(F.col("dedup_counts"), e["message"]).cast("string"), F.lit("x]")), F.lit(""))), e["below"]))
    return per.withColumn("dedup_counts", counts).withColumn("text", F.array_join(said, "\n")).withColumn("n_events", F.size("_e")).drop("_e")


def index_source(lines: DataFrame, source: Source, settings: LogSettings = LogSettings(), since: str | None = None, until: str | None = None) -> DataFrame:
    """``index_log_lines`` with the patterns and rules that a configured source names; its own settings come first."""
    own = source.log_settings or settings
    if own.fallback_detect:
        lines = fallback_filter(lines, own.fallback_detect, list(own.line_filters), list(own.fallback_filters), own.keep_unmatched)
    return index_log_lines(lines, list(source.log_patterns), own, own.line_filters, own.transforms, own.group_rules, dict(own.severity_map), since, until, own.event_filters)


def index_log_lines(
    lines: DataFrame, patterns: list[LogPattern], settings: LogSettings = LogSettings(), filters: list[FilterRule] = (), transforms: list[Transform] = (),
    groups: list[GroupRule] = (), levels: dict[str, str] | None = None, since: str | None = None, until: str | None = None, event_filters: list[FilterRule] = (),
) -> DataFrame:
    """Raw lines (file, line_no, line) to one row per group with its ``id``, ready to be upserted by it.

    ``since`` and ``until`` bound the time of day. Lines become events, events are transformed with their continuation
    lines, runs of the same message become one, and rules group what is left.
    """
    events = parse_events(lines, patterns, settings, filters, levels)
    stamp = utc_micros(F.col("timestamp_raw"), None, file_date(F.col("file")))["earliest"]
    events = events.withColumn("_us", stamp).withColumn("timestamp_iso", F.date_format(F.timestamp_micros("_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    time = F.substring("timestamp_iso", 12, 12)
    if since is not None:
        events = events.where(time >= since)
    if until is not None:
        events = events.where(time <= until)
    if event_filters:
        events = events.where(line_filter(F.coalesce("message", F.lit("")), list(event_filters)))
    text = apply_chain(full_text(F.col("message"), F.col("continuation_lines")), list(transforms))
    ready = events.withColumn("message", text).withColumn("continuation_lines", F.array().cast("array<string>"))
    once = deduplicated(ready, settings.dedup_threshold)
    joined = once.withColumn("text", F.concat_ws("|", "pattern_name", F.coalesce("command_name", F.lit("")), "event_type", "message")).withColumn("second", F.floor(F.col("_us") / 1_000) / 1_000)
    rows = group_rows(with_groups(joined, group_events(joined.select("file", "line_no", "second", "text"), list(groups), settings)))
    return rows.withColumn("id", F.concat(F.col("file"), F.lit("::line_"), F.col("line_start").cast("string")))


def group_aggregates(groups: DataFrame) -> DataFrame:
    """Line span, worst level (the first of equals), first level and messages of the events of each group."""
    events = groups.where("events is not null").select("group_id", F.posexplode("events").alias("at", "e"))
    level = severity(F.col("e.severity_raw"))
    return events.groupBy("group_id").agg(
        F.min("e.line_no").alias("line_start"),
        F.max("e.line_no").alias("line_end"),
        F.max_by(level, F.struct(rank(level), -F.col("at"))).alias("severity"),
        F.count("*").alias("n_events"),
        F.countDistinct("e.message").alias("n_messages"),
    )


def group_text(groups: DataFrame) -> DataFrame:
    """Messages of a group line by line, with the count of repeated ones."""

    def line(e: Column) -> Column:
        n = F.try_element_at(F.col("dedup_counts"), e["message"])
        return F.concat(F.coalesce(e["message"], F.lit("")), F.when(n.isNotNull(), F.concat(F.lit(" [repeated "), n.cast("string"), F.lit("x]"))).otherwise(""))

    return groups.where("events is not null").select("group_id", F.array_join(F.transform("events", line), "\n").alias("text"))
