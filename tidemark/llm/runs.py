"""Runs of the same or nearly the same consecutive event, each collapsed to one with its count and duration.

The events of one entity form a linked list of runs; a priority queue holds every pair of neighbours whose messages are
alike enough and whose gap is within the limit, and the most alike pair is merged until the queue is empty.

Defined results: events stand in line_no order, one per line_no (of several the greatest message); events without
line_no are left out; a null or blank message is like no other; a null or empty list gives no runs; ties merge from the
left. Groups stay whole rows, so copies under another group_id give their own runs. Unreadable stamps count as no gap
and add nothing to a duration.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.timestamps import file_date, resolve, stamp_mask, with_zone
from tidemark.session import spread

_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_TIMES = re.compile(
    rf"\d{{4}}[-/]\d\d[-/]\d\d[t ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?: ?z\b| ?[+-]\d\d:?\d\d)?|\d{{8}}t\d{{6}}z?|{_MONTH} +\d\d? \d\d:\d\d:\d\d"
    rf"|\d\d?[-/. ](?:\d\d|{_MONTH})[-/. ]\d{{4}}(?:[: ]\d\d:\d\d:\d\d)?|\d\d?:\d\d(?::\d\d(?:[:.,]\d+)?)?(?: ?[ap]m\b)?"
)
_WORDS, _DIGITS = re.compile(r"[^\W_]+"), re.compile(r"\d+")
_MAYBE_TIME = re.compile(r":\d\d|\d{4}")  # no time is without
_ID = re.compile(r"(?:0x)?[0-9a-f]*\d[0-9a-f]*|0x[0-9a-f]+")
_RUN_FIELDS = "run_no int, line_start int, line_end int, message string, n int, start_us bigint, end_us bigint, same_words boolean"


def message_words(message: str | None) -> tuple[str, ...] | None:
    """The words of a message that count: no embedded times, numbers, identifiers, case, spacing or punctuation."""
    if message is None or not message.strip():
        return None
    text = message.lower()
    if _MAYBE_TIME.search(text):
        text = _TIMES.sub(" ", text)
    words = (w for w in _WORDS.findall(text) if not _ID.fullmatch(w))
    return tuple(w for w in (_DIGITS.sub("", x) if not x.isalpha() else x for x in words) if w)


def likeness(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> float:
    """Twice the longest common subsequence of words over the words of both; 1 only for equal sequences."""
    if a is None or b is None:
        return -1.0
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            above = row[j + 1]
            row[j + 1] = left + 1 if x == y else max(above, row[j])
            left = above
    return 2 * row[-1] / (len(a) + len(b))


def agglomerate(words: list, starts: list, ends: list, similarity: float, max_gap_us: float | None) -> list[tuple[int, int]]:
    """Spans (first, last) of the runs after merging neighbours, most alike first."""
    n = len(words)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    last, size, version, words = list(range(n)), [1] * n, [0] * n, list(words)
    ends = list(ends)
    queue: list[tuple[float, int, int, int, int]] = []

    def push(i: int) -> None:
        j = nxt[i]
        if i < 0 or j >= n:
            return
        score = likeness(words[i], words[j])
        if score < similarity:
            return
        if max_gap_us is not None and not np.isnan(ends[i]) and not np.isnan(starts[j]) and starts[j] - ends[i] > max_gap_us:
            return
        heapq.heappush(queue, (-score, i, j, version[i], version[j]))

    for i in range(n - 1):
        push(i)
    while queue:
        _, i, j, vi, vj = heapq.heappop(queue)
        if nxt[i] != j or version[i] != vi or version[j] != vj:
            continue
        if size[j] > size[i]:
            words[i] = words[j]
        size[i] += size[j]
        last[i], nxt[i] = last[j], nxt[j]
        ends[i] = ends[i] if np.isnan(ends[j]) else ends[j]
        version[i] += 1
        version[j] += 1
        if nxt[i] < n:
            prev[nxt[i]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    spans, i = [], 0
    while i < n:
        spans.append((i, last[i]))
        i = nxt[i]
    return spans


def event_runs(groups: DataFrame, devices: DataFrame, similarity: float = 0.8, max_gap_seconds: float | None = 3600.0) -> DataFrame:
    """One row per run of each group: its span of lines, first message, count and first and last instant."""
    masks = F.transform("events", lambda e: stamp_mask(e["timestamp_raw"]))
    trim = F.transform("events", lambda e: F.regexp_replace(e["timestamp_raw"], r"^\s+|\s+$", ""))
    slim = with_zone(spread(groups).select("group_id", "file", "events", "indexed_at"), devices).select(
        "group_id",
        "_zone",
        F.datediff(file_date(F.col("file")), F.lit("1970-01-01").cast("date")).cast("double").alias("day"),
        F.floor(F.unix_micros("indexed_at") / 1_000_000).cast("double").alias("ref"),
        F.col("events.line_no").alias("lines"),
        F.col("events.message").alias("messages"),
        trim.alias("stamps"),
        masks.alias("masks"),
    )
    gap = None if max_gap_seconds is None else max_gap_seconds * 1e6
    columns = ["group_id", "run_no", "line_start", "line_end", "message", "n", "start_us", "end_us", "same_words"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            batch = batch[batch["lines"].notna()]
            sizes = [len(x) for x in batch["lines"]]
            if sum(sizes):
                flat = lambda c: np.array([v for x in batch[c] for v in x], dtype=object)
                stamps, marks = flat("stamps"), flat("masks")
                live = np.array([m is not None and m != "" for m in marks])
                times = np.full(len(live), np.nan)
                each = lambda c: np.repeat(batch[c].to_numpy(), sizes)[live]
                if live.any():
                    times[live] = resolve(stamps[live], marks[live], each("_zone"), each("day").astype(float), each("ref").astype(float))[0]
                at = 0
                for group, lines, messages in zip(batch["group_id"], batch["lines"], batch["messages"]):
                    span = range(at, at + len(lines))
                    at += len(lines)
                    by_line: dict = {}
                    for line, message, k in zip(lines, messages, span):
                        if line is not None and not pd.isna(line):
                            key = (message is not None, message or "")
                            if line not in by_line or key > by_line[line][0]:
                                by_line[line] = (key, message, times[k])
                    order = sorted(by_line)
                    texts = [by_line[x][1] for x in order]
                    when = [by_line[x][2] for x in order]
                    words = [message_words(m) for m in texts]
                    for no, (a, b) in enumerate(agglomerate(words, when, when, similarity, gap)):
                        known = [w for w in when[a : b + 1] if not np.isnan(w)]
                        first, final = (int(min(known)), int(max(known))) if known else (None, None)
                        out.append((group, no, int(order[a]), int(order[b]), texts[a], b - a + 1, first, final, len(set(words[a : b + 1])) == 1))
            made = pd.DataFrame(out, columns=columns)
            for c in ("start_us", "end_us"):
                made[c] = made[c].astype("Int64")
            yield made

    return slim.mapInPandas(work, f"group_id bigint, {_RUN_FIELDS}")


def found_runs(groups: DataFrame, devices: DataFrame, least: int = 3) -> DataFrame:
    """Longest runs of at least three events whose messages have the same words in the same order, whatever the gap."""
    runs = event_runs(groups, devices, similarity=1.0, max_gap_seconds=None)
    return runs.where((F.col("n") >= least) & F.col("same_words")).select("group_id", "line_start", "line_end")


def collapsed_groups(groups: DataFrame, devices: DataFrame, similarity: float = 0.8, max_gap_seconds: float | None = 3600.0) -> DataFrame:
    """Groups with one event per run: events, dedup_counts of the repeated ones, line_start and line_end."""
    runs = event_runs(groups, devices, similarity, max_gap_seconds)
    event = F.struct("line_start", "line_end", "message", "n", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"))
    per = runs.groupBy("group_id").agg(F.array_sort(F.collect_list(event)).alias("events"), F.min("line_start").alias("first_line"), F.max("line_end").alias("last_line"))
    repeated = F.filter("events", lambda e: (e["n"] > 1) & e["message"].isNotNull())
    counts = F.aggregate(
        repeated,
        F.create_map().cast(T.MapType(T.StringType(), T.IntegerType())),
        lambda acc, e: F.map_concat(
            F.map_filter(acc, lambda k, v: k != e["message"]), F.create_map(e["message"], e["n"] + F.coalesce(F.try_element_at(acc, e["message"]), F.lit(0)))
        ),
    )
    return (
        groups.select("group_id", F.col("line_end").alias("given_end"))
        .join(per, "group_id")
        .select(
            "group_id", F.col("first_line").alias("line_start"), F.greatest("last_line", "given_end").alias("line_end"), "events", counts.alias("dedup_counts")
        )
    )
