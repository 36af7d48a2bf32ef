import random

import pytest

from tidemark.operators import log_template as lt

LINES = """\tat tail of an entry
2025-01-03 06:16:49,114 - lode.tail - DEBUG - a message
Traceback (most recent call last):
  File "x.py", line 3, in step

ValueError: bad row 3

Jan  3 00:00:04 mast-a idx-merge[2021]: INFO started
Jan  3 00:00:05 mast-a cron: no level
<131>1 2025-01-03T12:18:07.202Z bench7 store 7658 - - failed
W0104 11:12:40.802036  7194 config_loader.cc:126] closed
14:09:35.609 [pool-3-thread-3] ERROR o.l.tail.Lease - dropped | reason=stale
WRN:03:20:00:041|mast-1105|opened code=0134
2025-01-03 00:00:00.014Z warn grouper: limit
    last seen 2025-01-05 14:32:49 ERROR count=2
> 2025-01-04 00:25:13.000 WARN offsets: quoted
[2025-01-03T02:09:56.432Z] [\x1b[32mTRACE\x1b[0m] [scanner] colours
2025-01-05 18:03:16;Info;store;took 3 ms
1736194015 request 7 took 5 ms
0010  77 4b 98 ec 4e 55 c3 33
{"@t": "2025-01-05T07:00:02.446Z", "message": "x ERROR y", "lvl": "FATAL", "logger": "relayd"}
{
  "ts": "2025-01-05T22:22:45.514Z",
  "msg": "m",
  "severity": "wrn",
  "component": "scan.pool"
}
because of it
ts=2025-01-04T18:36:03.647Z lvl=error module=store msg="dropped 35 rows | window=1"
2025-01-07T19:18:13.135 user said "retry now"
""".split("\n")
WANT = [
    (2, 6, "debug", "lode.tail"), (8, 8, "info", "idx-merge"), (9, 9, "info", "cron"), (10, 10, "error", "store"), (11, 11, "warning", "config_loader.cc"),
    (12, 12, "error", "o.l.tail.Lease"), (13, 13, "warning", "mast-1105"), (14, 16, "warning", "grouper"), (17, 17, "debug", "scanner"), (18, 18, "info", "store"),
    (19, 20, "info", ""), (21, 21, "critical", "relayd"), (22, 28, "warning", "scan.pool"), (29, 29, "error", "store"), (30, 30, "info", ""),
]


@pytest.mark.parametrize("block", [3, 8192])
def test_entries(spark, block):
    rows = [("a.log", i + 1, x) for i, x in enumerate(LINES)]
    rows += [("b.log", i + 1, f"svc_1   | {x}\r") for i, x in enumerate(LINES)]
    rows += [("c.log", 1, "no entry here"), ("c.log", 2, None), ("d.log", 1, "edge | 2025-01-07T19:18:13.135 quoted"), ("d.log", 2, "2025-01-07T19:18:13.135 own")]
    rows += rows[:10] + [("a.log", 5, None)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame([(*r, "clash") for r in rows], "file string, line_no int, line string, mask string")
    got = sorted(tuple(r) for r in lt.found_entries(lines, block).collect())
    want = sorted([(f, *w) for f in ("a.log", "b.log") for w in WANT] + [("d.log", 2, 2, "info", "")])
    assert got == want


def test_fields_and_continuations(spark):
    lines = spark.createDataFrame([("a.log", i + 1, x) for i, x in enumerate(LINES)], "file string, line_no int, line string")
    entries = {r["line_start"]: r for r in lt.log_entries(lines).collect()}
    assert entries[2]["timestamp_raw"] == "2025-01-03 06:16:49,114" and entries[2]["continuation_count"] == 3
    assert entries[22]["timestamp_raw"] == "2025-01-05T22:22:45.514Z" and entries[22]["severity_raw"] == "wrn"
    parts = lt.continuation_lines(lines, segment=2).where("line_start = 2").orderBy("segment").collect()
    assert [x for p in parts for x in p["continuation_lines"]] == [LINES[2], LINES[3], LINES[5]]


def test_empty_and_long(spark):
    schema = "file string, line_no int, line string"
    assert lt.found_entries(spark.createDataFrame([], schema)).count() == 0
    long = "2025-01-03 00:00:00.014Z warn grouper: " + "word " * 20_000
    assert lt.found_entries(spark.createDataFrame([("a", 1, long)], schema)).collect()[0][4] == "grouper"


def test_templates_merge_words_only():
    got = lt.merge_templates(["<TS> <LVL> a : took <N> ms", "<TS> <LVL> b : took <N> ms", "<TS> <LVL> b - took <N> ms"])
    assert got[0] == got[1] == "<TS> <LVL> <*> : took <N> ms" or got[1] == "<TS> <LVL> <*> : took <N> ms"
    assert got[2] == "<TS> <LVL> b - took <N> ms"


def test_key_spellings_together(spark):
    rows, want = [], []
    for level in lt.LEVEL_KEYS[:3]:
        for component in lt.COMPONENT_KEYS[:3]:
            for first in (True, False):
                n = len(rows) + 1
                pairs = [f"{level}=warn", f"{component}=part-{'abc'[n % 3]}"]
                a, b = pairs if first else reversed(pairs)
                rows.append(("a.log", n, f'ts=2025-01-04T18:36:03.647Z {a} {b} msg="took 3 ms"'))
                want.append(("a.log", n, n, "warning", f"part-{'abc'[n % 3]}"))
    lines = spark.createDataFrame(rows, "file string, line_no int, line string")
    assert sorted(tuple(r) for r in lt.found_entries(lines).collect()) == want
