import random

import pytest

from tidemark.llm import runs, split

DEVICES = "device_id string, tz_name string"
GROUPS = "group_id bigint, file string, line_end int, events array<struct<line_no int, timestamp_raw string, severity_raw string, message string>>, indexed_at timestamp"


def groups_of(spark, rows):
    return spark.createDataFrame([(i, "p/l/d1/r/x-24-07-01.log", 99, e, None) for i, e in rows], GROUPS)


def ev(*messages, start=1):
    return [(start + i, f"10:00:{i:02d}:000", None, m) for i, m in enumerate(messages)]


def test_words():
    same = ["token 0x2ad9 expired", "TOKEN 8459f9 EXPIRED", " token\t12 expired ...", "2024-12-31T17:36:43Z token 0xbeef expired", "Dec  2 03:29:53 token 1 expired.", "13:50:39:120 token 7 expired!"]
    assert {runs.message_words(m) for m in same} == {("token", "expired")}
    assert runs.message_words("link fed up") == ("link", "fed", "up")
    assert runs.message_words(None) is None and runs.message_words("  ") is None


def test_agglomeration_against_brute_force():
    rng = random.Random(4)
    for _ in range(100):
        words = [tuple(rng.choice("ab") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 30))]
        nan = [float("nan")] * len(words)
        got = runs.agglomerate(words, nan, nan, 1.0, None)
        want, i = [], 0
        while i < len(words):
            j = i
            while j + 1 < len(words) and words[j + 1] == words[i]:
                j += 1
            want.append((i, j))
            i = j + 1
        assert got == want


def test_near_merging_against_brute_force():
    """Always the most alike neighbours within the limits, the left ones of equals, until none is left."""
    rng = random.Random(11)
    for _ in range(60):
        words = [tuple(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 25))]
        times = [float(i * 10 + rng.choice([0, 40])) for i in range(len(words))]
        spans = [[i, i, words[i], 1, times[i], times[i]] for i in range(len(words))]
        while True:
            best = None
            for k, (a, b) in enumerate(zip(spans, spans[1:])):
                score = runs.likeness(a[2], b[2])
                if score >= 0.6 and b[4] - a[5] <= 45 and (best is None or score > best[0]):
                    best = (score, k)
            if best is None:
                break
            a, b = spans[best[1]], spans.pop(best[1] + 1)
            spans[best[1]] = [a[0], b[1], b[2] if b[3] > a[3] else a[2], a[3] + b[3], a[4], b[5]]
        assert runs.agglomerate(words, times, times, 0.6, 45.0) == [(s[0], s[1]) for s in spans]


def test_gap_and_similarity():
    words = [("a", "b", "c", "d"), ("a", "b", "c", "e"), ("x",), ("x",)]
    times = [0.0, 1e6, 2e6, 9e6]
    assert runs.agglomerate(words, times, times, 0.7, 5e6) == [(0, 1), (2, 2), (3, 3)]
    assert runs.agglomerate(words, times, times, 0.7, None) == [(0, 1), (2, 3)]


def test_found(spark):
    devices = spark.createDataFrame([("d1", "UTC")], DEVICES)
    shuffled = ev("a 1", "a 2", "b", "A 3", "a 4.", "a\t5", "c")
    random.Random(1).shuffle(shuffled)
    rows = [(1, shuffled + shuffled[:2]), (2, None), (3, []), (4, ev(None, None, None, "", "")), (5, ev("a", "a", "a")), (5, ev("a", "a", "a"))]
    got = sorted(tuple(r) for r in runs.found_runs(groups_of(spark, rows), devices).collect())
    assert got == [(1, 4, 6), (5, 1, 3), (5, 1, 3)]
    assert runs.found_runs(groups_of(spark, []), devices).count() == 0


def test_collapsed(spark):
    devices = spark.createDataFrame([("d1", "UTC")], DEVICES)
    got = runs.collapsed_groups(groups_of(spark, [(1, ev("a 1", "a 2", "b"))]), devices).first()
    assert [(e["message"], e["n"], e["duration_s"]) for e in got["events"]] == [("a 1", 2, 1.0), ("b", 1, 0.0)]
    assert got["dedup_counts"] == {"a 1": 2} and got["line_end"] == 99


ITEMS = "item_id bigint, content string, size int, overlap int, separators array<string>"


def whole_cuts(text, size, overlap, separators):
    """The cuts of an item seen whole."""
    cutter = split.Cutter(size, overlap)
    cutter.add(0, [split.boundaries(text, s) for s in separators or [] if s], len(text), False)
    rows = cutter.end()
    return [tuple(rows[5 * k : 5 * k + 3]) for k in range(len(rows) // 5)]


@pytest.mark.parametrize("span", [3, 16, 50, 1 << 20])
def test_pieces(spark, span):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        text = "".join(rng.choice(["word ", "x", ". ", "\n", "\n\n", "\n## ", "é", "😀"]) for _ in range(rng.randint(1, 150)))
        size = rng.randint(5, 15)
        rows.append((i, text, size, rng.randint(0, size - 1), ["\n## ", "\n\n", "\n", ". ", " "]))
    rows += [(100, None, 5, 0, []), (101, "  \n", 1, 0, [" "]), (102, "", 5, 0, None), (103, "abcdefghij", 4, 1, []), (104, "abc", 3, 1, ["b"])]
    items = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[0]]], ITEMS + ", blank string")
    by = {}
    for r in split.pieces(items, span).orderBy("item_id", "piece_no").collect():
        by.setdefault(r["item_id"], []).append(r)
    for i, text, size, overlap, separators in rows:
        if not text or text.isspace():
            assert i not in by
            continue
        got = by[i]
        assert [p["piece_no"] for p in got] == list(range(len(got))) and {p["total_pieces"] for p in got} == {len(got)}
        assert all(len(p["content"]) <= size and p["content"] == text[p["start"] : p["stop"]] for p in got)
        assert "".join(p["content"][p["overlap"] :] for p in got) == text
        # the length of ranges changes no cut
        assert [(p["start"], p["start"] + p["overlap"], p["stop"]) for p in got] == whole_cuts(text, size, overlap, separators)
        if len(text) <= size:
            assert len(got) == 1
    want = {i for i, text, size, _, _ in rows if text and not text.isspace() and len(text) > size}
    assert {r["item_id"] for r in split.oversized(items, span).collect()} == want


def test_natural_boundary():
    text = "aaaa bbbb\ncccc dddd"
    assert [text[a:c] for a, _, c in whole_cuts(text, 12, 0, ["\n", " "])] == ["aaaa bbbb\n", "cccc dddd"]


def test_settings(spark):
    config = spark.createDataFrame([("default", 10, 2, [" "]), ("p", None, 3, None), ("q", 5, 9, [","])], "project string, chunk_size int, chunk_overlap int, separators array<string>")
    chunks = spark.createDataFrame([(1, "p", "x" * 11), (2, "q", "x" * 6), (3, None, "x" * 11), (4, "z", "x" * 10), (5, "q", None), (6, "q", " " * 9)], "chunk_id bigint, project string, content string")
    got = {r["item_id"]: tuple(r)[2:] for r in split.with_settings(chunks, config).collect()}
    assert got[1] == (10, 3, [" "]) and got[2] == (5, 4, [","]) and got[3] == (10, 2, [" "])
    assert {r[0] for r in split.found_oversized(chunks, config).collect()} == {1, 2, 3}
    assert split.found_oversized(chunks.limit(0), config.limit(0)).count() == 0


def test_file_by_byte_ranges(spark, tmp_path):
    rng = random.Random(12)
    rows, texts = [], {}
    for i in range(4):
        text = "".join(rng.choice(["wörd ", "x", ". ", "\n", "\n\n", "é", "😀", "索引", "abcdefghijklmnop"]) for _ in range(rng.choice([1, 300, 900])))
        path = tmp_path / f"f{i}.txt"
        path.write_bytes(text.encode())
        texts[path.as_uri()] = text
        rows.append((path.as_uri(), path.stat().st_size))
    (tmp_path / "empty").write_bytes(b"")
    files = spark.createDataFrame([*rows, ((tmp_path / "empty").as_uri(), 0)], "path string, n_bytes bigint")
    for span in (7, 64, 257, 1 << 20):
        by = {}
        for r in split.file_pieces(files, 20, 6, ["\n\n", "\n", ". ", " "], span).orderBy("path", "piece_no").collect():
            by.setdefault(r["path"], []).append(r)
        assert set(by) == {p for p, t in texts.items() if t.strip()}
        for path, got in by.items():
            text, data = texts[path], texts[path].encode()
            assert [p["piece_no"] for p in got] == list(range(len(got)))
            assert "".join(p["content"][p["overlap"] :] for p in got) == text
            assert all(len(p["content"]) <= 20 for p in got)
            assert all(text[p["start"] : p["stop"]] == p["content"] and p["content"][p["overlap"] :] == data[p["byte_start"] : p["byte_stop"]].decode() for p in got)
            assert [(p["start"], p["start"] + p["overlap"], p["stop"]) for p in got] == whole_cuts(text, 20, 6, ["\n\n", "\n", ". ", " "])


def test_found_by_its_pieces(spark, monkeypatch):
    """What is too long is told from the pieces emitted from the stitched cuts, not from a length."""
    rows = [(1, "one two three", 5, 1, [" "]), (2, "one", 5, 1, [" "]), (3, " " * 9, 5, 1, [" "])]
    items = spark.createDataFrame(rows, ITEMS)
    assert [r[0] for r in split.oversized(items, 4).collect()] == [1]
    true_cuts = split.stitched_cuts
    monkeypatch.setattr(split, "stitched_cuts", lambda *a: true_cuts(*a).where("piece_no = 0"))
    assert split.oversized(items, 4).count() == 0
