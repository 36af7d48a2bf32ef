import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import config as cf
from tidemark.functions import text as tx
from tidemark.functions.rx import replacement, translate
from tidemark.operators import catalog, chunking, log_rules, ordered, vectors
from tidemark.plans import reference_queries as rq
from tidemark.sources import files as fs


@pytest.fixture(scope="module")
def duck(data):
    import os

    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(rq.QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    df = rq.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in rq.ORACLES:
        assert got
        return
    cur = duck.execute(rq.ORACLES[name])
    at = [[x[0] for x in cur.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


# -- a row-at-a-time model of the chunker


def model_chunks(text, size, overlap, seps=chunking.SEPARATORS):
    if not text.strip():
        return []
    if len(text) <= size:
        return [text]

    def split(t, seps):
        if not seps:
            return [t[i : i + size] for i in range(0, len(t), size)]
        parts = t.split(seps[0])
        if len(parts) == 1:
            return split(t, seps[1:])
        out = []
        for i, p in enumerate(parts):
            p = (seps[0] + p if i and seps[0].strip() else p).strip()
            if p:
                out += [p] if len(p) <= size else split(p, seps[1:])
        return out

    merged, cur = [], None
    for p in split(text, list(seps)):
        if cur is None:
            cur = p
        elif len(cur) + len(p) + 1 <= size:
            cur += "\n" + p
        else:
            merged.append(cur)
            cur = p
    if cur is not None:
        merged.append(cur)
    out = merged[:1]
    for a, b in zip(merged, merged[1:]):
        tail = a[-overlap:] if overlap else ""
        at = tail.find("\n") if "\n" in tail else tail.find(" ")
        tail = tail[at + 1 :] if at > 0 else tail
        out.append(tail + "\n" + b if tail.strip() else b)
    return out


def test_chunker_against_model(spark):
    rng = random.Random(5)
    alphabet = ["a", "bb", " ", "\n", "\n\n", "\n## ", "\n### ", "é", "😀", "word "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(300)] + ["", "  \n", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for size, overlap in ((20, 5), (37, 10), (60, 0)):
        got = {r[0]: r[1] for r in df.select("id", chunking.chunk_text(F.col("text"), size, overlap)).collect()}
        for i, text in enumerate(texts):
            assert got[i] == model_chunks(text, size, overlap), (size, overlap, text)


def test_blocks_change_nothing(spark):
    rng = random.Random(2)
    rows = [(f, i, rng.choice("abc"), rng.random() < 0.1) for f in "xy" for i in range(200) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "file string, pos int, v string, flag boolean")
    w = Window.partitionBy("file").orderBy("pos")
    want = {(r["file"], r["pos"]): (r["a"], r["b"]) for r in df.select("*", F.lag("v").over(w).alias("a"), F.last(F.when(F.col("flag"), F.col("pos")), True).over(w).alias("b")).collect()}
    for block in (7, 64, 10_000):
        got = ordered.with_last(ordered.with_previous(df, "file", "pos", "v", "a", block), "file", "pos", "flag", "b", block)
        assert {(r["file"], r["pos"]): (r["a"], r["b"]) for r in got.collect()} == want


def test_regex_translation(spark):
    cases = [(r"(?P<error_code>\w+)=(?P<v>\d+)$", "é1=22\n"), (r"(?P<a>x)(?P=a)", "xx"), (r"[$^[]b", "[b")]
    for pattern, text in cases:
        java, groups = translate(pattern)
        hit = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(java)).first()[0]
        assert hit == bool(re.search(pattern, text)) and groups == re.compile(pattern).groupindex
    assert replacement(r"\1 $ \g<v>", {"v": 2}) == r"$1 \$ $2"
    with pytest.raises(ValueError):
        translate(r"(a)?(?(1)b|c)")


def test_config(tmp_path):
    for bad in (dict(name="a b", regex="(?P<timestamp>x)"), dict(name="a", regex="("), dict(name="a", regex="x"), dict(name="a", regex="(?P<timestamp>x)", priority=1000)):
        with pytest.raises(ValueError):
            cf.LogPattern(**bad)
    p = cf.LogPattern("a", "(?P<timestamp>x)")
    with pytest.raises(ValueError):
        cf.Source("*.log", log_patterns=(p, p))
    with pytest.raises(ValueError):
        cf.LogSettings(time_window_ms=9)
    for bad in ("", "/abs", "../up", "C:/x"):
        with pytest.raises(ValueError):
            cf.validate_path(bad)
    assert cf.clamp_k(0) == 1 and cf.clamp_k(99) == 20
    rules = cf.LogSettings(line_filters=(cf.FilterRule("x", False, 3),), transforms=(cf.Transform("strip", "y"),), group_rules=(cf.GroupRule("g", "s", ("c",)),), severity_map=(("E!", "error"),))
    rich = cf.Config(embedding=cf.Embedding(dims=32, instruction="find:"), reranker=cf.Rerank(True), projects=(cf.Project("p", "/x", sources=(cf.Source("*.log", "log", log_patterns=(p,), log_settings=rules),)),))
    cf.save(rich, str(tmp_path / "r.yaml"))
    assert cf.load(str(tmp_path / "r.yaml")) == rich
    (tmp_path / "bad.yaml").write_text("colour: red\n")
    with pytest.raises(ValueError):
        cf.load(str(tmp_path / "bad.yaml"))
    made = cf.locate({"XDG_CONFIG_HOME": str(tmp_path)})
    assert cf.load(made) == cf.Config() and cf.locate({"TIDEMARK_CONFIG": "/etc/t.yaml"}) == "/etc/t.yaml"
    whole = cf.Config(projects=(cf.Project("p", "/x", sources=(cf.Source("*.log", "log", log_patterns=(p,)),)), cf.Project("q", "/y", removed=True)))
    cf.save(whole, str(tmp_path / "c.yaml"))
    assert cf.load(str(tmp_path / "c.yaml")) == whole and [x.name for x in whole.active()] == ["p"]


def test_scan_and_read(spark, tmp_path):
    (tmp_path / "a" / "bin").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_bytes("één\r\nzwei".encode())
    (tmp_path / "a" / "l.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "a" / "z.txt").write_bytes(b"a\x00b")
    (tmp_path / "a" / "bin" / "y.txt").write_text("no")
    found = fs.scan(spark, str(tmp_path), "**/*.txt", ("bin",), with_content=True)
    assert {r["relative_path"] for r in found.collect()} == {"a/x.txt", "a/l.txt", "a/z.txt"}
    assert {r["relative_path"]: r["content"] for r in fs.read_texts(found).collect()} == {"a/x.txt": "één\nzwei", "a/l.txt": "café"}


def test_catalog(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, catalog.upsert(old, new, "k").collect())) == [("a", 1), ("b", 2), ("c", 2)]
    files = spark.createDataFrame([("a", None), ("b", "h"), ("c", "n")], "k string, h string")
    stored = spark.createDataFrame([("a", None), ("b", "x")], "k string, h string")
    assert sorted((r["k"], r["is_new"]) for r in catalog.changed(files, stored, "k", "h").collect()) == [("b", False), ("c", True)]
    paths = spark.createDataFrame([("a/x.c",), ("b/x.c",)], "p string")
    assert catalog.match_removed(paths, "p", "a/x.c").count() == 1 and catalog.match_removed(paths, "p", "x.c").count() == 2 and catalog.match_removed(paths, "p", "q").count() == 0


def test_index_source(spark):
    lines = ["at x", "2025-01-01 10:00:00 ERR a 1", "  below", "2025-01-01 10:00:01 INF a 2", "2025-01-01 10:00:01 INF drop", "2025-01-01 11:00:00 E! late"]
    df = spark.createDataFrame([("p/l/d-25-01-01.log", i + 1, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    pattern = cf.LogPattern("iso", r"^(?P<timestamp>\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) (?P<severity>\S+) (?P<message>.*)$")
    rules = cf.LogSettings(
        transforms=(cf.Transform("strip", r" \d+"),), event_filters=(cf.FilterRule("^drop", False),), group_rules=(cf.GroupRule("g", "iso", ("iso",), 5000),), severity_map=(("E!", "critical"),)
    )
    got = log_rules.index_source(df, cf.Source("*.log", "log", log_patterns=(pattern,), log_settings=rules)).orderBy("line_start").collect()
    assert [(r["id"], r["line_end"], r["severity"], r["text"], r["n_events"]) for r in got] == [("p/l/d-25-01-01.log::line_2", 4, "error", "a\n  below\na", 2), ("p/l/d-25-01-01.log::line_6", 6, "critical", "late", 1)]
    assert got[0]["timestamp_start"] == "2025-01-01T10:00:00.000" and got[0]["timestamp_end"] == "2025-01-01T10:00:01.000"
    only = log_rules.index_source(df, cf.Source("*.log", "log", log_patterns=(pattern,), log_settings=rules), since="10:30:00.000").collect()
    assert [r["line_start"] for r in only] == [6]


def test_project_verbs(spark, tmp_path):
    from tidemark.operators import projects as pj

    base = tmp_path / "base"
    (base / "doc").mkdir(parents=True)
    (base / "bin").mkdir()
    for name, text in (("doc/a.md", "alpha " * 400), ("doc/b.md", "beta"), ("bin/c.md", "no"), ("main.c", "int x;")):
        (base / name).write_text(text)
    config = pj.add_project(cf.Config(), "p", str(base))
    for bad in (lambda: pj.add_project(config, "p", str(base)), lambda: pj.add_project(config, "q", str(base / "none")), lambda: pj.add_pattern(config, "p", "../x")):
        with pytest.raises(ValueError):
            bad()
    config = pj.add_pattern(pj.add_pattern(config, "p", "**/*.md"), "p", "**/*.md")
    assert [s.pattern for s in pj.project(config, "p").sources] == ["**/*.md"]
    empty = spark.createDataFrame([], "row_key string, project string, file_path string, file_type string, chunk_index int, total_chunks int, content string, file_hash string")
    keys = lambda df: sorted(r["row_key"] for r in df.collect())
    index = spark.createDataFrame(pj.index_project(spark, config, empty, "p").collect(), empty.schema)
    assert {k.split("::")[0] for k in keys(index)} == {"doc/a.md", "doc/b.md"} and len(keys(index)) >= 4
    (base / "doc" / "a.md").write_text("short")
    (base / "doc" / "b.md").unlink()
    index = spark.createDataFrame(pj.index_project(spark, config, index, "p").collect(), empty.schema)
    assert keys(index) == ["doc/a.md::chunk_0"] and index.first()["content"] == "short"
    one = pj.index_files(index, pj.read_pattern(spark, config, "p", "main.c"), config)
    assert keys(one) == ["doc/a.md::chunk_0", "main.c::chunk_0"] and {r["file_type"] for r in one.collect()} == {"documentation", "source"}
    assert pj.clear_project(one, "p").count() == 0 and pj.clear_project(one, "q").count() == 2
    gone = pj.remove_project(config, "p")
    with pytest.raises(KeyError):
        pj.project(gone, "p")
    back = pj.add_project(gone, "p", str(base))
    assert pj.project(back, "p").sources == pj.project(config, "p").sources
    assert pj.drop_project(config, one, "p")[0].projects == ()


def test_rerank_falls_back(spark):
    class Broken:
        def score(self, query, texts):
            raise RuntimeError("no model")

    df = spark.createDataFrame([(1, "p", "a", "doc", "heater fan"), (2, "p", "b", "doc", "fan"), (3, "q", "c", "doc", None)], "chunk_id int, project string, file_path string, file_type string, content string")
    from tidemark.operators import tools

    blank = spark.createDataFrame([(9, "p", "z", "doc", " ")], df.schema)
    assert [r["chunk_id"] for r in tools.search_docs(df.unionByName(blank), "heater", vectors.HashEmbedder(), 9).collect()] == [1, 2, 9]
    plain = [r["chunk_id"] for r in tools.search_docs(df, "heater", vectors.HashEmbedder(), 2).collect()]
    assert [r["chunk_id"] for r in tools.search_docs(df, "heater", vectors.HashEmbedder(), 2, reranker=Broken()).collect()] == plain == [1, 2]
    best = tools.search_docs(df, "fan", vectors.HashEmbedder(), 1, reranker=vectors.WordScorer()).first()
    assert best["relevance"] == 1.0
    asked = vectors.HashEmbedder(instruction="find:")
    assert asked.query("fan") != vectors.HashEmbedder().query("fan") == df.where("chunk_id = 2").select(asked.documents(F.col("content"))).first()[0]
    for bad in (lambda: tools.search_docs(df, " ", asked), lambda: tools.search_logs(df, 5), lambda: tools.search_logs(df, 5, severity="loud"), lambda: tools.search_logs(df, 5, code="x" * 33)):
        with pytest.raises(ValueError):
            bad()


def test_grouping_rules_fold(spark):
    rows = [("f", 1, 0.0, "start a"), ("f", 2, 1.0, "go"), ("f", 3, 2.0, "go"), ("f", 4, 100.0, "go"), ("f", 5, 101.0, "other"), ("f", 6, 102.0, "start b"), ("f", 7, None, "go")]
    events = spark.createDataFrame(rows, "file string, line_no int, second double, text string")
    got = log_rules.group_events(events, [cf.GroupRule("r", "^start", ("^go",), 5000)])
    assert sorted((r["line_start"], r["line_end"], r["rule"], r["n_events"]) for r in got.collect()) == [(1, 3, "r", 3), (4, 4, None, 1), (5, 5, None, 1), (6, 7, "r", 2)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0]), (4, None)], "vec_id int, embedding array<float>")
    assert [r["vec_id"] for r in vectors.top_k(vectors.scored(df, [1.0, 0.0]), 2, "vec_id").collect()] == [1, 3]
    e = df.select(vectors.hash_embedding(F.lit("a b a"), 8).alias("e")).first()["e"]
    assert abs(sum(x * x for x in e) - 1) < 1e-6


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab/*?.", max_size=8), st.text(alphabet="ab/.", max_size=8))
def test_glob(pattern, path):
    got = bool(re.search(tx.glob_regex(pattern), path))
    if "*" not in pattern and "?" not in pattern:
        assert got == (pattern == path)


def test_tail_stream(spark, tmp_path):
    import shutil

    from tidemark.streaming.log_tail import current_lines, follow, into_table, write_batch

    logs, out, cp = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    logs.mkdir()
    a = logs / "a.log"

    def step():
        # each step is a restart: another reader, the same checkpoint
        into_table(follow(spark, str(logs), stretchBytes="7"), out, cp).awaitTermination(120)
        return sorted((r["file"], r["line_no"], r["line"]) for r in current_lines(spark, out).collect())

    def want(*lines):
        return [("a.log", i + 1, x) for i, x in enumerate(lines)]

    a.write_text("one\ntwo is a longer line\npart")
    assert step() == want("one", "two is a longer line")
    with a.open("a") as f:
        f.write("ial\nlast\n")
    assert step() == want("one", "two is a longer line", "partial", "last")
    # replaced by a shorter file while the stream is down
    a.write_text("new\n")
    assert step() == want("new")
    with a.open("a") as f:
        f.write("more\n")
    assert step() == want("new", "more")
    # rotated: another file under the name, longer than the one before
    a.rename(logs / "a.log.1")
    a.write_text("".join(f"line {i}\n" for i in range(9)))
    assert step() == want(*(f"line {i}" for i in range(9)))
    assert step() == want(*(f"line {i}" for i in range(9)))
    # emptied, then written again
    a.write_text("")
    assert step() == []
    a.write_text("x\n")
    assert step() == want("x")
    # a batch that runs again writes what it wrote before
    rows = spark.createDataFrame([("b.log", 0, "p", 0, False), ("b.log", 2, "q", 0, False), ("b.log", 4, "r", 4, False)], "file string, byte_offset bigint, line string, stretch bigint, replaced boolean")
    for _ in range(2):
        write_batch(rows, 99, out)
    got = sorted((r["line_no"], r["line"]) for r in current_lines(spark, out).where("file = 'b.log'").collect())
    assert got == [(1, "p"), (2, "q"), (3, "r")]
    shutil.rmtree(out)


def test_tail_bounds(tmp_path):
    """A bounded batch takes so many bytes of each file; what is left comes next, and lines are whole."""
    from tidemark.sources.tail import TailReader

    (tmp_path / "a.log").write_text("".join(f"{i:04d}\n" for i in range(100)))
    reader = TailReader({"path": str(tmp_path), "maxBytesPerFile": "123", "stretchBytes": "50"})
    at, lines = reader.initialOffset(), []
    while (end := reader.latestOffset()) != at:
        for part in reader.partitions(at, end):
            assert part.stop - part.start <= 50
            lines += [r[2] for r in reader.read(part)]
        at = end
    assert lines == [f"{i:04d}" for i in range(100)]
