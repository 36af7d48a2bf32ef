"""Queries over the project's tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FilterRule, GroupRule, LogPattern, Transform
from tidemark.functions import text as tx
from tidemark.functions.levels import SEVERITIES, severity
from tidemark.operators import catalog, chunking, log_rules, projects, tools, vectors
from tidemark.operators.timestamps import FULL_STAMP, OPENING_STAMP, file_date, utc_micros
from tidemark.session import table as t
from tidemark.sources import files as fs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


EXCLUDED = ["node_modules", "venv", "bin", "archive"]
SIZE_LIMIT = 60_000
# Levels as they may be printed, the longer before those they begin with.
_PRINTED = "|".join(sorted(SEVERITIES, key=lambda x: (-len(x), x)))
_DEVICE = r"([A-Z]{3,5}):(\d{2}:\d{2}:\d{2}:\d{3})\|([^|]+)\|(.*?)(?: code=([0-9a-f]+))?$"


def _named(regex: str, *names: str) -> str:
    """The capturing groups of a regular expression, given their names in order."""
    left = iter(names)
    return re.sub(r"(?<!\\)\((?!\?)", lambda _: f"(?P<{next(left)}>", regex)


ISO_SQL = rf"^({FULL_STAMP})\s+(?:({_PRINTED})\s+)?(.*)"
DEVICE_SQL = "^" + _DEVICE
PATTERNS = [
    LogPattern("iso", _named(ISO_SQL, "timestamp", "severity", "message"), "info", 100),
    LogPattern("device", _named(DEVICE_SQL, "severity", "timestamp", "device_id", "message", "error_code"), "comm", 50),
]
RULES = [FilterRule(r"^\s+at ", False, 10), FilterRule(r"(?:ERROR|WARN|CRITICAL)", True, 20), FilterRule(r"^\s*$", False, 30)]
NUMBERS = r"(\d+)"

_LINES_SQL = "(select file, line_no, max(line) as line from log_lines group by file, line_no)"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "log_lines").groupBy("file", "line_no").agg(F.max("line").alias("line"))


def _plain_lines(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).withColumn("line", F.regexp_replace(F.coalesce("line", F.lit("")), r"\r$", ""))


_PLAIN_SQL = rf"(select file, line_no, regexp_replace(coalesce(max(line), ''), '\r$', '') as line from log_lines group by file, line_no)"


def _events(s: SparkSession, d: str) -> DataFrame:
    """One row per (file, line_no), the first indexed."""
    return t(s, d, "log_events").groupBy("file", "line_no").agg(F.min_by(F.struct("event_id", "message", "severity_raw", "event_type", "error_code", "device_id", "timestamp_iso"), "event_id").alias("e")).select("file", "line_no", "e.*")


_EVENTS_SQL = "(select * from log_events qualify row_number() over (partition by file, line_no order by event_id) = 1)"


# -- scans ------------------------------------------------------------------------------------------------------------


@query()
def scan_files(s, d):
    return fs.scan(s, d, "**/*.parquet").select("relative_path", "length")


@query(f"select file_id, relative_path from files where not list_has_any(string_split(relative_path, '/'), {EXCLUDED})")
def scan_excluded_dirs(s, d):
    return t(s, d, "files").where(~tx.excluded(F.col("relative_path"), EXCLUDED)).select("file_id", "relative_path")


@query(rf"with f as (select file, 'log' as file_type, sum(octet_length(encode(line)) + 1) as n_bytes from {_LINES_SQL} where line is not null group by file) select file, n_bytes from f where n_bytes <= {SIZE_LIMIT}")
def scan_size_limit(s, d):
    listing = _lines(s, d).where("line is not null").groupBy("file").agg(F.sum(F.octet_length("line") + 1).alias("n_bytes")).withColumn("file_type", F.lit("log"))
    return projects.without_large_logs(listing, SIZE_LIMIT).select("file", "n_bytes")


@query(r"""
    select f.file_id from files f where not (f.relative_path like '%.pdf' and exists (
      select 1 from files m where m.relative_path like '%.md' and m.read_at >= f.read_at
      and regexp_replace(m.relative_path, '\.[^./]+$', '') = regexp_replace(f.relative_path, '\.[^./]+$', '')))""")
def scan_sibling_skip(s, d):
    return fs.without_fresh_sibling(t(s, d, "files").select("file_id", "relative_path", "read_at"), "relative_path", "read_at").select("file_id")


@query(r"select file_id, md5(regexp_replace(content, '\r\n?', chr(10), 'g')) as text_hash from files where content is not null")
def decode_text(s, d):
    f = t(s, d, "files").where("content is not null")
    return f.select("file_id", F.md5(tx.decode_text(F.encode("content", "UTF-8"))).alias("text_hash"))


@query("select file_id, content is null as skipped from files")
def binary_skip(s, d):
    return t(s, d, "files").select("file_id", tx.is_binary(F.encode("content", "UTF-8")).alias("skipped"))


@query("select file_id, md5(content) as content_hash from files")
def file_hash(s, d):
    return t(s, d, "files").select("file_id", F.md5("content").alias("content_hash"))


@query(r"""
    with p as (select file_id, relative_path, read_at, content, regexp_replace(relative_path, '\.[^./]+$', '') as stem from files where relative_path like '%.pdf'),
         m as (select regexp_replace(relative_path, '\.[^./]+$', '') as stem, max(read_at) as fresh from files where relative_path like '%.md' group by 1),
         c as (select file_hash, min(file_id) as first_id from files where file_hash <> '' and content is not null group by 1)
    select p.file_id, case when m.fresh >= p.read_at then 'sibling' when c.first_id < p.file_id then 'cache' when p.content is not null then 'raw' end as origin
    from p left join m using (stem) join files f using (file_id) left join c on c.file_hash = f.file_hash""")
def pdf_precedence(s, d):
    f = t(s, d, "files").withColumn("stem", fs.stem(F.col("relative_path")))
    fresh = f.where(F.col("relative_path").endswith(".md")).groupBy("stem").agg(F.max("read_at").alias("fresh"))
    cached = f.where("file_hash <> '' and content is not null").groupBy("file_hash").agg(F.min("file_id").alias("first_id"))
    p = f.where(F.col("relative_path").endswith(".pdf")).select("file_id", "stem", "read_at", "file_hash", F.col("content").isNotNull().alias("has"))
    origin = F.when(F.col("fresh") >= F.col("read_at"), "sibling").when(F.col("first_id") < F.col("file_id"), "cache").when(F.col("has"), "raw")
    return p.join(fresh, "stem", "left").join(cached, "file_hash", "left").select("file_id", origin.alias("origin"))


@query(r"""
    with l as (select file_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: not regexp_matches(x, '^[0-9]{1,4}$')) as k
               from files where is_pdf and content is not null),
         b as (select file_id, list_filter(k, lambda x, i: x <> '' or (i > 1 and k[i - 1] <> '')) as k from l)
    select file_id, md5(array_to_string(list_transform(k, lambda x: case when length(x) < 80 and not regexp_matches(x, '[.,]$') and regexp_matches(x, '^[A-Z]')
      and length(x) - length(replace(x, ' ', '')) < 10 then '**' || x || '**' else x end), chr(10))) as clean_hash from b""")
def page_text_clean(s, d):
    return t(s, d, "files").where("is_pdf and content is not null").select("file_id", F.md5(fs.clean_page(F.col("content"))).alias("clean_hash"))


_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TRIM_SQL = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_PAGE_SQL = "(select file_id, unnest(string_split(content, chr(12))) as page, generate_subscripts(string_split(content, chr(12)), 1) as n from files where is_pdf and content is not null)"


@query(f"select file_id, md5(string_agg(page, chr(10) || chr(10) order by n)) as text_hash from (select file_id, n, {_TRIM_SQL('page')} as page from {_PAGE_SQL}) where page <> '' group by file_id")
def pdf_raw_text(s, d):
    pages = t(s, d, "files").where("is_pdf and content is not null").select("file_id", fs.raw_pages(F.split("content", "\f")).alias("text"))
    return pages.where("text is not null").select("file_id", F.md5("text").alias("text_hash"))


@query(rf"""
    with l as (select file_id, n, list_filter(list_transform(string_split(page, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: not regexp_matches(x, '^[0-9]{{1,4}}$')) as k from {_PAGE_SQL} where {_TRIM_SQL('page')} <> ''),
         b as (select file_id, n, list_filter(k, lambda x, i: x <> '' or (i > 1 and k[i - 1] <> '')) as k from l),
         m as (select file_id, n, {_TRIM_SQL("array_to_string(list_transform(k, lambda x: case when length(x) < 80 and not regexp_matches(x, '[.,]$') and regexp_matches(x, '^[A-Z]') and length(x) - length(replace(x, ' ', '')) < 10 then '**' || x || '**' else x end), chr(10))")} as page from b)
    select file_id, md5(string_agg('## Page ' || n || chr(10) || chr(10) || page, chr(10) || chr(10) order by n)) as text_hash from m group by file_id""")
def pdf_pages(s, d):
    pages = t(s, d, "files").where("is_pdf and content is not null").select("file_id", "content", fs.pages_markdown(F.split("content", "\f")).alias("text"))
    return pages.where("text <> ''").select("file_id", F.md5("text").alias("text_hash"))


@query(r"""
    with c as (select project as sheet, [trim(device_id), coalesce(trim(model), ''), coalesce(trim(tz_name), '')] as cells from devices where project is not null),
         u as (select *, list_max(list_transform(cells, lambda x, i: case when x <> '' then i else 0 end)) as used from c),
         g as (select sheet, max(used) as width, list(cells order by cells) as rows from u where used > 0 group by sheet)
    select sheet, '## Sheet: ' || sheet || chr(10) || '| ' || array_to_string(['device_id', 'model', 'tz_name'][1:width], ' | ') || ' |' || chr(10) ||
      '| ' || array_to_string(list_transform(range(width), lambda x: '---'), ' | ') || ' |' || chr(10) ||
      array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(r[1:width], ' | ') || ' |'), chr(10)) as text from g""")
def render_table(s, d):
    return fs.markdown_table(t(s, d, "devices").where("project is not null"), "project", ["device_id", "model", "tz_name"])


_EXT_SQL = ", ".join(f"('{e}', {i})" for i, e in enumerate(fs.EXTENSIONS))


@query(rf"""select e.ext as extension, e.pos as position from (values {_EXT_SQL}) e(ext, pos)
    where e.ext in (select lower(regexp_extract(relative_path, '(\.[^./]+)$', 1)) from files)
       or (e.ext = '.md' and exists (select 1 from files where lower(relative_path) like '%.pdf'))""")
def discover_extensions(s, d):
    present = t(s, d, "files").select(F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)).alias("extension")).where("extension <> ''").distinct()
    implied = present.where("extension = '.pdf'").select(F.lit(".md").alias("extension"))
    wanted = s.createDataFrame([(e, i) for i, e in enumerate(fs.EXTENSIONS)], "extension string, position int")
    return wanted.join(present.union(implied).distinct(), "extension", "left_semi")


STACKS = {"c": {"markers": ["*.c", "*.h"], "marker_dirs": ["src"]}, "python": {"markers": ["*.py"], "marker_dirs": []}, "docs": {"markers": ["README.md"], "marker_dirs": ["doc", "docs"]}}


@query(r"""
    select distinct project as "group", unnest(list_filter([
      case when regexp_matches(relative_path, '\.[ch]$') or (list_contains(string_split(relative_path, '/'), 'src') and not relative_path like '%/src') then 'c' end,
      case when relative_path like '%.py' then 'python' end,
      case when regexp_matches(relative_path, '^(.*/)?README\.md$') or (list_contains(string_split(relative_path, '/'), 'doc') and not relative_path like '%/doc')
        or (list_contains(string_split(relative_path, '/'), 'docs') and not relative_path like '%/docs') then 'docs' end], lambda x: x is not null)) as stack from files""")
def detect_stacks(s, d):
    return fs.stacks(t(s, d, "files"), "relative_path", "project", STACKS)


@query(r"""
    with r as (select distinct project, string_split(relative_path, '/')[1] as root from files where relative_path like '%/%')
    select project, root from r where root not like '.%' and root not like 'arch%' and project not in (select project from chunking_config where project is not null)""")
def discover_roots(s, d):
    return projects.discover_roots(t(s, d, "files"), t(s, d, "chunking_config"))


@query(r"""
    with r as (select distinct project, string_split(relative_path, '/')[1] as root from files where relative_path like '%/%'),
         k as (select project, root, row_number() over (order by project, root) as n from r where root not like '.%' and root not like 'arch%' and project is not null)
    select project, root from k where n in (1, 3)""")
def discover_chosen_roots(s, d):
    return projects.discover_roots(t(s, d, "files"), t(s, d, "chunking_config").where("false"), chosen="1,3")


@query(f"select file, line_no, octet_length(encode(line)) as n_bytes from {_LINES_SQL} where line is not null")
def log_scan(s, d):
    return _lines(s, d).where("line is not null").select("file", "line_no", F.octet_length("line").cast("bigint").alias("n_bytes"))


@query(r"select distinct file from log_lines where contains(regexp_extract(file, '([^/]+)$', 1), 'navd') or regexp_matches(file, '^inbox/(?:.*/)?rover[^/]*\.log$')")
def log_file_select(s, d):
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    return t(s, d, "log_lines").where(name.contains("navd") | F.col("file").rlike(tx.glob_regex("inbox/**/rover*.log"))).select("file").distinct()


# -- index maintenance ------------------------------------------------------------------------------------------------

_CUT = "chunk_index % 2 = 0"
_OLD_SQL = f"(select * from chunks where {_CUT} qualify row_number() over (partition by row_key order by indexed_at desc, chunk_id desc) = 1)"
_NEW_SQL = "(select * from chunks where total_chunks > 2 qualify row_number() over (partition by row_key order by indexed_at desc, chunk_id desc) = 1)"


@query(f"select row_key, chunk_id from {_OLD_SQL} o where row_key not in (select row_key from {_NEW_SQL}) union all select row_key, chunk_id from {_NEW_SQL}")
def index_upsert(s, d):
    chunks = t(s, d, "chunks")
    old = catalog.latest(chunks.where(_CUT), "row_key", "indexed_at", "chunk_id").select("row_key", "chunk_id")
    new = catalog.latest(chunks.where("total_chunks > 2"), "row_key", "indexed_at", "chunk_id").select("row_key", "chunk_id")
    return catalog.upsert(old, new, "row_key")


@query("""
    with o as (select relative_path, min_by(file_hash, file_id) as h from files group by 1), n as (select relative_path, max_by(file_hash, file_id) as file_hash, max(file_id) as file_id from files group by 1)
    select n.relative_path, n.file_id, o.h is null as is_new from n left join (select * from o where hash_even) o using (relative_path) where n.file_hash is distinct from o.h
    """.replace("(select * from o where hash_even)", "(select * from o where right(h, 1) in ('0','2','4','6','8','a','c','e'))"))
def index_changed_files(s, d):
    f = t(s, d, "files")
    now = f.groupBy("relative_path").agg(F.max_by("file_hash", "file_id").alias("file_hash"), F.max("file_id").alias("file_id"))
    stored = f.groupBy("relative_path").agg(F.min_by("file_hash", "file_id").alias("file_hash")).where(F.right("file_hash", F.lit(1)).isin(*"02468ace"))
    return catalog.changed(now, stored, "relative_path", "file_hash").select("relative_path", "file_id", "is_new")


@query("select chunk_id from chunks where file_path is null or file_path <> (select min(file_path) from chunks)")
def index_delete_file(s, d):
    chunks = t(s, d, "chunks")
    gone = chunks.agg(F.min("file_path").alias("file_path"))
    return chunks.join(gone, "file_path", "left_anti").select("chunk_id")


@query("select chunk_id from chunks where file_id not in (select file_id from files where file_type = 'documentation')")
def index_prune(s, d):
    return catalog.prune(t(s, d, "chunks"), t(s, d, "files").where("file_type = 'documentation'"), "file_id").select("chunk_id")


@query("select distinct file_path from chunks where content is not null")
def indexed_files(s, d):
    return t(s, d, "chunks").where("content is not null").select("file_path").distinct()


@query("select project, count(*) filter (content is not null) as n_rows, project in ('lodewerk', 'tarnhub') as removed from chunks group by project")
def project_soft_delete(s, d):
    return t(s, d, "chunks").groupBy("project").agg(F.count_if(F.col("content").isNotNull()).alias("n_rows")).withColumn("removed", F.col("project").isin("lodewerk", "tarnhub"))


@query("select chunk_id from chunks where project is distinct from 'lodewerk'")
def project_clear(s, d):
    return projects.clear_project(t(s, d, "chunks"), "lodewerk").select("chunk_id")


@query("select chunk_id from chunks where contains(file_path, 'navd_00') and not exists (select 1 from chunks where file_path = 'navd_00')")
def remove_file_match(s, d):
    return catalog.match_removed(t(s, d, "chunks").select("chunk_id", "file_path"), "file_path", "navd_00").select("chunk_id")


_TYPE_SQL = "case lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1)) " + " ".join(f"when '{e}' then '{k}'" for e, k in fs.EXTENSIONS.items()) + " else 'source' end"


@query(f"select file_id, {_TYPE_SQL} as mapped_type from files")
def file_type_map(s, d):
    return t(s, d, "files").select("file_id", catalog.file_type(F.col("relative_path"), fs.EXTENSIONS, "source").alias("mapped_type"))


_SIZES_SQL = f"(select file, sum(octet_length(encode(line)) + 1) as size, sum(octet_length(encode(line)) + 1) filter (line_no <= 20) as seen from {_LINES_SQL} where line is not null group by file)"


def _sizes(s, d):
    n = F.octet_length("line") + 1
    return _lines(s, d).where("line is not null").groupBy("file").agg(F.sum(n).alias("size"), F.sum(F.when(F.col("line_no") <= 20, n)).alias("seen"))


@query(f"select file, size as byte_offset from {_SIZES_SQL}")
def log_offsets(s, d):
    return _sizes(s, d).select("file", F.col("size").alias("byte_offset"))


@query(f"""select file, case when size < seen * 2 - 100 then 0 else seen * 2 - 100 end as read_from,
    case when size < seen * 2 - 100 then 'replace' when size = seen * 2 - 100 then 'skip' else 'append' end as action from {_SIZES_SQL} where seen is not null""")
def log_tail_plan(s, d):
    start, action = catalog.tail_plan(F.col("size"), F.col("seen") * 2 - 100)
    return _sizes(s, d).where("seen is not null").select("file", start.alias("read_from"), action.alias("action"))


@query("select project, file_type, count(*) as n_chunks, sum(length(content)) as n_chars, count(*) * 10 as kilobytes, grouping(project, file_type) as level from chunks group by rollup (project, file_type)")
def estimate_rollup(s, d):
    sums = t(s, d, "chunks").rollup("project", "file_type").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).alias("n_chars"), (F.count("*") * 10).alias("kilobytes"), F.grouping_id().alias("level"))
    return sums


@query("""select coalesce(c.project, p.project) as project, coalesce(p.n, 0) as n, case when p.n is null then 'missing' when c.project is null then 'orphan' else 'ok' end as state
    from (select project from chunking_config) c full join (select project, count(*) as n from chunks group by 1) p on c.project = p.project""")
def catalog_drift(s, d):
    return catalog.drift(t(s, d, "chunking_config").select("project"), t(s, d, "chunks"), "project")


# -- filters ----------------------------------------------------------------------------------------------------------


@query("select file_path, min_by(file_type, chunk_index) as file_type, count(*) over () as n_files from chunks where project = 'lodewerk' group by file_path")
def list_files(s, d):
    return tools.list_files(t(s, d, "chunks"), "lodewerk")


@query("select event_id from log_events where severity = 'error' and event_type = 'power' and timestamp_iso >= '2025-01-01' and timestamp_iso <= '2025-12-31'")
def search_logs_filter(s, d):
    return tools.filter_events(t(s, d, "log_events"), severity="ERROR", event_type="power", since="2025-01-01", until="2025-12-31").select("event_id")


@query("select group_id from log_groups where timestamp_start >= '2024-06-01' and timestamp_end <= '2025-03-01'")
def search_logs_time(s, d):
    return tools.time_range(t(s, d, "log_groups"), "2024-06-01", "2025-03-01").select("group_id")


@query("select doc_id from documents where contains(text, 'watchdog')")
def text_contains(s, d):
    return t(s, d, "documents").where(F.col("text").contains("watchdog")).select("doc_id")


@query("select event_id from log_events where starts_with(error_code, '4e')")
def error_code_prefix(s, d):
    return t(s, d, "log_events").where(F.col("error_code").startswith("4e")).select("event_id")


@query(rf"""select file, line_no, case when regexp_matches(line, '^\s+at ') then false when regexp_matches(line, '(?:ERROR|WARN|CRITICAL)') then true
    when regexp_matches(line, '^\s*$') then false else true end as kept from {_PLAIN_SQL}""")
def line_filter(s, d):
    return _plain_lines(s, d).select("file", "line_no", log_rules.line_filter(F.col("line"), RULES).alias("kept"))


@query(f"select file, line_no from {_PLAIN_SQL} where position(':' in line) > 1 and string_split(line, ':')[1] in ('ERR', 'WRN', 'INF')")
def severity_gate(s, d):
    return _plain_lines(s, d).where(log_rules.severity_gate(F.col("line"), ["ERR", "WRN", "INF"])).select("file", "line_no")


@query("select event_id from events where strftime(ts, '%H:%M:%S') between '06:00:00' and '07:30:00'")
def time_of_day(s, d):
    return tools.time_of_day(t(s, d, "events"), "ts", "06:00:00", "07:30:00").select("event_id")


# -- search -----------------------------------------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 4)"
_Q = "(select embedding from embeddings where vec_id = 0) q"
_HITS_SQL = f"""(select d.doc_id, d.project, d.file_path, d.file_type, d.text, v.vec_id, {_COS} as relevance from embeddings v, {_Q}, documents d where d.doc_id = v.vec_id)"""


def _query_vector(s, d) -> list[float]:
    row = t(s, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


def _scored_vectors(s, d) -> DataFrame:
    return vectors.scored(t(s, d, "embeddings"), _query_vector(s, d))


def _hits(s, d) -> DataFrame:
    docs = t(s, d, "documents").select("doc_id", "project", "file_path", "file_type", "text")
    return _scored_vectors(s, d).select("vec_id", "relevance").join(docs, F.col("vec_id") == F.col("doc_id"))


@query(f"select vec_id, label, {_COS} as relevance from embeddings v, {_Q} order by relevance desc, vec_id limit 10")
def knn_topk(s, d):
    return vectors.top_k(_scored_vectors(s, d), 10, "vec_id").select("vec_id", "label", "relevance")


@query(f"select vec_id, round(1 - (list_dot_product(v.embedding::double[], v.embedding::double[]) + list_dot_product(q.embedding::double[], q.embedding::double[]) - 2 * list_dot_product(v.embedding::double[], q.embedding::double[])), 4) as relevance from embeddings v, {_Q} order by relevance desc, vec_id limit 10")
def knn_l2(s, d):
    return vectors.top_k(vectors.scored(t(s, d, "embeddings"), _query_vector(s, d), "l2sq"), 10, "vec_id").select("vec_id", "relevance")


@query(f"select vec_id, label, relevance, rank from (select vec_id, label, {_COS} as relevance, row_number() over (partition by label order by {_COS} desc, vec_id) as rank from embeddings v, {_Q}) where rank <= 3")
def knn_per_project(s, d):
    return vectors.top_k_per(_scored_vectors(s, d), 3, "label", "vec_id").select("vec_id", "label", "relevance", "rank")


@query(f"select vec_id, greatest(0.0::double, least(1.0::double, {_COS} * 3)) as relevance from embeddings v, {_Q}")
def relevance_clamp(s, d):
    return _scored_vectors(s, d).select("vec_id", vectors.clamp(F.col("relevance") * 3).alias("relevance"))


@query()
def embed_hashing(s, d):
    return t(s, d, "documents").select("doc_id", vectors.hash_embedding(F.col("text")).alias("embedding"))


_WORDS = "the watchdog heater"
_LEX_SQL = r"round(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')), ['heater', 'the', 'watchdog'])) / 3, 4)"


@query(f"select doc_id, {_LEX_SQL} as relevance from (select * from {_HITS_SQL} order by relevance desc, doc_id limit 20) order by relevance desc, doc_id limit 5")
def two_stage_rerank(s, d):
    return vectors.rerank(_hits(s, d), vectors.lexical_score(F.col("text"), _WORDS), 5, 4, "doc_id").select("doc_id", "relevance")


_ASKED = "reset the watchdog after the heater failed"
_PARTS_SQL = lambda source, key, text: rf"""(select {key} as id, k, sum(s) as v from (select {key}, (h % 64)::int as k, case when (h >> 31) = 1 then 1.0 else -1.0 end::double as s
    from (select {key}, ('0x' || substr(md5(w), 1, 8))::bigint as h from (select {key}, unnest(regexp_split_to_array(lower({text}), '\s+')) as w from {source}) where w <> '')) group by all)"""  # noqa: E731
_NEAR_SQL = lambda source, key, text, asked, digits: f"""(with p as {_PARTS_SQL(source, key, text)}, q as {_PARTS_SQL(f"(select 0 as one, '{asked}' as asked)", 'one', 'asked')},
    n as (select id, sqrt(sum(v * v)) as n from p group by id), m as (select sqrt(sum(v * v)) as n from q),
    d as (select p.id, sum(p.v * q.v) as dot from p join q using (k) group by p.id)
    select n.id, round(coalesce(d.dot, 0) / (n.n * m.n), {digits}) as relevance from n cross join m left join d on d.id = n.id where n.n > 0)"""  # noqa: E731
_DOC_NEAR_SQL = f"(select x.doc_id, x.project, x.file_path, x.file_type, h.relevance from {_NEAR_SQL('documents', 'doc_id', 'text', _ASKED, 4)} h join documents x on x.doc_id = h.id)"


def _documents(s, d) -> DataFrame:
    return t(s, d, "documents").select("doc_id", "project", "file_path", "file_type", "text")


@query(f"select doc_id, project, file_path, relevance from {_DOC_NEAR_SQL} order by relevance desc, doc_id limit 10")
def search_docs(s, d):
    return tools.search_docs(_documents(s, d), _ASKED, vectors.HashEmbedder(), 10, key="doc_id", text="text").select("doc_id", "project", "file_path", "relevance")


@query(f"select doc_id, project, file_path, relevance from {_DOC_NEAR_SQL} where file_type = 'documentation' order by relevance desc, doc_id limit 10")
def search_specs(s, d):
    return tools.search_specs(_documents(s, d), _ASKED, vectors.HashEmbedder(), 10, key="doc_id", text="text").select("doc_id", "project", "file_path", "relevance")


@query(f"""select x.doc_id, round(len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '\\s+')), list_distinct(string_split('{_ASKED}', ' ')))) / 6, 4) as relevance
    from (select * from {_DOC_NEAR_SQL} where project = 'lodewerk' order by relevance desc, doc_id limit 20) p join documents x using (doc_id) order by relevance desc, doc_id limit 5""")
def search_docs_reranked(s, d):
    found = tools.search_docs(_documents(s, d), _ASKED, vectors.HashEmbedder(), 5, "lodewerk", reranker=vectors.WordScorer(), key="doc_id", text="text")
    return found.select("doc_id", "relevance")


@query(f"""select event_id, greatest(0.0::double, least(1.0::double, relevance)) as score
    from {_NEAR_SQL("(select event_id, message from log_events where severity = 'error' and message is not null)", 'event_id', 'message', 'session timeout retry', 6)} h join log_events x on x.event_id = h.id
    order by score desc, event_id limit 20""")
def search_logs_query(s, d):
    return tools.search_logs(t(s, d, "log_events"), 20, "session timeout retry", vectors.HashEmbedder(), severity="error").select("event_id", "score")


_CHUNK_HITS_SQL = f"(select c.chunk_id, c.project, c.file_path, c.file_type, c.content, {_COS} as relevance from embeddings v, {_Q}, chunks c where c.chunk_id = v.vec_id)"


def _chunk_hits(s, d) -> DataFrame:
    chunks = t(s, d, "chunks").select("chunk_id", "project", "file_path", "file_type", "content")
    return _scored_vectors(s, d).select("vec_id", "relevance").join(chunks, F.col("vec_id") == F.col("chunk_id"))


@query(f"""select * from (select 0 as branch, chunk_id, file_path, relevance from {_CHUNK_HITS_SQL} where file_type = 'header' order by relevance desc, chunk_id limit 5)
    union all select * from (select 1 as branch, chunk_id, file_path, relevance from {_CHUNK_HITS_SQL} where file_type = 'source' order by relevance desc, chunk_id limit 5)""")
def search_code(s, d):
    return tools.search_code(_chunk_hits(s, d), 5)


@query(f"""select * from (select 'declaration' as part, file_path, chunk_id from {_CHUNK_HITS_SQL} where file_type = 'header' order by relevance desc, chunk_id limit 3)
    union all select * from (select 'implementation' as part, file_path, chunk_id from {_CHUNK_HITS_SQL} where file_type = 'source' order by relevance desc, chunk_id limit 5)
    union all select * from (select distinct 'mention' as part, file_path, null::bigint as chunk_id from chunks where contains(content, 'navd_slot') order by file_path limit 15)""")
def find_function(s, d):
    return tools.find_function(_chunk_hits(s, d), t(s, d, "chunks"), "navd_slot")


_HEX = ["0x4c", "4c", "0X4C", "0x4c", "0x4C", "$4C"]
_AROUND_SQL = lambda text, term, n: rf"""(with z as (select {text} as t, lower({term}) as w), y as (select t, position(w in lower(t)) - 1 as a, length(w) as k from z)
    select case when a < 0 then substr(t, 1, 400) else (case when a > {n} then '...' else '' end) || regexp_replace(substr(t, greatest(a - {n}, 0)::int + 1, (least(length(t), a + k + {n}) - greatest(a - {n}, 0))::int), '^{_WS}+|{_WS}+$', '', 'g')
    || (case when a + k + {n} < length(t) then '...' else '' end) end from y)"""  # noqa: E731
_HEX_SQL = "case " + " ".join(f"when contains(content, '{v}') then {i}" for i, v in enumerate(_HEX)) + " end"


@query(f"""select chunk_id, project, variant, {_AROUND_SQL('content', str(_HEX) + '[variant + 1]', 200)} as snippet from (select chunk_id, project, variant, content, row_number() over (order by project, variant, chunk_id) as n
    from (select *, {_HEX_SQL} as variant from chunks) where variant is not null) where n <= 10""")
def search_hex(s, d):
    return tools.search_hex(t(s, d, "chunks"), "0x4c", 10)


@query(f"""select project, file_path, chunk_index, {_AROUND_SQL('content', "'relayd_limit'", 150)} as snippet from (select *, row_number() over (partition by project, file_path order by chunk_index, chunk_id) as n
    from chunks where contains(content, 'relayd_limit')) where n = 1 order by project, file_path limit 15""")
def find_variable(s, d):
    return tools.find_variable(t(s, d, "chunks"), "relayd_limit", 15)


_AT = "position('watchdog' in lower(text)) - 1"
_CUT_SQL = r"regexp_replace(substr(text, (case when a > 60 then a - 60 else 0 end) + 1, least(length(text), a + 68) - (case when a > 60 then a - 60 else 0 end)), '^\s+|\s+$', '', 'g')"


@query(f"""select doc_id, case when a < 0 then substr(text, 1, 400) else (case when a > 60 then '...' else '' end) || {_CUT_SQL} || (case when a + 68 < length(text) then '...' else '' end) end as snippet
    from (select doc_id, text, {_AT} as a from documents where lang = 'en')""")
def snippet(s, d):
    return t(s, d, "documents").where("lang = 'en'").select("doc_id", tx.snippet(F.col("text"), "Watchdog", 60).alias("snippet"))


@query("select event_id, timestamp_iso from log_events where severity = 'critical' and starts_with(error_code, '4') order by timestamp_iso desc nulls last, event_id limit 20")
def search_logs(s, d):
    return tools.search_logs(t(s, d, "log_events"), 20, code="4", severity="critical").select("event_id", "timestamp_iso")


@query(f"""select * from (select 'lodewerk' as side, doc_id, relevance from {_HITS_SQL} where project = 'lodewerk' order by relevance desc, doc_id limit 3)
    union all select * from (select 'tarnhub' as side, doc_id, relevance from {_HITS_SQL} where project = 'tarnhub' order by relevance desc, doc_id limit 3)""")
def compare_projects(s, d):
    return tools.compare_projects(_hits(s, d), "lodewerk", "tarnhub", 3)


@query("select file_id, md5(string_agg(content, chr(10) order by chunk_index, chunk_id)) as text_hash from chunks where content is not null group by file_id")
def get_document(s, d):
    return tools.get_document(t(s, d, "chunks")).select("file_id", F.md5("text").alias("text_hash"))


@query("""select c.project, count(*) as n_chunks, any_value(k.chunk_size) as chunk_size from chunks c left join chunking_config k using (project)
    where c.project <> 'lodewerk' group by c.project""")
def list_projects(s, d):
    return tools.list_projects(t(s, d, "chunks"), t(s, d, "chunking_config"), removed=["lodewerk"])


@query("select project, file_type, count(*) as n_chunks, count(distinct file_path) as n_files, grouping(project, file_type) as level from chunks group by rollup (project, file_type)")
def project_summary(s, d):
    return t(s, d, "chunks").rollup("project", "file_type").agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.grouping_id().alias("level"))


# -- chunking ---------------------------------------------------------------------------------------------------------

_W = _WS
_STRIP = lambda x: f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _split_sql(text: str, size: int, seps: list[str], depth: int = 0) -> str:
    """List expression of the pieces of a text."""
    if not seps:
        return f"list_transform(range(0, greatest(length({text}), 1), {size}), lambda i{depth}: substr({text}, i{depth}::int + 1, {size}))"
    sep = "||".join("chr(10)" if c == "\n" else f"'{c}'" for c in seps[0])
    p, i, q = f"p{depth}", f"i{depth}", f"q{depth}"
    whole = f"case when {i} > 1 then {sep} || {p} else {p} end" if seps[0].strip() else p
    inner = _split_sql(q, size, seps[1:], depth + 1)
    piece = f"list_transform([{_STRIP(whole)}], lambda {q}: case when {q} = '' then [] when length({q}) <= {size} then [{q}] else {inner} end)[1]"
    return f"case when position({sep} in {text}) = 0 then {_split_sql(text, size, seps[1:], depth + 1)} else flatten(list_transform(string_split({text}, {sep}), lambda {p}, {i}: {piece})) end"


_SEPS = list(chunking.SEPARATORS)
_LONG = "(select doc_id, text from documents where length(text) > 1000 and regexp_matches(text, '[^ \\n\\t]'))"
_PIECES_SQL = f"(select doc_id, {_split_sql('text', 1000, _SEPS)} as pieces from {_LONG})"
_MERGED_SQL = f"""
    with recursive base as (select doc_id, pieces from {_PIECES_SQL}),
    pc as (select doc_id, unnest(pieces) as piece, generate_subscripts(pieces, 1) as k from base),
    walk as (
      select doc_id, k, piece as cur, 1 as chunk from pc where k = 1
      union all
      select w.doc_id, p.k, case when length(w.cur) + length(p.piece) + 1 <= 1000 then w.cur || chr(10) || p.piece else p.piece end,
        case when length(w.cur) + length(p.piece) + 1 <= 1000 then w.chunk else w.chunk + 1 end
      from walk w join pc p on p.doc_id = w.doc_id and p.k = w.k + 1),
    merged as (select doc_id, chunk - 1 as chunk_index, max_by(cur, k) as content from walk group by doc_id, chunk)"""
_OVER_SQL = rf"""{_MERGED_SQL},
    tails as (select doc_id, chunk_index, content, right(lag(content) over (partition by doc_id order by chunk_index), 200) as tail from merged),
    cuts as (select *, case when position(chr(10) in tail) > 0 then position(chr(10) in tail) else position(' ' in tail) end as pos from tails),
    over_ as (select doc_id, chunk_index, content, case when pos > 1 then substr(tail, pos + 1) else tail end as tail from cuts),
    whole as (select doc_id, chunk_index, case when tail is null or regexp_full_match(tail, '{_W}*') then content else tail || chr(10) || content end as content from over_)"""


@query("select doc_id, text as content from documents where length(text) <= 1000 and regexp_matches(text, '[^ \\n\\t]')")
def chunk_small(s, d):
    short = t(s, d, "documents").where("length(text) <= 1000")
    return short.where(~tx.is_blank(F.col("text"))).select("doc_id", F.element_at(chunking.chunk_text(F.col("text")), 1).alias("content"))


@query(f"select doc_id, len(pieces) as n_pieces, md5(array_to_string(pieces, chr(1))) as pieces_hash from {_PIECES_SQL}")
def chunk_split(s, d):
    long = t(s, d, "documents").where("length(text) > 1000").select("doc_id", chunking.split_pieces(F.col("text"), 1000).alias("pieces"))
    return long.select("doc_id", F.size("pieces").alias("n_pieces"), F.md5(F.array_join("pieces", "\x01")).alias("pieces_hash"))


@query("select doc_id, md5(array_to_string(list_transform(range(0, length(text), 300), lambda i: substr(text, i::int + 1, 300)), chr(1))) as pieces_hash from documents where length(text) > 300")
def chunk_force(s, d):
    return t(s, d, "documents").where("length(text) > 300").select("doc_id", F.md5(F.array_join(chunking.force_split(F.col("text"), 300), "\x01")).alias("pieces_hash"))


@query(f"{_MERGED_SQL} select doc_id, chunk_index::int as chunk_index, md5(content) as content_hash from merged")
def chunk_merge(s, d):
    long = t(s, d, "documents").where("length(text) > 1000")
    merged = long.select("doc_id", chunking.bind(chunking.split_pieces(F.col("text"), 1000), lambda p: chunking.merge_pieces(p, 1000)).alias("m"))
    return merged.select("doc_id", F.posexplode("m").alias("chunk_index", "c")).select("doc_id", "chunk_index", F.md5("c").alias("content_hash"))


@query(f"{_OVER_SQL} select doc_id, chunk_index::int as chunk_index, md5(content) as content_hash from whole where chunk_index > 0")
def chunk_overlap(s, d):
    made = chunking.chunk_documents(t(s, d, "documents").where("length(text) > 1000"), "doc_id", "text")
    return made.where("chunk_index > 0").select("doc_id", "chunk_index", F.md5("content").alias("content_hash"))


@query(f"""{_OVER_SQL}, everything as (select doc_id, chunk_index::int as chunk_index, content from whole
      union all select doc_id, 0, text from documents where length(text) <= 1000 and regexp_matches(text, '[^ \\n\\t]'))
    select doc_id, chunk_index, md5(content) as content_hash, count(*) over (partition by doc_id)::int as total_chunks from everything""")
def chunk_documents(s, d):
    made = chunking.chunk_documents(t(s, d, "documents"), "doc_id", "text")
    return made.select("doc_id", "chunk_index", F.md5("content").alias("content_hash"), "total_chunks")


@query(f"""{_OVER_SQL}, everything as (select doc_id, chunk_index::int as chunk_index, content from whole
      union all select doc_id, 0, text from documents where length(text) <= 1000 and regexp_matches(text, '[^ \\n\\t]'))
    select doc_id || '.md::chunk_' || chunk_index as row_key, md5(content) as content_hash, 'documentation' as file_type from everything""")
def index_rows(s, d):
    files = t(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.col("text").alias("content"), F.md5("text").alias("file_hash"), "project")
    return projects.chunk_rows(files).select("row_key", F.md5("content").alias("content_hash"), "file_type")


# -- logs -------------------------------------------------------------------------------------------------------------

_MATCH_SQL = f"case when regexp_matches(line, '{DEVICE_SQL}') then 'device' when regexp_matches(line, '{ISO_SQL}') then 'iso' end"


@query(f"select file, line_no, {_MATCH_SQL} as pattern_name from {_PLAIN_SQL}")
def log_match(s, d):
    return _plain_lines(s, d).select("file", "line_no", log_rules.match_pattern(F.col("line"), PATTERNS).alias("pattern_name"))


@query(rf"""select file, line_no, case when p = 'device' then regexp_extract(line, '{DEVICE_SQL}', 2) else regexp_extract(line, '{ISO_SQL}', 1) end as timestamp_raw,
    case when p = 'device' then regexp_extract(line, '{DEVICE_SQL}', 1) else regexp_extract(line, '{ISO_SQL}', 2) end as severity_raw,
    case when p = 'device' then regexp_extract(line, '{DEVICE_SQL}', 4) else regexp_extract(line, '{ISO_SQL}', 3) end as message,
    case when p = 'device' then regexp_extract(line, '{DEVICE_SQL}', 3) else '' end as device_id,
    case when p = 'device' then regexp_extract(line, '{DEVICE_SQL}', 5) else '' end as error_code
    from (select *, {_MATCH_SQL} as p from {_PLAIN_SQL}) where p is not null""")
def log_extract(s, d):
    got = log_rules.extract_fields(_plain_lines(s, d), PATTERNS).where("pattern_name is not null")
    return got.select("file", "line_no", "timestamp_raw", "severity_raw", "message", "device_id", "error_code")


@query(rf"""with l as (select file, line_no, {_MATCH_SQL} as p from {_PLAIN_SQL} where {_MATCH_SQL} is not null or not regexp_matches(line, '^\s*$')),
    o as (select *, max(case when p is not null then line_no end) over (partition by file order by line_no) as owner from l)
    select file, owner as line_no, least(count(*) filter (p is null), 500) as continuation_count from o where owner is not null group by file, owner""")
def log_continuation(s, d):
    lines = _plain_lines(s, d).withColumn("pattern_name", log_rules.match_pattern(F.col("line"), PATTERNS))
    return log_rules.attach_continuations(lines)


_OWNED_SQL = rf"""(with l as (select file, line_no, line, {_MATCH_SQL} as p from {_PLAIN_SQL} where {_MATCH_SQL} is not null or not regexp_matches(line, '^{_W}*$'))
    select *, max(case when p is not null then line_no end) over (partition by file order by line_no) as owner from l)"""
_BELOW_SQL = f"(select *, row_number() over (partition by file, owner order by line_no) as k from {_OWNED_SQL} where owner is not null)"


@query(f"""select file, owner as line_no, count(*) filter (p is null) as n, md5(coalesce(string_agg(line, chr(10) order by line_no) filter (p is null), '')) as lines_hash
    from {_BELOW_SQL} where k <= 501 group by file, owner""")
def log_continuation_lines(s, d):
    lines = _plain_lines(s, d).withColumn("pattern_name", log_rules.match_pattern(F.col("line"), PATTERNS))
    got = log_rules.continuation_lines(lines)
    return got.select("file", "line_no", F.size("continuation_lines").cast("bigint").alias("n"), F.md5(F.array_join("continuation_lines", "\n")).alias("lines_hash"))


@query("""select event_id, md5(coalesce(message, '') || case when len(continuation_lines) > 0 then chr(10) || array_to_string(continuation_lines, chr(10)) else '' end) as text_hash from log_events""")
def log_full_text(s, d):
    return t(s, d, "log_events").select("event_id", F.md5(log_rules.full_text(F.col("message"), F.col("continuation_lines"))).alias("text_hash"))


@query(rf"""with k as (select file, bool_or(regexp_matches(line, '^\w+\s')) as known from {_PLAIN_SQL} group by file)
    select file, line_no from {_PLAIN_SQL} l join k using (file) where case when regexp_matches(line, '^\s+at ') then false when regexp_matches(line, '(?:ERROR|WARN|CRITICAL)') then true
      when regexp_matches(line, '^\s*$') then false when not known and regexp_matches(line, 'INFO|info') then false else true end""")
def log_fallback_filter(s, d):
    return log_rules.fallback_filter(_plain_lines(s, d), r"^\w+\s", RULES, [FilterRule("INFO|info", False, 40)]).select("file", "line_no")


_DAY_SQL = r"try_strptime('20' || regexp_extract(file, '(\d{2}-\d{2}-\d{2})\.log$', 1), '%Y-%m-%d')"


@query(rf"""select event_id, second from (select event_id, floor(case
      when regexp_matches(r, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?Z$') then epoch(try_cast(regexp_replace(r, 'Z$', '') as timestamp))
      when regexp_matches(r, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(?:[.,]\d+)?$') then epoch(try_cast(replace(r, ',', '.') as timestamp))
      when regexp_matches(r, '^\d{{10}}$') then r::double when regexp_matches(r, '^\d{{13}}$') then floor(r::bigint / 1000)
      when regexp_matches(r, '^\d{{2}}:\d{{2}}:\d{{2}}:\d{{3}}$') then epoch({_DAY_SQL}) + substr(r, 1, 2)::int * 3600 + substr(r, 4, 2)::int * 60 + substr(r, 7, 2)::int end)::bigint as second
    from (select event_id, file, trim(timestamp_raw) as r from log_events)) where second is not null""")
def ts_normalize(s, d):
    forms = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$|^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?$|^\d{10}$|^\d{13}$|^\d{2}:\d{2}:\d{2}:\d{3}$"
    e = t(s, d, "log_events").where(F.trim("timestamp_raw").rlike(forms))
    at = log_rules.normalized_stamp(F.col("timestamp_raw"), F.col("file"), F.lit(None).cast("timestamp"))
    return e.select("event_id", F.unix_seconds(at).alias("second")).where("second is not null")


@query(r"""select event_id, case when regexp_matches(m, '^\s+at ') then false when regexp_matches(m, '(?:ERROR|WARN|CRITICAL)') then true when regexp_matches(m, '^\s*$') then false else true end as kept
    from (select event_id, coalesce(message, '') as m from log_events)""")
def event_filter(s, d):
    return t(s, d, "log_events").select("event_id", log_rules.line_filter(F.coalesce("message", F.lit("")), RULES).alias("kept"))


@query(r"select distinct file, try_strptime('20' || regexp_extract(file, '(\d{2}-\d{2}-\d{2})\.log$', 1), '%Y-%m-%d')::date as day from log_events")
def file_dates(s, d):
    return t(s, d, "log_events").select("file", file_date(F.col("file")).alias("day")).distinct()


QUERIES["file_date"], ORACLES["file_date"] = QUERIES.pop("file_dates"), ORACLES.pop("file_dates")

_SEVERITY_SQL = r"""coalesce(case upper(trim(coalesce(severity_raw, ''))) when 'ERR' then 'error' when 'WRN' then 'warning' when 'DBG' then 'debug' when 'CRITICAL' then 'critical'
    when 'FATAL' then 'critical' when 'ERROR' then 'error' when 'WARN' then 'warning' when 'WARNING' then 'warning' when 'INFO' then 'info' when 'DEBUG' then 'debug' when 'TRACE' then 'debug' end, 'info')"""


@query(f"select event_id, {_SEVERITY_SQL} as level from log_events")
def severity_normalize(s, d):
    return t(s, d, "log_events").select("event_id", severity(F.col("severity_raw")).alias("level"))


def _message_query(name: str, change: Callable[[Column], Column], sql: str) -> None:
    QUERIES[name] = lambda s, d: t(s, d, "log_events").where("message is not null").select("event_id", change(F.col("message")).alias("text"))
    ORACLES[name] = f"select event_id, {sql} as text from log_events where message is not null"


_T_EXTRACT = Transform("extract", r"(?P<what>\w+) (?P<n>\d+) (?P<rest>\w+)", 10, ("what", "rest"))
_T_REPLACE = Transform("replace", r"(\w+) (\d+)", 20, replacement=r"\2 of \1")
_T_STRIP = Transform("strip", r"\s*0x[0-9a-f]+", 30)
_T_COLLAPSE = Transform("collapse", r"[a-z ]{12,}", 40, max_length=10, annotation="<{byte_count}>")
_S_EXTRACT = r"case when regexp_matches({x}, '(\w+) (\d+) (\w+)') then regexp_extract({x}, '(\w+) (\d+) (\w+)', 1) || ' ' || regexp_extract({x}, '(\w+) (\d+) (\w+)', 3) else {x} end"
_S_REPLACE = r"regexp_replace({x}, '(\w+) (\d+)', '\2 of \1', 'g')"
_S_STRIP = r"regexp_replace({x}, '\s*0x[0-9a-f]+', '', 'g')"
_S_COLLAPSE = r"""case when length(regexp_extract({x}, '[a-z ]{{12,}}')) > 10 then substr({x}, 1, position(regexp_extract({x}, '[a-z ]{{12,}}') in {x}) - 1 + 10) ||
    '<' || (length(regexp_extract({x}, '[a-z ]{{12,}}')) - 10) || '>' || substr({x}, position(regexp_extract({x}, '[a-z ]{{12,}}') in {x}) + length(regexp_extract({x}, '[a-z ]{{12,}}'))) else {x} end"""
for _name, _t, _s in (("extract", _T_EXTRACT, _S_EXTRACT), ("replace", _T_REPLACE, _S_REPLACE), ("strip", _T_STRIP, _S_STRIP), ("collapse", _T_COLLAPSE, _S_COLLAPSE)):
    _message_query(f"transform_{_name}", lambda c, _t=_t: log_rules.apply_transform(c, _t), _s.format(x="message"))
_message_query("transform_chain", lambda c: log_rules.apply_chain(c, [_T_COLLAPSE, _T_STRIP, _T_REPLACE]), _S_COLLAPSE.format(x="(" + _S_STRIP.format(x=_S_REPLACE.format(x="message")) + ")"))

_KEY_SQL = f"regexp_replace(coalesce(message, ''), '{OPENING_STAMP}', '')"
_DEDUP_SQL = f"""
    with k as (select file, line_no, event_id, {_KEY_SQL} as key from {_EVENTS_SQL}),
    f as (select *, lag(key) over (partition by file order by line_no) as before from k),
    r as (select *, sum(case when before is null or before <> key then 1 else 0 end) over (partition by file order by line_no) as run from f),
    c as (select *, count(*) over (partition by file, run) as size, min(line_no) over (partition by file, run) as first_line from r),
    dedup as (select file, line_no, event_id, (case when size >= 3 then size else 1 end)::int as n from c where size < 3 or line_no = first_line)"""


@query(f"{_DEDUP_SQL} select file, line_no, event_id, n from dedup")
def log_dedup(s, d):
    return log_rules.deduplicated(_events(s, d)).select("file", "line_no", "event_id", "n")


@query(f"{_DEDUP_SQL} select file, line_no as line_start, line_no as line_end, null::varchar as rule, 1 as n_events from dedup")
def log_group(s, d):
    return log_rules.group_events(log_rules.deduplicated(_events(s, d)), [])


@query()
def log_group_rules(s, d):
    events = log_rules.deduplicated(_events(s, d))
    second = F.floor(utc_micros(F.col("timestamp_iso"))["earliest"] / 1_000_000).cast("double")
    ready = events.select("file", "line_no", second.alias("second"), F.concat_ws("|", "event_type", "message").alias("text"))
    return log_rules.group_events(ready, [GroupRule("session", r"session .* opened", (r"session", r"cache", r"token"), 60_000), GroupRule("retry", r"retry \d+", (), 30_000)])


_LEVEL_E = _SEVERITY_SQL.replace("severity_raw", "e.severity_raw")


@query(f"""with e as (select group_id, unnest(events) as e, generate_subscripts(events, 1) as pos from log_groups where events is not null),
    l as (select group_id, pos, e.line_no as line_no, e.message as message, {_LEVEL_E} as level from e),
    r as (select *, case level when 'debug' then 0 when 'info' then 1 when 'warning' then 2 when 'error' then 3 else 4 end as rank from l)
    select group_id, min(line_no) as line_start, max(line_no) as line_end, max_by(level, rank * 100000 - pos) as severity, count(*) as n_events, count(distinct message) as n_messages from r group by group_id""")
def log_group_agg(s, d):
    return log_rules.group_aggregates(t(s, d, "log_groups"))


@query("""select group_id, md5(array_to_string(list_transform(events, lambda e: coalesce(e.message, '') ||
    case when dedup_counts[e.message] is not null then ' [repeated ' || dedup_counts[e.message] || 'x]' else '' end), chr(10))) as text_hash from log_groups where events is not null""")
def log_group_text(s, d):
    return log_rules.group_text(t(s, d, "log_groups")).select("group_id", F.md5("text").alias("text_hash"))


_GROUPED_SQL = f"""(select file, (line_no // 40)::int as line_start, line_no, event_id, coalesce(message, '') as message, coalesce(continuation_lines, []) as below, timestamp_iso, {_SEVERITY_SQL} as level,
    device_id, error_code, event_type, (1 + event_id % 3)::int as n from {_EVENTS_SQL})"""


@query(f"""with g as {_GROUPED_SQL}, r as (select *, case level when 'debug' then 0 when 'info' then 1 when 'warning' then 2 when 'error' then 3 else 4 end as rank,
      last_value(case when n > 1 then n end ignore nulls) over (partition by file, line_start, message order by line_no rows between unbounded preceding and unbounded following) as times from g)
    select file, line_start, max_by(line_no + len(below), line_no)::int as line_end, min(timestamp_iso) as timestamp_start, max(timestamp_iso) as timestamp_end,
      max_by(level, rank * 1000000 - line_no) as severity, coalesce(min_by(device_id, line_no) filter (device_id <> ''), '') as device_id, coalesce(min_by(error_code, line_no) filter (error_code <> ''), '') as error_code,
      arg_min_null(event_type, line_no) as event_type, count(*)::int as n_events,
      md5(string_agg(message || case when times is not null then ' [repeated ' || times || 'x]' else '' end || case when len(below) > 0 then chr(10) || array_to_string(below, chr(10)) else '' end, chr(10) order by line_no)) as text_hash
    from r group by file, line_start""")
def log_group_rows(s, d):
    newest = t(s, d, "log_events").groupBy("file", "line_no").agg(F.min_by(F.struct("event_id", "message", "continuation_lines", "timestamp_iso", "severity_raw", "device_id", "error_code", "event_type"), "event_id").alias("e"))
    events = newest.select("file", "line_no", "e.*").withColumns({"line_start": F.floor(F.col("line_no") / 40).cast("int"), "severity": severity(F.col("severity_raw")), "n": (1 + F.col("event_id") % 3).cast("int")})
    rows = log_rules.group_rows(events)
    return rows.select("file", "line_start", "line_end", "timestamp_start", "timestamp_end", "severity", "device_id", "error_code", "event_type", "n_events", F.md5("text").alias("text_hash"))


_PARSED_SQL = rf"""(with e as (select file, owner as line_no, max(case when p is not null then line end) as line, max(p) as p, string_agg(line, chr(10) order by line_no) filter (p is null) as below
      from {_BELOW_SQL} where k <= 501 group by file, owner)
    select file, line_no, case when p = 'device' then regexp_extract(line, '{DEVICE_SQL}', 1) else regexp_extract(line, '{ISO_SQL}', 2) end as severity_raw,
      regexp_replace((case when p = 'device' then regexp_extract(line, '{DEVICE_SQL}', 4) else regexp_extract(line, '{ISO_SQL}', 3) end) || coalesce(chr(10) || below, ''), '\s*0x[0-9a-f]+', '', 'g') as message from e)"""


@query(f"""with k as (select *, {_KEY_SQL} as key from {_PARSED_SQL}),
    f as (select *, lag(key) over (partition by file order by line_no) as before from k),
    r as (select *, sum(case when before is null or before <> key then 1 else 0 end) over (partition by file order by line_no) as run from f),
    c as (select *, count(*) over (partition by file, run) as size, min(line_no) over (partition by file, run) as first_line from r)
    select file || '::line_' || line_no as id, line_no as line_end, {_SEVERITY_SQL} as severity, md5(message || case when size >= 3 then ' [repeated ' || size || 'x]' else '' end) as text_hash
    from c where size < 3 or line_no = first_line""")
def index_log_file(s, d):
    rows = log_rules.index_log_lines(_plain_lines(s, d), PATTERNS, transforms=[_T_STRIP])
    return rows.select("id", "line_end", "severity", F.md5("text").alias("text_hash"))


@query(f"""{_DEDUP_SQL} select d.file, d.line_no, d.event_id, d.n, {_SEVERITY_SQL.replace('severity_raw', 'x.severity_raw')} as level, {_S_STRIP.format(x="coalesce(x.message, '')")} as text
    from dedup d join log_events x using (event_id)""")
def log_pipeline(s, d):
    kept = log_rules.deduplicated(_events(s, d))
    text = log_rules.apply_chain(F.coalesce("message", F.lit("")), [_T_STRIP])
    return kept.select("file", "line_no", "event_id", "n", severity(F.col("severity_raw")).alias("level"), text.alias("text"))
