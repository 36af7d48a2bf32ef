"""Queries of the training-text problems over the project's tables."""

from __future__ import annotations

from tidemark.llm import encoding, mixing, packing, runs, scans, sentences, split
from tidemark.llm.tokens import document_sizes
from tidemark.session import table as t

QUERIES = {
    "p2_found": lambda s, d: runs.found_runs(t(s, d, "log_groups"), t(s, d, "devices")),
    "p2_collapsed": lambda s, d: runs.collapsed_groups(t(s, d, "log_groups"), t(s, d, "devices")),
    "p3_found": lambda s, d: scans.found_faults(t(s, d, "files")),
    "p3_repaired": lambda s, d: scans.repaired_files(t(s, d, "files")),
    "p5_found": lambda s, d: encoding.found_texts(t(s, d, "files")),
    "p5_restored": lambda s, d: encoding.restored_texts(t(s, d, "files")),
    "p6_found": lambda s, d: split.found_oversized(t(s, d, "chunks"), t(s, d, "chunking_config")),
    "p6_pieces": lambda s, d: split.chunk_pieces(t(s, d, "chunks"), t(s, d, "chunking_config")),
    "p7_bins": lambda s, d: packing.packed(document_sizes(t(s, d, "documents")), t(s, d, "pack_sizes")),
    "p7_report": lambda s, d: packing.packing_report(packing.packed(document_sizes(t(s, d, "documents")), t(s, d, "pack_sizes"))),
    "p8_mix": lambda s, d: mixing.mixed(document_sizes(t(s, d, "documents")), t(s, d, "mix_targets")),
    "p8_shares": lambda s, d: mixing.mix_shares(document_sizes(t(s, d, "documents")), t(s, d, "mix_targets")),
    "p8_tempered": lambda s, d: mixing.tempered_weights(document_sizes(t(s, d, "documents")), t(s, d, "mix_targets")),
    "p9_found": lambda s, d: sentences.found_units(t(s, d, "documents")),
    "p9_units": lambda s, d: sentences.sentence_units(t(s, d, "documents")),
}

_TIMES = (
    r"\d{4}[-/]\d\d[-/]\d\d[t ]\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?(?: ?z\b| ?[+-]\d\d:?\d\d)?|\d{8}t\d{6}z?"
    r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* +\d\d? \d\d:\d\d:\d\d|\d\d?:\d\d(?::\d\d(?:[:.,]\d+)?)?(?: ?[ap]m\b)?"
)

ORACLES = {
    "p2_found": rf"""
        with e as (select group_id, unnest(events) as e from log_groups where events is not null),
        one as (select group_id, e.line_no as line_no, max(e.message) as message from e where e.line_no is not null group by all),
        w as (select group_id, line_no, case when message is null or trim(message) = '' then null else array_to_string(list_filter(
            regexp_split_to_array(regexp_replace(lower(message), '{_TIMES}', ' ', 'g'), '[^a-z0-9]+'),
            lambda x: x <> '' and not regexp_full_match(x, '(?:0x)?[0-9a-f]*[0-9][0-9a-f]*|0x[0-9a-f]+')), ' ') end as words from one),
        f as (select *, coalesce(words = lag(words) over (partition by group_id order by line_no), false) as same from w),
        r as (select *, count(*) filter (not same) over (partition by group_id order by line_no) as run from f)
        select group_id, min(line_no) as line_start, max(line_no) as line_end from r where words is not null group by group_id, run having count(*) >= 3""",
    "p6_found": """
        select k.chunk_id from chunks k
        left join chunking_config c on c.project = k.project
        left join (select chunk_size from chunking_config where project = 'default') z on true
        where length(k.content) > coalesce(c.chunk_size, z.chunk_size)
          and not regexp_full_match(k.content, '(\\s|[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}])*')
    """,
}
