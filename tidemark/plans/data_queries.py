"""Queries of the general data problems over the project's tables."""

from __future__ import annotations

from tidemark.operators import log_template, timestamps
from tidemark.session import table

QUERIES = {
    "p1_found": lambda s, d: timestamps.wrong_instants(table(s, d, "log_events"), table(s, d, "log_groups"), table(s, d, "devices")),
    "p1_events": lambda s, d: timestamps.normalized_events(table(s, d, "log_events"), table(s, d, "devices")),
    "p1_groups": lambda s, d: timestamps.normalized_groups(table(s, d, "log_groups"), table(s, d, "devices")),
    "p4_found": lambda s, d: log_template.found_entries(table(s, d, "log_lines")),
    "p4_entries": lambda s, d: log_template.log_entries(table(s, d, "log_lines")),
    "p4_continuations": lambda s, d: log_template.continuation_lines(table(s, d, "log_lines")),
}
ORACLES: dict[str, str] = {}
