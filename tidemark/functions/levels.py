"""Levels of log events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

# What raw prefixes count as.
SEVERITIES = {
    "ERR": "error", "WRN": "warning", "DBG": "debug", "CRITICAL": "critical", "FATAL": "critical", "ERROR": "error",
    "WARN": "warning", "WARNING": "warning", "INFO": "info", "DEBUG": "debug", "TRACE": "debug",
}
# Order of levels.
RANKS = {"debug": 0, "info": 1, "warning": 2, "error": 3, "critical": 4}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def severity(raw: Column, custom: dict[str, str] | None = None) -> Column:
    """Normalised level: a custom map (as it stands, then in capitals) before the built-in one; info for the rest."""
    plain = F.coalesce(strip(raw), F.lit(""))
    found = [F.try_element_at(_map(SEVERITIES), F.upper(plain))]
    if custom:
        found = [F.try_element_at(_map(custom), plain), F.try_element_at(_map(custom), F.upper(plain)), *found]
    return F.coalesce(*found, F.lit("info"))


def rank(level: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(RANKS), level), F.lit(1))
