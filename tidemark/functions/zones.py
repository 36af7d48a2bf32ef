"""Versioned zone transition tables: instants, offsets and abbreviations as sorted arrays."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np

FIRST, LAST = 0, 4102444800  # 1970-01-01 and 2100-01-01, in seconds
STEP = 5 * 86_400


class ZoneTable(NamedTuple):
    name: str
    version: str
    since: np.ndarray  # UTC second from which offsets[i] holds
    offsets: np.ndarray  # seconds east of UTC
    labels: np.ndarray  # abbreviation in force

    def at(self, utc: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.since, utc, side="right") - 1, 0)


def tz_version() -> str:
    """Version of the zone rules in use, kept with every table built from them."""
    try:
        with open("/usr/share/zoneinfo/tzdata.zi") as f:
            return f.readline().split()[-1]
    except OSError:
        pass
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=None)
def zone_table(name: str | None) -> ZoneTable:
    """Transitions of a zone, found by stepping five days and bisecting to the second; UTC where the name is unknown."""
    try:
        zone = ZoneInfo(name) if name else ZoneInfo("UTC")
    except (ZoneInfoNotFoundError, ValueError, OSError):
        name, zone = "UTC", dt.timezone.utc

    def state(second: int) -> tuple[int, str]:
        when = dt.datetime.fromtimestamp(second, zone)
        return int(when.utcoffset().total_seconds()), when.tzname() or ""

    since, states = [FIRST], [state(FIRST)]
    at = FIRST
    while at < LAST:
        nxt = min(at + STEP, LAST)
        now = state(nxt)
        if now != states[-1]:
            low, high = at, nxt
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if state(mid) == states[-1] else (low, mid)
            since.append(high)
            states.append(now)
        at = nxt
    since[0] = -(1 << 40)
    return ZoneTable(
        name or "UTC", tz_version(), np.array(since, np.int64), np.array([s[0] for s in states], np.int64),
        np.array([s[1] for s in states], dtype=object),
    )


def local_to_utc(local: np.ndarray, zone: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Both UTC seconds a local second may stand for; they differ only where clocks were set back.

    A local time skipped when clocks were set forward takes the offset in force before the change.
    """
    table = zone_table(zone)
    before = local - table.offsets[table.at(local - 86_400)]
    after = local - table.offsets[table.at(local + 86_400)]
    before_ok = table.offsets[table.at(before)] == local - before
    after_ok = table.offsets[table.at(after)] == local - after
    first = np.where(before_ok | ~after_ok, before, after)
    second = np.where(after_ok, after, first)
    return np.minimum(first, second), np.maximum(first, second)


def labelled_to_utc(local: np.ndarray, zone: str | None, label: str) -> tuple[np.ndarray, np.ndarray]:
    """As local_to_utc, with the printed label of the zone choosing the offset."""
    table = zone_table(zone)
    early, late = local_to_utc(local, zone)
    early_named = table.labels[table.at(early)] == label
    late_named = table.labels[table.at(late)] == label
    known = np.flatnonzero(table.labels == label)
    if len(known):
        fixed = local - table.offsets[known[-1]]
    elif label in ("UTC", "GMT", "Z"):
        fixed = local
    else:
        return early, late
    one = np.where(early_named, early, np.where(late_named, late, fixed))
    return one, one
