import datetime as dt
import random
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.zones import local_to_utc, tz_version, zone_table
from tidemark.operators import timestamps as ts

EVENTS = "event_id bigint, file string, line_no int, timestamp_raw string, timestamp_iso string, indexed_at timestamp"
DEVICES = "device_id string, tz_name string"
UTC = dt.timezone.utc


def resolve_one(stamp, zone=None, day=None, ref=None):
    import re

    mask = re.sub("[A-Za-z]", "a", re.sub(r"\d", "9", stamp))
    days = (day - dt.date(1970, 1, 1)).days if day else np.nan
    low, high = ts.resolve(np.array([stamp], object), np.array([mask], object), np.array([zone], object), np.array([days], float), np.array([ref.timestamp() if ref else np.nan]))
    to = lambda x: None if np.isnan(x) else dt.datetime.fromtimestamp(x / 1e6, UTC)
    return to(low[0]), to(high[0])


@pytest.mark.parametrize(
    ("stamp", "zone", "want"),
    [
        ("2025-01-02T03:04:05Z", None, "2025-01-02T03:04:05+00:00"),
        ("2025-01-02 03:04:05.678+02:00", None, "2025-01-02T01:04:05.678000+00:00"),
        ("2025-07-02 03:04:05,678", "Europe/Berlin", "2025-07-02T01:04:05.678000+00:00"),
        ("2025-07-02 03:04", "America/New_York", "2025-07-02T07:04:00+00:00"),
        ("02.11.2024 22:54:33", "America/New_York", "2024-11-03T02:54:33+00:00"),
        ("02/17/2024 04:22:48 AM", "Europe/Helsinki", "2024-02-17T02:22:48+00:00"),
        ("02/17/2024 12:00:00 AM", "UTC", "2024-02-17T00:00:00+00:00"),
        ("02/17/2024 12:00:00 PM", "UTC", "2024-02-17T12:00:00+00:00"),
        ("20250329T231314Z", None, "2025-03-29T23:13:14+00:00"),
        ("23/Oct/2024:10:10:28 +0200", None, "2024-10-23T08:10:28+00:00"),
        ("Wed, 04 Jun 2025 11:22:32 +0000", None, "2025-06-04T11:22:32+00:00"),
        ("2024-12-31 14:26:42 PST", "America/Los_Angeles", "2024-12-31T22:26:42+00:00"),
        ("2024-11-03 01:30:00 PST", "America/Los_Angeles", "2024-11-03T09:30:00+00:00"),
        ("2024-11-03 01:30:00 PDT", "America/Los_Angeles", "2024-11-03T08:30:00+00:00"),
        ("1750666500", None, "2025-06-23T08:15:00+00:00"),
        ("1750666500.250", None, "2025-06-23T08:15:00.250000+00:00"),
        ("1729672790873", None, "2024-10-23T08:39:50.873000+00:00"),
        ("1761417732376417", None, "2025-10-25T18:42:12.376417+00:00"),
    ],
)
def test_forms(stamp, zone, want):
    low, high = resolve_one(stamp, zone)
    assert low == high and low.isoformat() == want


@pytest.mark.parametrize("stamp", ["", "n/a", "--:--:--", "boot+12.3s", "0000-00-00 00:00:00", "2025-02-30 10:00:00", "2025-01-01 25:00:00", "13/45/2025 01:00:00", "x" * 10_000])
def test_no_time(stamp):
    assert resolve_one(stamp, "UTC") == (None, None)


def test_missing_parts():
    assert resolve_one("18:10:02:056", "UTC")[0] is None
    assert resolve_one("18:10:02:056", "Europe/Berlin", dt.date(2024, 3, 10))[0].isoformat() == "2024-03-10T17:10:02.056000+00:00"
    ref = dt.datetime(2025, 1, 1, 16, tzinfo=UTC)
    assert resolve_one("Dec 31 14:36:11", "UTC", None, ref)[0].year == 2024
    assert resolve_one("Jan  1 15:00:00", "UTC", None, ref)[0].year == 2025
    assert resolve_one("Feb 29 15:00:00", "UTC", None, ref)[0].year == 2024
    assert resolve_one("Dec 31 14:36:11", "UTC")[0] is None


def test_hour_that_occurs_twice():
    low, high = resolve_one("2024-11-03 01:30:00", "America/New_York")
    assert (high - low).total_seconds() == 3600


def test_zone_tables_against_zoneinfo():
    rng = random.Random(3)
    assert tz_version()
    for name in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/Lisbon"):
        zone, table = ZoneInfo(name), zone_table(name)
        local = np.array([rng.randrange(1_000_000_000, 1_900_000_000) for _ in range(500)])
        low, high = local_to_utc(local, name)
        for loc, a, b in zip(local, low, high):
            naive = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(loc))
            both = {int(naive.replace(tzinfo=zone, fold=f).timestamp()) for f in (0, 1)}
            back = dt.datetime.fromtimestamp(int(a), zone).replace(tzinfo=None)
            if back == naive:
                assert {int(a), int(b)} == {u for u in both if dt.datetime.fromtimestamp(u, zone).replace(tzinfo=None) == naive}
        assert len(table.since) == len(table.offsets)


def test_wrong_instants(spark):
    at = dt.datetime(2025, 1, 1, 12)
    events = spark.createDataFrame(
        [
            (1, "p/logs/d1/r/x.log", 1, "2024-07-01 10:00:00", "2024-07-01T08:00:00Z", at),
            (2, "p/logs/d1/r/x.log", 2, "2024-07-01 10:00:00", "2024-07-01T10:00:00Z", at),
            (3, "p/logs/d1/r/x.log", 3, "2024-07-01 10:00:00.9", "2024-07-01T08:00:00.1Z", at),
            (4, "p/logs/d1/r/x.log", 4, None, "2024-07-01T08:00:00Z", at),
            (5, "p/logs/d1/r/x.log", 5, "2024-07-01 10:00:00", None, at),
            (6, None, None, "2024-07-01T10:00:00Z", "2024-07-01T12:00:00+02:00", None),
            (7, "p/logs/none/r/x.log", 7, "2024-10-27 02:30:00", "2024-10-27T02:30:00Z", at),
            (8, "p/logs/d1/r/x.log", 8, "2024-10-27 02:30:00", "2024-10-27T01:30:00Z", at),
            (9, "p/logs/d1/r/x.log", 9, "2024-10-27 02:30:00", "2024-10-27T00:30:00Z", at),
        ],
        EVENTS,
    ).withColumn("_zone", F.lit("clash"))
    devices = spark.createDataFrame([("d1", "Europe/Berlin"), ("d2", None), (None, "UTC"), ("d1", "Europe/Berlin")], DEVICES)
    groups = spark.createDataFrame(
        [
            (1, "p/logs/d1/r/x-24-07-01.log", "2024-07-01T08:00:00Z", [("10:00:01:000",), ("10:00:00:500",), (None,)], at),
            (2, "p/logs/d1/r/x-24-07-01.log", "2024-07-01T08:00:01Z", [("10:00:01:000",), ("10:00:00:500",)], at),
            (3, "p/logs/d1/r/x-24-07-01.log", None, [("10:00:01:000",)], at),
            (4, "p/logs/d1/r/x-24-07-01.log", "2024-07-01T08:00:01Z", None, at),
            (5, "p/logs/d1/r/x-24-07-01.log", "2024-07-01T08:00:01Z", [], at),
        ],
        "group_id bigint, file string, timestamp_start string, events array<struct<timestamp_raw string>>, indexed_at timestamp",
    )
    got = {tuple(r) for r in ts.wrong_instants(events, groups, devices).collect()}
    assert got == {("log_events", 2), ("log_groups", 2)}
    none = ts.wrong_instants(events.limit(0), groups.limit(0), devices.limit(0))
    assert none.count() == 0 and none.columns == ["rec", "rec_id"]
