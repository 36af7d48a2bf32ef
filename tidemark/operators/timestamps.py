"""Mixed timestamp forms and zones to one UTC instant.

Each stamp is tokenised into a mask of character classes (digits ``9``, letters ``a``, the rest as is). A mask is mapped
to a parser once; the parser reads its fields from fixed positions for all stamps of that mask in a batch, as arrays,
and local times go through versioned zone transition tables.

Defined results: null, blank or unreadable stamps and impossible dates give null; a time without date takes the date
given for its file (null without one); a date without year takes the latest year whose instant is not after the
reference time (null without one); where a local time occurs twice both instants are returned, the earlier first; a
skipped local time takes the offset before the change; unknown zones count as UTC. Other columns are never touched.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.zones import labelled_to_utc, local_to_utc
from tidemark.session import spread

# English month names as logs print them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,:](?P<f>9{1,9}))?)?"
_ZONE = r"(?: ?(?P<sign>[+-])(?P<zh>99):?(?P<zm>99)| ?(?P<word>a{1,5}))?"
_FORMS = (
    rf"(?P<Y>9999)[-/](?P<M>99)[-/](?P<D>99)(?:a| +){_TIME}{_ZONE}",
    rf"(?P<Y>9999)(?P<M>99)(?P<D>99)a(?P<h>99)(?P<mi>99)(?P<s>99)(?:[.,](?P<f>9{{1,9}}))?{_ZONE}",
    rf"(?P<M>99?)/(?P<D>99?)/(?P<Y>9999),? {_TIME}{_ZONE}",
    rf"(?P<D>99?)\.(?P<M>99?)\.(?P<Y>9999),? {_TIME}{_ZONE}",
    rf"(?:a{{3,9}}, )?(?P<D>99?)[-/ ](?P<mon>a{{3,9}})[-/ ](?P<Y>9999)[: ]{_TIME}{_ZONE}",
    rf"(?:a{{3}} )?(?P<mon>a{{3}}) +(?P<D>99?) {_TIME}{_ZONE}",
    rf"{_TIME}{_ZONE}",
    r"(?P<e>9{10})(?:[.,](?P<f>9{1,9}))?",
    r"(?P<e>9{10})(?P<f>9{3}|9{6}|9{9})",
)
_NUMBERS = ("Y", "M", "D", "h", "mi", "s", "e", "zh", "zm")


def text_form(mask_form: str) -> str:
    """The regular expression of texts whose mask matches a form, without named groups; quantifiers stay."""
    parts = re.split(r"(\{[\d,]+\})", re.sub(r"\(\?P<\w+>", "(?:", mask_form))
    return "".join(x if k % 2 else x.replace("9", r"\d").replace("a", "[A-Za-z]") for k, x in enumerate(parts))


# Masks of stamps that may open a message: a date with time and perhaps a zone, a time of four parts, a month with day and time.
OPENING_MASKS = (r"9999-99-99(?:a| )99:99:99(?:\.9{1,9})?(?:a|[+-]99:?99)?", r"99:99:99:999", r"a{3} +99? 99:99:99")
FULL_STAMP = text_form(OPENING_MASKS[0])
OPENING_STAMP = rf"^(?:{'|'.join(map(text_form, OPENING_MASKS))})\s*"


def stamp_mask(stamp: Column) -> Column:
    """Character classes of a trimmed stamp."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    trimmed = F.regexp_replace(stamp, r"^\s+|\s+$", "")
    return F.translate(trimmed, "012345678" + letters, "9" * 9 + "a" * len(letters))


@lru_cache(maxsize=65_536)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """The positions of the fields in stamps of this mask; None where it holds no time."""
    for form in _FORMS:
        if found := re.fullmatch(form, mask):
            return {name: found.span(name) for name, text in found.groupdict().items() if text is not None}
    return None


def _days(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1)
    month = np.where(ok, month, 1)
    start = (np.where(ok, year, 1970) - 1970) * 12 + month - 1
    first = start.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (start + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + day - 1, ok & (day <= after - first)


def resolve(stamps: np.ndarray, masks: np.ndarray, zones: np.ndarray, file_days: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earlier and later instant of each stamp in microseconds, as floats with NaN for none.

    ``file_days`` are days since 1970, ``refs`` seconds; both are floats with NaN for none.
    """
    low, high = np.full(len(stamps), np.nan), np.full(len(stamps), np.nan)
    for mask, rows in pd.Series(np.arange(len(masks))).groupby(masks).indices.items():
        if (fields := parser_of(mask)) is None:
            continue
        n, width = len(rows), len(mask)
        text = np.array(stamps[rows], dtype=f"U{width}")
        codes = text.view(np.uint32).reshape(n, width).astype(np.int64) - 48
        number = {k: codes[:, a:b] @ (10 ** np.arange(b - a - 1, -1, -1)) for k in _NUMBERS if k in fields for a, b in [fields[k]]}
        words = {k: np.array([t[a:b] for t in text], dtype=object) for k in ("mon", "word", "sign") if k in fields for a, b in [fields[k]]}
        micros = np.zeros(n, np.int64)
        if "f" in fields:
            a, b = fields["f"]
            digits = min(b - a, 6)
            micros = (codes[:, a : a + digits] @ (10 ** np.arange(digits - 1, -1, -1))) * 10 ** (6 - digits)
        if "e" in number:
            low[rows] = high[rows] = number["e"] * 1e6 + micros
            continue
        hour, minute, second = number["h"], number["mi"], number.get("s", np.zeros(n, np.int64))
        ok = (hour < 24) & (minute < 60) & (second < 61)
        label = np.full(n, None, dtype=object)
        if "word" in words:
            upper = np.array([w.upper() for w in words["word"]], dtype=object)
            half = (upper == "AM") | (upper == "PM")
            ok &= ~half | ((hour >= 1) & (hour <= 12))
            hour = np.where(half, hour % 12 + 12 * (upper == "PM"), hour)
            label = np.where(half, None, upper)
        clock = hour * 3600 + minute * 60 + second
        offset = None
        if "sign" in words:
            offset = np.where(words["sign"] == "-", -1, 1) * (number["zh"] * 3600 + number["zm"] * 60)

        def utc(days: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            local = days * 86_400 + clock[which]
            if offset is not None:
                return local - offset[which], local - offset[which]
            early, late = local.copy(), local.copy()
            keys = pd.DataFrame({"z": zones[rows][which], "l": label[which]})
            for (zone, name), part in keys.groupby(["z", "l"], dropna=False).indices.items():
                zone, name = (None if pd.isna(x) else x for x in (zone, name))
                if name == "Z":
                    continue
                early[part], late[part] = labelled_to_utc(local[part], zone, name) if name else local_to_utc(local[part], zone)
            return early, late

        early, late = np.full(n, np.nan), np.full(n, np.nan)
        month = number.get("M")
        if "mon" in words:
            month = np.array([MONTHS.index(w[:3].lower()) + 1 if w[:3].lower() in MONTHS else 0 for w in words["mon"]], np.int64)
        if "Y" in number:
            days, exists = _days(number["Y"], month, number["D"])
            which = np.flatnonzero(ok & exists)
            early[which], late[which] = utc(days[which], which)
        elif month is not None:
            ref = refs[rows]
            year = np.where(np.isnan(ref), 0, ref).astype("datetime64[s]").astype("datetime64[Y]").astype(np.int64) + 1970
            open_ = ok & ~np.isnan(ref)
            for back in range(-1, 9):  # a date comes again within eight years, the 29th of February too
                if not open_.any():
                    break
                days, exists = _days(year - back, month, number["D"])
                which = np.flatnonzero(open_ & exists)
                if not len(which):
                    continue
                e, l = utc(days[which], which)
                fits = e <= ref[which]
                early[which[fits]], late[which[fits]] = e[fits], np.where(l <= ref[which], l, e)[fits]
                open_[which[fits]] = False
        else:
            which = np.flatnonzero(ok & ~np.isnan(file_days[rows]))
            early[which], late[which] = utc(file_days[rows][which].astype(np.int64), which)
        low[rows], high[rows] = early * 1e6 + micros, late * 1e6 + micros
    return low, high


_INSTANTS = T.StructType([T.StructField("earliest", T.LongType()), T.StructField("latest", T.LongType())])


@F.pandas_udf(_INSTANTS)
def _resolve_udf(stamps: pd.Series, masks: pd.Series, zones: pd.Series, days: pd.Series, refs: pd.Series) -> pd.DataFrame:
    live = masks.notna().to_numpy()
    low, high = np.full(len(live), np.nan), np.full(len(live), np.nan)
    pick = lambda s, kind: s[live].to_numpy(dtype=kind, na_value=np.nan if kind is float else None)
    low[live], high[live] = resolve(pick(stamps, object), pick(masks, object), pick(zones, object), pick(days, float), pick(refs, float))
    return pd.DataFrame(
        {k: pd.Series(np.where(np.isnan(v), 0, v).astype(np.int64)).astype("Int64").mask(np.isnan(v)) for k, v in (("earliest", low), ("latest", high))}
    )


def utc_micros(stamp: Column, zone: Column | None = None, file_date: Column | None = None, reference: Column | None = None) -> Column:
    """A struct (earliest, latest) of microseconds since 1970 for a printed stamp."""
    trimmed = F.regexp_replace(stamp, r"^\s+|\s+$", "")
    day = F.datediff(file_date, F.lit("1970-01-01").cast("date")).cast("double") if file_date is not None else F.lit(None).cast("double")
    ref = F.floor(F.unix_micros(reference) / 1_000_000).cast("double") if reference is not None else F.lit(None).cast("double")
    mask = F.when(F.length(trimmed) > 0, stamp_mask(stamp))
    return _resolve_udf(trimmed, mask, zone if zone is not None else F.lit(None).cast("string"), day, ref)


def file_date(file: Column) -> Column:
    """The date in a file name that ends in ``YY-MM-DD.log``; null for none or an impossible one."""
    found = F.regexp_extract(file, r"(\d{2}-\d{2}-\d{2})\.log$", 1)
    return F.when(found != "", F.try_to_date(F.concat(F.lit("20"), found), "yyyy-MM-dd"))


def file_device(file: Column) -> Column:
    return F.try_element_at(F.split(file, "/"), F.lit(3))


def with_zone(rows: DataFrame, devices: DataFrame) -> DataFrame:
    """Adds ``_zone`` of the device that the file names; devices without a row keep null."""
    zones = devices.groupBy(F.col("device_id").alias("_device")).agg(F.max("tz_name").alias("_zone")).where("_device is not null")
    return rows.withColumn("_device", file_device(F.col("file"))).join(zones, "_device", "left").drop("_device")


def _seconds(micros: Column) -> Column:
    return F.floor(micros / 1_000_000)


def event_instants(events: DataFrame, devices: DataFrame) -> DataFrame:
    """Per event: ``ts_utc`` (the earlier instant), ``ts_utc_alt`` (the later) and ``iso_utc`` of what an earlier run made of it."""
    slim = spread(events.select("event_id", "file", "timestamp_raw", "timestamp_iso", "indexed_at"))
    read = with_zone(slim, devices).select(
        "event_id",
        "timestamp_raw",
        utc_micros(F.col("timestamp_raw"), F.col("_zone"), file_date(F.col("file")), F.col("indexed_at")).alias("raw"),
        utc_micros(F.col("timestamp_iso")).alias("iso"),
    )
    return read.select(
        "event_id", "timestamp_raw", F.col("raw.earliest").alias("raw_us"), F.col("raw.latest").alias("raw_alt_us"), F.col("iso.earliest").alias("iso_us")
    )


def group_instants(groups: DataFrame, devices: DataFrame) -> DataFrame:
    """Per group: the earliest instant of its events and whether timestamp_start denotes one it may be.

    Where events stand in an hour that occurs twice either reading is right, so every candidate instant up to the
    smallest later reading may be the earliest.
    """
    slim = with_zone(spread(groups.select("group_id", "file", "timestamp_start", "indexed_at", F.col("events.timestamp_raw").alias("stamps"))), devices)
    flat = slim.select("group_id", "file", "_zone", "indexed_at", F.explode(F.array_distinct("stamps")).alias("stamp"))
    read = flat.select(
        "group_id", utc_micros(F.col("stamp"), F.col("_zone"), file_date(F.col("file")), F.col("indexed_at")).alias("t")
    ).where("t.earliest is not null")
    per = read.groupBy("group_id").agg(
        F.min("t.earliest").alias("start_us"),
        F.min("t.latest").alias("bound_us"),
        F.array_distinct(F.flatten(F.collect_set(F.array(_seconds(F.col("t.earliest")), _seconds(F.col("t.latest")))))).alias("seconds"),
    )
    starts = groups.select("group_id", utc_micros(F.col("timestamp_start")).alias("s")).select("group_id", F.col("s.earliest").alias("given_us"))
    given = _seconds(F.col("given_us"))
    right = F.array_contains("seconds", given) & (given <= _seconds(F.col("bound_us")))
    return per.join(starts, "group_id").select("group_id", "start_us", "given_us", F.when(F.col("given_us").isNotNull(), right).alias("right"))


def wrong_instants(events: DataFrame, groups: DataFrame, devices: DataFrame) -> DataFrame:
    """Records whose normalised stamp denotes another second than the printed one."""
    e = event_instants(events, devices).where("raw_us is not null and iso_us is not null")
    iso = _seconds(F.col("iso_us"))
    bad = e.where((iso != _seconds(F.col("raw_us"))) & (iso != _seconds(F.col("raw_alt_us"))))
    g = group_instants(groups, devices).where("not right")
    return bad.select(F.lit("log_events").alias("rec"), F.col("event_id").alias("rec_id")).unionByName(
        g.select(F.lit("log_groups").alias("rec"), F.col("group_id").alias("rec_id"))
    ).distinct()


def normalized_events(events: DataFrame, devices: DataFrame) -> DataFrame:
    read = event_instants(events, devices)
    return read.select("event_id", "timestamp_raw", F.timestamp_micros("raw_us").alias("ts_utc"), F.timestamp_micros("raw_alt_us").alias("ts_utc_alt"))


def normalized_groups(groups: DataFrame, devices: DataFrame) -> DataFrame:
    return group_instants(groups, devices).select("group_id", F.timestamp_micros("start_us").alias("ts_start"), "right")
