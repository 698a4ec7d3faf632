"""Scalar functions: durations, windows, series keys, partition keys, checksums."""

from __future__ import annotations

import hashlib
import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError, ValidationError

# Seconds per duration suffix, and date formats of the partition intervals.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
PARTITION_FORMAT = {"1h": "yyyyMMdd_HH", "1d": "yyyyMMdd", "1M": "yyyyMM"}


def parse_duration(text: str) -> float:
    """Seconds of "30s", "5m", "1.5h" or "2d"."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)([smhd])\s*", text or "")
    if not m:
        raise ParseError(f"not a duration: {text!r}")
    return float(m[1]) * SECONDS[m[2]]


def window_start(seconds: Column, interval: float, origin: float = 0.0) -> Column:
    """Start of the half-open window [start, start + interval) that holds a time; times before the origin too."""
    if interval <= 0:
        raise ValidationError("an interval is positive")
    return F.floor((seconds - F.lit(float(origin))) / F.lit(float(interval))) * F.lit(float(interval)) + F.lit(float(origin))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,")), F.lit("="), F.lit("\\="))


def series_key(measurement: Column, tags: Column) -> Column:
    """Canonical text of a series: the measurement, then k=v by ascending key, with backslash, comma and equals escaped."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(_escaped(e["key"]), F.lit("="), _escaped(e["value"])))
    return F.concat_ws(",", F.concat(F.array(_escaped(measurement)), F.coalesce(pairs, F.array().cast("array<string>"))))


def parse_series_key(key: str) -> tuple[str, dict[str, str]]:
    """The inverse of series_key, in one pass, so that every text round-trips."""
    parts, now, sides, i = [], "", [], 0
    for i, c in enumerate(_units(key)):
        if c in (",", "="):
            sides.append(now)
            now = ""
            if c == ",":
                parts.append(sides)
                sides = []
        else:
            now += c[-1]
    sides.append(now)
    parts.append(sides)
    if len(parts[0]) != 1 or any(len(p) != 2 for p in parts[1:]):
        raise ParseError(f"not a series key: {key!r}")
    return parts[0][0], {k: v for k, v in parts[1:]}


def series_parts(key: Column) -> Column:
    """The inverse of series_key as a column: (measurement, tags). Escaped pairs stand aside, from the left, while the text is split."""
    # private characters, which no key is expected to have
    aside = (("\\\\", "\ue000", "\\"), ("\\,", "\ue001", ","), ("\\=", "\ue002", "="))
    for pair, mark, _ in aside:
        key = F.replace(key, F.lit(pair), F.lit(mark))

    def back(c: Column) -> Column:
        for _, mark, plain in aside:
            c = F.replace(c, F.lit(mark), F.lit(plain))
        return c

    parts = F.split(key, ",")
    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(back(F.split_part(p, F.lit("="), F.lit(1))).alias("key"), back(F.split_part(p, F.lit("="), F.lit(2))).alias("value")))
    return F.struct(back(F.element_at(parts, 1)).alias("measurement"), F.map_from_entries(pairs).alias("tags"))


def _units(text: str) -> list[str]:
    """Characters, with an escaped one together with its backslash."""
    return re.findall(r"\\.|[^\\]|\\$", text, re.DOTALL)


def partition_key(ts: Column, interval: str) -> Column:
    """UTC partition of a timestamp for "1h", "1d" or "1M"."""
    if interval not in PARTITION_FORMAT:
        raise ValidationError(f"not a partition interval: {interval!r}")
    return F.date_format(ts, PARTITION_FORMAT[interval])


def partition_bounds(moment: datetime, unit: str) -> tuple[datetime, datetime]:
    """Half-open [start, end) of the hour, day, week (from Monday) or month around a moment, in UTC."""
    t = moment.astimezone(UTC) if moment.tzinfo else moment.replace(tzinfo=UTC)
    t = t.replace(minute=0, second=0, microsecond=0)
    if unit == "hour":
        return t, t + timedelta(hours=1)
    t = t.replace(hour=0)
    if unit == "day":
        return t, t + timedelta(days=1)
    if unit == "week":
        t -= timedelta(days=t.weekday())
        return t, t + timedelta(days=7)
    if unit == "month":
        t = t.replace(day=1)
        return t, (t + timedelta(days=32)).replace(day=1)
    raise ValidationError(f"not a partition unit: {unit!r}")


def partition_path(base: str, measurement: str, moment: datetime, unit: str) -> str:
    """base/YYYY[/MM[/DD[/HH]]]/measurement of a moment in UTC."""
    t = partition_bounds(moment, unit)[0]
    parts = {"month": "%Y/%m", "week": "%Y/%m/%d", "day": "%Y/%m/%d", "hour": "%Y/%m/%d/%H"}[unit]
    return f"{base}/{t.strftime(parts)}/{measurement}"


def bloom_positions(item: str, bits: int, hashes: int) -> list[int]:
    """Bit numbers of an item by double hashing of the halves of its MD5."""
    digest = hashlib.md5(item.encode()).digest()
    a, b = (int.from_bytes(digest[i : i + 8], "big") for i in (0, 8))
    return [(a + i * b) % bits for i in range(hashes)]
