"""Grouped and windowed aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.aggregates import aggregate
from ..functions.scalars import parse_duration, window_start
from ..model import Relation

#: Windows without points that are made from one row.
STRETCH = 100_000


def group(rel: Relation, tags: list[str], field: str, agg: str | Callable[[Column], Column]) -> DataFrame:
    """(tags, value, count): value over finite numbers, count of all points. A missing tag is a group of its own, null, first.

    Without tags there is one row if there are points, and none otherwise.
    """
    keys = [rel.tag(t).alias(t) for t in tags] or [F.lit(0).alias("_all")]
    out = rel.df.groupBy(*keys).agg(aggregate(agg)(rel.number(field)).alias("value"), F.count(F.lit(1)).alias("count"))
    return out.orderBy(*[F.col(t).asc_nulls_first() for t in tags]) if tags else out.drop("_all")


def tumbling(rel: Relation, interval: str | float, field: str, agg: str | Callable[[Column], Column] = "mean", origin: float = 0.0, tags: tuple[str, ...] = (), start_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(tags, start, end, value, count) of half-open windows of Unix seconds that have points, by tags and start.

    ``start_of`` replaces the rule that gives a time its window.
    """
    size = parse_duration(interval) if isinstance(interval, str) else float(interval)
    if size <= 0:
        raise ValidationError("an interval is positive")
    at = start_of(rel.seconds) if start_of else window_start(rel.seconds, size, origin)
    rows = rel.df.select(*[rel.tag(t).alias(t) for t in tags], at.alias("start"), rel.number(field).alias("v")).where("start is not null")
    out = rows.groupBy(*tags, "start").agg(aggregate(agg)(F.col("v")).alias("value"), F.count(F.lit(1)).alias("count"))
    return out.select(*tags, "start", (F.col("start") + size).alias("end"), "value", "count").orderBy(*[F.col(t).asc_nulls_first() for t in tags], "start")


def fill_gaps(windows: DataFrame, interval: str | float, origin: float = 0.0) -> DataFrame:
    """Adds (start, end, null, 0) for each window without points between the first and the last; by start.

    Windows are numbered from ``origin``, the one they were made with, so that
    steps don't drift. The numbers come from one row with the bounds, which is
    split into stretches of ``STRETCH`` numbers before these are made.
    """
    size = parse_duration(interval) if isinstance(interval, str) else float(interval)
    numbered = windows.select(F.round((F.col("start") - origin) / size).cast("long").alias("n"), "value", "count")
    span = numbered.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).where("lo is not null")
    parts = span.select(F.explode(F.sequence("lo", "hi", F.lit(STRETCH).cast("long"))).alias("lo"), "hi").repartition("lo")
    every = parts.select(F.explode(F.sequence("lo", F.least(F.col("hi"), F.col("lo") + STRETCH - 1))).alias("n"))
    start = F.lit(float(origin)) + F.col("n") * size
    return every.join(numbered, "n", "left").select(start.alias("start"), (start + size).alias("end"), "value", F.coalesce("count", F.lit(0)).alias("count")).orderBy("start")
