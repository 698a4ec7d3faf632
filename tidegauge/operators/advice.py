"""Rules of thumb for partitions and batches, and shares of time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ValidationError

#: What a point, a batch and a Parquet file take, about.
POINT_BYTES, BATCH_BYTES, FILE_BYTES = 100, 10 << 20, 256 << 20
HOURS = {"1h": 1, "1d": 24, "1M": 720}


def batch_size(latency_ms: float, points_per_s: float, most_bytes: int = BATCH_BYTES) -> int:
    """Points that arrive while a write takes ``latency_ms``: smaller batches queue up, larger ones only wait. One at least, a batch's bytes at most."""
    if latency_ms < 0 or points_per_s < 0:
        raise ValidationError("latency and rate aren't negative")
    return max(1, min(math.ceil(points_per_s * latency_ms / 1000), most_bytes // POINT_BYTES))


def partition_count(days: int, interval: str) -> int:
    if interval not in HOURS:
        raise ValidationError(f"not a partition interval: {interval!r}")
    return math.ceil(days * 24 / HOURS[interval])


def partition_interval(points_per_s: float, query_hours: float = 24, retention_days: float = 30, file_bytes: int = FILE_BYTES, executors: int = 1) -> str:
    """The longest interval whose partition is wanted whole.

    That is one of at most a file for each executor, so that a partition is
    read in one round; of no more than what a query asks for, unless its
    partition would be less than a file; and within the retention, as a
    partition goes only when all of it is old.
    """
    if points_per_s < 0:
        raise ValidationError("a rate isn't negative")

    def size(interval: str) -> float:
        return points_per_s * HOURS[interval] * 3600 * POINT_BYTES

    fit = [i for i, hours in HOURS.items() if size(i) <= file_bytes * executors and hours <= 24 * retention_days and (hours <= query_hours or size(i) < file_bytes)]
    return fit[-1] if fit else "1h"


def shares(timings: DataFrame, name: str = "operation", time: str = "total_time") -> DataFrame:
    """(name, time, share, cumulative) from the largest; one row per operation."""
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.desc(time), name).rowsBetween(W.unboundedPreceding, 0)
    return timings.select(name, time, (F.col(time) / F.sum(time).over(everything)).alias("share"), (F.sum(time).over(order) / F.sum(time).over(everything)).alias("cumulative"))


def speedup(share: float, factor: float = math.inf) -> float:
    """Of the whole, if a share of its time gets ``factor`` times faster."""
    rest = 1 - share + (0 if math.isinf(factor) else share / factor)
    return math.inf if rest == 0 else 1 / rest
