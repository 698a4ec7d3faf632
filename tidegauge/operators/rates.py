"""Derivatives, counter rates and increases along each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _steps(samples: DataFrame, keys: tuple[str, ...], tie: tuple[str, ...]) -> DataFrame:
    """Each sample beside the one just before it: dt, dv. The pair counts even if that one's own pair was skipped."""
    w = W.partitionBy(*keys).orderBy("timestamp", *tie)
    s = samples.withColumn("_t", F.lag("timestamp").over(w)).withColumn("_v", F.lag("value").over(w))
    return s.withColumn("dt", F.col("timestamp") - F.col("_t")).withColumn("dv", F.col("value") - F.col("_v"))


def _increment(counter: bool) -> Column:
    """What a counter rose by: after a reset it has risen from 0."""
    return F.when(F.col("dv") < 0, F.col("value")).otherwise(F.col("dv")) if counter else F.col("dv")


def derivative(samples: DataFrame, *keys: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """(keys, timestamp, value): change per second at the later of two samples; pairs of one time give none."""
    return rate(samples, *keys, counter=False, tie=tie)


def rate(samples: DataFrame, *keys: str, counter: bool = True, tie: tuple[str, ...] = ()) -> DataFrame:
    """(keys, timestamp, value): increase per second; of a counter never negative."""
    s = _steps(samples, keys, tie).where("dt <> 0")
    return s.select(*keys, "timestamp", F.try_divide(_increment(counter), F.col("dt")).alias("value"))


def total_increase(samples: DataFrame, *keys: str, counter: bool = True, tie: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value): the sum of all increments, pairs of one time included; 0 for a single sample."""
    return _steps(samples, keys, tie).groupBy(*keys).agg(F.coalesce(F.sum(_increment(counter)), F.lit(0.0)).alias("value"))


def rate_over_window(samples: DataFrame, *keys: str, counter: bool = True, tie: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value): the total increase over the time from first to last sample; null without such a time."""
    span = F.max("timestamp") - F.min("timestamp")
    return _steps(samples, keys, tie).groupBy(*keys).agg(F.try_divide(F.sum(_increment(counter)), F.nullif(span, F.lit(0.0))).alias("value"))
