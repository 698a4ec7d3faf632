"""Aggregates over finite numbers only, percentiles and histogram quantiles."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError, ValidationError
from ..model import Relation

#: Name to a builder from a numeric column; custom ones can be added.
AGGREGATES: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}


def aggregate(name: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A registered aggregate by name, or a builder as it is."""
    if callable(name):
        return name
    if name not in AGGREGATES:
        raise QueryError(f"unknown aggregate: {name!r}")
    return AGGREGATES[name]


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    AGGREGATES[name] = build


def folded(make: Callable[[], object]) -> Callable[[Column], Column]:
    """An aggregate of a Python fold, an object with update(value) and result(), over the numbers of a group.

    For what built-in aggregates can't express; a group's numbers meet in one
    task, in no order, so it isn't for groups of unbounded size.
    """

    def one(values) -> float | None:
        fold = make()
        for v in values:
            fold.update(v)
        return fold.result()

    def run(groups):
        return groups.map(one)

    run.__annotations__ = {"groups": pd.Series, "return": pd.Series}
    each = F.pandas_udf(run, "double")
    return lambda c: each(F.collect_list(c))  # goes with built-in aggregates, as a grouped Python one doesn't


def aggregate_field(rel: Relation, field: str, agg: str | Callable) -> DataFrame:
    """One row, ``value``: count is 0 and all others null if nothing is a number."""
    return rel.df.agg(aggregate(agg)(rel.number(field)).alias("value"))


def percentile(c: Column, p: float) -> Column:
    """Exact, by linear interpolation at p/100*(n-1); null for no values. For very many values use percentile_estimate."""
    if not 0 <= p <= 100:
        raise ValidationError("a percentile is from 0 to 100")
    return F.percentile(c, p / 100)


def percentile_estimate(c: Column, p: float, accuracy: int = 10_000) -> Column:
    """An estimate in bounded memory, mergeable map-side."""
    return F.percentile_approx(c, p / 100, accuracy)


def histogram(df: DataFrame, value: Column, lo: float, hi: float, buckets: int, *keys: str) -> DataFrame:
    """(keys, bucket, n): counts in equal buckets of [lo, hi]; values beyond go to the first or last."""
    if hi <= lo or buckets < 1:
        raise ValidationError("a histogram has hi > lo and a bucket")
    b = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((value - lo) / ((hi - lo) / buckets)))).cast("int")
    return df.where(value.isNotNull()).groupBy(*keys, b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(counts: DataFrame, lo: float, hi: float, buckets: int, p: float, *keys: str) -> DataFrame:
    """(keys, value): centre of the first bucket at which the running count reaches ceil(p/100*n).

    ``counts`` is histogram()'s result or sums of several: at most ``buckets``
    rows a key reach the window.
    """
    w = W.partitionBy(*(keys or [F.lit(0)]))
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    hit = run.where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * (p / 100))))
    width = (hi - lo) / buckets
    return hit.groupBy(*keys).agg((F.min("bucket") * width + (lo + width / 2)).alias("value"))


def operation_stats(events: DataFrame, *keys: str) -> DataFrame:
    """Per key of (latency, error): mean and p95 latency, error rate, and operations per second of latency."""
    total = F.sum("latency")
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("latency").alias("mean_latency"),
        percentile(F.col("latency"), 95).alias("p95_latency"),
        (F.sum(F.col("error").cast("int")) / F.count(F.lit(1))).alias("error_rate"),
        F.when(total > 0, F.count(F.lit(1)) / total).otherwise(F.lit(0.0)).alias("throughput"),
    )
