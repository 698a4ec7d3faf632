"""Reads of a measurement: filters first, then time order, then a limit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..model import Relation, WideRelation
from .predicates import between, equal_to


def timed(rel: Relation, start, end) -> Relation:
    """The rows of an inclusive range of times. Bounds on a timestamp column itself reach the scan."""
    if isinstance(rel, WideRelation) and (start is None or isinstance(start, str)) and (end is None or isinstance(end, str)):
        kind = rel.df.schema[rel.time].dataType.simpleString()
        c = F.col(rel.time)
        if start is not None:
            rel = rel.where(c >= F.lit(start).cast(kind))
        return rel.where(c <= F.lit(end).cast(kind)) if end is not None else rel
    return rel.where(between(rel, start, end))


def read(rel: Relation, start=None, end=None, tags: dict | None = None, fields: dict | None = None, predicate=None, also: Column | None = None, limit: int | None = None, *tie: str) -> DataFrame:
    """Points of a range with given tags and fields, by time and then the columns ``tie``; ``limit`` of them if given.

    Order and limit together are one top-n operator. ``start`` and ``end`` are
    Unix seconds or timestamp text; ``also`` is any further condition.
    """
    rel = timed(rel, start, end)
    rel = rel.where(equal_to(tags, fields).column(rel))
    if predicate is not None:
        rel = rel.where(predicate.column(rel))
    if also is not None:
        rel = rel.where(also)
    out = rel.df.orderBy(F.col(rel.time) if isinstance(rel, WideRelation) else rel.seconds, *tie)
    return out.limit(limit) if limit is not None else out


def stream(rel: Relation, condition: Column, start=None, end=None, *tie: str) -> Iterator[Row]:
    """Rows of one location (any condition that picks it) in time order, a partition at a time on the driver."""
    return read(rel, start, end, None, None, None, condition, None, *tie).toLocalIterator()


def count(rel: Relation, **of) -> int:
    return read(rel, **of).count()


def merge(streams: list[DataFrame], key: str, *tie: str, limit: int | None = None) -> DataFrame:
    """All rows of several DataFrames by key; equal keys by the stream's number (column ``src``), then ``tie``."""
    numbered = [s.withColumn("src", F.lit(i)) for i, s in enumerate(streams)]
    out = reduce(DataFrame.unionByName, numbered).orderBy(key, "src", *tie)
    return out.limit(limit) if limit is not None else out


def strategy(rel: Relation, start=None, end=None, tags: dict | None = None, fields: dict | None = None) -> dict[str, object]:
    """How a read would go: "tag+time", "tag", "time" or "scan", and what reaches the Parquet scan."""
    from ..plans.stages import scan_facts

    by = [name for name, used in (("tag", tags), ("time", start is not None or end is not None)) if used]
    return {"strategy": "+".join(by) or "scan", **scan_facts(read(rel, start, end, tags, fields))}
