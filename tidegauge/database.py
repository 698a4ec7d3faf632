"""An embedded database: a point store and the SQL dialect over it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import safe_name
from .errors import ValidationError
from .plans import dialect
from .sources.json_points import check_point
from .sources.store import PointStore, StoreConfig, from_rows


class _Stored:
    """A catalog over a store: any measurement has a relation, an unknown one without points."""

    def __init__(self, store: PointStore):
        self.store = store

    def __getitem__(self, name: str):
        return self.store.relation(name)


class Database:
    """``with Database(spark, path) as db``; the session stays the caller's. ``now`` gives points their time if they have none."""

    def __init__(self, spark: SparkSession, path: str, interval: str = "1d", retention_days: int = 30, now: Callable[[], float] = time.time):
        self.store = PointStore(spark, StoreConfig(path, interval, retention_days))
        self._now, self._open = now, True

    def write(self, measurement: str, tags: dict[str, str], fields: dict, timestamp: float | None = None) -> None:
        self.write_many(measurement, [{"tags": tags, "fields": fields, "timestamp": timestamp}])

    def write_many(self, measurement: str, points: list[dict]) -> int:
        """All of the points or, if one is invalid, none."""
        if not self._open:
            raise ValidationError("the database is closed")
        safe_name(measurement)
        rows = [check_point({"measurement": measurement, "tags": p.get("tags") or {}, "fields": p.get("fields") or {}, "timestamp": self._now() if p.get("timestamp") is None else p["timestamp"]}) for p in points]
        if rows:
            self.store.write(from_rows(self.store.spark, rows), atomic=True)
        return len(rows)

    def append(self, points: DataFrame) -> DataFrame:
        """Valid rows of a DataFrame of points; returns the others with their reasons."""
        return self.store.write(points)

    def plan(self, sql: str) -> DataFrame:
        return dialect.plan(sql, _Stored(self.store))

    def query(self, sql: str) -> list[dict]:
        return dialect.rows(self.plan(sql))

    def measurements(self) -> list[str]:
        return [r.measurement for r in self.store.measurements().collect()]

    def close(self) -> None:
        self._open = False

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()
