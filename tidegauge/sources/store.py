"""Points in a folder of Parquet files, partitioned by measurement and time.

Spark's commit protocol makes a write appear as a whole, so there is no log of
its own. The catalog is read from the data.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import safe_name
from ..errors import ValidationError
from ..functions.scalars import PARTITION_FORMAT, partition_key
from ..model import POINTS, PointRelation

STORED = POINTS + ", part STRING"


@dataclass(frozen=True)
class StoreConfig:
    path: str
    interval: str = "1d"
    retention_days: int = 30
    #: Tasks, and so files, that a write gives one partition.
    tasks: int = 4

    def __post_init__(self):
        if not self.path:
            raise ValidationError("a store has a path")
        if self.interval not in PARTITION_FORMAT:
            raise ValidationError(f"not a partition interval: {self.interval!r}")
        if self.retention_days < 1:
            raise ValidationError("retention is a day at least")


def validity(now: float | None = None) -> Column:
    """Null for a valid point, else what is wrong with it."""
    name = F.col("measurement")
    illegal = name.isNull() | (F.trim(name) == "") | (name == ".") | name.contains("..") | name.rlike(r"[/\\\x00]")
    return (
        F.when(illegal, "measurement")
        .when(F.col("timestamp").isNull() | F.isnan("timestamp") | (F.col("timestamp") < 0), "timestamp")
        .when(F.col("fields").isNull() | F.coalesce(F.is_variant_null("fields"), F.lit(False)) | (F.to_json("fields") == "{}"), "fields")
    )


class PointStore:
    def __init__(self, spark: SparkSession, config: StoreConfig):
        self.spark, self.config = spark, config
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def write(self, points: DataFrame, atomic: bool = False, now: float | None = None) -> DataFrame:
        """Appends the valid points of columns measurement, timestamp, tags, fields; returns the others with ``reason``.

        With ``atomic`` nothing is written if any point is invalid. A null time
        becomes ``now`` if that is given.
        """
        p = points.select("measurement", F.coalesce(F.col("timestamp").cast("double"), F.lit(now).cast("double")).alias("timestamp"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), "fields")
        p = p.withColumn("reason", validity())
        bad = p.where("reason is not null")
        if atomic and bad.limit(1).count():
            return bad
        good = p.where("reason is null").drop("reason")
        good = good.withColumn("part", partition_key(F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")), self.config.interval))
        good.repartition("measurement", "part", F.pmod(F.xxhash64("timestamp"), F.lit(self.config.tasks))).write.mode("append").partitionBy("measurement", "part").parquet(self._points)
        return bad

    def write_batch(self, points: DataFrame, atomic: bool = True, now: float | None = None) -> tuple[str, int, int]:
        """("success", "partial" or "failure", points written, points refused)."""
        total = points.count()
        refused = self.write(points, atomic, now).count()
        if atomic and refused:
            return "failure", 0, refused
        return ("success" if not refused else "partial" if refused < total else "failure"), total - refused, refused

    @property
    def _points(self) -> str:
        return f"{self.config.path}/points"

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        files, p = self._file(path)
        return files.exists(p)

    def points(self) -> DataFrame:
        schema = self.spark.createDataFrame([], STORED).schema
        return self.spark.read.schema(schema).parquet(self._points) if self._exists(self._points) else self.spark.createDataFrame([], STORED)

    def relation(self, name: str) -> PointRelation:
        return PointRelation(name, self.points().where(F.col("measurement") == safe_name(name)))

    def measurements(self) -> DataFrame:
        return self.points().select("measurement").distinct().orderBy("measurement")

    def tag_keys(self, name: str) -> DataFrame:
        return self.relation(name).df.select(F.explode(F.map_keys("tags")).alias("key")).distinct().orderBy("key")

    def tag_values(self, name: str, key: str) -> DataFrame:
        return self.relation(name).df.select(F.col("tags")[key].alias("value")).where("value is not null").distinct().orderBy("value")

    def field_keys(self, name: str) -> DataFrame:
        """(key, type) of each field and type that occurs."""
        leaf = self.relation(name).df.select(F.explode(F.from_json(F.to_json("fields"), "map<string,variant>")).alias("key", "v"))
        return leaf.select("key", F.regexp_replace(F.schema_of_variant("v"), r"\(.*", "").alias("type")).distinct().orderBy("key", "type")

    def stats(self) -> DataFrame:
        """(measurement, points, oldest, newest)."""
        return self.points().groupBy("measurement").agg(F.count(F.lit(1)).alias("points"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))

    def expired(self, now: float, days: int | None = None) -> DataFrame:
        """(measurement, part) whose newest point is older than the retention."""
        cutoff = now - (self.config.retention_days if days is None else days) * 86400
        return self.points().groupBy("measurement", "part").agg(F.max("timestamp").alias("newest")).where(F.col("newest") < cutoff).select("measurement", "part")

    def drop_expired(self, now: float, days: int | None = None) -> int:
        """Removes expired partitions' folders, one row each, and says how many."""
        gone = self.expired(now, days).collect()
        for r in gone:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._points}/measurement={r.measurement}/part={r.part}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        return len(gone)

    def write_with_retry(self, points: DataFrame, retries: int = 3, wait: Callable[[float], object] = time.sleep, now: float | None = None) -> tuple[str, int, int]:
        """write_batch() that is tried again after 2, 4, 8, ... seconds if it fails.

        A write appears as a whole or not at all, so trying again doubles
        nothing; invalid points are no failure and are not tried again.
        """
        for n in range(retries + 1):
            try:
                return self.write_batch(points, atomic=False, now=now)
            except Exception:
                if n == retries:
                    raise
                wait(2.0 ** (n + 1))

    def compact(self, name: str, part: str, files: int = 1) -> None:
        """Rewrites one partition as fewer files: the new ones are whole before the old ones go.

        If it breaks off after that, recover() puts the new ones in place.
        """
        self.recover()
        at = f"measurement={safe_name(name)}/part={part}"
        self.spark.read.parquet(f"{self._points}/{at}").sort("timestamp").coalesce(files).write.mode("overwrite").parquet(f"{self._compacting}/{at}")
        self._put_in_place(at)

    @property
    def _compacting(self) -> str:
        return f"{self.config.path}/compacting"

    def _put_in_place(self, at: str) -> None:
        files, fresh = self._file(f"{self._compacting}/{at}")
        _, old = self._file(f"{self._points}/{at}")
        files.delete(old, True)
        files.mkdirs(old.getParent())
        if not files.rename(fresh, old):
            raise OSError(f"couldn't move {fresh} to {old}")

    def recover(self) -> int:
        """Ends compactions that broke off: whole rewrites replace their partitions, others go. Returns how many replaced theirs."""
        files, top = self._file(self._compacting)
        done = 0
        for name in files.listStatus(top) if files.exists(top) else []:
            for part in files.listStatus(name.getPath()):
                at = f"{name.getPath().getName()}/{part.getPath().getName()}"
                if self._exists(f"{self._compacting}/{at}/_SUCCESS"):
                    self._put_in_place(at)
                    done += 1
                else:
                    files.delete(part.getPath(), True)
        return done

    def partitions(self, name: str, start: float | None = None, end: float | None = None) -> DataFrame:
        """(part): stored partitions of a measurement that reach into [start, end] Unix seconds, in order; only folder names are filtered."""
        found = self.relation(name).df
        for bound, low in ((start, True), (end, False)):
            if bound is not None:
                key = partition_key(F.timestamp_micros(F.lit(int(bound * 1e6))), self.config.interval)
                found = found.where(F.col("part") >= key if low else F.col("part") <= key)
        return found.select("part").distinct().orderBy("part")

    def partition_info(self, name: str) -> DataFrame:
        """(part, oldest, newest, points, files, bytes, modified) of each stored partition."""
        m = F.col("_metadata")
        each = self.relation(name).df.groupBy("part", m["file_path"].alias("path"), m["file_size"].alias("bytes"), m["file_modification_time"].alias("modified")).agg(F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"), F.count(F.lit(1)).alias("points"))
        return each.groupBy("part").agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.sum("points").alias("points"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified")).orderBy("part")

    def health(self) -> dict[str, bool]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.config.path)
        files = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            files.mkdirs(p)
            probe = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.config.path}/_probe")
            files.create(probe, True).close()
            writable = bool(files.delete(probe, False))
        except Exception:
            writable = False
        return {"running": self.spark._jsc is not None, "writable": writable, "healthy": writable}


class WriteBuffer:
    """Points gathered on the driver until there are ``most`` of them or the first is ``seconds`` old; then they are written together.

    A write that fails keeps its points. Threads may share a buffer; the clock
    is looked at as points come, and by flush_if_due().
    """

    def __init__(self, store: PointStore, most: int = 1000, seconds: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.store, self.most, self.seconds, self.clock = store, most, seconds, clock
        self._lock, self._rows, self._since = threading.RLock(), [], None

    def __len__(self) -> int:
        return len(self._rows)

    def add(self, *points: dict) -> bool:
        """Whether this wrote the buffer."""
        with self._lock:
            if points and self._since is None:
                self._since = self.clock()
            self._rows += points
            return self.flush_if_due()

    def flush_if_due(self) -> bool:
        with self._lock:
            due = len(self._rows) >= self.most or self._since is not None and self.clock() - self._since >= self.seconds
            return due and self.flush() > 0

    def flush(self) -> int:
        """Writes what there is; returns how many points were valid."""
        with self._lock:
            if not self._rows:
                return 0
            _, written, _ = self.store.write_batch(from_rows(self.store.spark, self._rows), atomic=False)
            self._rows, self._since = [], None
            return written


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Points given as dicts on the driver."""
    import json

    data = [(r.get("measurement"), None if r.get("timestamp") is None else float(r["timestamp"]), r.get("tags") or {}, json.dumps(r.get("fields") or {})) for r in rows]
    df = spark.createDataFrame(data, "measurement string, timestamp double, tags map<string,string>, fields string")
    return df.withColumn("fields", F.try_parse_json("fields"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
