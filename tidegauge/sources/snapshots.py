"""Versioned metadata tables: whole snapshots, and a log of rows since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import safe_name


class Snapshots:
    """Tables of names under a folder. A snapshot is visible once its commit marker is written; older versions stay readable until compaction."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark._jvm

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        files, p = self._fs(f"{self.path}/{safe_name(name)}")
        if not files.exists(p):
            return []
        names = [s.getPath().getName() for s in files.listStatus(p)]
        done = [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()]
        return sorted(v for v in done if self._done(f"{self.path}/{name}/v{v}"))

    def _done(self, path: str) -> bool:
        files, p = self._fs(path + "/_SUCCESS")
        return files.exists(p)

    def save(self, name: str, table: DataFrame) -> int:
        """A new version; returns its number. Rows logged before are taken to be in it."""
        version = max(self._versions(name), default=0) + 1
        table.write.mode("overwrite").parquet(f"{self.path}/{name}/v{version}")
        return version

    def append(self, name: str, rows: DataFrame) -> None:
        """Logs rows on top of the newest version."""
        version = max(self._versions(name), default=0)
        rows.write.mode("append").parquet(f"{self.path}/{name}/log{version}")

    def load(self, name: str, version: int | None = None) -> DataFrame | None:
        """The newest version with its logged rows, or an older one as saved; None if there is none."""
        known = self._versions(name)
        if not known or version is not None and version not in known:
            return None
        at = known[-1] if version is None else version
        out = self.spark.read.parquet(f"{self.path}/{name}/v{at}")
        log = f"{self.path}/{name}/log{at}"
        return out.unionByName(self.spark.read.parquet(log)).distinct() if version is None and self._done(log) else out

    def backup(self, to: str) -> None:
        """Copies all tables, versions and logs to another folder, which must not exist yet."""
        self._copy(self.path, to)

    def restore(self, source: str) -> None:
        """The tables become those of a backup; the ones that are there go once its copy is whole."""
        fresh = self.path.rstrip("/") + "-restoring"
        files, p = self._fs(fresh)
        files.delete(p, True)
        self._copy(source, fresh)
        _, old = self._fs(self.path)
        files.delete(old, True)
        files.rename(p, old)

    def _copy(self, source: str, to: str) -> None:
        (a, here), (b, there) = self._fs(source), self._fs(to)
        if b.exists(there):
            raise FileExistsError(to)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(a, here, b, there, False, True, self.spark._jsc.hadoopConfiguration())

    def compact(self, name: str) -> int:
        """Saves version and log as a new version and deletes what came before."""
        old = self._versions(name)
        version = self.save(name, self.load(name))
        for v in old:
            for kind in ("v", "log"):
                files, p = self._fs(f"{self.path}/{name}/{kind}{v}")
                files.delete(p, True)
        return version
