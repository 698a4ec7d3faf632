"""Line protocol as a data source: spark.read.format("lines").load(folder).

Each file is a partition's worth of work and is parsed where it is read. For
many small files or other columns of text use line_protocol.read on spark.read.text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ParseError
from ..session import findable
from .line_protocol import parse_line

SCHEMA = "measurement string, timestamp double, tags map<string,string>, numbers map<string,double>, texts map<string,string>, error string"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = files.get_file_info(fs.FileSelector(path, recursive=True)) if files.get_file_info(path).type == fs.FileType.Directory else [files.get_file_info(path)]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [_File(scheme + f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[tuple]:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        with files.open_input_stream(path) as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + bytes(chunk)).split(b"\n")
                yield from self._rows(lines)
            yield from self._rows([rest])

    @staticmethod
    def _rows(lines: list[bytes]) -> Iterator[tuple]:
        for raw in lines:
            line = raw.decode("utf-8", "replace")
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            try:
                p = parse_line(line)
            except ParseError as e:
                yield (None, None, None, None, None, f"{e}")
                continue
            numbers = {k: float(v) for k, v in p["fields"].items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
            texts = {k: str(v).lower() if isinstance(v, bool) else v for k, v in p["fields"].items() if isinstance(v, (str, bool))}
            yield (p["measurement"], p["timestamp"], p["tags"], numbers, texts, None)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    findable(spark)
    spark.dataSource.register(LineSource)
