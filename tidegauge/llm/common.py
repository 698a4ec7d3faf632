"""What the operators of this subpackage share: shared storage, blobs, texts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import findable

#: Arrow batches between the JVM and Python stay near this many bytes.
BATCH_BYTES = 8 << 20
#: Texts are worked on in pieces of about this many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Rows without a doc_id come after all others.
LAST_ID = (1 << 63) - 1


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset,
    as in tests on one machine, a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
            spark.sparkContext.setCheckpointDir(_own[app])
        at = _own[app]
    return at.rstrip("/")


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Bounds Arrow batches by bytes, as rows here may be blobs or long texts, and lets workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    findable(spark)


def give_back() -> None:
    """Returns a worker's freed memory to the machine; its allocators would keep it for the operators that the worker serves next."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def materialize(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut.

    Lost executors don't lose the rows. The shuffle files behind df are of no
    more use and are released, unless ``free`` is false for small ones.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegauge-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.kept_at = path
    del df
    if free:
        release(spark)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of unreachable plans."""
    for _ in range(2):  # the first lets go of Python's handles, the second finds the plans unreachable
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of text behind one shard or bucket at most: what a task gathers of it is of the same order.
SHARD_BYTES = 256 << 20


def n_shards(docs: DataFrame, most: int = SHARD_BYTES) -> int:
    """Shards for a table of texts: as many as shuffle partitions, and more where these would hold over ``most`` bytes each.

    One pass over the lengths, so that memory per task doesn't hang on a setting.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    return max(n_parts(docs.sparkSession), -(-size // most))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text) and ``more``; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the offsets, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return buf, off


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (or one row)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def batches(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slots(shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, row indices in their order) for each shard that occurs."""
    order = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[order], np.arange(n + 1))
    for s in np.flatnonzero(at[1:] > at[:-1]):
        yield int(s), order[at[s] : at[s + 1]]


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one blob; unpack() gives them back."""
    head = np.array([len(a) for a in arrays], dtype=np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    head = np.frombuffer(blob, dtype=np.int64, count=len(dtypes))
    out, at = [], 8 * len(dtypes)
    for n, t in zip(head, dtypes, strict=True):
        out.append(np.frombuffer(blob, dtype=t, count=int(n), offset=at))
        at += int(n) * np.dtype(t).itemsize
    return out


def by_key(df: DataFrame, n: int, key: str, fn: Callable, schema: str, *order: str) -> DataFrame:
    """Deals df by ``key`` to n partitions, sorts each by key and ``order``, and applies fn to its batches."""
    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(fn, schema)


def runs(rows: Iterator[pa.RecordBatch], key: str = "shard") -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Groups a stream of batches that is sorted by ``key``."""
    now, held = None, []
    for b in rows:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for i, j in zip(cut, np.r_[cut[1:], len(k)], strict=True):
            if held and k[i] != now:
                yield now, held
                held = []
            now = k[i]
            held.append(b.slice(i, j - i))
    if held:
        yield now, held
