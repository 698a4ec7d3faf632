"""Relational forms of delta, run-length, dictionary and XOR encodings with their decoders, packed bytes, and what data would gain.

Parquet's own encodings do the storing; these show the values, the runs and the bytes.
All of them work along a series given by ``keys``, so that no whole table is
sorted in one task unless there is one series.
"""

from __future__ import annotations

import time
import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParseError, ValidationError
from ..session import findable

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _along(keys: tuple[str, ...], order: tuple[str, ...]):
    return W.partitionBy(*keys).orderBy(*order)


def delta_encode(df: DataFrame, value: str, order: tuple[str, ...], *keys: str, steps: int = 1) -> DataFrame:
    """Adds ``delta``: the value less the one before; the first row has the value itself. Two steps give deltas of deltas."""
    out = df.withColumn("delta", F.col(value))
    for _ in range(steps):
        out = out.withColumn("delta", F.col("delta") - F.coalesce(F.lag("delta").over(_along(keys, order)), F.lit(0)))
    return out


def delta_decode(df: DataFrame, order: tuple[str, ...], *keys: str, value: str = "value", steps: int = 1) -> DataFrame:
    out = df.withColumn(value, F.col("delta"))
    for _ in range(steps):
        out = out.withColumn(value, F.sum(value).over(_along(keys, order).rowsBetween(W.unboundedPreceding, 0)))
    return out


def zigzag(c: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(c.cast("long"), 1).bitwiseXOR(F.shiftright(c.cast("long"), 63))


def unzigzag(c: Column) -> Column:
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1).cast("long")))


def varint_bytes(c: Column) -> Column:
    """Bytes of an unsigned number at seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(c)) / 7)).cast("int")


def runs(df: DataFrame, value: str, order: tuple[str, ...], *keys: str) -> DataFrame:
    """(keys, run, value, n): maximal stretches of equal values; null equals null."""
    w = _along(keys, order)
    new = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)
    s = df.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(*keys, "run").agg(F.first(value).alias("value"), F.count(F.lit(1)).alias("n"))


def run_stats(run: DataFrame, *keys: str) -> DataFrame:
    """Values, runs, longest and mean run; ratio values/(2*runs), worth it above 1.1."""
    ratio = F.sum("n") / (2 * F.count(F.lit(1)))
    return run.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"), F.avg("n").alias("mean_run"), ratio.alias("ratio"), (ratio > 1.1).alias("worth"))


def dictionary(df: DataFrame, value: str, first_seen: str) -> DataFrame:
    """(value, code): dense codes in the order in which values were first seen; one row per distinct value is ranked."""
    seen = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(first_seen).alias("_f"))
    return seen.select("value", (F.row_number().over(W.orderBy("_f", "value")) - 1).cast("long").alias("code"))


def compress_tags(points: DataFrame, tags: str, first_seen: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary of tag maps by tag_ref, points with the reference instead of the map)."""
    canon = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))
    keyed = points.withColumn("_tags", canon)
    seen = dictionary(keyed, "_tags", first_seen).select(F.col("value").alias("_tags"), F.concat(F.lit("tag_"), F.col("code")).alias("tag_ref"))
    return seen.select("tag_ref", F.from_json("_tags", "map<string,string>").alias("tags")), keyed.join(seen, "_tags").drop("_tags", tags)


def xor_encode(df: DataFrame, value: str, order: tuple[str, ...], *keys: str) -> DataFrame:
    """Adds ``xor``: the value's IEEE bits against the value before; equal neighbours give 0, near ones many leading zeros."""

    @F.pandas_udf("long")
    def ieee(v: pd.Series) -> pd.Series:
        return pd.Series(np.ascontiguousarray(v.to_numpy(dtype=np.float64)).view(np.int64))

    s = df.withColumn("_bits", ieee(F.col(value).cast("double")))
    return s.withColumn("xor", F.col("_bits").bitwiseXOR(F.coalesce(F.lag("_bits").over(_along(keys, order)), F.lit(0).cast("long")))).drop("_bits")


def regular(df: DataFrame, time: str, *keys: str) -> DataFrame:
    """(keys, regular): whether all gaps between times, to a microsecond, are alike."""
    gap = F.round(F.col(time) - F.lag(time).over(W.partitionBy(*keys).orderBy(time)), 6)
    return df.withColumn("_gap", gap).groupBy(*keys).agg((F.countDistinct("_gap") <= 1).alias("regular"))


def potential(df: DataFrame, time: str, tags: tuple[str, ...], fields: tuple[str, ...], *series: str) -> DataFrame:
    """(measure, name, value): distinct values per tag, type per field, and whether times are regular in all series."""
    spark = df.sparkSession
    out = [regular(df, time, *series).agg(F.bool_and("regular").cast("string").alias("value")).select(F.lit("regular").alias("measure"), F.lit(time).alias("name"), "value")]
    if tags:
        one = df.agg(*[F.countDistinct(t).cast("string").alias(t) for t in tags])
        out.append(one.select(F.inline(F.array(*[F.struct(F.lit("cardinality").alias("measure"), F.lit(t).alias("name"), F.col(t).alias("value")) for t in tags]))))
    if fields:
        out.append(spark.createDataFrame([("type", f, df.schema[f].dataType.simpleString()) for f in fields], "measure string, name string, value string"))
    return reduce(DataFrame.unionByName, out)


def parquet_sizes(df: DataFrame, folder: str, codecs: tuple[str, ...] = ("none", "snappy", "gzip", "zstd")) -> dict[str, int]:
    """Bytes that a table takes as Parquet with each codec."""
    out, spark = {}, df.sparkSession
    for c in codecs:
        df.write.mode("overwrite").option("compression", c).parquet(f"{folder}/{c}")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{c}")
        out[c] = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return out


def dictionary_decode(codes: DataFrame, dictionary_: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``value`` to rows of codes."""
    return codes.join(dictionary_, code, "left")


def runs_decode(run: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, value): the values that runs() counted, in their order, from 0."""
    before = F.coalesce(F.sum("n").over(_along(keys, ("run",)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    one = run.withColumn("_at", before).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return one.select(*keys, (F.col("_at") + F.col("_k") - 1).alias("pos"), "value")


#: Values of a packed block: a series of any length becomes rows of bounded size.
BLOCK = 4096


def _varints(z: np.ndarray) -> bytes:
    """Unsigned numbers at seven bits a byte, low bits first, the top bit set in all bytes but a number's last."""
    parts = np.stack([(z >> np.uint64(7 * i)) & np.uint64(0x7F) for i in range(10)], axis=1).astype(np.uint8)
    size = 1 + sum((z >> np.uint64(7 * i)) > 0 for i in range(1, 10)).astype(np.int64)
    at = np.arange(10)[None, :]
    parts |= np.where(at < size[:, None] - 1, 0x80, 0).astype(np.uint8)
    return parts[at < size[:, None]].tobytes()


def _unvarints(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    last = np.flatnonzero(b < 0x80)
    if len(b) and (not len(last) or last[-1] != len(b) - 1):
        raise ParseError("a number ends early")
    first = np.append(0, last[:-1] + 1)
    shift = (np.arange(len(b)) - np.repeat(first, last - first + 1)) * 7 if len(b) else np.empty(0, dtype=np.int64)
    if len(shift) and shift.max() > 63:
        raise ParseError("a number has too many bytes")
    return np.add.reduceat((b & 0x7F).astype(np.uint64) << shift.astype(np.uint64), first) if len(b) else np.empty(0, dtype=np.uint64)


def _deltas(v: np.ndarray) -> bytes:
    d = np.diff(v, prepend=v.dtype.type(0))
    return _varints(((d << 1) ^ (d >> 63)).view(np.uint64))


def _undeltas(raw: bytes) -> np.ndarray:
    z = _unvarints(raw)
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64), dtype=np.int64)


def _xors(v: np.ndarray) -> bytes:
    bits = np.ascontiguousarray(v, dtype=np.float64).view(np.uint64)
    return _varints(np.bitwise_xor(bits, np.append(np.uint64(0), bits[:-1])))


def _unxors(raw: bytes) -> np.ndarray:
    return np.bitwise_xor.accumulate(_unvarints(raw)).view(np.float64)


#: Codec to (type of the values, encoder of one block, decoder).
CODECS = {"delta": ("long", _deltas, _undeltas), "xor": ("double", _xors, _unxors)}


def pack_series(df: DataFrame, value: str, order: tuple[str, ...], *keys: str, codec: str = "delta", block: int = BLOCK) -> DataFrame:
    """(keys, block, n, payload): bytes of each series' values, ``block`` of them a row.

    "delta": zigzag varints of differences, for whole numbers. "xor": varints
    of IEEE bits against the value before, for floats. Nulls are left out.
    """
    kind, encode, _ = CODECS[codec]
    if kind == "long" and not isinstance(df.schema[value].dataType, INTEGERS):
        raise ValidationError(f"whole numbers only: {value!r}")
    findable(df.sparkSession)

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: encode(np.asarray(v, dtype=np.int64 if kind == "long" else np.float64)))

    rows = df.where(F.col(value).isNotNull()).withColumn("_pos", F.row_number().over(_along(keys, order)) - 1)
    blocks = rows.groupBy(*keys, F.floor(F.col("_pos") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(value).cast(kind).alias("v")))).alias("_v"))
    return blocks.select(*keys, "block", F.size("_v").alias("n"), packed(F.col("_v.v")).alias("payload"))


def unpack_series(blocks: DataFrame, *keys: str, codec: str = "delta", block: int = BLOCK) -> DataFrame:
    """(keys, pos, value): what pack_series() packed, in its order, from 0."""
    kind, _, decode = CODECS[codec]
    findable(blocks.sparkSession)

    @F.pandas_udf(f"array<{kind}>")
    def values(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: decode(bytes(p)))

    out = blocks.withColumn("_v", values("payload"))
    return out.select(*keys, "block", F.posexplode("_v").alias("_i", "value")).select(*keys, (F.col("block") * block + F.col("_i")).alias("pos"), "value")


def compress_points(points: DataFrame, order: tuple[str, ...], per: int = 1000) -> DataFrame:
    """(batch, n, payload): all columns of up to ``per`` rows as JSON lines under zlib; rows are numbered within their partition, so nothing is shuffled."""
    order_ = [F.col(c) for c in order]
    at = points.sortWithinPartitions(*order_).withColumn("_id", F.monotonically_increasing_id())
    batch = F.concat_ws("-", F.shiftright("_id", 33).cast("string"), F.floor(F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) / per).cast("string"))

    @F.pandas_udf("binary")
    def packed(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: zlib.compress("\n".join(x).encode()))

    rows = at.select(batch.alias("batch"), F.struct("_id", F.to_json(F.struct(*points.columns)).alias("line")).alias("r"))
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list("r")).alias("r")).select("batch", F.size("r").alias("n"), packed(F.col("r.line")).alias("payload"))


def decompress_points(batches: DataFrame, schema) -> DataFrame:
    """The points of compress_points(), given their schema."""

    @F.pandas_udf("array<string>")
    def lines(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: zlib.decompress(bytes(p)).decode().split("\n"))

    return batches.select(F.explode(lines("payload")).alias("line")).select(F.from_json("line", schema).alias("p")).select("p.*")


def compare_codecs(df: DataFrame, folder: str, codecs: tuple[str, ...] = ("none", "snappy", "gzip", "zstd")) -> DataFrame:
    """(codec, bytes, ratio, saved, seconds) of a table as Parquet; the ratio is against "none"."""
    rows, plain = [], None
    for c in codecs:
        began = time.perf_counter()
        size = parquet_sizes(df, folder, (c,))[c]
        plain = plain or size
        rows.append((c, size, plain / size, 1 - size / plain, time.perf_counter() - began))
    return df.sparkSession.createDataFrame(rows, "codec string, bytes long, ratio double, saved double, seconds double")
