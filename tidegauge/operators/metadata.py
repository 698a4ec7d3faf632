"""Metadata as tables: tag postings, time blocks, series, partitions, Bloom filters; and how they prune."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions.scalars import bloom_positions


def postings(points: DataFrame, tags: dict[str, Column] | Column, location: Column) -> DataFrame:
    """(tag_key, tag_value, location), each once, of non-empty keys and values. ``tags``: a map column, or columns by key."""
    pairs = F.create_map(*[x for k, c in tags.items() for x in (F.lit(k), c.cast("string"))]) if isinstance(tags, dict) else tags
    out = points.select(F.explode(pairs).alias("tag_key", "tag_value"), location.cast("string").alias("location"))
    return out.where("tag_key <> '' and tag_value <> '' and location <> ''").distinct()


def lookup(post: DataFrame, filters: dict[str, str], mode: str = "and") -> DataFrame:
    """(location): those with all ("and") or any ("or") of the tags; without filters none."""
    if not filters:
        return post.select("location").limit(0)
    hit = reduce(lambda a, b: a | b, ((F.col("tag_key") == k) & (F.col("tag_value") == v) for k, v in filters.items()))
    found = post.where(hit)
    if mode == "or":
        return found.select("location").distinct()
    return found.groupBy("location").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(filters)).select("location")


def tag_keys(post: DataFrame) -> DataFrame:
    return post.select("tag_key").distinct().orderBy("tag_key")


def tag_values(post: DataFrame, key: str) -> DataFrame:
    return post.where(F.col("tag_key") == key).select("tag_value").distinct().orderBy("tag_value")


def without_location(post: DataFrame, location: str) -> DataFrame:
    return post.where(F.col("location") != location)


def cardinality(post: DataFrame, estimate: bool = False) -> DataFrame:
    """(tag_key, n): distinct values per key; estimated by a sketch if asked."""
    return post.groupBy("tag_key").agg((F.approx_count_distinct if estimate else F.countDistinct)("tag_value").alias("n"))


def index_stats(post: DataFrame) -> DataFrame:
    """(keys, pairs, postings, locations), all distinct."""
    pair = F.struct("tag_key", "tag_value")
    return post.agg(F.countDistinct("tag_key").alias("keys"), F.countDistinct(pair).alias("pairs"), F.count(F.lit(1)).alias("postings"), F.countDistinct("location").alias("locations"))


def blocks(points: DataFrame, time: Column, location: Column) -> DataFrame:
    """(location, min_ts, max_ts, n) of each location."""
    return points.groupBy(location.alias("location")).agg(F.min(time).alias("min_ts"), F.max(time).alias("max_ts"), F.count(F.lit(1)).alias("n"))


def overlapping(block: DataFrame, start, end) -> DataFrame:
    """Blocks that have a time in [start, end], in time order."""
    if start > end:
        raise ValidationError("a range starts before it ends")
    return block.where((F.col("min_ts") <= F.lit(end)) & (F.col("max_ts") >= F.lit(start))).orderBy("min_ts", "max_ts")


def time_bounds(block: DataFrame) -> DataFrame:
    return block.agg(F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def candidates(post: DataFrame, block: DataFrame, tags: dict[str, str], start=None, end=None) -> DataFrame:
    """(location): what tags and times leave; without filters every location."""
    out = block.select("location")
    if start is not None or end is not None:
        out = block.where((F.col("min_ts") <= F.lit(end) if end is not None else F.lit(True)) & (F.col("max_ts") >= F.lit(start) if start is not None else F.lit(True))).select("location")
    return out.join(lookup(post, tags), "location", "left_semi") if tags else out


def pruned(points: DataFrame, location: str, found: DataFrame, time: str | None = None) -> DataFrame:
    """The points in the locations found.

    With ``time``, blocks found by overlapping() also bound the column that
    they are blocks of, so that the scan leaves out what no block reaches.
    """
    if time is not None:
        kind = points.schema[time].dataType.simpleString()
        at = found.agg(F.min("min_ts").alias("lo"), F.max("max_ts").alias("hi")).head()
        if at.lo is None:
            return points.limit(0)
        points = points.where(F.col(time).between(F.lit(at.lo).cast(kind), F.lit(at.hi).cast(kind)))
        found = found.select("location")
    return points.join(found.withColumnRenamed("location", location), location, "left_semi")


def series(points: DataFrame, key: Column, first_seen: str) -> DataFrame:
    """(series_key, series_id): dense ids in the order in which series were first seen, by the column ``first_seen``.

    The ranking runs over one row per series.
    """
    seen = points.groupBy(key.alias("series_key")).agg(F.min(first_seen).alias("_first"))
    return seen.select("series_key", (F.row_number().over(W.orderBy("_first", "series_key")) - 1).cast("long").alias("series_id"))


def series_report(points: DataFrame, measurement: Column, key: Column) -> DataFrame:
    """(measurement, n): distinct series of each."""
    return points.groupBy(measurement.alias("measurement")).agg(F.countDistinct(key).alias("n"))


def partition_metadata(points: DataFrame, location: Column, time: Column, tags: dict[str, Column]) -> DataFrame:
    """Per location: min and max time, number of points, and the sorted distinct values of each tag."""
    return points.groupBy(location.alias("location")).agg(F.min(time).alias("min_ts"), F.max(time).alias("max_ts"), F.count(F.lit(1)).alias("n"), *[F.array_sort(F.collect_set(c)).alias(k) for k, c in tags.items()])


def partitions_for(meta: DataFrame, start=None, end=None, tags: dict[str, str] | None = None) -> DataFrame:
    """Partitions that can hold matching points, by first time."""
    c = F.lit(True)
    if start is not None:
        c &= F.col("max_ts") >= F.lit(start)
    if end is not None:
        c &= F.col("min_ts") <= F.lit(end)
    for k, v in (tags or {}).items():
        c &= F.array_contains(k, v)
    return meta.where(c).orderBy("min_ts")


def file_info(df: DataFrame) -> DataFrame:
    """(path, bytes, modified, points) of the files behind a DataFrame."""
    m = F.col("_metadata")
    return df.groupBy(m["file_path"].alias("path"), m["file_size"].alias("bytes"), m["file_modification_time"].alias("modified")).agg(F.count(F.lit(1)).alias("points"))


@dataclass(frozen=True)
class BloomSize:
    """Bits and hashes for an expected number of items and a false-positive rate."""

    items: int
    rate: float = 0.01

    @property
    def bits(self) -> int:
        return max(1, math.ceil(-self.items * math.log(self.rate) / math.log(2) ** 2))

    @property
    def hashes(self) -> int:
        return max(1, math.ceil(self.bits / max(1, self.items) * math.log(2)))

    def expected_rate(self, added: int) -> float:
        return (1 - math.exp(-self.hashes * added / self.bits)) ** self.hashes


def bloom_filters(post: DataFrame, size: BloomSize) -> DataFrame:
    """(location, bloom): a filter of "key=value" tokens per location, of fixed size, merged bit by bit map-side."""
    digest = F.md5(F.concat_ws("=", "tag_key", "tag_value").cast("binary"))

    def half(start: int) -> Column:
        """Half of the digest, modulo the number of bits."""
        return (F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)") % size.bits).cast("long")

    bit = F.transform(F.sequence(F.lit(0), F.lit(size.hashes - 1)), lambda i: (half(1) + i * half(17)) % size.bits)
    at = post.select("location", F.explode(bit).alias("bit")).distinct()
    words = at.groupBy("location", F.floor(F.col("bit") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("v"))
    return words.groupBy("location").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("bloom"))


def might_have(filters: DataFrame, key: str, value: str, size: BloomSize) -> DataFrame:
    """Locations whose filter may hold the tag: never fewer than really do."""
    ok = F.lit(True)
    for p in bloom_positions(f"{key}={value}", size.bits, size.hashes):
        ok &= F.coalesce(F.col("bloom")[F.lit(p // 32).cast("long")].bitwiseAND(F.lit(1 << (p % 32)).cast("long")) != 0, F.lit(False))
    return filters.where(ok).select("location")
