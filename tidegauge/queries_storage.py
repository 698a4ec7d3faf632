"""Registered queries of what is written and read back: the store, files, codecs, snapshots, streams; and of the order of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workload
from .functions import aggregates, scalars
from .model import POINTS, Relation
from .operators import codecs, grouping, metadata, scan
from .operators.predicates import tag
from .plans.stages import Sketch, Stage
from .queries import DAY, KEY, POST, SAMPLES, SECONDS, posts, query, r6, rel, rounded, samples, sql, tag_map
from .session import scratch
from .sources import json_points, line_protocol
from .sources.snapshots import Snapshots
from .sources.store import PointStore, StoreConfig
from .streaming import windows


def event_points(s, d) -> DataFrame:
    """Events as schemaless points of a measurement each type."""
    e = rel(s, d)
    fields = F.try_parse_json(F.to_json(F.struct("value", "k", F.col("event_type").alias("name"))))
    return e.df.select(F.col("event_type").alias("measurement"), e.seconds.alias("timestamp"), tag_map(e).alias("tags"), fields.alias("fields"))


def stored(s, d, points: DataFrame | None = None) -> PointStore:
    store = PointStore(s, StoreConfig(scratch(s, "store")))
    store.write(event_points(s, d) if points is None else points)
    return store


@query("select event_type as measurement, count(*) as n, round(sum(value), 4) as total, cast(sum(cast(json_extract(props, '$.k') as bigint)) as double) as k from events group by 1")
def store_round_trip(s, d):
    p = stored(s, d).points()
    return p.groupBy("measurement").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.try_variant_get("fields", "$.value", "double")), 4).alias("total"), F.sum(F.try_variant_get("fields", "$.k", "double")).alias("k"))


@query(f"select event_type as measurement, count(*) as points, min({SECONDS}) as oldest, max({SECONDS}) as newest from events group by 1")
def store_stats(s, d):
    return stored(s, d).stats()


@query("select distinct 'measurement' as kind, event_type as name from events union select distinct 'tag', unnest(['event_type', 'user_id']) from events where event_type = 'click' union select distinct 'field', unnest(['k BIGINT', 'name STRING', 'value']) from events where event_type = 'click'")
def store_catalog(s, d):
    store = stored(s, d)
    kinds = (store.measurements().select(F.lit("measurement"), "measurement"), store.tag_keys("click").select(F.lit("tag"), "key"), store.field_keys("click").select(F.lit("field"), F.concat_ws(" ", "key", F.when(F.col("key") != "value", F.col("type")))).distinct())
    return kinds[0].union(kinds[1]).union(kinds[2]).toDF("kind", "name")


@query("select distinct cast(user_id as varchar) as value from events where event_type = 'view'")
def store_tag_values(s, d):
    return stored(s, d).tag_values("view", "user_id")


@query(f"select distinct {DAY} as part from events where event_type = 'click' and {DAY} between '20240105' and '20240108'")
def store_partitions_in_range(s, d):
    return stored(s, d).partitions("click", 1704412800 + 3600, 1704672000 + 7200)


@query(f"select {DAY} as part, min({SECONDS}) as oldest, max({SECONDS}) as newest, count(*) as points from events where event_type = 'error' group by 1")
def store_partition_info(s, d):
    return stored(s, d).partition_info("error").select("part", "oldest", "newest", "points")


@query(f"select event_type as measurement, {DAY} as part from events group by 1, 2 having max({SECONDS}) < 1705708800 - 5 * 86400")
def store_expired(s, d):
    return stored(s, d).expired(1705708800, 5)


@query(f"select event_type as measurement, {DAY} as part, count(*) as n from events group by 1, 2 having max({SECONDS}) >= 1705708800 - 5 * 86400")
def store_drop_expired(s, d):
    store = stored(s, d)
    store.drop_expired(1705708800, 5)
    return store.points().groupBy("measurement", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"select count(*) as n, round(sum(value), 4) as total, 1 as files from events where event_type = 'click' and {DAY} = '20240110'")
def store_compact(s, d):
    store = stored(s, d)
    store.compact("click", "20240110")
    p = store.relation("click").df.where("part = '20240110'")
    total = F.round(F.sum(F.try_variant_get("fields", "$.value", "double")), 4)
    return p.agg(F.count(F.lit(1)).alias("n"), total.alias("total"), F.countDistinct(F.col("_metadata")["file_path"]).cast("int").alias("files"))


BROKEN = "case when event_id % 10 = 0 then 'measurement' when event_id % 7 = 0 then 'timestamp' when event_id % 5 = 1 then 'fields' end"


def broken(s, d) -> DataFrame:
    e = rel(s, d)
    i = F.col("event_id")
    return e.df.select(F.when(i % 10 == 0, F.lit("a/b")).otherwise(F.col("event_type")).alias("measurement"), F.when(i % 7 == 0, F.lit(-1.0)).otherwise(e.seconds).alias("timestamp"), tag_map(e).alias("tags"), F.when(i % 5 == 1, F.try_parse_json(F.lit("{}"))).otherwise(F.try_parse_json(F.to_json(F.struct("value")))).alias("fields"))


@query(f"select {BROKEN} as reason, count(*) as n from events where {BROKEN} is not null group by 1")
def store_rejects(s, d):
    return PointStore(s, StoreConfig(scratch(s, "store"))).write(broken(s, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"select 'partial' as batch, count(*) - count({BROKEN}) as written, count({BROKEN}) as refused from events union all select 'failure', 0, count({BROKEN}) from events")
def store_batches(s, d):
    """A batch that keeps invalid points out, and one that they keep out as a whole."""
    some = PointStore(s, StoreConfig(scratch(s, "store"))).write_with_retry(broken(s, d))
    none = PointStore(s, StoreConfig(scratch(s, "store"))).write_batch(broken(s, d), atomic=True)
    return s.createDataFrame([some, none], "batch string, written long, refused long")


@query("select event_type, count(*) as n, round(sum(value), 2) as total, count(*) filter (where event_id % 2 = 0) as yes, cast(sum(-event_id) as bigint) as whole from events group by 1")
def line_protocol_types(s, d):
    """Floats, truth, negative integers and text come back with their types."""
    e = rel(s, d)
    line = line_protocol.format_lines(F.lit("events"), {"event_type": e.tag("event_type")}, {"v": (F.col("value"), "float"), "even": (F.col("event_id") % 2 == 0, "boolean"), "id": (-F.col("event_id"), "integer"), "s": (F.col("event_type"), "string")}, e.micros)
    p = line_protocol.read(e.df.select(line.alias("line")), "line").where("error is null")
    of = lambda key, kind: F.try_variant_get("fields", f"$.{key}", kind)
    return p.where(of("s", "string") == F.col("tags")["event_type"]).groupBy(F.col("tags")["event_type"].alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(of("v", "double")), 2).alias("total"), F.count_if(of("even", "boolean")).alias("yes"), F.sum(of("id", "long")).alias("whole"))


@query("select event_id % 4 as unit, count(*) as n, min(epoch_us(ts) // 1000000) as first from events group by 1")
def line_protocol_units(s, d):
    """Seconds, milliseconds, microseconds and nanoseconds are told by their digits."""
    e = rel(s, d).df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    at = F.when(F.col("event_id") % 4 == 0, F.floor(F.col("us") / 1000000)).when(F.col("event_id") % 4 == 1, F.floor(F.col("us") / 1000)).when(F.col("event_id") % 4 == 2, F.col("us")).otherwise(F.col("us") * 1000)
    p = line_protocol.read(e.select(F.concat(F.lit("m,unit="), F.col("event_id") % 4, F.lit(" v=1i "), at.cast("string")).alias("line")), "line").where("error is null")
    return p.groupBy(F.col("tags")["unit"].cast("long").alias("unit")).agg(F.count(F.lit(1)).alias("n"), F.floor(F.min("timestamp")).alias("first"))


@query("select p_name as name, count(*) as n from part group by 1")
def line_protocol_escapes(s, d):
    """Spaces, commas and equals in tags, quotes and backslashes in text."""
    part = s.read.parquet(f"{d}/part.parquet")
    odd = F.concat(F.col("p_name"), F.lit(", \"a\\b\" = c"))
    line = line_protocol.format_lines(F.lit("part"), {"name": odd}, {"text": (odd, "string")}, F.lit(1_700_000_000_000_000).cast("long"))
    p = line_protocol.read(part.select(line.alias("line")), "line").where("error is null")
    p = p.where(F.col("tags")["name"] == F.try_variant_get("fields", "$.text", "string"))
    return p.groupBy(F.expr("substring(tags['name'], 1, length(tags['name']) - 11)").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id % 6 as kind, count(*) filter (where event_id % 6 not in (1, 2, 3, 4)) as good, count(*) filter (where event_id % 6 in (1, 2, 3, 4)) as bad from events where event_id % 6 <> 5 group by 1")
def line_protocol_rejects(s, d):
    """Bad lines don't stop the others; comments give nothing."""
    i = F.col("event_id")
    line = F.when(i % 6 == 0, F.concat(F.lit("m,i="), i, F.lit(" v=1i"))).when(i % 6 == 1, F.concat(F.lit("m "), i)).when(i % 6 == 2, F.lit("m v=")).when(i % 6 == 3, F.lit("m v=1 12345")).when(i % 6 == 4, F.lit("m v=nothing")).otherwise(F.lit("# v=1"))
    p = line_protocol.read(rel(s, d).df.select(line.alias("line")), "line")
    kind = F.when(F.col("error").isNull(), 0).when(F.col("line") == "m v=", 2).when(F.col("line") == "m v=1 12345", 3).when(F.col("line") == "m v=nothing", 4).otherwise(1).cast("long")
    return p.groupBy(kind.alias("kind")).agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("error").alias("bad"))


@query("select event_type, count(*) as n from events group by 1")
def line_protocol_files(s, d):
    e = rel(s, d)
    at = scratch(s, "lines")
    e.df.select(line_protocol.format_lines(F.lit("events"), {"event_type": e.tag("event_type")}, {"k": (F.col("k"), "integer")}, e.micros)).write.text(at)
    return line_protocol.read_files(s, at).where("error is null").groupBy(F.col("tags")["event_type"].alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_type as measurement, count(*) as n, round(sum(value), 4) as total, 0 as broken from events group by 1")
def json_points_round_trip(s, d):
    at = scratch(s, "json")
    event_points(s, d).select(F.to_json(F.struct("measurement", "timestamp", "tags", "fields"))).write.text(at)
    return json_points.read(s, at).groupBy("measurement").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.try_variant_get("fields", "$.value", "double")), 4).alias("total"), F.count("_corrupt").cast("int").alias("broken"))


@query("select event_type as measurement, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k from events group by 1")
def json_typed_round_trip(s, d):
    at = scratch(s, "json")
    typed = F.struct(F.struct(F.col("k").alias("value"), F.lit("integer").alias("type")).alias("k"))
    e = rel(s, d)
    e.df.select(F.to_json(F.struct(F.col("event_type").alias("measurement"), e.seconds.alias("timestamp"), tag_map(e).alias("tags"), typed.alias("fields")))).write.text(at)
    return json_points.read_typed(s, at).groupBy("measurement").agg(F.sum(F.try_variant_get("fields", "$.k", "long")).alias("k"))


@query("select cast(user_id as varchar) as user_id, count(*) as n, cast(sum(epoch_us(ts) % 1000003 * (r % 17)) as bigint) as mark from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 r from events) group by 1")
def delta_packed_round_trip(s, d):
    """Times as bytes and back; positions weigh them, so that the order counts."""
    e = rel(s, d)
    t = e.df.select(e.tag("user_id").alias("user_id"), "event_id", e.micros.alias("t"))
    back = codecs.unpack_series(codecs.pack_series(t, "t", ("t", "event_id"), "user_id", block=64), "user_id", block=64)
    return back.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") % 1000003 * (F.col("pos") % 17)).alias("mark"))


@query(f"select user_id, row_number() over (partition by user_id order by t, event_id) - 1 as pos, v as value from ({SAMPLES})")
def xor_packed_round_trip(s, d):
    blocks = codecs.pack_series(samples(s, d), "value", ("timestamp", "event_id"), "user_id", codec="xor")
    return codecs.unpack_series(blocks, "user_id", codec="xor")


@query("""with a as (select user_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) over (partition by user_id order by ts, event_id), 0) d from events)
select cast(user_id as varchar) as user_id, cast(count(*) as integer) as n, cast(sum(greatest(1, ceil(length(bin(case when d >= 0 then 2 * d else -2 * d - 1 end)) / 7.0))) as bigint) as bytes from a group by 1""")
def delta_packed_bytes(s, d):
    e = rel(s, d)
    t = e.df.select(e.tag("user_id").alias("user_id"), "event_id", e.micros.alias("t"))
    return codecs.pack_series(t, "t", ("t", "event_id"), "user_id", block=1 << 20).select("user_id", "n", F.length("payload").cast("long").alias("bytes"))


@query("select cast(user_id as varchar) as user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, event_type as value from events")
def rle_round_trip(s, d):
    e = rel(s, d)
    t = e.df.select(e.tag("user_id").alias("user_id"), "event_id", "ts", "event_type")
    return codecs.runs_decode(codecs.runs(t, "event_type", ("ts", "event_id"), "user_id"), "user_id")


@query("select cast(user_id as varchar) as user_id, event_id, epoch_us(ts) as t from events")
def delta_round_trip(s, d):
    e = rel(s, d)
    t = e.df.select(e.tag("user_id").alias("user_id"), "event_id", e.micros.alias("at"))
    return codecs.delta_decode(codecs.delta_encode(t, "at", ("at", "event_id"), "user_id", steps=2), ("at", "event_id"), "user_id", value="t", steps=2).select("user_id", "event_id", "t")


@query("select event_id, event_type as value from events")
def dict_round_trip(s, d):
    e = rel(s, d).df.select("event_id", "event_type")
    codes = codecs.dictionary(e, "event_type", "event_id")
    coded = e.join(codes, e["event_type"] == codes["value"]).select("event_id", "code")
    return codecs.dictionary_decode(coded, codes).select("event_id", "value")


@query("select event_type, count(*) as n, round(sum(value), 4) as total, cast(sum(event_id) as bigint) as ids from events group by 1")
def points_compressed_round_trip(s, d):
    e = rel(s, d).df.select("event_id", "event_type", "value")
    back = codecs.decompress_points(codecs.compress_points(e, ("event_id",), 500), e.schema)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum("event_id").alias("ids"))


@query(f"select 2 as version, count(*) as postings, count(distinct location) as locations from ({POST})")
def snapshots_round_trip(s, d):
    """Postings of some days as a snapshot, the others logged, compacted to the second version, backed up and restored."""
    at, p = scratch(s, "snapshots"), posts(s, d)
    tables = Snapshots(s, at)
    tables.save("tags", p.where("location < '20240115'"))
    tables.append("tags", p.where("location >= '20240115'"))
    version = tables.compact("tags")
    tables.backup(at + "-backup")
    tables.restore(at + "-backup")
    return tables.load("tags").agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("postings"), F.countDistinct("location").alias("locations"))


@query("select count(*) as n from events where event_type = 'click' and ts >= timestamp '2024-01-05'")
def scan_count(s, d):
    return s.createDataFrame([(scan.count(rel(s, d), start="2024-01-05 00:00:00", tags={"event_type": "click"}),)], "n long")


@query("select event_id from events where ts between timestamp '2024-01-05' and timestamp '2024-01-06' and (value + event_id) % 2 < 1 and user_id = 7")
def read_also(s, d):
    """A condition of one's own beside the tags."""
    e = rel(s, d)
    return scan.read(e, "2024-01-05 00:00:00", "2024-01-06 00:00:00", {"user_id": "7"}, also=(F.col("value") + F.col("event_id")) % 2 < 1).select("event_id")


@query("select event_id, row_number() over (order by ts, event_id) - 1 as place from events where event_type = 'error' and ts between timestamp '2024-01-05' and timestamp '2024-01-07'")
def scan_stream(s, d):
    """One location's rows come to the driver in time order."""
    e = rel(s, d)
    rows = scan.stream(e, tag("event_type", "=", "error").column(e), "2024-01-05 00:00:00", "2024-01-07 00:00:00", "event_id")
    return s.createDataFrame([(r.event_id, i) for i, r in enumerate(rows)], "event_id long, place long")


class Spread:
    """The greatest less the least: a fold of one's own."""

    def __init__(self):
        self.low = self.high = None

    def update(self, v: float) -> None:
        self.low, self.high = (v if self.low is None else min(v, self.low)), (v if self.high is None else max(v, self.high))

    def result(self) -> float | None:
        return None if self.low is None else self.high - self.low


@query("select event_type, round(max(value) - min(value), 6) as value, count(*) as count from events group by 1")
def agg_own_fold(s, d):
    return rounded(grouping.group(rel(s, d), ["event_type"], "value", aggregates.folded(Spread)), "value")


@query("select event_type, round(avg(value * value), 6) as value, count(*) as count from events group by 1")
def agg_own_column(s, d):
    return rounded(grouping.group(rel(s, d), ["event_type"], "value", lambda v: F.avg(v * v)), "value")


@query(f"select start, start + 86400 as \"end\", round(sum(value), 4) as value, count(*) as count from (select value, floor(({SECONDS} - 21600) / 86400) * 86400 + 21600 as start from events) group by 1, 2")
def window_own_start(s, d):
    """Days that begin at six."""
    e = rel(s, d)
    own = lambda t: F.floor((t - 21600) / 86400) * 86400.0 + 21600
    return grouping.tumbling(e, "1d", "value", "sum", start_of=own).withColumn("value", F.round("value", 4))


@query("select event_type, max(value) as value from events where user_id = 7 group by 1")
def sql_quoted_names(s, d):
    return sql(s, d, 'SELECT max("value") FROM "events" WHERE "user_id" = \'7\' GROUP BY "event_type"')


@query("select distinct 'a,b=c' as measurement, 'x=' || event_type || ',\\' as type, cast(user_id as varchar) as user_id from events")
def series_key_round_trip(s, d):
    e = rel(s, d)
    tags = F.create_map(F.lit("t,y=pe"), F.concat(F.lit("x="), e.tag("event_type"), F.lit(",\\")), F.lit("user_id"), e.tag("user_id"))
    keys = e.df.select(scalars.series_key(F.lit("a,b=c"), tags).alias("key")).distinct()
    parts = keys.select(scalars.series_parts(F.col("key")).alias("p"))
    return parts.select("p.measurement", F.col("p.tags")["t,y=pe"].alias("type"), F.col("p.tags")["user_id"].alias("user_id"))


@query("select event_id, sha256(event_id || '|' || event_type) as checksum from events")
def batch_checksum_sha256(s, d):
    return rel(s, d).df.select("event_id", json_points.checksum(F.col("event_id"), F.col("event_type"), sha256=True).alias("checksum"))


@query(f"select distinct tag_key from ({POST})")
def tag_key_list(s, d):
    return metadata.tag_keys(posts(s, d))


@query(f"select tag_key, count(*) as n from ({POST}) where location <> '20240110' group by 1")
def tag_postings_without(s, d):
    return metadata.without_location(posts(s, d), "20240110").groupBy("tag_key").agg(F.count(F.lit(1)).alias("n"))


@query("select 'cardinality' as measure, 'event_type' as name, cast(count(distinct event_type) as varchar) as value from events union all select 'cardinality', 'user_id', cast(count(distinct user_id) as varchar) from events union all select 'type', 'value', 'double' union all select 'regular', 'timestamp', 'false'")
def encoding_potential(s, d):
    e = samples(s, d).join(rel(s, d).df.select("event_id", "event_type"), "event_id")
    return codecs.potential(e, "timestamp", ("event_type", "user_id"), ("value",), "user_id")


def placed(df: DataFrame) -> DataFrame:
    """Adds the place of each row of an ordered DataFrame of few rows."""
    return df.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query("select t as event_type, row_number() over (order by t nulls first) - 1 as place from (select distinct nullif(event_type, 'view') t from events)")
def group_order(s, d):
    """Groups come in order, a missing tag first."""
    e = rel(s, d)
    e = e.on(e.df.withColumn("event_type", F.nullif("event_type", F.lit("view"))))
    return placed(grouping.group(e, ["event_type"], "value", "mean")).select("event_type", "place")


@query("select t as l_returnflag, row_number() over (order by t) - 1 as place from (select distinct l_returnflag t from lineitem)")
def sql_group_order(s, d):
    return placed(sql(s, d, "SELECT count(l_tax) FROM lineitem GROUP BY l_returnflag")).select("l_returnflag", "place")


@query(f"select start, row_number() over (order by start) - 1 as place from (select distinct floor({SECONDS} / 21600) * 21600 as start from events)")
def window_order(s, d):
    return placed(grouping.tumbling(rel(s, d), "6h", "value", "mean")).select("start", "place")


@query(f"select location, row_number() over (order by lo, hi) - 1 as place from (select {DAY} as location, min(ts) lo, max(ts) hi from events group by 1) where lo <= timestamp '2024-01-20' and hi >= timestamp '2024-01-10'")
def block_order(s, d):
    b = metadata.blocks(rel(s, d).df, F.col("ts").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return placed(metadata.overlapping(b, "2024-01-10 00:00:00", "2024-01-20 00:00:00")).select("location", "place")


@query("select *, row_number() over (order by score desc, option) as rank from (select event_type as option, round(sum(m * w) / sum(w), 6) as score from (select event_type, event_id % 3 c, avg(value) m, event_id % 3 + 1 w from events group by 1, 2, 4) group by 1)")
def weighted_scores(s, d):
    marks = rel(s, d).df.groupBy(F.col("event_type").alias("option"), (F.col("event_id") % 3).alias("criterion")).agg(F.avg("value").alias("mark"))
    return rounded(workload.scored(marks, s.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "criterion long, weight double")), "score")


@query("select name, row_number() over (order by impact / effort desc, impact desc, name) as rank, impact / effort > 4 as quick_win from (select event_type as name, cast(sum(user_id) as double) as impact, cast(count(*) * 10 as double) as effort from events group by 1)")
def priorities(s, d):
    plan = rel(s, d).df.groupBy(F.col("event_type").alias("name")).agg(F.sum("user_id").cast("double").alias("impact"), (F.count(F.lit(1)) * 10).cast("double").alias("effort"))
    return workload.prioritized(plan, 4.0).select("name", "rank", "quick_win")


@query("""select 'late filters' as plan, round(3.1 * n, 3) as cost, round(2.15 * n, 3) as optimized, 'scan -> filter(tag) -> filter -> aggregate' as shape from (select count(*) n from events)
union all select 'after a limit', round(2.0 * n + 10, 3), round(2.0 * n + 10, 3), 'scan -> limit -> filter' from (select count(*) n from events)
union all select 'on both sides', round(2.1 * n + 5, 3), round(2.1 * n + 5, 3), 'scan -> filter(tag) -> limit -> filter' from (select count(*) n from events)
union all select 'bare limit', round(2.0 * n, 3), round(1.0 * n + 10, 3), 'limit -> scan' from (select count(*) n from events)""")
def plan_costs(s, d):
    n = rel(s, d).df.count()
    late = (Stage("scan"), Stage("aggregate"), Stage("filter", True, 0.1), Stage("filter", False, 0.5))
    after = (Stage("scan"), Stage("limit", limit=10), Stage("filter", False, 0.5))
    both = (Stage("scan"), Stage("filter", True, 0.1), Stage("limit", limit=5), Stage("filter", False, 0.5))
    rows = []
    for name, stages in (("late filters", late), ("after a limit", after), ("on both sides", both), ("bare limit", after[:2])):
        sketch = Sketch(stages, n)
        better = sketch.optimized()
        rows.append((name, round(sketch.cost(), 3), round(better.cost(), 3), better.explain()))
    return s.createDataFrame(rows, "plan string, cost double, optimized double, shape string")


def event_stream(s, d) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("select event_type as measurement, count(*) as points from events group by 1")
def stream_to_store(s, d):
    """Micro-batches of a stream, flushed to the store."""
    store = PointStore(s, StoreConfig(scratch(s, "store")))
    points = event_stream(s, d).select(F.col("event_type").alias("measurement"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("tags"), F.try_parse_json(F.to_json(F.struct("value"))).alias("fields"))
    windows.flush_to(points, store.write, scratch(s, "checkpoint")).awaitTermination()
    return store.stats().select("measurement", "points")


@query("select event_type, cast(floor(epoch_us(ts) / 1e6 / 3600) * 3600 as bigint) as start, round(avg(value), 6) as value, count(*) as count from events group by 1, 2")
def stream_windows(s, d):
    """Hourly means of a stream; its last state is what all of the events give."""
    at = scratch(s, "windows")
    stream = event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.tumbling(stream, "ts", "1 hour", "value", "mean", "30 minutes", "event_type")
    keep = lambda df, _: df.write.mode("overwrite").parquet(at)
    out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(s, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(at).select("event_type", F.unix_seconds("start").alias("start"), r6(F.col("value"), "value"), "count")
