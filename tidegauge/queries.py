"""The registered queries of the time-series operators, each with its SQL for comparison.

Floats are rounded to six places on both sides, and sums of money are exact
decimals, as the order of additions is Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, table_catalog
from .functions import aggregates, scalars
from .model import PointRelation, Relation, series_points
from .operators import advice, codecs, grouping, metadata, rates, scan
from .operators.predicates import AND, OR, Comparison, fld, split_for_pushdown, tag
from .plans import dialect
from .sources import json_points, line_protocol

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return put


def rel(spark: SparkSession, d: str, name: str = "events") -> Relation:
    return table_catalog(spark, d)[name]


def sql(spark: SparkSession, d: str, text: str) -> DataFrame:
    return dialect.plan(text, table_catalog(spark, d))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


SECONDS = "epoch_us(ts) / 1e6"
SAMPLES = "select cast(user_id as varchar) user_id, event_id, epoch_us(ts) / 1e6 t, value v from events"
STEPS = f"select *, lag(t) over w pt, lag(v) over w pv from ({SAMPLES}) window w as (partition by user_id order by t, event_id)"

for _f, _sql in {"count": "count(value)", "sum": "round(sum(value), 6)", "mean": "round(avg(value), 6)", "min": "min(value)", "max": "max(value)"}.items():
    query(f"select {_sql} as value from events", f"sql_global_{_f}")(lambda s, d, f=_f: sql(s, d, f"SELECT {f}(value) FROM events") if f in ("count", "min", "max") else rounded(sql(s, d, f"SELECT {f}(value) FROM events"), "value"))


@query("select user_id, value from (select cast(user_id as varchar) user_id, round(avg(value), 6) as value from events where event_type = 'error' group by 1)")
def sql_group_mean(s, d):
    return rounded(sql(s, d, "SELECT mean(value) FROM events WHERE event_type = 'error' GROUP BY user_id"), "value")


@query("select count(value) as value from events where event_type = 'nothing'")
def sql_where_no_match(s, d):
    return sql(s, d, "SELECT count(value) FROM events WHERE event_type = 'nothing'")


@query("select event_type, max(value) as value from events where value > 1e9 group by 1")
def sql_group_no_match(s, d):
    return sql(s, d, "SELECT max(value) FROM events WHERE value > 1000000000 GROUP BY event_type")


@query("select l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) as value from lineitem where l_quantity >= 10 and l_discount < 0.05 group by 1, 2")
def sql_where_group(s, d):
    return rounded(sql(s, d, "select mean(l_extendedprice) from lineitem where l_quantity >= 10 and l_discount < 0.05 group by l_returnflag, l_linestatus"), "value")


@query("select event_id, event_type, value from events where (event_type = 'click' and value > 50) or (event_type = 'view' and (value < 5 or k >= 90)) ".replace("k >= 90", "cast(json_extract(props, '$.k') as bigint) >= 90"))
def filter_and_or_tree(s, d):
    e = rel(s, d)
    p = OR(AND(tag("event_type", "=", "click"), fld("value", ">", 50)), AND(tag("event_type", "=", "view"), OR(fld("value", "<", 5), fld("k", ">=", 90))))
    return e.where(p.column(e)).df.select("event_id", "event_type", "value")


@query("select event_id from events where false")
def filter_missing_key(s, d):
    e = rel(s, d)
    return e.where(Comparison("nothing", "!=", "x").column(e)).df.select("event_id")


@query("select count(*) filter (where false) as eq, count(event_type) as ne from events")
def filter_tag_number_mismatch(s, d):
    e = rel(s, d)
    return e.df.agg(F.count_if(tag("event_type", "=", 5).column(e)).alias("eq"), F.count_if(tag("event_type", "!=", 5).column(e)).alias("ne"))


@query("select event_id, ts, value from events where ts between timestamp '2024-01-05' and timestamp '2024-01-06' order by ts, event_id limit 10")
def time_range_limit(s, d):
    return scan.read(rel(s, d), "2024-01-05 00:00:00", "2024-01-06 00:00:00", None, None, None, None, 10, "event_id").select("event_id", "ts", "value")


@query("select event_id, event_type, value from events where event_type = 'purchase' and value = (select max(value) from events where event_type = 'purchase')")
def read_equal_tags_fields(s, d):
    e = rel(s, d)
    top = e.where(tag("event_type", "=", "purchase").column(e)).df.agg(F.max("value").alias("top"))
    return scan.read(e, tags={"event_type": "purchase"}).join(F.broadcast(top), F.col("value") == F.col("top")).select("event_id", "event_type", "value")


@query("select count(*) as n from events where event_type = 'error' and value > 100")
def read_indexed_predicate(s, d):
    e = rel(s, d)
    on_tags, rest = split_for_pushdown(AND(tag("event_type", "=", "error"), fld("value", ">", 100)))
    return scan.read(e, predicate=AND(on_tags, rest)).agg(F.count(F.lit(1)).alias("n"))


@query("select * from (select event_id, ts, 0 as src from events where event_type = 'click' union all select event_id, ts, 1 as src from events where event_type = 'view') order by ts, src, event_id limit 50")
def merge_streams(s, d):
    e = rel(s, d)
    parts = [e.where(tag("event_type", "=", t).column(e)).df.select("event_id", "ts") for t in ("click", "view")]
    return scan.merge(parts, "ts", "event_id", limit=50)


DIRTY = "select event_type, case when event_id % 11 = 0 then 'nan'::double when event_id % 13 = 0 then 'inf'::double when event_id % 7 = 0 then null else value end v from events"


def dirty(s, d) -> Relation:
    e = rel(s, d)
    v = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value"))
    return e.on(e.df.withColumn("value", v))


@query(f"select event_type, count(*) as points, count(v) filter (where isfinite(v)) as numbers, round(sum(v) filter (where isfinite(v)), 6) as total, max(v) filter (where isfinite(v)) as top from ({DIRTY}) group by 1")
def agg_dirty_finite(s, d):
    e = dirty(s, d)
    v = e.number("value")
    return e.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("points"), F.count(v).alias("numbers"), r6(F.sum(v), "total"), F.max(v).alias("top"))


@query(f"select count(v) filter (where isfinite(v)) as value from ({DIRTY})")
def agg_field_count(s, d):
    return aggregates.aggregate_field(dirty(s, d), "value", "count")


@query("select event_type, round(avg(value), 6) as value, count(*) as count from (select nullif(event_type, 'view') event_type, value from events) group by 1")
def group_null_tag(s, d):
    e = rel(s, d)
    e = e.on(e.df.withColumn("event_type", F.nullif("event_type", F.lit("view"))))
    return rounded(grouping.group(e, ["event_type"], "value", "mean"), "value")


@query("select cast(count(*) as bigint) as count, round(sum(value), 6) as value from events")
def group_without_tags(s, d):
    return rounded(grouping.group(rel(s, d), [], "value", "sum"), "value")


@query(f"select event_type, start, start + 300 as \"end\", round(sum(value), 6) as value, count(*) as count from (select event_type, value, floor({SECONDS} / 300) * 300 as start from events) group by 1, 2, 3")
def group_windowed_sum(s, d):
    return rounded(grouping.tumbling(rel(s, d), "5m", "value", "sum", tags=("event_type",)), "value")


@query("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1")
def percentiles(s, d):
    e = rel(s, d)
    v = e.number("value")
    return e.df.groupBy("event_type").agg(*[r6(aggregates.percentile(v, p), f"p{p}") for p in (50, 95, 99)])


@query("""with b as (select event_type, least(199, greatest(0, floor(value / 2.5))) as bucket, count(*) n from events group by 1, 2),
r as (select *, sum(n) over (partition by event_type order by bucket) upto, sum(n) over (partition by event_type) total from b)
select event_type, min(bucket) * 2.5 + 1.25 as value from r where upto >= ceil(total * 0.95) group by 1""")
def histogram_quantile_p95(s, d):
    e = rel(s, d)
    h = aggregates.histogram(e.df, e.number("value"), 0, 500, 200, "event_type")
    return aggregates.histogram_quantile(h, 0, 500, 200, 95, "event_type")


@query(f"select start, start + 3600 as \"end\", round(avg(value), 6) as value, count(*) as count from (select value, floor({SECONDS} / 3600) * 3600 as start from events) group by 1, 2")
def window_mean_1h(s, d):
    return rounded(grouping.tumbling(rel(s, d), "1h", "value", "mean"), "value")


@query(f"select start, start + 300 as \"end\", round(avg(value), 6) as value, count(*) as count from (select value, floor(({SECONDS} - 75) / 300) * 300 + 75 as start from events) group by 1, 2")
def window_mean_5m_origin(s, d):
    return rounded(grouping.tumbling(rel(s, d), "5m", "value", "mean", origin=75), "value")


@query(f"""with w as (select cast(floor({SECONDS} / 60) as bigint) b, max(value) v, count(*) n from events group by 1),
a as (select unnest(range((select min(b) from w), (select max(b) + 1 from w))) b)
select cast(a.b * 60 as double) as start, cast(a.b * 60 + 60 as double) as "end", v as value, coalesce(n, 0) as count from a left join w on a.b = w.b""")
def window_fill_empty_1m(s, d):
    return grouping.fill_gaps(grouping.tumbling(rel(s, d), "1m", "value", "max"), "1m")


def samples(s, d) -> DataFrame:
    e = rel(s, d)
    return e.df.select(e.tag("user_id").alias("user_id"), "event_id", e.seconds.alias("timestamp"), e.number("value").alias("value"))


@query(f"select user_id, t as timestamp, round(case when v - pv < 0 then v else v - pv end / (t - pt), 6) as value from ({STEPS}) where t <> pt")
def counter_rate(s, d):
    return rounded(rates.rate(samples(s, d), "user_id", tie=("event_id",)), "value")


@query(f"select user_id, t as timestamp, round((v - pv) / (t - pt), 6) as value from ({STEPS}) where t <> pt")
def gauge_derivative(s, d):
    return rounded(rates.derivative(samples(s, d), "user_id", tie=("event_id",)), "value")


@query(f"select user_id, round(coalesce(sum(case when v - pv < 0 then v else v - pv end), 0), 6) as value from ({STEPS}) group by 1")
def total_increase(s, d):
    return rounded(rates.total_increase(samples(s, d), "user_id", tie=("event_id",)), "value")


@query(f"select user_id, round(sum(case when v - pv < 0 then v else v - pv end) / nullif(max(t) - min(t), 0), 6) as value from ({STEPS}) group by 1")
def rate_over_window(s, d):
    return rounded(rates.rate_over_window(samples(s, d), "user_id", tie=("event_id",)), "value")


@query("select event_type, cast(sum(cast(json_extract(props, '$.k') as bigint)) as double) as value from events group by 1")
def json_field_sum(s, d):
    return sql(s, d, "SELECT sum(k) FROM events GROUP BY event_type")


@query("select event_type, count(value) as n from events group by 1")
def samples_of_points(s, d):
    return series_points(rel(s, d), ("event_type",), "value").groupBy("event_type").agg(F.count("value").alias("n"))


def tag_map(e: Relation):
    return F.create_map(F.lit("user_id"), e.tag("user_id"), F.lit("event_type"), e.tag("event_type"))


KEY = "'events,event_type=' || event_type || ',user_id=' || user_id"


@query(f"select distinct {KEY} as series_key from events")
def series_keys(s, d):
    e = rel(s, d)
    return e.df.select(scalars.series_key(F.lit("events"), tag_map(e)).alias("series_key")).distinct()


@query(f"select series_key, row_number() over (order by f, series_key) - 1 as series_id from (select {KEY} as series_key, min(event_id) f from events group by 1)")
def series_ids(s, d):
    e = rel(s, d)
    return metadata.series(e.df, scalars.series_key(F.lit("events"), tag_map(e)), "event_id")


@query(f"select 'events' as measurement, count(distinct {KEY}) as n from events")
def series_cardinality(s, d):
    e = rel(s, d)
    return metadata.series_report(e.df, F.lit("events"), scalars.series_key(F.lit("events"), tag_map(e)))


DAY = "strftime(ts, '%Y%m%d')"
POST = f"select distinct k as tag_key, v as tag_value, location from (select 'event_type' k, event_type v, {DAY} as location from events union all select 'user_id', cast(user_id as varchar), {DAY} from events)"


def posts(s, d) -> DataFrame:
    e = rel(s, d)
    return metadata.postings(e.df, {"event_type": e.tag("event_type"), "user_id": e.tag("user_id")}, F.date_format("ts", "yyyyMMdd"))


@query(POST)
def tag_postings(s, d):
    return posts(s, d)


@query(f"select location from ({POST}) where tag_key = 'user_id' and tag_value = '7' intersect select location from ({POST}) where tag_key = 'event_type' and tag_value = 'error'")
def tag_postings_and(s, d):
    return metadata.lookup(posts(s, d), {"user_id": "7", "event_type": "error"})


@query(f"select distinct location from ({POST}) where (tag_key = 'user_id' and tag_value in ('7')) or (tag_key = 'event_type' and tag_value = 'error')")
def tag_postings_or(s, d):
    return metadata.lookup(posts(s, d), {"user_id": "7", "event_type": "error"}, "or")


@query(f"select tag_key, count(distinct tag_value) as n from ({POST}) group by 1")
def tag_cardinality(s, d):
    return metadata.cardinality(posts(s, d))


@query(f"select count(distinct tag_key) as keys, count(distinct (tag_key, tag_value)) as pairs, count(*) as postings, count(distinct location) as locations from ({POST})")
def tag_index_stats(s, d):
    return metadata.index_stats(posts(s, d))


@query(f"select {DAY} as location, min(ts) as min_ts, max(ts) as max_ts, count(*) as n from events group by 1")
def time_blocks(s, d):
    return metadata.blocks(rel(s, d).df, F.col("ts"), F.date_format("ts", "yyyyMMdd"))


@query(f"select event_id from events where {DAY} in (select {DAY} from events group by {DAY} having min(ts) <= timestamp '2024-01-10 12:00:00' and max(ts) >= timestamp '2024-01-09 06:00:00')")
def blocks_in_range(s, d):
    # blocks are days, so only the days of the range can reach into it: the scan reads no others
    e = scan.timed(rel(s, d), "2024-01-09 00:00:00", "2024-01-10 23:59:59.999999").df.withColumn("day", F.date_format("ts", "yyyyMMdd"))
    b = metadata.blocks(e, F.col("ts").cast("string"), F.col("day"))
    return metadata.pruned(e, "day", metadata.overlapping(b, "2024-01-09 06:00:00", "2024-01-10 12:00:00").select("location")).select("event_id")


@query(f"select location from ({POST}) where tag_key = 'event_type' and tag_value = 'purchase' and location between '20240110' and '20240112'")
def indexed_candidates(s, d):
    e = rel(s, d).df
    b = metadata.blocks(e, F.col("ts").cast("string"), F.date_format("ts", "yyyyMMdd"))
    return metadata.candidates(posts(s, d), b, {"event_type": "purchase"}, "2024-01-10 00:00:00", "2024-01-12 23:59:59.999999")


@query("select strftime(o_orderdate, '%Y%m') as location, min(o_orderdate) as min_ts, max(o_orderdate) as max_ts, count(*) as n, list_sort(list(distinct o_orderstatus)) as o_orderstatus from orders group by 1 ".replace("list_sort(list(distinct o_orderstatus))", "array_to_string(list_sort(list(distinct o_orderstatus)), ',')"))
def partition_month_meta(s, d):
    o = rel(s, d, "orders")
    m = metadata.partition_metadata(o.df, scalars.partition_key(F.col("o_orderdate"), "1M"), F.col("o_orderdate"), {"o_orderstatus": F.col("o_orderstatus")})
    return m.withColumn("o_orderstatus", F.array_join("o_orderstatus", ","))


@query("select strftime(o_orderdate, '%Y%m') as location from orders group by 1 having max(o_orderdate) < timestamp '1996-07-01'")
def retention_candidates(s, d):
    o = rel(s, d, "orders").df
    b = metadata.blocks(o, F.col("o_orderdate"), scalars.partition_key(F.col("o_orderdate"), "1M"))
    return b.where(F.col("max_ts") < F.lit("1996-07-01").cast("timestamp_ntz")).select("location")


@query("select cast(user_id as varchar) as user_id, event_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) over (partition by user_id order by ts, event_id), 0) as delta from events")
def delta_encode(s, d):
    e = rel(s, d)
    t = e.df.select(e.tag("user_id").alias("user_id"), "event_id", e.micros.alias("t"))
    return codecs.delta_encode(t, "t", ("t", "event_id"), "user_id").select("user_id", "event_id", "delta")


@query("""with a as (select user_id, event_id, event_type, ts, case when event_type = lag(event_type) over w then 0 else 1 end n from events window w as (partition by user_id order by ts, event_id)),
b as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) r from a)
select cast(user_id as varchar) as user_id, cast(r as bigint) as run, any_value(event_type) as value, count(*) as n from b group by user_id, r""")
def rle_runs(s, d):
    e = rel(s, d)
    t = e.df.select(e.tag("user_id").alias("user_id"), "event_id", "ts", "event_type")
    return codecs.runs(t, "event_type", ("ts", "event_id"), "user_id")


@query("""with a as (select user_id, event_id, event_type, ts, case when event_type = lag(event_type) over w then 0 else 1 end n from events window w as (partition by user_id order by ts, event_id))
select cast(count(*) as bigint) as total, cast(sum(n) as bigint) as runs, round(count(*) / (2.0 * sum(n)), 6) as ratio, count(*) / (2.0 * sum(n)) > 1.1 as worth from a""")
def rle_analysis(s, d):
    return rounded(codecs.run_stats(rle_runs(s, d)).select("total", "runs", "ratio", "worth"), "ratio")


@query("select event_type as value, row_number() over (order by min(event_id)) - 1 as code from events group by 1")
def dict_encode(s, d):
    return codecs.dictionary(rel(s, d).df, "event_type", "event_id")


@query("select user_id, count(distinct gap) <= 1 as regular from (select cast(user_id as varchar) user_id, round(t - lag(t) over (partition by user_id order by t), 6) gap from (" + SAMPLES + ")) group by 1")
def regular_series(s, d):
    return codecs.regular(samples(s, d), "timestamp", "user_id")


@query("select 'events,event_type=' || event_type || ',user_id=' || user_id || ' k=' || cast(json_extract(props, '$.k') as bigint) || 'i,name=\"' || event_type || '\" ' || (epoch_us(ts) * 1000) as line from events")
def line_protocol_export(s, d):
    e = rel(s, d)
    return e.df.select(line_protocol.format_lines(F.lit("events"), {"user_id": e.tag("user_id"), "event_type": e.tag("event_type")}, {"k": (F.col("k"), "integer"), "name": (F.col("event_type"), "string")}, e.micros).alias("line"))


@query("select event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k, cast(min(epoch_us(ts)) // 1000000 as bigint) as first from events group by 1")
def line_protocol_round_trip(s, d):
    p = line_protocol.read(line_protocol_export(s, d), "line").where("error is null")
    return p.groupBy(F.col("tags")["event_type"].alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("fields", "$.k", "long")).alias("k"), F.floor(F.min("timestamp")).alias("first"))


@query("with t as (select event_type, sum(value) v from events group by 1) select event_type as operation, round(v, 4) as total_time, round(v / sum(v) over (), 6) as share, round(sum(v) over (order by v desc, event_type) / sum(v) over (), 6) as cumulative from t")
def hotspot_rank(s, d):
    t = rel(s, d).df.groupBy(F.col("event_type").alias("operation")).agg(F.sum("value").alias("total_time"))
    return rounded(advice.shares(t), "share", "cumulative").withColumn("total_time", F.round("total_time", 4))


@query("select event_id, md5(event_id || '|' || event_type || '|' || user_id) as checksum from events")
def batch_checksum(s, d):
    return rel(s, d).df.select("event_id", json_points.checksum(F.col("event_id"), F.col("event_type"), F.col("user_id")).alias("checksum"))


@query("select event_type as operation, count(*) as n, round(avg(value), 6) as mean_latency, round(quantile_cont(value, 0.95), 6) as p95_latency, round(avg(case when event_id % 10 = 0 then 1 else 0 end), 6) as error_rate, round(count(*) / sum(value), 6) as throughput from events group by 1")
def operation_stats(s, d):
    e = rel(s, d).df.select(F.col("event_type").alias("operation"), F.col("value").alias("latency"), (F.col("event_id") % 10 == 0).alias("error"))
    return rounded(aggregates.operation_stats(e, "operation"), "mean_latency", "p95_latency", "error_rate", "throughput")


@query(f"""with p as ({POST}), bits as (select distinct location, (h.a + i * h.b) % 9586 as bit from
  (select location, {{'a': ('0x' || substr(m, 1, 16))::ubigint::hugeint, 'b': ('0x' || substr(m, 17, 16))::ubigint::hugeint}} h from (select location, md5(tag_key || '=' || tag_value) m from p)), range(7) r(i)),
w as (select (('0x' || substr(md5('user_id=7'), 1, 16))::ubigint::hugeint + i * ('0x' || substr(md5('user_id=7'), 17, 16))::ubigint::hugeint) % 9586 as bit from range(7) r(i))
select location from bits where bit in (select bit from w) group by location having count(distinct bit) = (select count(distinct bit) from w)""")
def bloom_candidates(s, d):
    """Days whose Bloom filter may hold user 7; every day that does is among them."""
    size = metadata.BloomSize(1000)
    return metadata.might_have(metadata.bloom_filters(posts(s, d), size), "user_id", "7", size)


# IEEE bits of a double that isn't negative: its exponent and the rest of it after the leading one.
IEEE = """case when v = 0 then 0 else (e + 1023)::bigint * 4503599627370496 + cast((v / power(2.0, e) - 1) * 4503599627370496 as bigint) end"""
EXPONENT = "case when v = 0 then 0 when v < power(2.0, floor(log2(v))) then floor(log2(v)) - 1 when v >= power(2.0, floor(log2(v)) + 1) then floor(log2(v)) + 1 else floor(log2(v)) end"


@query(f"select user_id, event_id, xor(b, coalesce(lag(b) over (partition by user_id order by t, event_id), 0)) as xor from (select *, {IEEE} b from (select *, {EXPONENT} e from ({SAMPLES})))")
def xor_encode(s, d):
    return codecs.xor_encode(samples(s, d), "value", ("timestamp", "event_id"), "user_id").select("user_id", "event_id", "xor")


@query("select min(ts) as min_ts, max(ts) as max_ts from events")
def time_bounds(s, d):
    return metadata.time_bounds(metadata.blocks(rel(s, d).df, F.col("ts"), F.date_format("ts", "yyyyMMdd")))


@query("select strftime(o_orderdate, '%Y%m') as location from orders group by 1 having max(o_orderdate) >= timestamp '1996-03-10' and min(o_orderdate) <= timestamp '1996-09-10' and list_contains(list(o_orderstatus), 'F')")
def partitions_for_query(s, d):
    o = rel(s, d, "orders")
    m = metadata.partition_metadata(o.df, scalars.partition_key(F.col("o_orderdate"), "1M"), F.col("o_orderdate").cast("string"), {"o_orderstatus": F.col("o_orderstatus")})
    return metadata.partitions_for(m, "1996-03-10 00:00:00", "1996-09-10 00:00:00", {"o_orderstatus": "F"}).select("location")


@query(f"select distinct tag_value from ({POST}) where tag_key = 'event_type'")
def tag_value_list(s, d):
    return metadata.tag_values(posts(s, d), "event_type")


@query("select 'tag_' || (row_number() over (order by min(event_id), event_type, user_id) - 1) as tag_ref, event_type, cast(user_id as varchar) as user_id from events group by event_type, user_id")
def tag_dictionary(s, d):
    e = rel(s, d)
    tags, _ = codecs.compress_tags(e.df.select("event_id", tag_map(e).alias("tags")), "tags", "event_id")
    return tags.select("tag_ref", F.col("tags")["event_type"].alias("event_type"), F.col("tags")["user_id"].alias("user_id"))


@query("""with a as (select user_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) over (partition by user_id order by ts, event_id), 0) d from events),
z as (select user_id, case when d >= 0 then 2 * d else -2 * d - 1 end z from a)
select cast(user_id as varchar) as user_id, cast(sum(greatest(1, ceil(length(bin(z)) / 7.0))) as bigint) as bytes from z group by 1""")
def delta_varint_bytes(s, d):
    return delta_encode(s, d).groupBy("user_id").agg(F.sum(codecs.varint_bytes(codecs.zigzag(F.col("delta")))).alias("bytes"))


@query("select event_type, user_id, value from (select event_type, cast(user_id as varchar) user_id, round(avg(value), 6) as value from events where value > 5 and event_type != 'view' group by 1, 2)")
def schemaless_group_mean(s, d):
    """The dialect over points whose tags are a map and whose fields are a VARIANT."""
    e = rel(s, d)
    fields = F.try_parse_json(F.to_json(F.struct("value", "k")))
    p = PointRelation("events", e.df.select(F.lit("events").alias("measurement"), e.seconds.alias("timestamp"), tag_map(e).alias("tags"), fields.alias("fields")))
    c = Catalog()
    c.add("events", p)
    return rounded(dialect.plan("SELECT mean(value) FROM events WHERE value > 5 AND event_type != 'view' GROUP BY event_type, user_id", c), "value")


@query("select bucket, cast(count(*) as bigint) as n from (select cast(least(9, greatest(0, floor((l_quantity - 5) / 4))) as integer) as bucket from lineitem) group by 1")
def histogram_counts(s, d):
    li = rel(s, d, "lineitem")
    return aggregates.histogram(li.df, li.number("l_quantity"), 5, 45, 10)


@query("select l_returnflag, start, start + 86400 * 30 as \"end\", max(l_tax) as value, count(*) as count from (select l_returnflag, l_tax, floor(epoch_us(l_shipdate) / 1e6 / 2592000) * 2592000 as start from lineitem) group by 1, 2")
def window_max_30d(s, d):
    return grouping.tumbling(rel(s, d, "lineitem"), "30d", "l_tax", "max", tags=("l_returnflag",))


from . import queries_storage  # noqa: E402,F401  registers the queries that write and read back
