"""Golden cases, plans and edges of the time-series operators."""

import pytest
from pyspark.sql import functions as F

from tidegauge.catalog import safe_name, table_catalog
from tidegauge.database import Database
from tidegauge.errors import ParseError, QueryError, ValidationError
from tidegauge.functions import aggregates as A
from tidegauge.functions import scalars as S
from tidegauge.model import PointRelation, WideRelation
from tidegauge.operators import codecs, grouping, metadata, rates
from tidegauge.operators.predicates import AND, OR, Comparison, fld, split_for_pushdown, tag
from tidegauge.plans import dialect, stages
from tidegauge.sources.store import from_rows

from .conftest import DATA


def wide(spark, rows, schema, tags, fields):
    return WideRelation("m", spark.createDataFrame(rows, schema), "t", tags, fields)


@pytest.fixture(scope="module")
def cpu(spark):
    return wide(spark, [(0.0, "a", "us", 10.0), (1.0, "a", "us", 30.0), (2.0, "b", "us", 100.0), (3.0, "c", "eu", 50.0)], "t double, host string, region string, value double", ("host", "region"), ("value",))


class One:
    def __init__(self, r):
        self.r = r

    def __getitem__(self, name):
        return self.r


def ask(rel, sql):
    return dialect.rows(dialect.plan(sql, One(rel)))


def test_dialect_golden(cpu):
    assert ask(cpu, "SELECT mean(value) FROM cpu") == [{"value": 47.5}]
    assert ask(cpu, "SELECT sum(value) FROM cpu WHERE region = 'us'") == [{"value": 140.0}]
    assert ask(cpu, "SELECT count(value) FROM cpu WHERE value > 25") == [{"value": 3}]
    assert ask(cpu, "SELECT mean(value) FROM cpu GROUP BY host") == [{"host": "a", "value": 20.0}, {"host": "b", "value": 100.0}, {"host": "c", "value": 50.0}]
    assert ask(cpu, "SELECT max(value) FROM cpu WHERE region = 'us' AND value < 100") == [{"value": 30.0}]
    assert ask(cpu, "SELECT mean(value) FROM cpu WHERE nothing = 1") == [{"value": None}]
    assert ask(cpu, "SELECT mean(value) FROM cpu WHERE host = 1 GROUP BY host") == []


@pytest.mark.parametrize("bad", ["", "SELECT", "SELECT median(v) FROM m", "SELECT mean(v) FROM m WHERE", "SELECT mean(v) FROM m extra", "SELECT mean(v) FROM m GROUP host", "SELECT mean(v) FROM m WHERE a ~ 1", "SELECT Mean(v) FROM m"])
def test_dialect_errors(bad):
    with pytest.raises(ParseError):
        dialect.parse(bad)


def test_dialect_parses():
    q = dialect.parse("select count(v) from \"a-b\" where x = 'y z' and n >= -1.5 group by h, r")
    assert q == dialect.Select("count", "v", "a-b", (Comparison("x", "=", "y z"), Comparison("n", ">=", -1.5)), ("h", "r"))


def test_order_of_text_and_number_is_an_error(cpu):
    with pytest.raises(QueryError):
        tag("host", ">", 5).column(cpu)
    with pytest.raises(QueryError):
        ask(cpu, "SELECT mean(value) FROM cpu GROUP BY value")


def test_nan_compares_with_nothing(spark):
    r = wide(spark, [(0.0, float("nan")), (1.0, 1.0), (2.0, None)], "t double, v double", (), ("v",))
    n = {op: r.where(fld("v", op, 1.0).column(r)).df.count() for op in ("=", "!=", "<", "<=", ">", ">=")}
    assert n == {"=": 1, "!=": 1, "<": 0, "<=": 1, ">": 0, ">=": 1}


def test_variant_points_keep_types_apart(spark):
    rows = [{"measurement": "m", "timestamp": i, "tags": {"h": "a"} if i else {}, "fields": {"v": v}} for i, v in enumerate([10, 1.5, "5", True, None])]
    r = PointRelation("m", from_rows(spark, rows))
    assert r.df.agg(F.sum(r.number("v")).alias("s"), F.count(r.number("v")).alias("n")).collect()[0] == (11.5, 2)
    assert r.where(fld("v", "=", "5").column(r)).df.count() == 1
    assert r.where(fld("v", "=", 5).column(r)).df.count() == 0
    assert r.where(Comparison("h", "!=", "b").column(r)).df.count() == 4


def test_predicate_trees(cpu):
    assert cpu.where(AND().column(cpu)).df.count() == 4
    assert cpu.where(OR().column(cpu)).df.count() == 0
    t, f = tag("host", "=", "a"), fld("value", ">", 1)
    assert split_for_pushdown(AND(t, f)) == (t, f)
    assert split_for_pushdown(OR(t, f)) == (None, OR(t, f))
    assert split_for_pushdown(t) == (t, None)


def test_filters_and_columns_reach_the_scan(spark):
    df = dialect.plan("SELECT mean(value) FROM events WHERE event_type = 'click' AND value > 5", table_catalog(spark, DATA))
    facts = stages.scan_facts(df)
    assert "EqualTo(event_type,click)" in facts["PushedFilters"][0] and "GreaterThan(value,5" in facts["PushedFilters"][0]
    assert "props" not in facts["ReadSchema"][0]


def test_read_strategy(spark):
    from tidegauge.operators import scan

    e = table_catalog(spark, DATA)["events"]
    how = scan.strategy(e, "2024-01-05 00:00:00", "2024-01-06 00:00:00", {"event_type": "click"})
    assert how["strategy"] == "tag+time" and "EqualTo(event_type,click)" in how["PushedFilters"][0] and "GreaterThanOrEqual(ts" in how["PushedFilters"][0]
    assert scan.strategy(e)["strategy"] == "scan"
    plan = stages.physical(scan.read(e, limit=5))
    assert "TakeOrderedAndProject" in plan


def test_groups(spark):
    r = wide(spark, [(0.0, "us", "a", 10.0), (1.0, "us", "a", 20.0), (2.0, "us", "b", 100.0), (3.0, "eu", "a", 5.0), (4.0, "eu", None, 7.0)], "t double, region string, host string, v double", ("region", "host"), ("v",))
    assert [tuple(x) for x in grouping.group(r, ["region"], "v", "sum").collect()] == [("eu", 12.0, 2), ("us", 130.0, 3)]
    assert tuple(grouping.group(r, ["region", "host"], "v", "sum").collect()[0]) == ("eu", None, 7.0, 1)
    assert [tuple(x) for x in grouping.group(r, [], "v", "sum").collect()] == [(142.0, 5)]
    assert grouping.group(r.where(F.lit(False)), [], "v", "sum").collect() == []


def test_windows_and_gaps(spark):
    r = wide(spark, [(0.0, 10.0), (30.0, 20.0), (60.0, 100.0), (90.0, 200.0), (180.0, 5.0)], "t double, v double", (), ("v",))
    w = grouping.tumbling(r, "1m", "v")
    assert sorted(map(tuple, w.collect())) == [(0.0, 60.0, 15.0, 2), (60.0, 120.0, 150.0, 2), (180.0, 240.0, 5.0, 1)]
    assert sorted(map(tuple, grouping.fill_gaps(w, "1m").collect()))[2] == (120.0, 180.0, None, 0)
    edges = spark.createDataFrame([(x,) for x in (1000.0, 900.0, 1199.0, 1200.0, -1.0)], "t double")
    assert [x[0] for x in edges.select(S.window_start(F.col("t"), 300)).collect()] == [900.0, 900.0, 900.0, 1200.0, -300.0]
    assert [x[0] for x in edges.limit(1).select(S.window_start(F.lit(70.0), 60, 15)).collect()] == [15.0]


def test_rates(spark):
    def f(fn, rows, **kw):
        return [x.value for x in fn(spark.createDataFrame(rows, "timestamp double, value double"), **kw).collect()]

    assert f(rates.derivative, [(0.0, 0.0), (10.0, 30.0), (30.0, 90.0)]) == [3.0, 3.0]
    assert f(rates.rate, [(0.0, 90.0), (10.0, 100.0), (20.0, 10.0)]) == [1.0, 1.0]
    assert f(rates.total_increase, [(float(i), float(v)) for i, v in enumerate([0, 5, 10, 2, 6])]) == [16.0]
    assert f(rates.rate_over_window, [(0.0, 0.0), (10.0, 100.0)]) == [10.0]
    assert f(rates.rate_over_window, [(0.0, 5.0)]) == [None]
    assert f(rates.total_increase, [(0.0, 5.0)]) == [0.0]
    assert f(rates.derivative, [(2.0, 20.0), (0.0, 0.0), (2.0, 25.0)], tie=("value",)) == [10.0]


def test_percentiles_and_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert tuple(df.agg(*[A.percentile(F.col("v"), p) for p in (0, 50, 95, 100)]).collect()[0]) == (1.0, 50.5, 95.05, 100.0)
    h = A.histogram(spark.createDataFrame([(-5.0,), (105.0,), (50.0,)], "v double"), F.col("v"), 0, 100, 100)
    assert sorted(map(tuple, h.collect())) == [(0, 1), (50, 1), (99, 1)]
    assert [x.value for x in A.histogram_quantile(h, 0, 100, 100, 50).collect()] == [50.5]
    with pytest.raises(QueryError):
        A.aggregate("median")


@pytest.mark.parametrize(("text", "seconds"), [("30s", 30), ("5m", 300), ("1h", 3600), ("2d", 172800)])
def test_durations(text, seconds):
    assert S.parse_duration(text) == seconds


@pytest.mark.parametrize("bad", ["", "5", "10x", "abc", "m", None])
def test_bad_durations(bad):
    with pytest.raises(ParseError):
        S.parse_duration(bad)


@pytest.mark.parametrize("tags", [{}, {"host": "server1", "region": "us-west"}, {"path": "/a,b=c"}, {"a=b,c": "x\\y", "z": "\\"}])
def test_series_keys_round_trip(spark, tags):
    df = spark.createDataFrame([("http,x", tags)], "m string, tags map<string,string>")
    key = df.select(S.series_key(F.col("m"), F.col("tags"))).collect()[0][0]
    assert S.parse_series_key(key) == ("http,x", tags)


def test_series_key_text(spark):
    df = spark.createDataFrame([("cpu", {"region": "us-west", "host": "server1"})], "m string, tags map<string,string>")
    assert df.select(S.series_key(F.col("m"), F.col("tags"))).collect()[0][0] == "cpu,host=server1,region=us-west"


def test_codecs(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([3, 3, 3, 5, None, None, 3])], "s string, i int, v long")
    assert [(r.value, r.n) for r in codecs.runs(df, "v", ("i",), "s").orderBy("run").collect()] == [(3, 3), (5, 1), (None, 2), (3, 1)]
    whole = df.where("v is not null")
    back = codecs.delta_decode(codecs.delta_encode(whole, "v", ("i",), "s", steps=2).drop("v"), ("i",), "s", value="v", steps=2)
    assert [r.v for r in back.orderBy("i").collect()] == [3, 3, 3, 5, 3]
    z = spark.createDataFrame([(x,) for x in (0, -1, 1, -2, 2**62, -(2**62))], "v long").select("v", codecs.zigzag(F.col("v")).alias("z"))
    assert [r.z for r in z.collect()][:4] == [0, 1, 2, 3]
    assert all(r[0] == r[1] for r in z.select("v", codecs.unzigzag(F.col("z"))).collect())
    points = spark.createDataFrame([(0, {"h": "a"}), (1, {"h": "b"}), (2, {"h": "a"})], "i int, tags map<string,string>")
    d, p = codecs.compress_tags(points, "tags", "i")
    assert {r.tag_ref: r.tags for r in d.collect()} == {"tag_0": {"h": "a"}, "tag_1": {"h": "b"}}
    assert [r.tag_ref for r in p.orderBy("i").collect()] == ["tag_0", "tag_1", "tag_0"]


def test_metadata_edges(spark):
    post = spark.createDataFrame([("h", "a", "f1"), ("h", "b", "f2"), ("r", "x", "f1")], "tag_key string, tag_value string, location string")
    assert metadata.lookup(post, {}).count() == 0
    assert [r.location for r in metadata.lookup(post, {"h": "a", "r": "x"}).collect()] == ["f1"]
    assert metadata.without_location(post, "f1").count() == 1
    with pytest.raises(ValidationError):
        metadata.overlapping(post, 2, 1)
    size = metadata.BloomSize(1000)
    assert size.bits == 9586 and size.hashes == 7 and size.expected_rate(500) < 0.01


def test_sketch_costs():
    s = stages.Sketch((stages.Stage("scan"), stages.Stage("aggregate"), stages.Stage("filter", True, 0.1), stages.Stage("filter", False, 0.5)), 1000)
    o = s.optimized()
    assert [x.kind for x in o.stages] == ["scan", "filter", "filter", "aggregate"] and o.stages[1].on_tag and o.cost() < s.cost()
    kept = stages.Sketch((stages.Stage("scan"), stages.Stage("limit", limit=5), stages.Stage("filter", False, 0.5)), 1000)
    assert kept.optimized() == kept


@pytest.mark.parametrize("bad", ["", " ", ".", "..", "a/b", "a\\b", "a\0b", None, 5])
def test_unsafe_names(bad):
    with pytest.raises(ValidationError):
        safe_name(bad)


def test_database(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db", now=lambda: 1_700_000_000.0) as db:
        assert db.query("SELECT count(v) FROM cpu") == [{"value": 0}]
        assert db.write_many("cpu", [{"tags": {"host": h}, "fields": {"v": v}, "timestamp": t} for h, v, t in (("a", 1, 0), ("a", 2.5, 86400), ("b", 4, 172800))]) == 3
        db.write("cpu", {}, {"v": 8, "note": "x"})
        assert db.query("SELECT sum(v) FROM cpu GROUP BY host") == [{"value": 8.0}, {"host": "a", "value": 3.5}, {"host": "b", "value": 4.0}]
        with pytest.raises(ValidationError):
            db.write_many("cpu", [{"tags": {}, "fields": {"v": 1}}, {"tags": {}, "fields": {}}])
        assert db.query("SELECT count(v) FROM cpu") == [{"value": 4}]
        assert db.measurements() == ["cpu"]
        assert [tuple(r) for r in db.store.field_keys("cpu").collect()] == [("note", "STRING"), ("v", "BIGINT"), ("v", "DECIMAL")]
        assert [r.key for r in db.store.tag_keys("cpu").collect()] == ["host"]
        assert db.store.health()["healthy"]
        db.store.compact("cpu", "19700101")
        assert db.store.drop_expired(now=86400 * 40, days=39) == 1
        assert db.query("SELECT count(v) FROM cpu") == [{"value": 3}]
    with pytest.raises(ValidationError):
        db.write("cpu", {}, {"v": 1})
