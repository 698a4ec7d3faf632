import json

import pytest
from pyspark.sql import functions as F

from tidegauge.errors import ParseError, ValidationError
from tidegauge.operators import advice
from tidegauge.sources import json_points, line_protocol
from tidegauge.sources.store import PointStore, StoreConfig
from tidegauge.streaming import windows


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("cpu,host=a v=1.5,n=42i,s=\"x y\",b=t 1609459200", {"measurement": "cpu", "tags": {"host": "a"}, "fields": {"v": 1.5, "n": 42, "s": "x y", "b": True}, "timestamp": 1609459200.0}),
        ("cpu v=1 1609459200000", {"measurement": "cpu", "tags": {}, "fields": {"v": 1.0}, "timestamp": 1609459200.0}),
        (r'm,p=/a\,b\=c\ d s="q\"\\,=" 1609459200000000000', {"measurement": "m", "tags": {"p": "/a,b=c d"}, "fields": {"s": 'q"\\,='}, "timestamp": 1609459200.0}),
        ("m v=1", {"measurement": "m", "tags": {}, "fields": {"v": 1.0}, "timestamp": None}),
    ],
)
def test_lines(line, want):
    assert line_protocol.parse_line(line) == want


@pytest.mark.parametrize("bad", ["m", "m v", "m v=", "m, v=1", "m,t= v=1", "_m v=1", "m v=1x", "m v=12ii", "m v=1 123", "m v=1 -609459200", "m v=99999999999999999999i", "m a=1 2 3 4"])
def test_bad_lines(bad):
    with pytest.raises(ParseError):
        line_protocol.parse_line(bad)


def test_future_time():
    with pytest.raises(ParseError):
        line_protocol.parse_line("m v=1 1609459200", now=0)


def test_batch_keeps_good_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ("m v=1", "bad", "m,h=a v=2i 1609459200", "", None, "# note", "m v=oops", 'm s="t"')], "value string")
    got = line_protocol.read(lines)
    assert got.where("error is null").count() == 3 and got.where("error is not null").count() == 2
    assert got.where("measurement is not null").agg(F.sum(F.try_variant_get("fields", "$.v", "double"))).collect()[0][0] == 3.0


def test_json(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"measurement":"m","timestamp":1,"tags":{"h":"a"},"fields":{"v":1,"w":NaN}}\n{broken\n')
    rows = json_points.read(spark, str(tmp_path)).collect()
    assert sum(r._corrupt is not None for r in rows) == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t/p.jsonl").write_text(json.dumps({"measurement": "m", "timestamp": 1, "tags": {}, "fields": json_points.typed_fields({"v": 2, "b": True})}))
    assert json_points.read_typed(spark, str(tmp_path / "t")).select(F.try_variant_get("fields", "$.v", "long")).collect()[0][0] == 2


def test_batches():
    points = [{"measurement": "m", "timestamp": 1.0, "tags": {"h": "a"}, "fields": {"v": 1, "f": 1.0, "s": "x", "b": False}}]
    text = json_points.dump_batch(points, 0.0)
    assert json_points.load_batch(text) == points
    with pytest.raises(ValidationError):
        json_points.load_batch(text.replace('"value": 1,', '"value": 2,'))
    with pytest.raises(ValidationError):
        json_points.dump_batch([{"measurement": "m", "timestamp": -1, "tags": {}, "fields": {"v": 1}}], 0.0)


def test_advice():
    assert advice.batch_size(100, 2000) == 200 and advice.batch_size(0, 5) == 1
    assert advice.batch_size(10_000, 1e9) == advice.BATCH_BYTES // advice.POINT_BYTES
    assert advice.partition_interval(0.1, 200, 365) == "1M" and advice.partition_interval(1000, 24, 30) == "1h"
    assert advice.partition_interval(20, 24, 90) == "1d" and advice.partition_interval(0.1, 200, 5) == "1d"
    assert advice.partition_interval(1000, 24, 30, executors=50) == "1d"
    assert advice.partition_count(31, "1M") == 2
    assert advice.speedup(0.5) == 2 and advice.speedup(0.5, 2) == pytest.approx(4 / 3)


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{i}:30", float(i)) for i in range(6)] + [("a", "2024-01-01 00:01:10", float("nan"))]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "ts", "2 minutes", "v", "sum", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r.start.minute, r.value, r["count"]) for r in spark.table("w").collect())
    assert got == [(0, 1.0, 3), (2, 5.0, 2), (4, 9.0, 2)]
    seen = []
    windows.flush_to(stream, lambda b: seen.append(b.count()), f"{tmp_path}/ck").awaitTermination(60)
    assert sum(seen) == 7


def test_stream_rates_go_on_across_batches(spark, tmp_path):
    rows = [("a", 0.0, 0.0), ("a", 10.0, 30.0), ("b", 0.0, 90.0)], [("a", 30.0, 90.0), ("b", 10.0, 100.0), ("b", 20.0, 10.0)]
    schema = "k string, timestamp double, value double"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = windows.rate(stream, "k").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("a", 10.0, 3.0), ("a", 30.0, 3.0), ("b", 10.0, 1.0), ("b", 20.0, 1.0)]


def test_snapshots(spark, tmp_path):
    from tidegauge.sources.snapshots import Snapshots

    s = Snapshots(spark, f"file://{tmp_path}/meta")
    assert s.load("postings") is None
    table = spark.createDataFrame([("h", "a", "f1")], "k string, v string, location string")
    assert s.save("postings", table) == 1
    s.append("postings", spark.createDataFrame([("h", "b", "f2"), ("h", "a", "f1")], table.schema))
    assert s.load("postings").count() == 2 and s.load("postings", 1).count() == 1
    assert s.compact("postings") == 2 and s.load("postings").count() == 2 and s.load("postings", 1) is None


def test_batch_status(spark, tmp_path):
    from tidegauge.sources.store import PointStore, StoreConfig, from_rows

    good = {"measurement": "m", "timestamp": 1, "tags": {}, "fields": {"v": 1}}
    bad = [{**good, "measurement": "../x"}, {**good, "timestamp": -1}, {**good, "fields": {}}]
    store = PointStore(spark, StoreConfig(f"file://{tmp_path}/s"))
    assert store.write_batch(from_rows(spark, [good, *bad])) == ("failure", 0, 3)
    assert store.write_batch(from_rows(spark, [good, *bad]), atomic=False) == ("partial", 1, 3)
    assert store.write_batch(from_rows(spark, [good])) == ("success", 1, 0)
    assert sorted(r.reason for r in store.write(from_rows(spark, bad)).collect()) == ["fields", "measurement", "timestamp"]
    assert store.points().count() == 2
    with pytest.raises(ValidationError):
        StoreConfig("x", "1w")


def test_workload(spark, tmp_path):
    from tidegauge.operators import codecs
    from tidegauge.workload import Timing, compare, points

    w = points(spark, 1000)
    assert w.df.exceptAll(points(spark, 1000).df).count() == 0
    assert w.df.selectExpr("count(distinct host)", "count(distinct region)").collect()[0] == (4, 3)
    same, times = compare("x", w.df.where("host = 'host1'"), w.where(F.col("host") == "host1").df, 1)
    assert same and times > 0
    assert Timing("x", (1.0, 2.0, 3.0)).p95 == pytest.approx(2.9)
    found = {(r.measure, r.name): r.value for r in codecs.potential(w.df, "timestamp", ("host",), ("value",)).collect()}
    assert found == {("cardinality", "host"): "4", ("regular", "timestamp"): "true", ("type", "value"): "double"}
    sizes = codecs.parquet_sizes(w.df, f"file://{tmp_path}/c", ("none", "zstd"))
    assert 0 < sizes["zstd"] < sizes["none"]


def test_line_source(spark, tmp_path):
    from tidegauge.sources import line_source

    (tmp_path / "a.txt").write_text('m,h=a v=1,s="x" 1609459200\nbad\n# note\n\nm v=2i')
    (tmp_path / "b.txt").write_text("n b=t\n")
    line_source.register(spark)
    df = spark.read.format("lines").load(f"{tmp_path}")
    assert df.where("error is null").count() == 3 and df.where("error is not null").count() == 1
    assert df.agg(F.sum(F.col("numbers")["v"])).collect()[0][0] == 3.0
    assert df.where("measurement = 'n'").select(F.col("texts")["b"]).collect()[0][0] == "true"


def test_buffer_writes_by_size_and_age(spark, tmp_path):
    from tidegauge.sources.store import WriteBuffer

    now = [0.0]
    store = PointStore(spark, StoreConfig(f"file://{tmp_path}/s"))
    buffer = WriteBuffer(store, most=3, seconds=5, clock=lambda: now[0])
    point = lambda i: {"measurement": "m", "timestamp": i, "tags": {}, "fields": {"v": i}}
    assert not buffer.add(point(1), point(2)) and buffer.add(point(3)) and len(buffer) == 0
    assert not buffer.add(point(4))
    now[0] = 6.0
    assert buffer.flush_if_due() and not buffer.flush_if_due() and store.points().count() == 4


def test_retries_wait_longer(spark, tmp_path, monkeypatch):
    store = PointStore(spark, StoreConfig(f"file://{tmp_path}/s"))
    waits, calls = [], []

    def write_batch(points, atomic, now):
        calls.append(1)
        if len(calls) < 4:
            raise OSError("away")
        return "success", 1, 0

    monkeypatch.setattr(store, "write_batch", write_batch)
    assert store.write_with_retry(None, 3, waits.append) == ("success", 1, 0) and waits == [2, 4, 8]
    calls.clear()
    with pytest.raises(OSError):
        store.write_with_retry(None, 2, waits.append)


def test_a_broken_compaction_is_ended(spark, tmp_path, monkeypatch):
    from tidegauge.sources.store import from_rows

    store = PointStore(spark, StoreConfig(f"file://{tmp_path}/s"))
    store.write(from_rows(spark, [{"measurement": "m", "timestamp": i, "fields": {"v": i}} for i in range(20)]))
    with monkeypatch.context() as m:
        m.setattr(PointStore, "_put_in_place", lambda self, at: (_ for _ in ()).throw(OSError("broke off")))
        with pytest.raises(OSError):
            store.compact("m", "19700101")
    import shutil

    shutil.rmtree(tmp_path / "s/points/measurement=m/part=19700101")  # it broke off between deleting and moving
    assert store.recover() == 1 and store.points().count() == 20 and store.recover() == 0


def test_workload_reports(spark):
    from tidegauge import workload

    seen = []
    assert set(workload.write_sweep(list(range(10)), (1, 5), seen.append)) == {1, 5} and [len(x) for x in seen] == [1] * 10 + [5, 5]
    report = workload.concurrent_writes(lambda w, n: 1 / (w + n), 3, 4)
    assert report["writes"] == 11 and report["failures"] == 1
    assert {r.query: r.rows_agree for r in workload.suite(workload.points(spark, 200), "host", 1).collect()} == dict.fromkeys(("point", "range", "aggregation", "group_by"), True)
    assert workload.markdown(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")) == "| n | s |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"


def test_packed_series_refuse_what_they_cannot_hold(spark):
    from tidegauge.errors import ParseError
    from tidegauge.operators import codecs

    with pytest.raises(ValidationError):
        codecs.pack_series(spark.range(1).selectExpr("1.5D v", "id"), "v", ("id",))
    for raw in (b"\x80", b"\x80" * 11 + b"\x01"):
        with pytest.raises(ParseError):
            codecs._unvarints(raw)


def test_plain_lines_stay_out_of_python(spark):
    """Every line means the same, whichever way it is parsed."""
    import json
    import re

    from tidegauge.errors import ParseError
    from tidegauge.sources import line_protocol

    lines = ["cpu,host=a v=1,w=2i,s=\"x\",b=t 1700000000", "cpu v=1.50 1700000000000", "cpu v=1.5,v=2", "cpu,h=a,h=b v=1i", " cpu  v=3", "cpu,h=a\\ b v=\"a b\"", "bad", "cpu v=T,w=false,x=TRUE", "cpu v=-0.25,w=-7i", "cpu v=1e5", "cpu v=0.1 9999999999999", "cpu v=\"\" 1700000000", "cpu v=00", "cpu,h= v=1", "1x v=99999999999999999999i"]
    rows = {r.line: r for r in line_protocol.read(spark.createDataFrame([(x,) for x in lines], "value string"), now=1.8e9).selectExpr("*", "to_json(fields) f").collect()}
    for x in lines:
        r = rows[x]
        try:
            want = line_protocol.parse_line(x, 1.8e9)
        except ParseError as e:
            assert r.error == str(e)
        else:
            assert (r.measurement, r.timestamp, r.tags, json.loads(r.f)) == (want["measurement"], want["timestamp"], want["tags"], want["fields"])
    assert sum(bool(re.search(line_protocol.PLAIN, x)) for x in lines) >= 6
