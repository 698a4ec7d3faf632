import pytest

from tidegauge.database import Database
from tidegauge.errors import QueryError
from tidegauge.functions.aggregates import operation_stats
from tidegauge.server import wire
from tidegauge.server.service import Client, Server

V = wire.VERSION


def test_frames_in_pieces():
    data = wire.frame(b"one") + wire.frame(b"") + wire.frame("zwei ü".encode())
    d = wire.Deframer()
    assert [p for i in range(len(data)) for p in d.feed(data[i : i + 1])] == [b"one", b"", "zwei ü".encode()]
    with pytest.raises(wire.WireError):
        wire.Deframer().feed(b"\xff\xff\xff\xff")


def test_answers():
    def fail(_):
        raise RuntimeError("secret")

    def bad(_):
        raise QueryError("unknown")

    ask = lambda line, q=lambda _: [{"host": "a", "value": 1.0}], w=lambda p: None: wire.answer(line, w, q)
    assert ask(f"{V} PING").text() == f"{V} OK"
    assert ask(f"{V} QUERY SELECT sum(v) FROM m").body == ("host=a value=1.0",)
    assert ask("nonsense").code == 400 and ask(f"{V} DROP x").code == 404
    assert ask(f"{V} QUERY hello").code == 422 and ask(f"{V} QUERY SELECT x FROM y", bad).code == 422
    assert ask(f"{V} WRITE m").code == 400
    assert ask(f"{V} QUERY SELECT x FROM y", fail).text() == f"{V} ERROR 500\ninternal error"
    assert wire.parse_response(f"{V} ERROR 404\nx") == wire.Response(False, 404, ("x",))
    assert wire.parse_write("m h=a v=1,w=1.5,x=y 10.25") == {"measurement": "m", "tags": {"h": "a"}, "fields": {"v": 1, "w": 1.5, "x": "y"}, "timestamp": 10.25}
    assert wire.table([]) == "(no results)" and wire.table([{"a": 1, "value": 2}]).splitlines()[0] == "a  value"


def test_values_with_marks_come_back(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db") as db, Server(db) as server:
        c = Client(*server.address)
        odd = "a b=c,d\\e\nf"
        c.write("cpu", {"host": odd}, {"v": 1}, 1.0)
        assert c.query("SELECT sum(v) FROM cpu GROUP BY host") == [{"host": odd, "value": 1.0}]
        c.close()


def test_command(spark, tmp_path, capsys):
    import threading

    from tidegauge.server.__main__ import main

    stop = threading.Event()
    stop.set()
    main([f"file://{tmp_path}/db", "--port", "0"], stop, spark)
    assert "listening on 127.0.0.1:" in capsys.readouterr().out


def test_metrics_are_bounded():
    from tidegauge.server.service import Metrics

    m = Metrics(keep=3)
    for i in range(10):
        m.record("PING", float(i))
    assert [x for x, _ in m._seen["PING"]] == [7.0, 8.0, 9.0]


def test_loopback(spark, tmp_path):
    with Database(spark, f"file://{tmp_path}/db") as db, Server(db) as server:
        c = Client(*server.address)
        assert c.ping()
        for host, region, v, t in (("a", "us", 10, 1.25), ("a", "us", 30, 2.5), ("b", "eu", 60, 3.0)):
            c.write("cpu", {"host": host, "region": region}, {"v": v}, t)
        c.write("cpu", {}, {"v": 100}, 4.0)
        assert c.query("SELECT mean(v) FROM cpu GROUP BY host") == [{"value": 100.0}, {"host": "a", "value": 20.0}, {"host": "b", "value": 60.0}]
        with pytest.raises(wire.WireError) as e:
            c.query("SELECT mean(v) FROM")
        assert e.value.code == 422
        c.close()
        stats = {r.operation: r.n for r in operation_stats(server.metrics.frame(spark), "operation").collect()}
        assert stats["WRITE"] == 4 and stats["QUERY"] == 2
