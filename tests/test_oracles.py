"""Every registered query of the time-series part against its SQL in DuckDB."""

import duckdb
import pytest

from tidegauge.queries import ORACLES, QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "~"
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = [sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]


def test_rejects_of_larger_ids(spark, tmp_path):
    """a bad line is told by the whole of it; the id 112345 makes one that ends like a bad time."""
    con = duckdb.connect()
    con.execute(f"copy (select * replace (event_id + 112000 as event_id) from '{DATA}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = QUERIES["line_protocol_rejects"](spark, str(tmp_path)).collect()
    assert con.execute("select count(*) from events where event_id = 112345").fetchone() == (1,)
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["line_protocol_rejects"]).fetchall())


def test_bloom_has_no_false_negatives(spark, duck):
    found = {r.location for r in QUERIES["bloom_candidates"](spark, DATA).collect()}
    assert {d for (d,) in duck.execute("select distinct strftime(ts, '%Y%m%d') from events where user_id = 7").fetchall()} <= found


def test_xor_of_equal_neighbours_is_zero(spark):
    from tidegauge.operators.codecs import xor_encode

    df = spark.createDataFrame([("a", 1, 2.5), ("a", 2, 2.5), ("a", 3, -0.5)], "s string, t long, v double")
    got = [r.xor for r in xor_encode(df, "v", ("t",), "s").orderBy("t").collect()]
    assert got[1] == 0 and got[0] != 0 and got[2] != 0
