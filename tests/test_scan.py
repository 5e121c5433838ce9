"""Scans of many files: missing years, overlaps, widened files; periods and gaps."""

from __future__ import annotations

import datetime as dt
import warnings

import pytest

from exceedra.sources import scan

D = dt.date


def put(spark, root, name, rows, schema="cell_id int, d date, tx double"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{root}/{name}")


@pytest.mark.parametrize(("name", "years"), [("Tx_1990.parquet", (1990,)), ("Tx1990", (1990,)), ("a_1990to1992", (1990, 1991, 1992)), ("a-1990-1991_x", (1990, 1991)), ("grid_19900101", ()), ("none", ())])
def test_years_in(name, years):
    assert scan.years_in(name) == years


def test_files(spark, tmp_path):
    put(spark, tmp_path, "Tx_1990", [(1, D(1990, 5, 1), 1.0), (2, D(1990, 5, 1), 2.0)])
    put(spark, tmp_path, "Tx_1991", [(1, D(1991, 5, 1), 3.0), (1, D(1991, 5, 2), float("nan"))])
    put(spark, tmp_path, "Tx_1991_b", [(1, D(1991, 5, 1), 30.0, 0.5), (1, D(1991, 5, 2), None, 0.6), (9, D(1991, 5, 3), 4.0, None)], "cell_id int, d date, tx double, rr double")
    put(spark, tmp_path, "Tx_1993", [(1, D(1993, 5, 1), 9.0)])
    with pytest.warns(UserWarning, match="1992"):
        found = scan.discover(spark, f"file://{tmp_path}", "Tx", 1990, 1992)
    assert found.missing == (1992,) and len(found.files) == 3
    got = {(r.cell_id, r.d): (r.tx, r.rr) for r in scan.scan(spark, found, ["cell_id", "d"], ["tx", "rr"]).collect()}
    assert got == {(1, D(1990, 5, 1)): (1.0, None), (2, D(1990, 5, 1)): (2.0, None), (1, D(1991, 5, 1)): (30.0, 0.5), (1, D(1991, 5, 2)): (None, 0.6), (9, D(1991, 5, 3)): (4.0, None)}
    assert scan.discover(spark, f"file://{tmp_path}/Tx_199[13]", "Tx", 1990, 1992).missing == ()
    assert len(scan.discover(spark, f"file://{tmp_path}/Tx_199[13]", "Tx", 1990, 1992).files) == 2
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert len(scan.discover(spark, f"file://{tmp_path}", "Tx", 1991, 1991, seasonal=True).files) == 3
    with pytest.raises(KeyError):
        scan.scan(spark, found, ["cell_id", "d"], ["wind"])
    with pytest.raises(FileNotFoundError), pytest.warns(UserWarning):
        scan.scan(spark, scan.discover(spark, f"file://{tmp_path}", "Zz", 1990, 1990), ["cell_id", "d"], ["tx"])


def test_files_without_years_may_overlap(spark, tmp_path):
    put(spark, tmp_path, "Tx_a", [(1, D(1990, 5, 1), 1.0), (1, D(1990, 5, 2), 2.0)])
    put(spark, tmp_path, "Tx_b", [(1, D(1990, 5, 2), 5.0), (None, D(1990, 5, 2), 6.0)])
    found = scan.discover(spark, f"file://{tmp_path}/Tx_*", "Tx", 1990, 1990)
    got = {(r.cell_id, r.d.day): r.tx for r in scan.scan(spark, found, ["cell_id", "d"], ["tx"]).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 5.0, (None, 2): 6.0}


def test_one_year_needs_no_shuffle(spark, tmp_path):
    put(spark, tmp_path, "Tx_1990", [(1, D(1990, 5, 1), 1.0)])
    put(spark, tmp_path, "Tx_1991", [(1, D(1991, 5, 1), 1.0)])
    df = scan.scan(spark, scan.discover(spark, f"file://{tmp_path}", "Tx", 1990, 1991), ["cell_id", "d"], ["tx"])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 2


def test_extract(spark):
    days = [(D(1990, 1, 1) + dt.timedelta(days=i),) for i in range(0, 1400)]
    df = spark.createDataFrame(days, "d date")
    ends = lambda x: (min(r.d for r in x.collect()), max(r.d for r in x.collect()))
    assert ends(scan.extract(df, "seasonal", 1991, 1992)) == (D(1990, 12, 1), D(1992, 11, 30))
    assert ends(scan.extract(df, "seasonal")) == (D(1990, 3, 1), D(1993, 10, 31))
    assert {r.d.month for r in scan.extract(df, "JJA", 1991, 1991).collect()} == {6, 7, 8}
    assert ends(scan.extract(df, "annual", 1991, 1991)) == (D(1991, 1, 1), D(1991, 12, 31))
    assert scan.extract(df.limit(0), "seasonal").count() == 0


def test_choose(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 4.0)], "p int, em double, em_gr double, em_avg_gr double, ef_agr double")
    assert scan.choose(df, ["p"], "cell").columns == ["p", "em"]
    assert scan.choose(df, ["p"], "gr").columns == ["p", "em_gr", "em_avg_gr"]
    assert scan.choose(df, ["p"], metrics=["ef"]).columns == ["p", "ef_agr"]


def test_station(spark, tmp_path):
    for name in ("Tmax_Graz_19000101.csv", "Tmax_Graz_18770101_x.csv"):
        (tmp_path / name).write_text("station,tmax,time\n" + "".join(f"7,{v},{d} 00:00:00+00:00\n" for d, v in (("1877-05-01", 10), ("1878-05-01", 20), ("1879-04-30", 5), ("1879-05-02", ""))))
    path = scan.station_file(spark, f"file://{tmp_path}", "Graz", "Tmax")
    assert path.endswith("18770101_x.csv")
    got = {r.d: r.v for r in scan.station_series(spark, path, "tmax", 1879, 1879).collect()}
    assert len(got) == 122 and got[D(1879, 5, 1)] == 15.0 and got[D(1879, 4, 30)] == 5.0 and got[D(1879, 5, 2)] is None
    assert set(scan.station_series(spark, path, "tmax", 1879, 1879, "JJA").collect()) == set()
    with pytest.raises(FileNotFoundError):
        scan.station_file(spark, f"file://{tmp_path}", "Wien", "Tmax")


def test_chosen_variable(spark):
    raw = spark.createDataFrame([(1, dt.datetime(2000, 1, 1), 280, 5.0)], "cell_id int, valid_time timestamp, t2m int, u10 double")
    assert scan.chosen_variable(raw, {"valid_time": "ts", "t2m": "T", "nothing": "x"}, "T").collect()[0].asDict() == {"cell_id": 1, "ts": dt.datetime(2000, 1, 1), "v": 280.0}
