"""Hand-derived values and properties of the operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exceedra.functions import columns
from exceedra.operators import daily, decadal, periods, prepare, regions
from exceedra.sources import sinks, tables
from exceedra.streaming import hourly as streaming

DAY = dt.date(2000, 1, 1)


def series(spark, values, key="cell_id", name="dtec"):
    rows = [(0, DAY + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{key} int, d date, {name} double")


@pytest.mark.parametrize(("flags", "want"), [([0, 1, 1, 0, 1, 1, 1, 0, 1], [0, 1, 0, 0, 0, 1, 0, 0, 1]), ([1, None, 1], [1, 0, 1])])
def test_event_marks(spark, flags, want):
    df = daily.mark_events(series(spark, flags).withColumn("dtec", F.col("dtec").cast("int")), "cell_id", "dtec", "e")
    assert [r["e"] for r in df.orderBy("d").collect()] == want


def test_event_marks_random(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for c in range(20):
        flags = rng.choice([0, 1, -1], 60, p=[0.4, 0.5, 0.1])
        marks, i = [0] * 60, 0
        while i < 60:
            if flags[i] == 1:
                j = i
                while j + 1 < 60 and flags[j + 1] == 1:
                    j += 1
                marks[(i + j) // 2] = 1
                i = j
            i += 1
        want[c] = marks
        rows += [(c, DAY + dt.timedelta(days=k), None if f < 0 else int(f)) for k, f in enumerate(flags)]
    got = daily.mark_events(spark.createDataFrame(rows, "cell_id int, d date, dtec int"), "cell_id", "dtec", "e").orderBy("cell_id", "d").collect()
    assert [r["e"] for r in got] == [m for c in range(20) for m in want[c]]


def test_exceedance(spark):
    df = spark.createDataFrame([(27.0,), (28.0,), (30.0,), (None,)], "v double")
    high = [r[0] for r in df.select(columns.exceedance(F.col("v"), F.lit(28.0))).collect()]
    low = [r[0] for r in df.select(columns.exceedance(F.col("v"), F.lit(28.0), True)).collect()]
    assert high == [0, 0, 2, None] and low == [1, 0, 0, None]


@pytest.mark.parametrize(("least", "want"), [(1.0, (5, 1, 2.8, 14, 4)), (6.0, (5, 0, 0, 0, 0))])
def test_region_day(spark, least, want):
    cells = spark.createDataFrame([(0, 0, 0.0, 2.0), (1, 0, 0.0, 3.0)], "cell_id int, gr_id int, thr double, area double")
    x = daily.cell_exceedance(spark.createDataFrame([(0, DAY, 1.0), (1, DAY, 4.0)], "cell_id int, d date, v double"), cells)
    r = daily.region_days(x, cells, least).first()
    assert (r.dtea_gr, r.dtec_gr, r.dtem_gr, r.dtema_gr, r.dtem_max_gr) == pytest.approx(want)


def test_decade_and_spread(spark):
    df = spark.createDataFrame([(0, dt.date(1990 + i, 1, 1), float(i + 1)) for i in range(12)], "gr_id int, p date, x double")
    got = [r.x for r in decadal.decadal_means(df, "gr_id", ["x"]).orderBy("p").collect()]
    assert got == [None] * 5 + [5.5, 6.5, 7.5] + [None] * 4
    row = decadal.spreads(df, "gr_id", "x").orderBy("p").collect()[5]
    assert row.supp == pytest.approx(math.sqrt(41.25 / 5)) and row.slow == pytest.approx(math.sqrt(41.25 / 5))


def test_geometric_mean(spark):
    df = spark.createDataFrame([(2.0,), (0.0,), (None,), (8.0,)], "x double")
    assert df.agg(columns.geometric_mean(F.col("x"))).first()[0] == pytest.approx(4.0)


def test_adjustments(spark):
    df = spark.createDataFrame([(180.0, 200.0, 1.0, 3.0, 5.0, 6.0)], "doy_first double, doy_last double, aep double, h_rise_avg double, h_set_avg double, h_avg double")
    r = decadal.adjust_hours(decadal.adjust_days(df)).first()
    assert (r.doy_first, r.doy_last, r.h_rise_avg, r.h_set_avg) == pytest.approx((175.25, 204.75, 2.25, 3.75))


def test_weighted_percentiles(spark):
    rows = [(i, DAY, float(i), w) for i, w in zip(range(1, 6), (0.03, 0.05, 0.42, 0.44, 0.06), strict=True)]
    r = regions.weighted_percentiles(spark.createDataFrame(rows, "gr_id int, p date, em double, a double"), "em").first()
    assert (r.p05, r.p95) == (1.0, 5.0)


def test_areas_and_extent(spark):
    one = spark.range(1)
    assert one.select(columns.area_latlon(F.lit(47.0), 0.25, 0.25)).first()[0] == pytest.approx(5.273254340)
    r = regions.with_extent(one.select(F.lit(47.0).alias("yc")), 2.0).first()
    assert (r.x_off, r.area_frac) == pytest.approx((1.5, 1.022997540))
    full = one.select(F.lit(494.572468460 * 3).alias("gr_area"))
    assert regions.degrees_of_freedom(full, 2.0).first()[0] == pytest.approx(3.0)


@pytest.mark.parametrize(("period", "want"), [("seasonal", "1994-12-01"), ("DJF", "1994-12-01"), ("EWS", "1994-11-01"), ("WAS", "1994-04-01"), ("monthly", "1995-01-01"), ("annual", "1995-01-01")])
def test_period_labels(spark, period, want):
    assert str(spark.range(1).select(columns.period_label(F.lit("1995-01-15").cast("date"), period)).first()[0]) == want


def test_first_of_tied_hours(spark):
    rows = [(0, dt.datetime(2024, 1, 1, h), v) for h, v in ((1, 2.0), (3, 5.0), (7, 5.0))]
    cells = spark.createDataFrame([(0, 0.0, 1.0)], "cell_id int, thr double, area double")
    r = daily.hourly_days(spark.createDataFrame(rows, "cell_id int, ts timestamp_ntz, v double"), cells).first()
    assert (r.t_hfirst, r.t_hmax, r.t_hlast, r.nhours) == (1, 3, 7, 3)


def test_utc_offset(spark):
    df = spark.createDataFrame([(15.0,), (22.5,), (37.5,), (-22.5,)], "lon double")
    assert [r[0] for r in df.select(prepare.utc_offset(F.col("lon"))).collect()] == [1, 2, 2, -2]


def test_unknown_period(spark):
    with pytest.raises(ValueError, match="unknown"):
        periods.labelled(series(spark, [1.0]), "XYZ")


def test_linear_fill(spark):
    df = periods.fill_linear(series(spark, [None, 1.0, None, None, 4.0, None], name="v"), "cell_id", "d", "v")
    assert [r.v for r in df.orderBy("d").collect()] == [None, 1.0, 2.0, 3.0, 4.0, None]


def test_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.345, None), (2, 2.5, 1.005)], "p int, a double, b double")
    sinks.save(df, str(tmp_path / "t"), 0)
    assert sorted(r.a for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2.0, 2.0]
    assert sinks.table_name("CTP", "Tx", "AUT", "WAS", "ERA5", 1961, 2020) == "CTP_Tx_AUT_WAS_ERA5_1961to2020"


def test_station_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,tmax\n2000-01-01T00:00:00+00:00,1.5\n2000-01-02T00:00:00+00:00,\n")
    rows = tables.station_csv(spark, str(tmp_path / "s.csv"), "tmax").orderBy("d").collect()
    assert [r.v for r in rows] == [1.5, None]


def test_config_checks(tmp_path):
    from exceedra.plans.config import RunConfig

    c = RunConfig.from_dict({"parameter": "Tx", "threshold": 99.0, "start": 1961, "end": 2020, "ref_period": "1961-1990", "no_such_key": 1})
    assert c.ref_period == (1961, 1990) and c.unknown == ("no_such_key",)
    with pytest.raises(ValueError, match="decimal"):
        RunConfig.from_dict({"parameter": "Tx", "threshold": 99.25})


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, dt.datetime(2024, 1, 1 + h // 24, h % 24), float(h)) for h in range(72)]
    df = spark.createDataFrame(rows, "cell_id int, ts timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.daily_maxima(stream).writeStream.outputMode("complete").format("memory").queryName("daymax").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.v for r in spark.sql("select v from daymax").collect()) == [23.0, 47.0, 71.0]


def test_region_and_window_with_a_cell_without_data(spark):
    """Cell 3 has no threshold: it counts for the size, adds no threshold, and a window of it alone has no days."""
    cells = spark.createDataFrame([(1, 7, 2.0, 10.0), (2, 7, 2.0, 20.0), (3, 7, 4.0, None)], "cell_id int, gr_id int, area double, thr double")
    size = daily.region_sizes(cells).first()
    assert size.gr_size == 8.0 and size.threshold_avg_gr == pytest.approx((2 * 10 + 2 * 20) / 8)
    links = spark.createDataFrame([(0, 1, 2.0, 1.0), (0, 3, 4.0, 1.0), (1, 3, 4.0, 1.0)], "gr_id int, cell_id int, area double, area_frac double")
    days = spark.createDataFrame([(1, "2000-01-01", 3.0), (1, "2000-01-02", 0.0), (2, "2000-01-01", 1.0), (3, "2000-01-01", None)], "cell_id int, d string, dtem double")
    got = regions.window_days(days, regions.valid_links(links, cells)).orderBy("gr_id", "d").collect()
    assert [(r.gr_id, r.d, r.dtec_gr, r.dtea_gr, r.dtem_gr) for r in got] == [(0, dt.date(2000, 1, 1), 1, 2.0, 3.0), (0, dt.date(2000, 1, 2), 0, 0.0, 0.0)]


def test_stations_long_and_wide(spark):
    long = spark.createDataFrame([(DAY, "a", 1.0), (DAY, "b", 2.0), (DAY + dt.timedelta(days=1), "a", 3.0)], "d date, id string, v double")
    wide = tables.wide_stations(long)
    assert wide.columns == ["d", "a", "b"]
    back = tables.long_stations(wide.withColumnRenamed("d", "ts")).filter("v is not null")
    assert {(r.ts, r.id, r.v) for r in back.collect()} == {tuple(r) for r in long.collect()}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(DAY, 1.04, 2.0), (DAY, 3.0, 4.0)], "p date, em_gr_agr double, ef_gr double")
    assert sinks.aggregate_columns(df).columns == ["p", "em_gr_agr"]
    sinks.export_means(df, "em_gr_agr", f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).collect()[0].em_gr_agr == "2.0"


def test_kelvin_and_percentile_thresholds(spark):
    cells = spark.createDataFrame([(1,)], "cell_id int")
    field = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), float(i)) for i in range(11)], "cell_id int, d date, v double")
    assert prepare.threshold_of(field, cells, "abs", 30.0, kelvin=True).first().thr == pytest.approx(303.15)
    assert prepare.threshold_of(field, cells, "perc", 90.0, "2000-01-01", "2000-01-11").first().thr == pytest.approx(9.0)
    with pytest.raises(ValueError):
        prepare.threshold_of(field, cells, "other", 1.0)


def test_measuring_day(spark):
    rows = spark.createDataFrame([(dt.datetime(2000, 1, 2, 3), 5.0), (dt.datetime(2000, 1, 2, 8), 0.5)], "ts timestamp, v double")
    assert [r.ts for r in prepare.wet(rows, 1.0, 7).collect()] == [dt.datetime(2000, 1, 1, 20)]


def test_centre_span():
    assert decadal.centre_span(1961, 1990, 1961, 2020) == ("1966-01-01", "1986-12-31")
    with pytest.raises(ValueError):
        decadal.centre_span(1951, 1990, 1961, 2020)


def test_station_union(spark):
    from exceedra.operators import stations

    a = spark.createDataFrame([(dt.date(y, 1, 1), float(y), 1.0) for y in (1918, 1920, 1921)], "p date, ef double, em double")
    b = spark.createDataFrame([(dt.date(1919, 1, 1), 7.0)], "p date, ef double")
    got = stations.station_union([("a", a, 1920), ("b", b, None)], ["ef", "em"])
    assert {(r.station, r.p.year, r.ef, r.em) for r in got.collect()} == {("a", 1920, 1920.0, 1.0), ("a", 1921, 1921.0, 1.0), ("b", 1919, 7.0, None)}
    with pytest.raises(KeyError):
        stations.station_union([("b", b, None)], ["em"])


def test_spans_with_gaps_and_overlaps(spark):
    from exceedra.operators import stations

    days = spark.createDataFrame([(1, DAY + dt.timedelta(days=i), float(i % 7)) for i in range(200)], "cell_id int, d date, v double")
    spans = [(DAY + dt.timedelta(days=a), DAY + dt.timedelta(days=b)) for a, b in ((0, 3), (2, 95), (90, 90), (150, 400), (20, 10))]
    df = stations.in_spans(days, spark.createDataFrame([(a, a, b) for a, b in spans], "p date, first date, last date"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((a, DAY + dt.timedelta(days=i)) for a, b in spans for i in range(200) if a <= DAY + dt.timedelta(days=i) <= b)
    assert sorted((r.p, r.d) for r in df.collect()) == want


def test_relative_comparison(spark):
    from exceedra.operators import analysis

    a = spark.createDataFrame([(1, 1.04, 0.0), (2, 0.5, 7.0), (3, 1.0, None)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0, 0.0), (2, 0.5, 0.0), (3, 1.0, 2.0)], "k int, x double, y double")
    got = {r.metric: (r.gap, r.one_sided, r.within) for r in analysis.compare(a, b, ["k"], ["x", "y"], relative=0.05).collect()}
    assert got["x"] == (pytest.approx(0.04), 0, True) and got["y"] == (0.0, 1, False)


def test_fixed_extent_is_not_clamped(spark):
    cells = spark.createDataFrame([(i, 50.0, -20.0 + 2 * i, 1.0 if i == 20 else None) for i in range(40)], "cell_id int, y double, x double, mask_frac double")
    got = [r.x for r in prepare.reduced(cells, cells, 2.0, "EUR").orderBy("x").collect()]
    assert got[0] == -14.0 and got[-1] == 42.0
    assert [r.x for r in prepare.reduced(cells, cells, 2.0, planar=True).orderBy("x").collect()] == [20.0]


def test_inner_lattice_without_room(spark):
    cells = spark.createDataFrame([(1, 50.0, 10.0), (2, 49.0, 11.0)], "cell_id int, y double, x double")
    assert regions.inner_lattice(cells, 0.5, 8.0).count() == 0
    got = regions.inner_lattice(cells, 0.5, 1.0, 0.0).collect()
    assert len(got) == 9 and got[0].yc == 50.0 and got[0].xc == 10.0


def test_coarse_blocks_trim_and_empty_blocks(spark):
    rows = [(iy, ix, 1.0 if ix < 2 else None, 2.0) for iy in range(3) for ix in range(5)]
    got = {(r.yb, r.xb): (r.mask_frac, r.gr_area) for r in regions.coarse_blocks(spark.createDataFrame(rows, "iy int, ix int, mask_frac double, area double"), 2).collect()}
    assert got == {(0, 0): (1.0, 8.0), (0, 1): (0.0, None)}


def test_land_of_unknown_cells(spark):
    cells = spark.createDataFrame([(1, 190.0), (2, 180.0), (3, -10.0)], "cell_id int, x double")
    land = spark.createDataFrame([(1, 0.5), (9, 1.0)], "cell_id int, lsm double")
    assert {(r.cell_id, r.x, r.lsm) for r in prepare.with_land(cells, land).collect()} == {(1, -170.0, 0.5), (2, 180.0, None), (3, -10.0, None)}
