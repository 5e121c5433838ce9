"""Stored levels: partitions, precedence, upserts, metadata, and a run from a configuration."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from exceedra.operators import periods
from exceedra.plans import run as runs
from exceedra.plans.config import RunConfig
from exceedra.plans.registry import METRICS, described, described_by, metric_of
from exceedra.sources.store import LevelStore, merge_left

SCHEMA = "gr_id int, p date, em_gr double"


def rows(spark, years, value, key=1):
    return spark.createDataFrame([(key, dt.date(y, 1, 1), float(value)) for y in years], SCHEMA)


def years_of(df):
    return {(r.gr_id, r.p.year): r.em_gr for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return LevelStore(spark, f"file://{tmp_path}/out")


def test_spans(spark, store):
    store.save(rows(spark, range(1990, 1996), 1), "CTP", "a", 1990, 1995)
    store.save(rows(spark, range(1994, 2000), 2), "CTP", "a", 1994, 1999)
    store.save(rows(spark, range(2000, 2005), 3), "CTP", "a", 2000, 2004)
    store.save(rows(spark, range(1990, 2005), 9), "CTP", "b", 1990, 2004)
    store.save(rows(spark, range(1990, 2005), 9), "CTP", "a", 1990, 2004, reference=True)
    assert store.spans("CTP", "a") == ["1990to1995", "1994to1999", "2000to2004", "ref"]
    want = {(1, y): 1.0 if y < 1994 else 2.0 for y in range(1990, 2000)}
    assert years_of(store.load("CTP", "a", 1992, 1998, ["gr_id"])) == want
    assert set(years_of(store.load("CTP", "a", 2003, 2010, ["gr_id"])).values()) == {3.0}
    store.save(rows(spark, range(1990, 1996), 5), "CTP", "a", 1990, 1995)  # replaces that span alone
    assert years_of(store.load("CTP", "a", 1990, 1991, ["gr_id"]))[1, 1990] == 5.0
    assert years_of(store.load("CTP", "b", 1990, 2004, ["gr_id"])) == {(1, y): 9.0 for y in range(1990, 2005)}
    with pytest.raises(FileNotFoundError):
        store.load("CTP", "a", 1900, 1910, ["gr_id"])
    with pytest.raises(FileNotFoundError):
        store.load("DEC", "a", 1990, 1991, ["gr_id"])
    with pytest.raises(ValueError):
        store.save(rows(spark, [1990], 1), "XYZ", "a", 1990, 1990)


def test_pruning(spark, store):
    for y in (1990, 1991, 1992):
        store.save(rows(spark, [y], y), "CTP", "a", y, y)
    plan = store.read("CTP", "a", ["1991to1991"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "1991to1991" in plan


def test_winter_label_in_two_spans(spark, store):
    """The label of a winter lies in the year before its span begins; it is held once all the same."""
    winter = lambda y, v: spark.createDataFrame([(1, dt.date(y, 12, 1), v)], SCHEMA)
    store.save(winter(1994, 1.0), "CTP", "a", 1990, 1994)
    store.save(winter(1994, 2.0), "CTP", "a", 1995, 1999)
    got = store.load("CTP", "a", 1990, 1999, ["gr_id"]).collect()
    assert [(r.p.year, r.em_gr) for r in got] == [(1994, 2.0)]


def test_upsert(spark, store):
    store.upsert(rows(spark, (1990, 1991), 1), "DEC", "a", 1990, 1995, ["gr_id", "p"])
    new = rows(spark, (1991, 1992), 2).withColumn("ed_gr", F.lit(7.0))
    store.upsert(new, "DEC", "a", 1990, 1995, ["gr_id", "p"])
    got = {r.p.year: (r.em_gr, r.ed_gr) for r in store.load("DEC", "a", 1990, 1995, ["gr_id"]).collect()}
    assert got == {1990: (1.0, None), 1991: (2.0, 7.0), 1992: (2.0, 7.0)}


def test_merge(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, 5.0), (None, 3.0, 3.0)], "k int, x double, y double")
    b = spark.createDataFrame([(2, 8.0, "r"), (3, 9.0, "s"), (None, 7.0, "t")], "k int, x double, z string")
    got = {r.k: (r.x, r.y, r.z) for r in merge_left(a, b, ["k"]).collect()}
    assert got == {1: (1.0, None, None), 2: (8.0, 5.0, "r"), 3: (9.0, None, "s"), None: (3.0, 3.0, "t")}
    assert merge_left(a.limit(0), b, ["k"]).count() == 3


def test_load_or_build(spark, store):
    calls = []

    def build():
        calls.append(1)
        return rows(spark, [1990], len(calls))

    first = years_of(store.load_or_build("STATIC", "t", 1990, 1990, build))
    assert years_of(store.load_or_build("STATIC", "t", 1990, 1990, build)) == first and len(calls) == 1
    assert years_of(store.load_or_build("STATIC", "t", 1990, 1990, build, recalculate=True)) != first


def test_metadata(spark, store):
    df = rows(spark, [1990], 1).withColumns({"tex_gr": F.lit(1.0), "em_gr_af": F.lit(1.0), "note": F.lit("x")})
    store.save(described(df, "CTP", "K", "made by hand"), "CTP", "a", 1990, 1990)
    found = described_by(store.load("CTP", "a", 1990, 1990, ["gr_id"]))
    assert found.keys() == {"em_gr", "tex_gr", "em_gr_af"}
    assert found["em_gr"] == {"long_name": METRICS["EM"].meaning, "unit": "K d yr^-1", "metric_type": "compound", "level": "CTP", "scope": "GR", "history": "made by hand"}
    assert found["tex_gr"]["unit"] == "100 km^2 K d yr^-1" and found["em_gr_af"]["unit"] == "1"
    assert metric_of("tex")[0].name == "tEX" and metric_of("em_avg_md_gr")[0].name == "EM_avg_Md" and metric_of("emu") is None


def test_run(spark, store):
    """Days in two regions; the stored periods equal those of the chain, and a second run reads what is there."""
    days = [(c, dt.date(1990, 1, 1) + dt.timedelta(days=i), float((i * (c + 3)) % 17)) for c in range(4) for i in range(0, 3650)]
    field = spark.createDataFrame(days, "cell_id int, d date, v double")
    cells = spark.createDataFrame([(c, c // 2, 2.0) for c in range(4)], "cell_id int, gr_id int, area double")
    config = RunConfig.from_dict({"parameter": "Tx", "threshold": 12.0, "threshold_type": "abs", "start": 1990, "end": 1999, "ref_period": [1990, 1994], "cc_period": [1995, 1999], "decadal_window": (3, 1, 1), "min_exceedance_area": 3.0})
    runs.run(store, config, field, cells)
    ctp = store.load("CTP", "region-annual", 1990, 1999, ["gr_id"])
    want = {}
    for c, d, v in days:
        over = want.setdefault((c // 2, d), [0.0, 0.0])
        if v > 12.0:
            over[0] += 2.0
            over[1] += 2.0 * (v - 12.0)
    total = {}
    for (g, d), (area, ma) in want.items():
        total[g, d.year] = total.get((g, d.year), 0.0) + (ma / area if area >= 3.0 else 0.0)
    assert {(r.gr_id, r.p.year): r.em_gr for r in ctp.collect()} == pytest.approx(total)
    assert store.spans("AF", "region-annual") == ["1990to1999"]
    again = RunConfig.from_dict({"parameter": "Tx", "threshold": 12.0, "threshold_type": "abs", "start": 1990, "end": 1999, "ref_period": [1990, 1994], "cc_period": [1995, 1999], "decadal_window": (3, 1, 1), "decadal_only": True})
    runs.run(store, again)
    with pytest.raises(ValueError):
        runs.run(store, config)
    least = runs.exceedance_days(store.load("DBV", "region", 1990, 1999, ["gr_id"], "d"), 3.0)
    assert periods.region_periods(least, "annual").count() == 20


def test_masks_by_name(spark, store):
    from exceedra.sources.store import box_of, mask_name

    mask = spark.createDataFrame([(1, 1.0)], "cell_id int, mask_frac double")
    store.save(mask, "STATIC", mask_name("ERA5", region="EUR", altitude=1500), 1900, 1900)
    corners = box_of((47.0, 15.0), 2.0, 3.0)
    assert corners == (46.0, 13.5, 48.0, 16.5)
    store.save(mask, "STATIC", mask_name("ERA5", "corners", corners=corners), 1900, 1900)
    assert store.land_sea_mask("ERA5", "SEUR", 1500).count() == 1 and store.mask("ERA5", "center", corners=corners).count() == 1
    assert store.static("area-none") is None
    with pytest.raises(FileNotFoundError):
        store.mask("ERA5", region="AUT")
    with pytest.raises(ValueError):
        mask_name("ERA5", "corners")
