"""The aggregate of a lattice against plain arithmetic."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from exceedra.operators import aggregate

BASIC = aggregate.BASIC


def compounds(b):
    ed = b["ef"] * b["ed_avg"]
    dm = b["ed_avg"] * b["em_avg"]
    es = dm * b["ea_avg"]
    return b | {"ed": ed, "em": ed * b["em_avg"], "em_md": ed * b["em_avg_md"], "dm_avg": dm, "es_avg": es, "tex": b["ef"] * es}


def gmean(xs):
    xs = [x for x in xs if x is not None and x > 0]
    return math.exp(sum(map(math.log, xs)) / len(xs))


def table(seed):
    rng = random.Random(seed)
    return {(g, y): {m: rng.uniform(0.5, 4) for m in BASIC} for g in range(5) for y in range(1990, 2000)}


def frames(spark, data, areas):
    rows = [(g, dt.date(y, 1, 1), *[v[m] for m in BASIC]) for (g, y), v in data.items()]
    return spark.createDataFrame(rows, "gr_id int, p date, " + ", ".join(f"{m}_gr double" for m in BASIC)), spark.createDataFrame(list(areas.items()), "gr_id int, a double")


REF, CC = ("1991-01-01", "1993-12-31"), ("1996-01-01", "1998-12-31")


def test_against_arithmetic(spark):
    data, areas = table(1), {0: 1.0, 1: 2.5, 2: 0.5, 3: 4.0}  # window 4 does not belong
    windows, a = frames(spark, data, areas)
    got = aggregate.aggregate(windows, a, REF, CC, 10.0)
    total = sum(areas.values())
    mean = lambda of: sum(areas[g] * of(g) for g in areas) / total
    ref = {m: mean(lambda g, m=m: gmean([data[g, y][m] for y in (1991, 1992, 1993)])) for m in BASIC}
    series = {y: {m: mean(lambda g, m=m, y=y: data[g, y][m]) for m in BASIC} for y in range(1990, 2000)}
    own = {m: gmean([series[y][m] for y in (1991, 1992, 1993)]) for m in BASIC}
    scaled = {y: compounds({m: series[y][m] * ref[m] / own[m] for m in BASIC}) for y in series}
    base = compounds(ref)
    recent = {m: gmean([scaled[y][m] for y in (1996, 1997, 1998)]) for m in scaled[1990]}
    means, factors = ({r.p.year: r for r in df.collect()} for df in (got.means, got.factors))
    for y, want in scaled.items():
        for m, v in want.items():
            assert means[y][f"{m}_agr"] == pytest.approx(v)
            assert factors[y][f"{m}_agr_af"] == pytest.approx(v / base[m]) and factors[y][f"{m}_agr_af_cc"] == pytest.approx(recent[m] / base[m])
        above = [g for g in areas if compounds(data[g, y])["tex"] >= want["tex"]]
        weight = sum(areas[g] for g in above)
        supp = math.sqrt(sum(areas[g] * (compounds(data[g, y])["tex"] - want["tex"]) ** 2 for g in above) / weight) if above else None
        assert means[y].tex_agr_supp == (pytest.approx(supp) if above else None)
    refs = got.references.first()
    assert refs.tex_agr_ref == pytest.approx(base["tex"]) and refs.ef_agr_cc == pytest.approx(recent["ef"])
    p = {(r.metric, r.p.year): (r.p05, r.p95) for r in got.percentiles.collect()}
    values = sorted(data[g, 1995]["ef"] for g in areas)
    assert p["ef_agr", 1995] == (values[0], values[-1]) or p["ef_agr", 1995][0] in values
    wide = aggregate.wide_percentiles(got.percentiles, ["ef_agr"])
    assert set(wide.columns) == {"p", "ef_agr_p05", "ef_agr_p95"} and wide.count() == 10


def test_short_reference_has_no_factors(spark):
    windows, a = frames(spark, table(2), {0: 1.0, 1: 1.0})
    got = aggregate.aggregate(windows, a, REF, CC, 10_000.0)
    assert all(v is None for r in got.factors.select("ed_agr_af", "tex_agr_af_cc").collect() for v in r)


def test_windows_in_a_box_and_a_mask(spark):
    grid = spark.createDataFrame([(i, 40.0 + i, 10.0 - i) for i in range(6)], "gr_id int, yc double, xc double")
    assert {r.gr_id for r in aggregate.within(grid, (43.0, 41.0), (7.0, 8.5)).collect()} == {2, 3}
    mask = spark.createDataFrame([(0, 1.0), (1, 0.0), (5, 0.2)], "gr_id int, mask_frac double")
    assert {r.gr_id for r in aggregate.within(grid, mask=mask).collect()} == {0, 5}
    assert aggregate.within(grid).count() == 6
