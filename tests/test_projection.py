"""Projections against numeric integration and the properties that define them."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from exceedra.functions.projection import AUSTRIA, GRS80, WGS84, ZONE33
from exceedra.operators import prepare


def e2(ellipsoid):
    f = 1 / ellipsoid[1]
    return f * (2 - f)


def meridian(lat, ellipsoid):
    """Length of the meridian from the equator, by integration."""
    q, x = e2(ellipsoid), np.linspace(0, math.radians(lat), 200_001)
    return np.trapezoid(ellipsoid[0] * (1 - q) / (1 - q * np.sin(x) ** 2) ** 1.5, x)


def places(spark, projection, points):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "i int, lat double, lon double")
    east, north = projection.forward(F.col("lat"), F.col("lon"))
    return {r.i: (r.e, r.n) for r in df.select("i", east.alias("e"), north.alias("n")).collect()}


def test_central_meridian(spark):
    got = places(spark, ZONE33, [(lat, 15.0) for lat in (0, 10, 47, 60, -30)])
    for i, lat in enumerate((0, 10, 47, 60, -30)):
        assert got[i] == pytest.approx((500000.0, 0.9996 * math.copysign(meridian(abs(lat), WGS84), lat) if lat else 0.0), abs=1e-3)


@pytest.mark.parametrize(("projection", "ellipsoid", "lat", "lon", "scale"), [(AUSTRIA, GRS80, 46.0, 12.0, 1.0), (AUSTRIA, GRS80, 49.0, 16.5, 1.0), (AUSTRIA, GRS80, 47.3, 10.0, None), (ZONE33, WGS84, 46.7, 15.0, 0.9996), (ZONE33, WGS84, 47.5, 12.2, None)])
def test_conformal(spark, projection, ellipsoid, lat, lon, scale):
    """The scale is the same along both axes, the axes stay at right angles, and it is what the parallels say."""
    h = 1e-4
    got = places(spark, projection, [(lat - h, lon), (lat + h, lon), (lat, lon - h), (lat, lon + h)])
    q, s = e2(ellipsoid), math.sin(math.radians(lat))
    north = 2 * math.radians(h) * ellipsoid[0] * (1 - q) / (1 - q * s * s) ** 1.5
    east = 2 * math.radians(h) * ellipsoid[0] / math.sqrt(1 - q * s * s) * math.cos(math.radians(lat))
    a = np.subtract(got[1], got[0]) / north
    b = np.subtract(got[3], got[2]) / east
    assert np.hypot(*a) == pytest.approx(np.hypot(*b), rel=1e-6) and float(a @ b) == pytest.approx(0, abs=1e-6)
    if scale:
        assert np.hypot(*a) == pytest.approx(scale, rel=1e-6)


def test_origin(spark):
    assert places(spark, AUSTRIA, [(47.5, 40 / 3)])[0] == pytest.approx((400000.0, 400000.0), abs=1e-6)


@pytest.mark.parametrize("projection", [AUSTRIA, ZONE33])
def test_round_trip(spark, projection):
    df = spark.range(2000).select((45 + F.rand(1) * 5).alias("lat"), (9 + F.rand(2) * 9).alias("lon"))
    df = df.withColumns(dict(zip(("e", "n"), projection.forward(F.col("lat"), F.col("lon")), strict=True)))
    lat, lon = projection.inverse(F.col("e"), F.col("n"))
    worst = df.agg(F.max(F.abs(lat - F.col("lat"))), F.max(F.abs(lon - F.col("lon")))).first()
    assert max(worst) < 1e-9


def test_target_lattice():
    assert prepare.target_lattice((500.0, 700.0), 100.0, 180.0, 1010.0) == [300.0, 400.0, 500.0, 600.0, 700.0, 800.0, 900.0]  # bounds 200 and 1000 are outside
    assert prepare.target_lattice((530.0, 530.0), 100.0, 180.0, 420.0) == [230.0, 330.0]
    assert prepare.target_lattice((0.0, 0.0), 100.0, 10.0, 20.0) == []


def test_no_cells(spark):
    cells = spark.createDataFrame([], "cell_id int, x double, y double")
    assert prepare.projected_targets(cells, AUSTRIA, ZONE33, 1000.0, (0.0, 0.0)).count() == 0
