"""Spatial joins against brute force over random inputs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from exceedra.operators import spatial


def clipped(ring, x0, x1, y0, y1):
    """Area of a polygon inside a rectangle, cut side by side."""
    for axis, limit, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if a >= 0:
                out.append(p)
            if (a < 0) != (b < 0):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def convex(rng, n, cx, cy, r):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in angles]
    return ring if rng.random() < 0.5 else ring[::-1]


def no_nested_loop(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" not in plan and "Cartesian" not in plan


def test_polygon_shares(spark):
    rng = random.Random(3)
    step, h = 0.5, 0.25
    rows, want = [], {}
    cells = [(i, 0.5 * (i // 12), 0.5 * (i % 12)) for i in range(144)]
    for region in range(8):
        outer, hole = convex(rng, 9, 2.7, 2.6, 2.0), convex(rng, 5, 2.7, 2.6, 0.3)
        if region == 7:
            outer, hole = [(0.75, 0.75), (3.25, 0.75), (3.25, 3.25), (0.75, 3.25)], [(1.0, 1.0), (1.0, 1.5), (1.5, 1.5), (1.5, 1.0)]  # on the lattice's lines
        inside = clipped(hole, -9, 9, -9, 9) - sum(clipped(hole, x - h, x + h, y - h, y + h) for _, y, x in cells)
        assert abs(inside) < 1e-9
        for ring, (name, points) in enumerate((("outer", outer), ("hole", hole))):
            rows += [(region, ring, name == "hole", n, x, y) for n, (x, y) in enumerate(points)]
        for c, y, x in cells:
            hole_in = clipped(hole, x - h, x + h, y - h, y + h)
            share = (clipped(outer, x - h, x + h, y - h, y + h) - hole_in) / step**2
            if share > 1e-9 or share < -1e-9:
                want[region, c] = share
    rings = spark.createDataFrame(rows, "region int, ring int, hole boolean, n int, x double, y double")
    got = spatial.region_cells(spark.createDataFrame(cells, "cell_id int, y double, x double"), rings, step)
    found = {(r.region, r.cell_id): r.share for r in got.collect()}
    # A hole that is partly outside its region takes area away there; such cells are negative and left out.
    want = {k: v for k, v in want.items() if v > 0}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    assert no_nested_loop(got) and "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_window_sums(spark):
    rng = random.Random(4)
    cells = [(i, 40.0 - 0.5 * (i // 9), 5.0 + 0.5 * (i % 9), rng.random()) for i in range(81) if i % 7]
    grid = [(k, 40.0 - rng.uniform(-1, 5), 5.0 + rng.uniform(-1, 5), rng.choice([0.5, 1.0, 7.0]), rng.choice([0.25, 0.75, 9.0])) for k in range(60)]
    got = spatial.window_sums(spark.createDataFrame(cells, "cell_id int, y double, x double, a double"), spark.createDataFrame(grid, "gr_id int, yc double, xc double, y_off double, x_off double"), 0.5, ["a"])
    points = [(40.0 - 0.5 * i, 5.0 + 0.5 * j) for i in range(9) for j in range(9)]
    e = 1e-9
    for r in got.collect():
        _, yc, xc, yo, xo = grid[r.gr_id]
        inside = lambda y, x: yc - yo + e < y <= yc + yo + e and xc - xo - e <= x < xc + xo - e  # noqa: B023, E731
        assert r.places == sum(inside(y, x) for y, x in points)
        assert r.a == pytest.approx(sum(a for _, y, x, a in cells if inside(y, x)))


@pytest.mark.parametrize("size", [0.05, 0.5, 100.0])
def test_nearest(spark, size):
    rng = random.Random(5)
    points = [(i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(80)] + [(900, None, 1.0), (901, 60.0, 60.0)]
    stations = [(i, round(rng.uniform(-5, 5), 1), round(rng.uniform(-5, 5), 1)) for i in range(40)]
    stations += [(i + 100, y, x) for i, y, x in stations]  # equal distances
    got = spatial.nearest(spark.createDataFrame(points, "cell_id int, y double, x double"), spark.createDataFrame(stations, "station int, sy double, sx double"), size)
    assert no_nested_loop(got)
    for r in got.collect():
        _, y, x = next(p for p in points if p[0] == r.cell_id)
        want = min((round(abs(y - b) + abs(x - c), 9), s) for s, b, c in stations) if y is not None else (None, None)
        assert (r.distance, r.station) == pytest.approx(want) if y is not None else (r.distance, r.station) == want


def test_nearest_of_nothing(spark):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "cell_id int, y double, x double")
    none = spark.createDataFrame([], "station int, sy double, sx double")
    assert [tuple(r) for r in spatial.nearest(points, none).select("cell_id", "station").collect()] == [(1, None)]
    assert spatial.nearest(points.limit(0), none).count() == 0


def test_boxes(spark):
    stations = spark.createDataFrame([(i, i / 3, i / 4) for i in range(40)], "station int, sy double, sx double")
    boxes = spark.createDataFrame([(0.0, 2.0, 0.0, 1.0), (1.0, 5.0, 0.5, 9.0), (9.0, 8.0, 0.0, 9.0)], "south double, north double, west double, east double")
    got = spatial.in_boxes(stations, boxes)
    want = {i for i in range(40) for a, b, c, d in ((0, 2, 0, 1), (1, 5, 0.5, 9)) if a <= i / 3 <= b and c <= i / 4 <= d}
    assert {r.station for r in got.collect()} == want and no_nested_loop(got)


def test_mask_inside_another(spark):
    from exceedra.operators import prepare

    cells = spark.createDataFrame([(i, 0.5 * (i // 4), 0.5 * (i % 4)) for i in range(16)], "cell_id int, y double, x double")
    other = cells.select("cell_id", F.when(F.col("cell_id") < 8, 1.0).alias("mask_frac"))
    ring = [(-0.25, -0.25), (1.75, -0.25), (1.75, 1.75), (-0.25, 1.75)]
    got = prepare.region_mask(cells, "polygon", ring=ring, step=0.5, inside=other).collect()
    assert {r.cell_id for r in got} == set(range(8)) and all(r.mask_frac == pytest.approx(1.0) for r in got)
