"""Registered queries of windows, polygons, projections and stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.functions.projection import AUSTRIA, ZONE33, Conic, TransverseMercator
from exceedra.operators import prepare, regions, spatial
from exceedra.plans.chains import AGR_METRICS, WINDOWS, window_ctp
from exceedra.plans.queries import CELL, DAILY, LATTICE, extent, r6, register, sql6, window_weights
from exceedra.sources import tables

STEP = tables.STEP
LEAST_LAND = 0.4

# ------------------------------------------------------------------ land share of windows

LAND = """lsm AS (SELECT *, CASE WHEN (cell_id * 31 % 10) / 10.0::DOUBLE > 0.3 AND (cell_id * 97 % 13) * 150.0::DOUBLE < 1500 THEN 1.0::DOUBLE ELSE 0 END AS land FROM cell),
point AS (SELECT 46.0::DOUBLE - 0.5 * iy AS y, 9.0::DOUBLE + 0.5 * ix AS x FROM range(5) t(iy), range(5) u(ix)),
np AS (SELECT gr_id, count(*) AS places FROM ext JOIN point ON y > yc - 1 + 1e-9 AND y <= yc + 1 + 1e-9 AND x >= xc - x_off - 1e-9 AND x < xc + x_off - 1e-9 GROUP BY gr_id),
ws AS (SELECT ext.gr_id, coalesce(places, 0) AS places, coalesce(sum(lsm.land), 0) AS land, coalesce(sum(lsm.area), 0) AS area, count(lsm.cell_id)::DOUBLE AS cells FROM ext LEFT JOIN np USING (gr_id) LEFT JOIN lnk USING (gr_id) LEFT JOIN lsm ON lsm.cell_id = lnk.cell_id GROUP BY ALL),
wl AS (SELECT *, land / nullif(places, 0) AS land_share FROM ws)"""


def window_land(s: SparkSession, d: str) -> DataFrame:
    """Land, area and cells of every window of the lattice."""
    land = F.when((F.col("lsm") > 0.3) & (F.col("altitude") < 1500), 1.0).otherwise(0.0)
    c = tables.altitude(s, d).withColumn("land", land).withColumn("cells", F.lit(1.0))
    return spatial.window_sums(c, extent(s, d), STEP, ["land", "area", "cells"]).withColumn("gr_id", F.col("gr_id").cast("int"))


@register("window_land", f"WITH {CELL}, {LATTICE}, {LAND} " + sql6("land_share, area, cells", "wl", "gr_id"))
def _(s, d):
    return r6(spatial.land_windows(window_land(s, d), 0.0).select("gr_id", "land_share", "area", "cells"))


@register(
    "agr_mean_land",
    f"WITH {WINDOWS}, {LAND}, wa AS (SELECT gr_id, sum(area) AS a FROM lnk WHERE gr_id IN (SELECT gr_id FROM lnk SEMI JOIN thr USING (cell_id)) AND gr_id IN (SELECT gr_id FROM wl WHERE land_share >= {LEAST_LAND} - 1e-9) GROUP BY gr_id), ag AS (SELECT * FROM ctp JOIN wa USING (gr_id)), am AS (SELECT p, "
    + ", ".join(f"sum(a * {m}) / sum(a) AS {m}" for m in AGR_METRICS)
    + " FROM ag GROUP BY p) "
    + sql6(", ".join(AGR_METRICS), "am", "p"),
)
def _(s, d):
    """Windows with too little land leave the aggregate before it is weighted."""
    land = spatial.land_windows(window_land(s, d), LEAST_LAND).select("gr_id")
    kept = window_ctp(s, d).join(window_weights(s, d), "gr_id").join(land, "gr_id", "left_semi")
    return r6(regions.weighted_mean(kept, *AGR_METRICS))


# ------------------------------------------------------------------ polygons

RINGS = """corner AS (
  SELECT r_regionkey AS region, 0 AS ring, false AS hole, unnest([0, 1, 2, 3, 4]) AS n, unnest([9.1 + 0.1 * r_regionkey, 11.2 - 0.1 * r_regionkey, 10.9, 10.2, 9.0]::DOUBLE[]) AS x, unnest([44.1, 44.3 + 0.05 * r_regionkey, 45.9 - 0.1 * r_regionkey, 46.1, 45.5 - 0.1 * r_regionkey]::DOUBLE[]) AS y FROM region
  UNION ALL SELECT r_regionkey, 1, true, unnest([0, 1, 2]), unnest([9.9, 10.3 + 0.05 * r_regionkey, 10.1]::DOUBLE[]), unnest([44.9, 44.95, 45.3]::DOUBLE[]) FROM region
  UNION ALL SELECT r_regionkey, 2, false, unnest([0, 1, 2, 3]), unnest([8.9, 8.9, 9.2, 9.2]::DOUBLE[]), unnest([43.8, 44.0, 44.0, 43.8]::DOUBLE[]) FROM region),
edge AS (SELECT region, ring, hole, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM corner WINDOW w AS (PARTITION BY region, ring ORDER BY n)),
turn AS (SELECT *, -sign(sum(x1 * y2 - x2 * y1) OVER (PARTITION BY region, ring)) * CASE WHEN hole THEN -1 ELSE 1 END * sign(x2 - x1) AS s FROM edge),
cut AS (SELECT region, cell_id, s, y - 0.25 AS base, greatest(least(x1, x2), x - 0.25) AS a, least(greatest(x1, x2), x + 0.25) AS b, x1, y1, (y2 - y1) / (x2 - x1) AS m FROM turn JOIN cell ON x1 <> x2 AND least(x1, x2) < x + 0.25 AND greatest(x1, x2) > x - 0.25),
ends AS (SELECT region, cell_id, s, b - a AS w, m, y1 + m * (a - x1) - base AS ha, y1 + m * (b - x1) - base AS hb FROM cut),
ramp AS (SELECT region, cell_id, s * CASE WHEN abs(hb - ha) < 1e-12 THEN w * least(greatest(ha, 0), 0.5) ELSE (pow(greatest(hb, 0), 2) - pow(greatest(ha, 0), 2) - pow(greatest(hb - 0.5, 0), 2) + pow(greatest(ha - 0.5, 0), 2)) / 2 / m END AS part FROM ends),
shares AS (SELECT region, cell_id, sum(part) / 0.25 AS share FROM ramp GROUP BY ALL HAVING sum(part) / 0.25 > 1e-9)"""


def rings(s: SparkSession, d: str) -> DataFrame:
    """For each region a pentagon with a hole, and a small square apart that turns the other way."""
    k = F.col("r_regionkey")
    parts = [
        (0, False, [(9.1 + 0.1 * k, F.lit(44.1)), (11.2 - 0.1 * k, 44.3 + 0.05 * k), (F.lit(10.9), 45.9 - 0.1 * k), (F.lit(10.2), F.lit(46.1)), (F.lit(9.0), 45.5 - 0.1 * k)]),
        (1, True, [(F.lit(9.9), F.lit(44.9)), (10.3 + 0.05 * k, F.lit(44.95)), (F.lit(10.1), F.lit(45.3))]),
        (2, False, [(F.lit(a), F.lit(b)) for a, b in ((8.9, 43.8), (8.9, 44.0), (9.2, 44.0), (9.2, 43.8))]),
    ]
    corners = [F.struct(F.lit(ring).alias("ring"), F.lit(hole).alias("hole"), F.lit(n).alias("n"), x.alias("x"), y.alias("y")) for ring, hole, points in parts for n, (x, y) in enumerate(points)]
    return tables.read(s, d, "region").select(k.alias("region"), F.explode(F.array(*corners)).alias("c")).select("region", "c.*")


@register("polygon_shares", f"WITH {CELL}, {RINGS} " + sql6("share", "shares", "region, cell_id"))
def _(s, d):
    return r6(spatial.region_cells(tables.cells(s, d), rings(s, d), STEP))


@register("mask_where_present", f"WITH {CELL}, {RINGS}, a AS (SELECT cell_id, share AS mask_frac FROM shares WHERE region = 0 AND cell_id IN (SELECT cell_id FROM shares WHERE region = 4)) " + sql6("mask_frac", "a", "cell_id"))
def _(s, d):
    """The mask of one region where that of another has a share."""
    both = spatial.region_cells(tables.cells(s, d), rings(s, d), STEP).withColumnRenamed("share", "mask_frac")
    of = lambda k: both.filter(F.col("region") == k).select("cell_id", "mask_frac")
    return r6(spatial.where_present(of(0), of(4)))


# ------------------------------------------------------------------ projections


def _conic_sql(c: Conic) -> tuple[str, str]:
    n, scale, origin = c.cone
    t = f"(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {c.e!r}::DOUBLE * sin(radians(lat))) / (1 + {c.e!r}::DOUBLE * sin(radians(lat))), {c.e / 2!r}::DOUBLE))"
    turn = f"({n!r}::DOUBLE * radians(lon - {c.lon0!r}::DOUBLE))"
    return f"{c.east0} + {scale!r}::DOUBLE * pow({t}, {n!r}::DOUBLE) * sin({turn})", f"{c.north0} + {origin!r}::DOUBLE - {scale!r}::DOUBLE * pow({t}, {n!r}::DOUBLE) * cos({turn})"


def _mercator_sql(m: TransverseMercator, lat: str, lon: str, source: str) -> str:
    """Easting and northing in three steps of SQL."""
    k = 2 * m.third**0.5 / (1 + m.third)
    x = " + ".join(["eta", *[f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(m.series[0], 1)]])
    y = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(m.series[0], 1)]])
    return f"""m0 AS (SELECT *, radians({lon} - {m.lon0}) AS turn, sinh(atanh(sin(radians({lat}))) - {k!r}::DOUBLE * atanh({k!r}::DOUBLE * sin(radians({lat})))) AS t FROM {source}),
m1 AS (SELECT *, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM m0),
m2 AS (SELECT * EXCLUDE (turn, t, xi, eta), {m.east0} + {m.radius!r}::DOUBLE * ({x}) AS east, {m.north0} + {m.radius!r}::DOUBLE * ({y}) AS north FROM m1)"""


LATLON = "ll AS (SELECT cell_id, y AS lat, x + 3 AS lon FROM cell)"


@register("project_cells", f"WITH {CELL}, {LATLON}, {_mercator_sql(ZONE33, 'lat', 'lon', 'll')}, z AS (SELECT cell_id, east, north, {_conic_sql(AUSTRIA)[0]} AS x, {_conic_sql(AUSTRIA)[1]} AS y FROM m2) " + sql6("east, north, x, y", "z", "cell_id"))
def _(s, d):
    lat, lon = F.col("y"), F.col("x") + 3
    east, north = ZONE33.forward(lat, lon)
    x, y = AUSTRIA.forward(lat, lon)
    return r6(tables.cells(s, d).select("cell_id", east.alias("east"), north.alias("north"), x.alias("x"), y.alias("y")))


@register("project_back", f"WITH {CELL}, {LATLON} " + sql6("lat, lon, lat2, lon2", "(SELECT *, lat AS lat2, lon AS lon2 FROM ll)", "cell_id"))
def _(s, d):
    """There and back in both projections, to six decimals of a degree."""
    c = tables.cells(s, d).select("cell_id", F.col("y").alias("a"), (F.col("x") + 3).alias("b"))
    for n, p in (("", ZONE33), ("2", AUSTRIA)):
        east, north = p.forward(F.col("a"), F.col("b"))
        lat, lon = p.inverse(east, north)
        c = c.withColumn(f"lat{n}", lat).withColumn(f"lon{n}", lon)
    return r6(c.drop("a", "b"))


PLANE_STEP, TARGET_STEP, CORE = 10000.0, 4000.0, (432200.0, 5246600.0)


def plane_cells(s: SparkSession, d: str) -> DataFrame:
    """The synthetic lattice in the plane of the conic projection."""
    k = F.col("cell_id")
    return tables.cells(s, d).select("cell_id", (400000.0 + PLANE_STEP * (k % 5 - 2)).alias("x"), (400000.0 - PLANE_STEP * (F.floor(k / 5) - 2)).alias("y"))


def _inverse_sql(p: Conic | TransverseMercator, east: str, north: str, source: str) -> str:
    """Columns lat and lon of a plane's points, step by step."""
    if isinstance(p, Conic):
        n, scale, origin = p.cone
        lat = " + ".join(["chi", *[f"{c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(p.latitude_terms, 1)]])
        return f"""c0 AS (SELECT *, {east} - {p.east0} AS px, {origin!r}::DOUBLE - ({north} - {p.north0}) AS py FROM {source}),
c1 AS (SELECT *, pi() / 2 - 2 * atan(pow(sqrt(px * px + py * py) / {scale!r}::DOUBLE, {1 / n!r}::DOUBLE)) AS chi FROM c0), c2 AS (SELECT * EXCLUDE (px, py, chi), degrees({lat}) AS lat, {p.lon0!r}::DOUBLE + degrees(atan2(px, py)) / {n!r}::DOUBLE AS lon FROM c1)"""
    a = " - ".join(["xi", *[f"{c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(p.series[1], 1)]])
    b = " - ".join(["eta", *[f"{c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(p.series[1], 1)]])
    lat = " + ".join(["chi", *[f"{c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(p.series[2], 1)]])
    return f"""u0 AS (SELECT *, ({north} - {p.north0}) / {p.radius!r}::DOUBLE AS xi, ({east} - {p.east0}) / {p.radius!r}::DOUBLE AS eta FROM {source}), u1 AS (SELECT *, {a} AS ka, {b} AS kb FROM u0),
u2 AS (SELECT *, asin(sin(ka) / cosh(kb)) AS chi FROM u1), u3 AS (SELECT * EXCLUDE (xi, eta, ka, kb, chi), degrees({lat}) AS lat, {p.lon0} + degrees(atan2(sinh(kb), cos(ka))) AS lon FROM u2)"""


REGRID = f"""plane AS (SELECT cell_id, 400000.0::DOUBLE + 10000 * (cell_id % 5 - 2) AS x, 400000.0::DOUBLE - 10000 * (cell_id // 5 - 2) AS y FROM cell),
{_inverse_sql(AUSTRIA, 'x', 'y', 'plane')}, {_mercator_sql(ZONE33, 'lat', 'lon', 'c2')},
bound AS (SELECT round_even(min(east) / 4000, 0) * 4000 AS w, round_even(max(east) / 4000, 0) * 4000 AS e, round_even(min(north) / 4000, 0) * 4000 AS s, round_even(max(north) / 4000, 0) * 4000 AS n FROM m2),
ks AS (SELECT range - 500 AS k FROM range(1000)), xs AS (SELECT {CORE[0]}::DOUBLE + 4000 * k AS east, row_number() OVER (ORDER BY k) - 1 AS ix FROM ks, bound WHERE {CORE[0]} + 4000 * k > w AND {CORE[0]} + 4000 * k < e), ys AS (SELECT {CORE[1]}::DOUBLE + 4000 * k AS north, row_number() OVER (ORDER BY k) - 1 AS iy FROM ks, bound WHERE {CORE[1]} + 4000 * k > s AND {CORE[1]} + 4000 * k < n),
tgt AS (SELECT iy * (SELECT count(*) FROM xs) + ix AS target_id, east, north FROM xs, ys), {_inverse_sql(ZONE33, 'east', 'north', 'tgt')},
tp AS (SELECT target_id, {_conic_sql(AUSTRIA)[0]} AS tx, {_conic_sql(AUSTRIA)[1]} AS ty FROM u3),
wt AS (SELECT target_id, cell_id, (1 - abs(ty - y) / 10000) * (1 - abs(tx - x) / 10000) AS w FROM tp JOIN plane ON abs(ty - y) < 10000 AND abs(tx - x) < 10000),
rg AS (SELECT target_id, d, CASE WHEN count(*) = 4 THEN sum(w * v) END AS v FROM wt JOIN daily USING (cell_id) GROUP BY ALL)"""


@register("regrid_projected", f"WITH {CELL}, {DAILY}, {REGRID} " + sql6("v", "rg", "target_id, d"))
def _(s, d):
    """A field in the conic plane on a lattice of the other projection, every place of it a target."""
    c = plane_cells(s, d)
    targets = prepare.projected_targets(c, AUSTRIA, ZONE33, TARGET_STEP, CORE)
    return r6(prepare.bilinear(tables.daily(s, d), prepare.bilinear_weights(c, targets, PLANE_STEP)))


# ------------------------------------------------------------------ stations


STATION = "st AS (SELECT s_suppkey AS station, 43.5::DOUBLE + (s_suppkey * 37 % 101) * 0.03::DOUBLE AS sy, 8.0::DOUBLE + (s_suppkey * 53 % 97) * 0.05::DOUBLE AS sx FROM supplier)"


def supplier_stations(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return tables.read(s, d, "supplier").select(k.alias("station"), (43.5 + (k * 37 % 101) * F.lit(0.03)).alias("sy"), (8.0 + (k * 53 % 97) * F.lit(0.05)).alias("sx"))


@register("nearest_supplier", f"WITH {CELL}, {STATION}, z AS (SELECT cell_id, arg_min(station, (round(abs(y - sy) + abs(x - sx), 9), station)) AS station, min(abs(y - sy) + abs(x - sx)) AS distance FROM cell, st GROUP BY cell_id) " + sql6("distance", "z", "cell_id, station"))
def _(s, d):
    return r6(spatial.nearest(tables.cells(s, d), supplier_stations(s, d), 0.1))


@register("stations_in_boxes", f"WITH {CELL}, {STATION}, box AS (SELECT gr_id, min(y) AS south, max(y) AS north, min(x) AS west, max(x) AS east FROM cell WHERE gr_id IN (0, 3) GROUP BY gr_id) " + sql6("sy, sx", "st WHERE EXISTS (SELECT 1 FROM box WHERE sy BETWEEN south AND north AND sx BETWEEN west AND east)", "station"))
def _(s, d):
    boxes = tables.cells(s, d).filter(F.col("gr_id").isin(0, 3)).groupBy("gr_id").agg(F.min("y").alias("south"), F.max("y").alias("north"), F.min("x").alias("west"), F.max("x").alias("east"))
    return r6(spatial.in_boxes(supplier_stations(s, d), boxes).select("station", "sy", "sx"))
