"""Preparation: local days, units, derived variables, thresholds, gap filling, masks, regridding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exceedra.functions.columns import area_cartesian, area_latlon, specific_humidity
from exceedra.functions.projection import Conic, TransverseMercator
from exceedra.operators.spatial import region_cells, where_present

GRAVITY = 9.80665
AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}


def utc_offset(lon: Column) -> Column:
    """Whole hours of local solar time, halves to even."""
    return F.bround(lon / 15).cast("int")


def altitude(geopotential: Column) -> Column:
    return geopotential / GRAVITY


def signed_longitude(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def with_area(cells: DataFrame, dy: float, dx: float, planar: bool = False) -> DataFrame:
    """Area of each cell times its share of the mask, on the globe by latitude or, where coordinates are metres, in the plane."""
    whole = F.lit(area_cartesian(dx, dy)) if planar else area_latlon(F.col("y"), dy, dx)
    return cells.withColumn("area", whole * F.col("mask_frac"))


def with_land(cells: DataFrame, land: DataFrame) -> DataFrame:
    """Longitudes from -180 to 180 and each cell's share of land ``land (cell_id, lsm)``; missing where it is not known."""
    return cells.withColumn("x", signed_longitude(F.col("x"))).join(land.select("cell_id", "lsm"), "cell_id", "left")


def local_day(ts: Column, lon: Column, extra: int = 0) -> Column:
    return F.to_date(F.timestamp_seconds(F.unix_timestamp(ts) + 3600 * (utc_offset(lon) + extra)))


def daily_temperature(hourly: DataFrame) -> DataFrame:
    """Mean, least and greatest of ``hourly (cell_id, lon, ts, v)`` in kelvin over local days, in degrees."""
    c = F.col("v") - 273.15
    return hourly.groupBy("cell_id", local_day(F.col("ts"), F.col("lon")).alias("d")).agg(F.avg(c).alias("t"), F.min(c).alias("tn"), F.max(c).alias("tx"))


def daily_precipitation(hourly: DataFrame, seven: bool = False) -> DataFrame:
    """Daily sum and largest hour in mm of metres; ``seven``: days that end at seven."""
    d = local_day(F.col("ts"), F.col("lon"), 7 if seven else 0)
    return hourly.groupBy("cell_id", d.alias("d")).agg(F.sum(F.col("v") * 1000).alias("p24h"), F.max(F.col("v") * 1000).alias("px1h"))


def daily_wind(hourly: DataFrame) -> DataFrame:
    """Speed of the mean vector of ``hourly (cell_id, lon, ts, u, v)``, not the mean speed."""
    g = hourly.groupBy("cell_id", local_day(F.col("ts"), F.col("lon")).alias("d"))
    return g.agg(F.sqrt(F.pow(F.avg("u"), 2) + F.pow(F.avg("v"), 2)).alias("wind"))


def daily_humidity(hourly: DataFrame) -> DataFrame:
    """Mean pressure and specific humidity of ``hourly (cell_id, lon, ts, dewpoint, pressure)``."""
    q = specific_humidity(F.col("dewpoint"), F.col("pressure"))
    return hourly.groupBy("cell_id", local_day(F.col("ts"), F.col("lon")).alias("d")).agg(F.avg("pressure").alias("p"), F.coalesce(F.avg(q), F.lit(0.0)).alias("q"))


def daily_accumulated(hourly: DataFrame) -> DataFrame:
    """Precipitation that accumulates over a day shifted by one hour: its total and its largest hourly step."""
    d = F.to_date(F.timestamp_seconds(F.unix_timestamp("ts") - 3600))
    x = hourly.withColumn("d", d)
    step = F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy("cell_id", "d").orderBy("ts")), F.lit(0.0))
    return x.withColumn("s", step).groupBy("cell_id", "d").agg((F.max("v") * 1000).alias("p24h"), (F.max("s") * 1000).alias("px1h"))


def aggregate_days(hourly: DataFrame, method: str) -> DataFrame:
    return hourly.groupBy("cell_id", F.to_date("ts").alias("d")).agg(AGGREGATES[method]("v").alias("v"))


def method_for(parameter: str) -> str:
    return {"Tx": "max", "Tn": "min", "P": "sum", "R": "sum"}.get(parameter if parameter in ("Tx", "Tn") else parameter[:1], "mean")


def fill_gaps(series: DataFrame) -> DataFrame:
    """Missing days of ``series (cell_id, d, v)`` take the mean of their calendar day, from the first valid day on."""
    day = Window.partitionBy("cell_id", F.month("d"), F.dayofmonth("d"))
    first = F.min(F.when(F.col("v").isNotNull(), F.col("d"))).over(Window.partitionBy("cell_id"))
    mean = F.avg("v").over(day)
    return series.withColumn("_m", mean).withColumn("_f", first).withColumn("v", F.when(F.col("d") >= F.col("_f"), F.coalesce("v", "_m")).otherwise(F.col("v"))).drop("_m", "_f")


def long_stations(series: DataFrame, year: int) -> DataFrame:
    """Rows of stations whose record begins by ``year``."""
    old = series.filter("v is not null").groupBy("cell_id").agg(F.min("d").alias("a")).filter(F.year("a") <= year)
    return series.join(old.select("cell_id"), "cell_id", "left_semi")


def monthly_anomaly(series: DataFrame, first: int, last: int) -> DataFrame:
    """``series (gr_id, d, v)`` less the mean of its month over the years of the climatology."""
    own = F.when(F.year("d").between(first, last), F.col("v"))
    return series.withColumn("anomaly", F.col("v") - F.avg(own).over(Window.partitionBy("gr_id", F.month("d"))))


def percentile_threshold(field: DataFrame, q: float, first: str, last: str, wet: float | None = None, shared: bool = False) -> DataFrame:
    """Interpolated quantile of each cell over the reference days; ``wet``: of days above it only.

    The days are a filter, which reaches a stored field's scan.  ``shared`` makes them a
    condition of the aggregate instead: a field that the same plan derives for all days is
    then derived once, as both uses read the same exchange.
    """
    some = F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    if wet is not None:
        some &= F.col("v") > wet
    if not shared:
        return field.filter(some).groupBy("cell_id").agg(F.percentile("v", F.lit(q)).alias("thr"))
    value = F.when(some, F.col("v"))
    return field.groupBy("cell_id").agg(F.percentile(value, F.lit(q)).alias("thr")).filter("thr is not null")


def smooth(values: DataFrame, radius: int) -> DataFrame:
    """Mean of ``values (cell_id, iy, ix, thr)`` over cells within radius + 0.5; neighbours meet by an offset key."""
    reach = range(-radius - 1, radius + 2)
    near = [(a, b) for a in reach for b in reach if a * a + b * b < (radius + 0.5) ** 2]
    steps = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in near])
    sent = values.select("thr", "iy", "ix", F.explode(steps).alias("s")).select((F.col("iy") + F.col("s.dy")).alias("iy"), (F.col("ix") + F.col("s.dx")).alias("ix"), "thr")
    means = sent.groupBy("iy", "ix").agg(F.avg("thr").alias("smoothed"))
    return values.join(means, ["iy", "ix"]).select("cell_id", "smoothed")


def crop(df: DataFrame, y0: float, y1: float, x0: float, x1: float) -> DataFrame:
    """Rows inside a box, whichever way its sides are given; the filter reaches a Parquet scan."""
    return df.filter(F.col("y").between(min(y0, y1), max(y0, y1)) & F.col("x").between(min(x0, x1), max(x0, x1)))


def crop_to_mask(df: DataFrame, mask: DataFrame, margin: float = 0.0) -> DataFrame:
    """Rows inside the bounding box of the cells with a share of mask, widened by ``margin`` degrees.

    In longitude the margin is divided by the cosine of the box's highest latitude; sides go
    outwards to whole degrees where there is a margin.
    """
    box = mask.filter("mask_frac > 0").agg(F.min("y").alias("_s"), F.max("y").alias("_n"), F.min("x").alias("_w"), F.max("x").alias("_e"))
    if margin:
        wide = margin / F.cos(F.radians(F.greatest(F.abs(F.col("_n")), F.abs(F.col("_s")))))
        box = box.select(F.floor(F.col("_s") - margin).alias("_s"), F.ceil(F.col("_n") + margin).alias("_n"), F.floor(F.col("_w") - wide).alias("_w"), F.ceil(F.col("_e") + wide).alias("_e"))
    inside = F.col("y").between(F.col("_s"), F.col("_n")) & F.col("x").between(F.col("_w"), F.col("_e"))
    return df.crossJoin(F.broadcast(box)).filter(inside).drop("_s", "_n", "_w", "_e")  # one row beside every cell


# Western and eastern side, in degrees, of a region whose extent is not taken from its mask.
EXTENTS = {"EUR": (-12.0, 40.0)}


def reduced(df: DataFrame, mask: DataFrame, size: float, region: str = "", planar: bool = False) -> DataFrame:
    """Rows inside the mask's cells and half a window around them, in whole degrees, but not beyond the mask's lattice.

    ``size`` is a window's height; its width in degrees grows with the cosine of the box's
    northern side, and not at all where coordinates are planar.  Regions of ``EXTENTS`` have
    fixed western and eastern sides, which are not clamped.
    """
    own = lambda c: F.when(F.col("mask_frac") > 0, F.col(c))
    b = mask.agg(*[f(own(c)).alias(n) for f, c, n in ((F.min, "y", "s"), (F.max, "y", "n"), (F.min, "x", "w"), (F.max, "x", "e"))], *[f(c).alias(n) for f, c, n in ((F.min, "y", "s0"), (F.max, "y", "n0"), (F.min, "x", "w0"), (F.max, "x", "e0"))])
    b = b.select("*", F.greatest(F.floor(F.col("s") - size / 2).cast("double"), F.col("s0")).alias("_s"), F.least(F.ceil(F.col("n") + size / 2).cast("double"), F.col("n0")).alias("_n"))
    wide = F.lit(size) if planar else size / F.cos(F.radians("_n"))
    if region in EXTENTS:
        west, east = EXTENTS[region]
        sides = F.floor(west - wide / 2).cast("double"), F.ceil(east + wide / 2).cast("double")
    else:
        sides = F.greatest(F.floor(F.col("w") - wide / 2).cast("double"), F.col("w0")), F.least(F.ceil(F.col("e") + wide / 2).cast("double"), F.col("e0"))
    box = b.select("_s", "_n", sides[0].alias("_w"), sides[1].alias("_e"))
    inside = F.col("y").between(F.col("_s"), F.col("_n")) & F.col("x").between(F.col("_w"), F.col("_e"))
    return df.crossJoin(F.broadcast(box)).filter(inside).drop("_s", "_n", "_w", "_e")  # one row beside every cell


def land_mask(cells: DataFrame, least: float = 0.5, below: float = 0.0) -> DataFrame:
    """Cells with more than ``least`` of land and, where ``below`` is not 0, a height under it: share 1, else NULL."""
    ok = F.col("lsm") > least
    if below:
        ok &= F.col("altitude") < below
    return cells.select("cell_id", F.when(ok, 1.0).alias("mask_frac"))


def region_mask(cells: DataFrame, kind: str, **how) -> DataFrame:
    """Mask by kind: ``polygon``, ``box`` or ``land``; ``inside`` keeps the shares of cells in another mask."""
    makers = {"polygon": polygon_mask, "box": rectangle_mask, "land": land_mask}
    if kind not in makers:
        raise ValueError(f"unknown kind of mask: {kind}")
    inside = how.pop("inside", None)
    mask = makers[kind](cells, **how)
    return mask if inside is None else where_present(mask, inside)


def threshold_of(field: DataFrame, cells: DataFrame, kind: str, value: float, first: str = "", last: str = "", kelvin: bool = False) -> DataFrame:
    """Threshold by kind: ``abs``, one value for all cells, or ``perc``, each cell's percentile over the reference days."""
    if kind == "abs":
        thr = cells.select("cell_id", F.lit(float(value)).alias("thr"))
    elif kind == "perc":
        thr = percentile_threshold(field, value / 100, first, last)
    else:
        raise ValueError(f"unknown kind of threshold: {kind}")
    return thr.withColumn("thr", F.col("thr") + 273.15) if kelvin else thr


def mean_of(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of two variables where both are present as rows."""
    return a.alias("a").join(b.alias("b"), keys).select(*keys, ((F.col("a.v") + F.col("b.v")) / 2).alias("v"))


def wet(series: DataFrame, least: float, hours_back: int = 0) -> DataFrame:
    """Rows at or above ``least``; ``hours_back`` moves hourly rows to the earlier measuring day."""
    out = series.filter(F.col("v") >= least)
    return out.withColumn("ts", F.col("ts") - F.make_interval(hours=F.lit(hours_back))) if hours_back else out


def season_means(series: DataFrame, first_month: int = 1, last_month: int = 12) -> DataFrame:
    """Means of ``series (gr_id, d, v)`` by year over some months."""
    some = series.filter(F.month("d").between(first_month, last_month))
    return some.groupBy("gr_id", F.year("d").alias("year")).agg(F.avg("v").alias("v"))


def rectangle_mask(cells: DataFrame, y0: float, y1: float, x0: float, x1: float, step: float) -> DataFrame:
    """Share of each cell inside a rectangle."""
    cover = lambda c, a, b: F.greatest(F.least(c + step / 2, F.lit(b)) - F.greatest(c - step / 2, F.lit(a)), F.lit(0.0)) / step
    share = cover(F.col("y"), y0, y1) * cover(F.col("x"), x0, x1)
    return cells.select("cell_id", F.when(share > 0, share).alias("mask_frac"))


def polygon_mask(cells: DataFrame, ring: list[tuple[float, float]], step: float) -> DataFrame:
    """Share of each cell inside a polygon of (x, y) corners; missing outside."""
    corners = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for n, (x, y) in enumerate(ring)])
    rings = cells.sparkSession.range(1).select(F.lit(0).alias("region"), F.lit(0).alias("ring"), F.lit(False).alias("hole"), F.explode(corners).alias("c")).select("region", "ring", "hole", "c.*")
    return cells.select("cell_id").join(region_cells(cells, rings, step).select("cell_id", F.col("share").alias("mask_frac")), "cell_id", "left")


def bilinear(field: DataFrame, weights: DataFrame) -> DataFrame:
    """Regridded ``field (cell_id, d, v)`` by ``weights (target_id, cell_id, w)``; missing where a corner is."""
    corners = weights.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("target_id")))
    met = field.filter("v is not null").join(corners, "cell_id")
    g = met.groupBy("target_id", "d").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    return g.select("target_id", "d", F.when(F.col("k") == F.col("n"), F.col("v")).alias("v"))


def bilinear_weights(cells: DataFrame, targets: DataFrame, step: float) -> DataFrame:
    """Weights of the cells around each target (target_id, y, x), by integer lattice keys."""
    c = cells.select("cell_id", F.round(F.col("y") / step).cast("long").alias("ky"), F.round(F.col("x") / step).cast("long").alias("kx"))
    t = targets.withColumn("fy", F.floor(F.col("y") / step)).withColumn("fx", F.floor(F.col("x") / step))
    t = t.withColumn("uy", F.col("y") / step - F.col("fy")).withColumn("ux", F.col("x") / step - F.col("fx"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    t = t.select("target_id", "fy", "fx", "uy", "ux", corner.alias("k"))
    side = lambda u, k: F.when(k == 1, u).otherwise(1 - u)
    t = t.select("target_id", (F.col("fy") + F.col("k.a")).alias("ky"), (F.col("fx") + F.col("k.b")).alias("kx"), (side(F.col("uy"), F.col("k.a")) * side(F.col("ux"), F.col("k.b"))).alias("w"))
    return t.filter("w > 0").join(c, ["ky", "kx"], "left").select("target_id", F.coalesce("cell_id", F.lit(-1)).alias("cell_id"), "w")


def target_lattice(core: tuple[float, float], step: float, least: float, greatest: float) -> list[float]:
    """Coordinates in steps that pass through ``core``, kept strictly inside the data's bounds.

    The bounds are rounded to whole steps, halves to even; a core outside them is cut, too.
    """
    low, high = round(least / step) * step, round(greatest / step) * step
    first = math.floor((low - core[0]) / step) + 1
    last = math.ceil((high - core[0]) / step) - 1
    return [core[0] + k * step for k in range(first, last + 1)]


def reprojected(targets: DataFrame, source: Conic | TransverseMercator, target: Conic | TransverseMercator) -> DataFrame:
    """``targets (target_id, east, north)`` of one projection with x and y in another."""
    lat, lon = target.inverse(F.col("east"), F.col("north"))
    placed = targets.withColumn("_lat", lat).withColumn("_lon", lon)
    x, y = source.forward(F.col("_lat"), F.col("_lon"))
    return placed.withColumn("x", x).withColumn("y", y).drop("_lat", "_lon")


def projected_bounds(cells: DataFrame, source: Conic | TransverseMercator, target: Conic | TransverseMercator) -> DataFrame:
    """One row: least and greatest easting and northing of ``cells (x, y)`` in the target projection."""
    lat, lon = source.inverse(F.col("x"), F.col("y"))
    placed = cells.select(lat.alias("lat"), lon.alias("lon"))
    east, north = target.forward(F.col("lat"), F.col("lon"))
    return placed.agg(F.min(east).alias("west"), F.max(east).alias("east"), F.min(north).alias("south"), F.max(north).alias("north"))


def projected_targets(cells: DataFrame, source: Conic | TransverseMercator, target: Conic | TransverseMercator, step: float, core: tuple[float, float]) -> DataFrame:
    """A lattice through ``core`` (east, north) over the cells' extent, with its places in the source's plane.

    Only the four bounds reach the driver; the lattice itself is made of two ranges.
    """
    b = projected_bounds(cells, source, target).first()
    if b.west is None:
        return cells.sparkSession.createDataFrame([], "target_id long, east double, north double, x double, y double")
    xs, ys = target_lattice((core[0], core[0]), step, b.west, b.east), target_lattice((core[1], core[1]), step, b.south, b.north)
    n = max(len(xs), 1)
    points = cells.sparkSession.range(len(xs) * len(ys)).withColumnRenamed("id", "target_id")
    points = points.withColumn("east", (xs[0] if xs else 0.0) + step * (F.col("target_id") % n)).withColumn("north", (ys[0] if ys else 0.0) + step * F.floor(F.col("target_id") / n))
    return reprojected(points, source, target)
