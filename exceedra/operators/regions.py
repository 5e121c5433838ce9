"""Lattices of overlapping regions and their aggregate: windows, weighted means, spreads, percentiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exceedra.functions.columns import zero_sum
from exceedra.operators.daily import MIN_AREA, mark_events, region_metrics
from exceedra.operators.periods import region_periods

EARTH_KM = 6371.0
EDGE = 1e-9


def lattice(cells: DataFrame, spacing: float) -> DataFrame:
    """Centres of the lattice over the cells' extent: gr_id, yc, xc."""
    b = cells.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    ys = F.transform(F.sequence(F.lit(0), F.lit(int(math.floor((b[1] - b[0]) / spacing + EDGE)))), lambda i: F.lit(b[1]) - i * spacing)
    xs = F.transform(F.sequence(F.lit(0), F.lit(int(math.floor((b[3] - b[2]) / spacing + EDGE)))), lambda i: F.lit(b[2]) + i * spacing)
    rows = cells.sparkSession.range(1).select(F.posexplode(ys).alias("iy", "yc"))
    n = int(math.floor((b[3] - b[2]) / spacing + EDGE)) + 1
    return rows.select("iy", "yc", F.posexplode(xs).alias("ix", "xc")).select((F.col("iy") * n + F.col("ix")).alias("gr_id"), "yc", "xc")


def inner_lattice(cells: DataFrame, spacing: float, size: float, margin: float | None = None) -> DataFrame:
    """Centres gr_id, yc, xc that keep ``margin`` (half a window) from the cells' edges, from the top left on.

    In longitude the margin is that of the first row of centres, rounded to whole spacings.
    Everything comes from one row of bounds inside the plan; cells that leave no room give no
    centre.
    """
    margin = size / 2 if margin is None else margin
    b = cells.agg(F.max("y").alias("top"), F.min("y").alias("low"), F.min("x").alias("left"), F.max("x").alias("right"))
    wide = F.round(F.bround(margin / F.cos(F.radians(F.col("top") - margin)) / spacing) * spacing, 2)
    steps = lambda length: F.ceil(length / spacing - EDGE).cast("int")
    b = b.withColumn("wide", wide).withColumn("ny", steps(F.col("top") - F.col("low") + spacing - 2 * margin)).withColumn("nx", steps(F.col("right") - F.col("left") + spacing - 2 * F.col("wide")))
    some = b.filter("ny > 0 and nx > 0")
    rows = some.select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("iy"))
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("ix"))
    return at.select((F.col("iy") * F.col("nx") + F.col("ix")).alias("gr_id"), (F.col("top") - margin - F.col("iy") * spacing).alias("yc"), (F.col("left") + F.col("wide") + F.col("ix") * spacing).alias("xc"))


def with_extent(grid: DataFrame, size: float, step: float = 0.25) -> DataFrame:
    """Half widths: rounded to ``step`` in longitude, and the share of area that this adds."""
    half = size / 2
    exact = half / F.cos(F.radians("yc"))
    out = grid.withColumn("x_off", F.bround(exact / step) * step).withColumn("y_off", F.lit(half))
    return out.withColumn("area_frac", F.col("x_off") / exact)


def bridge(cells: DataFrame, grid: DataFrame, tile: float = 1.0) -> DataFrame:
    """(gr_id, cell_id) of every cell in every window; windows are half open in both directions.

    The range join is an equi-join on tiles of ``tile`` degrees: a cell is in one, a window in
    those that it touches.
    """
    at = lambda c: F.floor(c / tile).cast("int")
    span = lambda c, off: F.sequence(at(c - off - EDGE), at(c + off + EDGE))
    c = cells.select("cell_id", "y", "x", "area", at(F.col("y")).alias("ty"), at(F.col("x")).alias("tx"))
    g = grid.withColumn("ty", F.explode(span(F.col("yc"), F.col("y_off")))).withColumn("tx", F.explode(span(F.col("xc"), F.col("x_off"))))
    inside = (F.col("y") > F.col("yc") - F.col("y_off") + EDGE) & (F.col("y") <= F.col("yc") + F.col("y_off") + EDGE)
    inside &= (F.col("x") >= F.col("xc") - F.col("x_off") - EDGE) & (F.col("x") < F.col("xc") + F.col("x_off") - EDGE)
    return c.join(g, ["ty", "tx"]).filter(inside).select("gr_id", "cell_id", "area", "area_frac")


def valid_links(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Links to cells that have a threshold: a window without one has no days and no weight."""
    return links.join(cells.filter("thr is not null").select("cell_id"), "cell_id", "left_semi")


def window_weights(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Area ``a`` of all cells of each window that has a cell with a threshold: its weight in the aggregate."""
    some = valid_links(links, cells).select("gr_id").distinct()
    return links.join(some, "gr_id", "left_semi").groupBy("gr_id").agg(F.sum("area").alias("a"))


def window_days(dbv: DataFrame, links: DataFrame, min_area: float = MIN_AREA, field: DataFrame | None = None) -> DataFrame:
    """Daily metrics of every window: only exceeding cells meet the bridge, once for all windows.

    ``links`` are those of :func:`valid_links`, so that no window without data has days of
    zeros.  Days run from the first to the last of ``field``, by default those of ``dbv``, and
    are made beside each window; only exceedances are shuffled to meet them.
    """
    hot = dbv.filter("dtem > 0").select("cell_id", "d", "dtem")
    met = hot.join(links, "cell_id").withColumn("a", F.col("area") / F.col("area_frac"))
    sums = met.groupBy("gr_id", "d").agg(F.sum("a").alias("dtea_gr"), F.sum(F.col("dtem") * F.col("a")).alias("ma"), F.max("dtem").alias("top"))
    day = F.to_date("d")
    span = (dbv if field is None else field).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    spine = links.select("gr_id").distinct().crossJoin(F.broadcast(span)).select("gr_id", F.explode(F.sequence("_a", "_b")).alias("d"))  # one row beside every window
    filled = spine.join(sums.withColumn("d", day), ["gr_id", "d"], "left").fillna(0.0, ["dtea_gr", "ma", "top"])
    return region_metrics(filled, min_area)


def blocks(cells: DataFrame, size: float, top: float, left: float) -> DataFrame:
    """Coarse cells: share of valid fine cells and their area, by floor division of coordinates."""
    by = cells.withColumn("yb", F.floor((F.lit(top) - F.col("y")) / size + EDGE)).withColumn("xb", F.floor((F.col("x") - F.lit(left)) / size + EDGE))
    return by.groupBy("yb", "xb").agg(F.avg(F.when(F.col("mask_frac") > 0, 1.0).otherwise(0.0)).alias("mask_frac"), F.sum(F.when(F.col("mask_frac") > 0, F.col("area"))).alias("gr_area"))


def coarse_blocks(cells: DataFrame, factor: int) -> DataFrame:
    """Blocks of ``factor`` by ``factor`` lattice points ``(iy, ix)``: share of valid cells and their area, by block.

    Rows and columns that fill no whole block are trimmed at the far ends; a block without a
    valid cell has no area.  The lattice's ends come from one row inside the plan.
    """
    ends = cells.agg((F.floor((F.max("iy") + 1) / factor) * factor).alias("_ny"), (F.floor((F.max("ix") + 1) / factor) * factor).alias("_nx"))
    kept = cells.crossJoin(F.broadcast(ends)).filter((F.col("iy") < F.col("_ny")) & (F.col("ix") < F.col("_nx")))  # one row beside every cell
    valid = F.col("mask_frac") > 0
    by = kept.groupBy(F.floor(F.col("iy") / factor).alias("yb"), F.floor(F.col("ix") / factor).alias("xb"))
    return by.agg((F.count_if(valid) / (factor * factor)).alias("mask_frac"), F.sum(F.when(valid, F.col("area"))).alias("gr_area"))


def weighted_mean(df: DataFrame, *metrics: str) -> DataFrame:
    """Area-weighted means per period; a missing value adds nothing and keeps its weight."""
    return df.groupBy("p").agg(*[(F.sum(F.col("a") * F.col(m)) / F.sum("a")).alias(m) for m in metrics])


def window_periods(days: DataFrame, period: str) -> DataFrame:
    """All period metrics of every window at once, from :func:`window_days`."""
    return region_periods(mark_events(days, "gr_id", "dtec_gr", "dteec_gr"), period)


def all_percentiles(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Weighted 5 and 95 % points of every metric: (metric, p, p05, p95), one pass over long rows."""
    pairs = [y for m in metrics for y in (F.lit(m), F.col(m).cast("double"))]
    long = df.select("gr_id", "a", "p", F.stack(F.lit(len(metrics)), *pairs).alias("metric", "x"))
    long = long.withColumn("p", F.struct("metric", "p"))
    return weighted_percentiles(long, "x").select("p.metric", "p.p", "p05", "p95")


def weighted_spread(df: DataFrame, metric: str) -> DataFrame:
    """Weighted deviations above (or at) and below the mean; missing values weigh below."""
    m = weighted_mean(df, metric).select("p", F.col(metric).alias("m"))
    x = df.join(F.broadcast(m), "p")
    up = F.coalesce(F.col(metric) >= F.col("m"), F.lit(False))
    sq = F.col("a") * F.pow(F.col(metric) - F.col("m"), 2)
    part = lambda cond: F.sqrt(F.try_divide(F.sum(F.when(cond, sq)), F.sum(F.when(cond, F.col("a")))))
    return x.groupBy("p").agg(part(up).alias("supp"), part(~up).alias("slow"))


def weighted_percentiles(df: DataFrame, metric: str) -> DataFrame:
    """Values nearest the 5 and 95 % points of cumulative weight: not above the first, not below the second."""
    x = df.filter(F.col(metric).isNotNull()).withColumn("w", F.col("a") / F.sum("a").over(Window.partitionBy("p")))
    w = Window.partitionBy("p").orderBy(metric, "gr_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("c", F.sum("w").over(w)).withColumn("x", F.col(metric))
    near = F.abs(F.col("c") - 0.95)
    g = x.groupBy("p").agg(
        F.coalesce(F.max(F.when(F.col("c") <= 0.05, F.col("x"))), F.min("x")).alias("p05"),
        F.min_by("c", near).alias("cn"),
        F.min_by("x", near).alias("an"),
        F.coalesce(F.min(F.when(F.col("c") >= 0.95, F.col("x"))), F.max("x")).alias("above"),
    )
    return g.select("p", "p05", F.when(F.col("cn") >= 0.95, F.col("an")).otherwise(F.col("above")).alias("p95"))


def degrees_of_freedom(grid: DataFrame, size: float) -> DataFrame:
    """Independent regions in the aggregate: its area over that of one full window, at least one."""
    full = (2 * math.pi * EARTH_KM / 360 * size) ** 2 / 100
    return grid.agg(F.greatest(zero_sum(F.col("gr_area")) / full, F.lit(1.0)).alias("n_dof"))


def scaled_to(df: DataFrame, metrics: list[str], own: DataFrame, target: DataFrame) -> DataFrame:
    """Spatial series scaled so that their reference means are the target's; both tables one row."""
    one = own.select(*[F.col(m).alias(f"_own_{m}") for m in metrics]).crossJoin(target.select(*[F.col(m).alias(f"_to_{m}") for m in metrics]))
    met = df.crossJoin(F.broadcast(one))  # one row beside every period
    return met.select("p", *[(F.col(m) * F.try_divide(F.col(f"_to_{m}"), F.col(f"_own_{m}"))).alias(m) for m in metrics])
