"""Spatial joins without nested loops: sums over windows, shares of polygons, nearest stations, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exceedra.sources.store import written

EDGE = 1e-9
NOTHING = 1e-9  # a share below this is the rounding of an empty one


# ------------------------------------------------------------------ windows of a lattice


def prefix_sums(lattice: DataFrame, columns: list[str]) -> DataFrame:
    """Two-dimensional running sums of a whole lattice ``(iy, ix, ...)``: along rows, then down columns."""
    along = Window.partitionBy("iy").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("ix").orderBy("iy").rowsBetween(Window.unboundedPreceding, 0)
    rows = lattice.select("iy", "ix", *[F.sum(c).over(along).alias(c) for c in columns])
    return rows.select("iy", "ix", *[F.sum(c).over(down).alias(c) for c in columns])


def window_sums(cells: DataFrame, grid: DataFrame, step: float, columns: list[str]) -> DataFrame:
    """Sums of ``columns`` over each window ``(gr_id, yc, xc, y_off, x_off)``, and ``places``, its lattice points.

    A summed-area table of the lattice is looked up at four corners of a window, so the cost is
    that of the lattice and four rows for each window, however large windows are.  Windows are
    half open like those of the bridge and clamped to the lattice; missing cells add nothing.
    """
    extent = cells.agg(F.max("y").alias("_top"), F.min("y").alias("_low"), F.min("x").alias("_left"), F.max("x").alias("_right"))
    whole = lambda c: F.round(c / step).cast("int")
    extent = extent.select("_top", "_left", whole(F.col("_top") - F.col("_low")).alias("_ny"), whole(F.col("_right") - F.col("_left")).alias("_nx"))
    placed = cells.crossJoin(F.broadcast(extent)).select(whole(F.col("_top") - F.col("y")).alias("iy"), whole(F.col("x") - F.col("_left")).alias("ix"), *columns)  # one row beside every cell
    rows = extent.select("_nx", F.explode(F.sequence(F.lit(0), "_ny")).alias("iy"))
    lattice = rows.select("iy", F.explode(F.sequence(F.lit(0), "_nx")).alias("ix")).join(placed, ["iy", "ix"], "left").fillna(0.0, columns)
    first = lambda c: F.ceil(c / step).cast("int")
    w = grid.crossJoin(F.broadcast(extent)).select(
        "gr_id",
        F.greatest(first(F.col("_top") - F.col("yc") - F.col("y_off") - EDGE), F.lit(0)).alias("t"),
        F.least(first(F.col("_top") - F.col("yc") + F.col("y_off") - EDGE) - 1, F.col("_ny")).alias("b"),
        F.greatest(first(F.col("xc") - F.col("x_off") - EDGE - F.col("_left")), F.lit(0)).alias("l"),
        F.least(first(F.col("xc") + F.col("x_off") - EDGE - F.col("_left")) - 1, F.col("_nx")).alias("r"),
    )
    w = w.withColumn("places", F.greatest(F.col("b") - F.col("t") + 1, F.lit(0)) * F.greatest(F.col("r") - F.col("l") + 1, F.lit(0)))
    corner = lambda y, x, s: F.struct(y.alias("iy"), x.alias("ix"), F.lit(s).alias("s"))
    t, b, l, r = (F.col(c) for c in "tblr")
    corners = F.array(corner(b, r, 1), corner(t - 1, r, -1), corner(b, l - 1, -1), corner(t - 1, l - 1, 1))
    looked = w.filter("places > 0").select("gr_id", F.explode(corners).alias("k")).select("gr_id", "k.iy", "k.ix", "k.s").filter("iy >= 0 and ix >= 0")
    sums = looked.join(prefix_sums(lattice, columns), ["iy", "ix"]).groupBy("gr_id").agg(*[F.sum(F.col("s") * F.col(c)).alias(c) for c in columns])
    return w.select("gr_id", "places").join(sums, "gr_id", "left").fillna(0.0, columns)


def land_windows(sums: DataFrame, least: float) -> DataFrame:
    """Windows at least ``least`` of whose lattice points are land (``land`` of :func:`window_sums`); 0 takes all."""
    share = F.try_divide("land", "places")
    out = sums.withColumn("land_share", share)
    return out.filter(share >= least - EDGE) if least > 0 else out


# ------------------------------------------------------------------ polygons


def _edges(rings: DataFrame, step: float, y0: float, x0: float) -> DataFrame:
    """Directed edges in units of the lattice, ``s`` being their ring's sign: outer rings add, holes take away."""
    own = Window.partitionBy("region", "ring")
    line = own.orderBy("n")
    u, v = (F.col("x") - x0) / step + 0.5, (F.col("y") - y0) / step + 0.5
    p = rings.select("region", "ring", "hole", "n", u.alias("u1"), v.alias("v1"))
    p = p.withColumn("u2", F.coalesce(F.lead("u1").over(line), F.first("u1").over(line))).withColumn("v2", F.coalesce(F.lead("v1").over(line), F.first("v1").over(line)))
    turn = F.sum(F.col("u1") * F.col("v2") - F.col("u2") * F.col("v1")).over(own)
    return p.select("region", "u1", "v1", "u2", "v2", (-F.signum(turn) * F.when(F.col("hole"), -1).otherwise(1)).alias("s"))


def polygon_shares(rings: DataFrame, step: float, y0: float, x0: float) -> DataFrame:
    """Exact share of every lattice cell inside every region: region, iy (upwards), ix, share.

    ``rings (region, ring, hole, n, x, y)`` lists corners in order, the last joined to the
    first; rings may turn either way.  A cell's share is the integral of the region's height
    within the cell, which adds up edge by edge.  An edge is cut at the columns and rows that
    it passes.  In its own cell it adds the area below it, and in all cells below the width
    that it spans, so one running sum down each column fills the inside.
    """
    e = _edges(rings, step, y0, x0).filter("u1 <> u2")
    lo, hi = F.least("u1", "u2"), F.greatest("u1", "u2")
    e = e.select("region", "u1", "v1", "u2", "v2", (F.col("s") * F.signum(F.col("u2") - F.col("u1"))).alias("s"), lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor(lo).cast("int"), F.floor(hi).cast("int"))).alias("ix"))
    e = e.withColumn("a", F.greatest("lo", F.col("ix").cast("double"))).withColumn("b", F.least("hi", F.col("ix") + 1.0)).filter("b > a")
    at = lambda c: F.col("v1") + (F.col(c) - F.col("u1")) / (F.col("u2") - F.col("u1")) * (F.col("v2") - F.col("v1"))
    e = e.select("region", "s", "ix", (F.col("b") - F.col("a")).alias("w"), F.least(at("a"), at("b")).alias("low"), F.greatest(at("a"), at("b")).alias("top"))
    e = e.withColumn("iy", F.explode(F.sequence(F.floor("low").cast("int"), F.floor("top").cast("int"))))
    e = e.withColumn("c", F.greatest("low", F.col("iy").cast("double"))).withColumn("d", F.least("top", F.col("iy") + 1.0)).filter("d > c or top = low")
    width = F.col("s") * F.when(F.col("top") > F.col("low"), F.col("w") * (F.col("d") - F.col("c")) / (F.col("top") - F.col("low"))).otherwise(F.col("w"))
    e = e.withColumn("cover", width).withColumn("part", width * ((F.col("c") + F.col("d")) / 2 - F.col("iy")))
    own = e.groupBy("region", "ix", "iy").agg(F.sum("part").alias("part"), F.sum("cover").alias("cover"))
    down = Window.partitionBy("region", "ix").orderBy(F.desc("iy"))
    above = F.coalesce(F.sum("cover").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = own.withColumn("above", above).withColumn("next", F.lead("iy").over(down))
    cell = lambda y, share: F.struct(y.alias("iy"), share.alias("share"))
    below = F.when(F.col("next") < F.col("iy") - 1, F.transform(F.sequence(F.col("next") + 1, F.col("iy") - 1), lambda y: cell(y, F.col("above") + F.col("cover"))))
    here = F.array(cell(F.col("iy"), F.col("part") + F.col("above")))
    out = own.select("region", "ix", F.explode(F.concat(here, F.coalesce(below, F.slice(here, 1, 0)))).alias("k"))
    return out.select("region", "k.iy", "ix", "k.share").filter(F.col("share") > NOTHING)


def region_cells(cells: DataFrame, rings: DataFrame, step: float) -> DataFrame:
    """region, cell_id and share of the cells ``(cell_id, y, x)`` of a lattice inside polygons; the lattice meets by its indices."""
    shares = polygon_shares(rings, step, 0.0, 0.0)
    at = cells.select("cell_id", F.round(F.col("y") / step).cast("int").alias("iy"), F.round(F.col("x") / step).cast("int").alias("ix"))
    return at.join(shares, ["iy", "ix"]).select("region", "cell_id", "share")


def where_present(mask: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of a mask whose cell has a share of another mask."""
    return mask.join(other.filter("mask_frac > 0").select("cell_id"), "cell_id", "left_semi")


# ------------------------------------------------------------------ stations


def _bucket(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def nearest(points: DataFrame, stations: DataFrame, size: float = 0.5) -> DataFrame:
    """cell_id, station and distance (sum of coordinate differences) of each point's nearest station.

    Points meet the stations of their bucket and its eight neighbours.  What is nearer than a
    bucket's side cannot be beaten from further out; the points left go on with buckets of
    twice the side, until the neighbours hold everything.  Of distances equal to nine decimals the
    least station wins; points without coordinates, or all if there is no station, get none.
    """
    known = points.filter("y is not null and x is not null").select("cell_id", "y", "x")
    left = known
    box = left.select("y", "x").unionByName(stations.select(F.col("sy").alias("y"), F.col("sx").alias("x"))).agg(F.max("y") - F.min("y"), F.max("x") - F.min("x")).first()
    reach = max(box[0] or 0.0, box[1] or 0.0)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    far = F.abs(F.col("y") - F.col("sy")) + F.abs(F.col("x") - F.col("sx"))
    found = None
    while True:
        last = size > reach
        at = left.withColumn("k", F.explode(around)).select("cell_id", "y", "x", (_bucket(F.col("y"), size) + F.col("k.a")).alias("by"), (_bucket(F.col("x"), size) + F.col("k.b")).alias("bx"))
        held = stations.select("station", "sy", "sx", _bucket(F.col("sy"), size).alias("by"), _bucket(F.col("sx"), size).alias("bx"))
        best = at.join(held, ["by", "bx"]).groupBy("cell_id").agg(F.min(F.struct(F.round(far, 9).alias("distance"), "station")).alias("n")).select("cell_id", "n.station", "n.distance")
        best = best if last else best.filter(F.col("distance") < size)
        best = written(best)
        found = best if found is None else found.unionByName(best)
        if last:
            break
        left = written(left.join(best.select("cell_id"), "cell_id", "left_anti"))
        if left.isEmpty():
            break
        size *= 2
    return points.select("cell_id").join(found, "cell_id", "left")


def in_boxes(stations: DataFrame, boxes: DataFrame, tile: float = 1.0) -> DataFrame:
    """Stations that lie in any box ``(south, north, west, east)``, sides included; a semi-join on tiles."""
    span = lambda a, b: F.sequence(_bucket(F.col(a), tile), _bucket(F.col(b), tile))
    tiles = boxes.filter("south <= north and west <= east").withColumn("ty", F.explode(span("south", "north"))).withColumn("tx", F.explode(span("west", "east")))
    s = stations.withColumns({"ty": _bucket(F.col("sy"), tile), "tx": _bucket(F.col("sx"), tile)})
    inside = F.col("s.sy").between(F.col("b.south"), F.col("b.north")) & F.col("s.sx").between(F.col("b.west"), F.col("b.east"))
    return s.alias("s").join(tiles.alias("b"), (F.col("s.ty") == F.col("b.ty")) & (F.col("s.tx") == F.col("b.tx")) & inside, "left_semi").drop("ty", "tx")

