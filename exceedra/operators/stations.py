"""Station series: metrics over stated spans, unions of differing tables, natural variability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = ("ef", "ed_avg", "em_avg", "dm_avg")


def april_to_october(days: DataFrame) -> DataFrame:
    """Spans ``(p, first, last)`` of the months April to October of every year of the days."""
    years = days.agg(F.year(F.min("d")).alias("a"), F.year(F.max("d")).alias("b")).filter("a is not null")
    y = years.select(F.explode(F.sequence("a", "b")).alias("y"))
    return y.select(F.make_date("y", F.lit(4), F.lit(1)).alias("p"), F.make_date("y", F.lit(4), F.lit(1)).alias("first"), F.make_date("y", F.lit(10), F.lit(31)).alias("last"))


def in_spans(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Each day with every span ``(p, first, last)`` that holds it; spans may overlap, have gaps or be empty.

    The interval join is an equi-join on months: a day is in one, a span in those it touches.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    bins = spans.filter(F.col("first") <= F.col("last")).withColumn("_m", F.explode(F.sequence(month("first"), month("last"))))
    met = days.withColumn("_m", month("d")).join(bins, "_m")
    return met.filter(F.col("d").between(F.col("first"), F.col("last"))).drop("_m", "first", "last")


def span_metrics(days: DataFrame, spans: DataFrame, key: str, suffix: str = "") -> DataFrame:
    """Frequency, duration, median magnitude and their products over spans of ``days (key, d, dtem, dtec, dteec)``.

    A span without exceedance has no duration; its median lies on the straight line in time
    between the spans around it, and is missing outside the first and last.
    """
    c = lambda n: F.col(n + suffix)
    out = in_spans(days, spans).groupBy(key, "p").agg(
        F.sum(c("dteec")).cast("double").alias("ef" + suffix), F.sum(c("dtec")).cast("double").alias("ed" + suffix), F.median(F.when(c("dtem") > 0, c("dtem"))).alias("em_avg" + suffix)
    )
    out = out.withColumn("ed_avg" + suffix, F.try_divide(c("ed"), c("ef")))
    out = fill_between(out, key, "p", "em_avg" + suffix)
    out = out.withColumn("t_ex" + suffix, c("ef") * c("ed_avg") * c("em_avg"))
    return out.withColumn("fm" + suffix, c("ef") * c("em_avg"))


def fill_between(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Missing values between two present ones on the straight line through them in time."""
    w = Window.partitionBy(key).orderBy(day)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))
    df = df.withColumn("_a", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    share = F.datediff(day, "_a.d") / F.greatest(F.datediff("_b.d", "_a.d"), F.lit(1))
    return df.withColumn(value, F.coalesce(value, F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")))).drop("_a", "_b")


def station_union(tables: list[tuple[str, DataFrame, int | None]], columns: list[str]) -> DataFrame:
    """Rows ``(station, p, ...)`` of tables that may lack columns, each from its first year on.

    A column that no table has is an error; one that a table lacks is missing for its station.
    """
    held = {c for _, df, _ in tables for c in df.columns}
    if absent := [c for c in columns if c not in held]:
        raise KeyError(f"no station has {', '.join(absent)}")
    own = []
    for name, df, first in tables:
        some = df if first is None else df.filter(F.year("p") >= first)
        own.append(some.select(F.lit(name).alias("station"), "p", *[c for c in columns if c in df.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own).select("station", "p", *columns)


def reference_deviation(df: DataFrame, keys: list[str], metrics: list[str], first: str, last: str) -> DataFrame:
    """Standard deviation of factors over the centre years of the reference period."""
    some = df.filter(F.col("p").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return some.groupBy(*keys).agg(*[F.stddev_pop(m).alias(m) for m in metrics])


def natural_bounds(stations: DataFrame, regions: DataFrame, group: str, first: str, last: str, until: str) -> DataFrame:
    """Natural variability of factors, upper and lower, with event area carried through.

    ``stations (group, station, p, ef, ed_avg, em_avg, dm_avg)`` and ``regions (group, p, ...,
    ea_avg)`` hold factors about 1.  For each of the four: the root mean square of the
    stations' deviations above and below 1, up to ``until``, scaled by the region's deviation
    in the reference years over the stations' pooled one.  Area: the bounds of ``dm_avg``
    scaled by the ratio of the region's own deviations of the two.  Severity and total
    extremity: squares of independent parts added up.
    """
    pooled = reference_deviation(stations, [group, "station"], list(PARTS), first, last)
    pooled = pooled.groupBy(group).agg(*[F.sqrt(F.try_divide(F.sum(F.col(m) * F.col(m)), F.count("station"))).alias(f"_{m}") for m in PARTS])
    own = reference_deviation(regions, [group], list(PARTS), first, last)
    scale = own.join(pooled, group).select(group, *[F.try_divide(F.col(m), F.col(f"_{m}")).alias(f"scale_{m}") for m in PARTS])
    early = stations.filter(F.col("p") <= F.lit(until).cast("date"))
    sides = {"upper": lambda x: x >= 1, "lower": lambda x: x < 1}
    part = lambda m, on: F.try_divide(F.sum(F.when(on(F.col(m)), F.pow(F.col(m) - 1, 2))), F.count(F.when(on(F.col(m)), 1)))
    each = early.groupBy(group, "station").agg(*[part(m, on).alias(f"{m}_{side}") for m in PARTS for side, on in sides.items()])
    mean = each.groupBy(group).agg(*[F.sqrt(F.avg(f"{m}_{side}")).alias(f"{m}_{side}") for m in PARTS for side in sides])
    nv = mean.join(scale, group).select(group, *[F.col(f"scale_{m}") for m in PARTS], *[(F.col(f"{m}_{side}") * F.col(f"scale_{m}")).alias(f"nv_{m}_{side}") for m in PARTS for side in sides])
    about = lambda m: F.sqrt(F.avg(F.pow(F.col(m) - 1, 2)))
    some = regions.filter(F.col("p").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    ratio = some.groupBy(group).agg(F.try_divide(about("ea_avg"), about("dm_avg")).alias("scale_ea_dm"))
    out = nv.join(ratio, group)
    for side in sides:
        square = lambda m, s=side: F.pow(F.col(f"nv_{m}_{s}"), 2)
        out = out.withColumn(f"nv_ea_avg_{side}", F.col("scale_ea_dm") * F.col(f"nv_dm_avg_{side}"))
        out = out.withColumn(f"nv_es_avg_{side}", F.sqrt(square("dm_avg") + square("ea_avg"))).withColumn(f"nv_tex_{side}", F.sqrt(square("ef") + square("es_avg")))
    return out
