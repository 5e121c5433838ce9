"""Daily basis variables: exceedance per cell, events, aggregation to regions, hourly operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exceedra.functions.columns import exceedance, exceeds, zero_sum

MIN_AREA = 0.0001


def on_spine(daily: DataFrame, cells: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """``daily (cell_id, d, v)`` with a row for every cell and day; missing values NULL.

    Days and cells are dimensions; their product is made from the day list, cell by cell.
    """
    if first and last:
        days = cells.select("cell_id", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    else:
        span = daily.agg(F.min("d").alias("_a"), F.max("d").alias("_b"))  # one row, found when the plan runs
        days = cells.select("cell_id").crossJoin(F.broadcast(span)).select("cell_id", F.explode(F.sequence("_a", "_b")).alias("d"))
    return days.join(daily, ["cell_id", "d"], "left")


def cell_exceedance(field: DataFrame, cells: DataFrame, low: bool = False) -> DataFrame:
    """dtem, dtec and dtea of ``field (cell_id, d, v)`` with ``cells (cell_id, thr, area)``."""
    joined = field.join(cells.select("cell_id", "thr", "area"), "cell_id")
    out = joined.withColumn("dtem", exceedance(F.col("v"), F.col("thr"), low))
    return out.withColumn("dtec", exceeds(F.col("dtem"))).withColumn("dtea", F.col("dtec") * F.col("area"))


def mark_events(df: DataFrame, key: str, flag: str, out: str) -> DataFrame:
    """1 at the middle of each run of ``flag = 1``, else 0; a missing value ends a run."""
    w = Window.partitionBy(key).orderBy("d")
    on = F.coalesce(F.col(flag), F.lit(0))
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_on", on)
    df = df.withColumn("_run", F.col("_rn") - F.sum("_on").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_on", "_run")
    middle = F.floor((F.min("_rn").over(run) + F.max("_rn").over(run)) / 2)
    return df.withColumn(out, ((F.col("_on") == 1) & (F.col("_rn") == middle)).cast("int")).drop("_rn", "_on", "_run")


def region_days(dbv: DataFrame, cells: DataFrame, min_area: float = MIN_AREA) -> DataFrame:
    """Region scope: one aggregate over the exceeding cells of a region and day."""
    bridge = cells.select("cell_id", "gr_id")
    sums = dbv.join(bridge, "cell_id").groupBy("gr_id", "d").agg(
        zero_sum(F.col("dtea")).alias("dtea_gr"), zero_sum(F.col("dtem") * F.col("area")).alias("ma"), F.coalesce(F.max("dtem"), F.lit(0.0)).alias("top")
    )
    return region_metrics(sums, min_area)


def region_series(field: DataFrame, cells: DataFrame, min_area: float = MIN_AREA, low: bool = False) -> DataFrame:
    """Region days straight from ``field (cell_id, d, v)``: only exceedances are added up, days without one filled in after.

    The same rows as :func:`region_days` over a whole spine: every region with a cell in
    ``cells (cell_id, gr_id, thr, area)`` has every day from the field's first to its last.
    """
    x = field.join(cells.select("cell_id", "gr_id", "thr", "area"), "cell_id").withColumn("dtem", exceedance(F.col("v"), F.col("thr"), low)).filter("dtem > 0")
    sums = x.groupBy("gr_id", "d").agg(F.sum("area").alias("dtea_gr"), F.sum(F.col("dtem") * F.col("area")).alias("ma"), F.max("dtem").alias("top"))
    span = field.agg(F.min("d").alias("_a"), F.max("d").alias("_b"))
    days = cells.select("gr_id").distinct().crossJoin(F.broadcast(span)).select("gr_id", F.explode(F.sequence("_a", "_b")).alias("d"))  # one row beside every region
    return region_metrics(days.join(sums, ["gr_id", "d"], "left").fillna(0.0, ["dtea_gr", "ma", "top"]), min_area)


def region_metrics(sums: DataFrame, min_area: float = MIN_AREA) -> DataFrame:
    on = F.col("dtea_gr") >= min_area
    out = sums.withColumn("dtec_gr", on.cast("int"))
    out = out.withColumn("dtem_gr", F.when(on & (F.col("dtea_gr") > 0), F.col("ma") / F.col("dtea_gr")).otherwise(0.0))
    out = out.withColumn("dtem_max_gr", F.when(on, F.col("top")).otherwise(0.0)).drop("ma", "top")
    return out.withColumn("dtema_gr", F.col("dtem_gr") * F.col("dtea_gr"))


def region_sizes(cells: DataFrame) -> DataFrame:
    """gr_size, the area of all cells of a region, and the mean threshold over it, to which cells without one add nothing."""
    return cells.groupBy("gr_id").agg(zero_sum(F.col("area")).alias("gr_size"), F.try_divide(zero_sum(F.col("thr") * F.col("area")), F.sum("area")).alias("threshold_avg_gr"))


def hourly_days(hourly: DataFrame, cells: DataFrame, low: bool = False) -> DataFrame:
    """Exposure hours of each cell and day of ``hourly (cell_id, ts, v)``."""
    x = hourly.join(cells.select("cell_id", "thr", "area"), "cell_id").withColumn("m", exceedance(F.col("v"), F.col("thr"), low))
    x = x.withColumn("h", F.hour("ts")).withColumn("d", F.to_date("ts")).withColumn("on", exceeds(F.col("m")))
    hour = F.when(F.col("on") == 1, F.col("h"))
    out = x.groupBy("cell_id", "d").agg(
        zero_sum(F.col("on").cast("double")).alias("nhours"),
        F.min(hour).alias("t_hfirst"),
        F.max(hour).alias("t_hlast"),
        F.min_by(hour, F.when(F.col("on") == 1, F.struct(-F.col("m"), F.col("h")))).alias("t_hmax"),  # of ties the first hour
        F.first("area").alias("area"),
    )
    return out.withColumn("h_rise", F.col("t_hmax") - F.col("t_hfirst") + 0.5).withColumn("h_set", F.col("t_hlast") - F.col("t_hmax") + 0.5)


def hourly_region(hours: DataFrame, dbv: DataFrame, cells: DataFrame) -> DataFrame:
    """Exposure hours of regions, weighted by exceeding area."""
    x = hours.select("cell_id", "d", "nhours", "t_hfirst", "t_hlast", "t_hmax", "h_rise", "h_set").join(dbv.select("cell_id", "d", "dtea"), ["cell_id", "d"])
    x = x.join(cells.select("cell_id", "gr_id"), "cell_id")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("dtea")), F.sum("dtea"))
    names = ["t_hfirst", "t_hlast", "t_hmax", "h_rise", "h_set"]
    g = x.groupBy("gr_id", "d").agg(F.coalesce(mean("nhours"), F.lit(0.0)).alias("nhours_gr"), *[mean(c).alias(f"{c}_gr") for c in names])
    return g.select("gr_id", "d", "nhours_gr", *[F.when(F.col("nhours_gr") > 0, F.col(f"{c}_gr")).alias(f"{c}_gr") for c in names])


def on_exceedance_days(hourly: DataFrame, days: DataFrame, cells: DataFrame) -> DataFrame:
    """Hours of days on which the cell's region is in exceedance (``dtec_gr = 1``)."""
    hot = days.filter("dtec_gr = 1").select("gr_id", "d")
    at = hourly.join(cells.select("cell_id", "gr_id"), "cell_id").withColumn("d", F.to_date("ts"))
    return at.join(hot, ["gr_id", "d"], "left_semi").select("cell_id", "ts", "v")


def network_days(dbv: DataFrame) -> DataFrame:
    """Station network: any station counts, magnitudes add up."""
    return dbv.groupBy("gr_id", "d").agg(F.max("dtec").alias("dtec_gr"), zero_sum(F.col("dtem")).alias("dtem_gr"))


def network_events(dbv: DataFrame) -> DataFrame:
    """Days of a station network with the mark of each event."""
    return mark_events(network_days(dbv), "gr_id", "dtec_gr", "dteec_gr")


def relative_area(days: DataFrame, sizes: DataFrame) -> DataFrame:
    """Exceedance area of a region in percent of its size."""
    return days.join(sizes.select("gr_id", "gr_size"), "gr_id").withColumn("dtea_rel_gr", 100 * F.try_divide("dtea_gr", "gr_size"))
