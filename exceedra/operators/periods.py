"""Climatic-period metrics of cells and regions: one aggregate for each scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exceedra.functions.columns import DAYS_PER_MONTH, HEAT_CONTENT, OVER_NEW_YEAR, PERIODS, full_sum, in_period, per, period_label


def labelled(df: DataFrame, period: str) -> DataFrame:
    """Rows of the period's months with the label ``p``."""
    if period not in PERIODS:
        raise ValueError(f"unknown climatic period {period!r}")
    return df.filter(in_period(F.col("d"), period)).withColumn("p", period_label(F.col("d"), period))


def trim(df: DataFrame, key: str, period: str) -> DataFrame:
    """Without the first and last label where the period runs over new year."""
    if period not in OVER_NEW_YEAR:
        return df
    w = Window.partitionBy(key)
    ends = df.withColumn("_a", F.min("p").over(w)).withColumn("_b", F.max("p").over(w))
    return ends.filter((F.col("p") != F.col("_a")) & (F.col("p") != F.col("_b"))).drop("_a", "_b")


def _derived(df: DataFrame, s: str) -> DataFrame:
    c = lambda n: F.col(n + s)
    df = df.withColumn("ed_avg" + s, per(c("ed"), c("ef"))).withColumn("em_avg" + s, per(c("em"), c("ed")))
    df = df.withColumn("em_md" + s, c("ed") * c("em_avg_md")).withColumn("dm_avg" + s, c("ed_avg") * c("em_avg"))
    return df.withColumn("aep" + s, F.when(c("ef") == 0, 0.0).otherwise((c("doy_last") - c("doy_first") + 1) / DAYS_PER_MONTH))


def cell_periods(dbv: DataFrame, period: str) -> DataFrame:
    """``dbv (cell_id, d, dtem, dtec, dteec)`` to periods; a missing day leaves sums missing."""
    event_day = F.when(F.col("dteec") > 0, F.dayofyear("d"))
    out = labelled(dbv, period).groupBy("cell_id", "p").agg(
        full_sum(F.col("dtec")).cast("double").alias("ed"),
        F.sum("dteec").cast("double").alias("_ef"),
        full_sum(F.col("dtem")).alias("em"),
        F.coalesce(F.median(F.when(F.col("dtem") > 0, F.col("dtem"))), F.lit(0.0)).alias("em_avg_md"),
        F.min(event_day).alias("doy_first"),
        F.max(event_day).alias("doy_last"),
    )
    out = out.withColumn("ef", F.when(F.col("ed").isNotNull(), F.coalesce("_ef", F.lit(0.0)))).drop("_ef")
    return trim(_derived(out, ""), "cell_id", period)


def region_periods(days: DataFrame, period: str) -> DataFrame:
    """``days (gr_id, d, dtea_gr, dtec_gr, dtem_gr, dtem_max_gr, dtema_gr, dteec_gr)`` to periods."""
    event_day = F.when(F.col("dteec_gr") > 0, F.dayofyear("d"))
    out = labelled(days, period).groupBy("gr_id", "p").agg(
        F.sum("dtec_gr").cast("double").alias("ed_gr"),
        F.sum("dteec_gr").cast("double").alias("ef_gr"),
        F.sum("dtem_gr").alias("em_gr"),
        F.coalesce(F.median(F.when(F.col("dtem_gr") > 0, F.col("dtem_gr"))), F.lit(0.0)).alias("em_avg_md_gr"),
        F.sum("dtem_max_gr").alias("em_max_gr"),
        F.sum("dtema_gr").alias("tex_gr"),
        F.min(event_day).alias("doy_first_gr"),
        F.max(event_day).alias("doy_last_gr"),
    )
    out = _derived(out, "_gr")
    out = out.withColumn("em_avg_max_gr", F.try_divide("em_max_gr", "ed_gr")).withColumn("ea_avg_gr", per(F.col("tex_gr"), F.col("em_gr")))
    out = out.withColumn("es_avg_gr", F.col("ed_avg_gr") * F.col("em_avg_gr") * F.col("ea_avg_gr"))
    out = out.withColumn("h_aehc_avg_gr", HEAT_CONTENT * F.try_divide("es_avg_gr", "ed_avg_gr")).withColumn("h_aehc_gr", HEAT_CONTENT * F.col("tex_gr"))
    return trim(out, "gr_id", period)


def hourly_periods(hours: DataFrame, key: str, period: str, suffix: str = "") -> DataFrame:
    """Mean exposure, rise and set hours per period."""
    c = lambda n: F.col(n + suffix)
    return labelled(hours, period).groupBy(key, "p").agg(
        F.coalesce(F.avg(F.when(c("nhours") > 0, c("nhours"))), F.lit(0.0)).alias("h_avg" + suffix), F.avg(c("h_rise")).alias("h_rise_avg" + suffix), F.avg(c("h_set")).alias("h_set_avg" + suffix)
    )


def with_hours(periods: DataFrame, hours: DataFrame, key: str, suffix: str = "") -> DataFrame:
    """Metrics times exposure hours: htEX, and for regions hTEX and hES."""
    out = periods.join(hours, [key, "p"], "left").withColumn("htex" + suffix, F.col("em" + suffix) * F.col("h_avg" + suffix))
    if suffix:
        out = out.withColumn("htotal_ex" + suffix, F.col("tex" + suffix) * F.col("h_avg" + suffix)).withColumn("hes_avg" + suffix, F.col("es_avg" + suffix) * F.col("h_avg" + suffix))
    return out


def fill_linear(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Missing values between two present ones on the straight line through them, by row."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    row = F.row_number().over(w)
    df = df.withColumn("_n", row)
    at = F.when(F.col(value).isNotNull(), F.struct("_n", F.col(value).alias("v")))
    df = df.withColumn("_a", F.last(at, True).over(before)).withColumn("_b", F.first(at, True).over(after))
    share = (F.col("_n") - F.col("_a._n")) / F.greatest(F.col("_b._n") - F.col("_a._n"), F.lit(1))
    return df.withColumn(value, F.coalesce(value, F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")))).drop("_n", "_a", "_b")
