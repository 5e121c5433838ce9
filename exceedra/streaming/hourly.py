"""Daily values and exceedance of hourly streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exceedra.functions.columns import exceedance, exceeds


def daily_maxima(hourly: DataFrame, late: str = "6 hours") -> DataFrame:
    """Largest value of each cell and day of a stream ``(cell_id, ts, v)``; later rows than ``late`` are dropped."""
    day = F.window("ts", "1 day")
    return hourly.withWatermark("ts", late).groupBy("cell_id", day.alias("w")).agg(F.max("v").alias("v")).select("cell_id", F.to_date("w.start").alias("d"), "v")


def exceedances(daily: DataFrame, cells: DataFrame, low: bool = False) -> DataFrame:
    """Magnitude and count of a stream of daily values; thresholds are a static dimension."""
    x = daily.join(cells.select("cell_id", "thr"), "cell_id").withColumn("dtem", exceedance(F.col("v"), F.col("thr"), low))
    return x.withColumn("dtec", exceeds(F.col("dtem")))
