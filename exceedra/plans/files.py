"""Registered queries of fields in many files, written from the synthetic field first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.plans.queries import DAILY, RAIN, r6, register, sql6
from exceedra.sources import scan, tables
from exceedra.sources.store import scratch_root


def yearly_files(s: SparkSession, d: str) -> str:
    """Temperature by year, 1997 missing; rain in another file of 1998; a correction of some cells over two years."""
    root = scratch_root(s)
    t = tables.daily(s, d).withColumnRenamed("v", "tx")
    rain = tables.rain(s, d).withColumnRenamed("v", "rr")
    year = F.year("d")
    for y in (1995, 1996, 1998, 1999):
        t.filter(year == y).write.parquet(f"{root}/Tx_{y}_daily")
    rain.filter(year == 1998).write.parquet(f"{root}/Tx-rain_{y - 1}")
    t.filter(year.between(1998, 1999) & (F.col("cell_id") % 3 == 0)).select("cell_id", "d", (F.col("tx") + 100).alias("tx")).write.parquet(f"{root}/Tx_corrected_1998to1999")
    t.filter(year == 1998).select("cell_id", "d", (F.col("tx") * 0).alias("tx")).write.parquet(f"{root}/other_1998")
    return root


@register(
    "scan_files",
    f"WITH {DAILY}, {RAIN}, z AS (SELECT cell_id, d, CASE WHEN year(d) >= 1998 AND cell_id % 3 = 0 THEN daily.v + 100 ELSE daily.v END AS tx, CASE WHEN year(d) = 1998 THEN rain.v END AS rr FROM daily JOIN rain USING (cell_id, d) WHERE year(d) IN (1996, 1998, 1999)) " + sql6("tx, rr", "z", "cell_id, d"),
)
def _(s, d):
    """Files of 1996 to 1999: one year is missing, another is in four files of two variables."""
    root = yearly_files(s, d)
    found = scan.discover(s, root, "Tx", 1996, 1999)
    if found.missing != (1997,):
        raise ValueError(f"missing years are {found.missing}")
    return r6(scan.scan(s, found, ["cell_id", "d"], ["tx", "rr"]))


@register(
    "seasonal_extract",
    f"WITH {DAILY} " + sql6("v", "daily WHERE d BETWEEN DATE '1996-12-01' AND DATE '1998-11-30'", "cell_id, d"),
)
def _(s, d):
    return r6(scan.extract(tables.daily(s, d), "seasonal", 1997, 1998).select("cell_id", "d", "v"))


def whole_days(s: SparkSession, d: str) -> DataFrame:
    return scan.fill_days(tables.daily(s, d), "cell_id", "1996-01-01", "1996-12-31")


@register("filled_days", f"WITH {DAILY}, k AS (SELECT DISTINCT cell_id FROM daily), g AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY))::DATE AS d), z AS (SELECT cell_id, d, v FROM k CROSS JOIN g LEFT JOIN daily USING (cell_id, d)) " + sql6("v", "z", "cell_id, d"))
def _(s, d):
    return r6(whole_days(s, d).select("cell_id", "d", "v"))
