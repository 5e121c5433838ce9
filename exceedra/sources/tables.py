"""Sources: fields, cells and station series as canonical tables, and result tables.

Canonical forms: ``cell (cell_id, y, x, mask_frac, area, gr_id, thr)``, ``daily (cell_id, d, v)``
and ``hourly (cell_id, ts, v)``.  NaN becomes NULL here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from exceedra.functions.columns import area_latlon

STEP = 0.5


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the synthetic data; its schema is looked up once in a session, not by a job for each use."""
    path = f"{sf_dir}/{name}.parquet"
    key = spark.sparkContext.applicationId, path
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def field(spark: SparkSession, path: str, first_year: int, last_year: int, seasonal: bool = False) -> DataFrame:
    """A field partitioned by ``year``; the filter prunes partitions."""
    df = spark.read.parquet(path).filter(F.col("year").between(first_year - int(seasonal), last_year))
    return df.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def station_csv(spark: SparkSession, path: str, parameter: str) -> DataFrame:
    """A station's series: columns time and the parameter."""
    raw = spark.read.csv(path, header=True)  # by name, wherever the columns stand
    return raw.select(F.to_date(F.substring("time", 1, 10)).alias("d"), F.nanvl(F.col(f"`{parameter}`").cast("double"), F.lit(None).cast("double")).alias("v"))


def wide_stations(df: DataFrame) -> DataFrame:
    """Long station rows (d, id, v) to one column for each station."""
    return df.groupBy("d").pivot("id").agg(F.first("v"))


def long_stations(df: DataFrame) -> DataFrame:
    """One column for each station to long rows (ts, id, v)."""
    return df.unpivot("ts", [c for c in df.columns if c != "ts"], "id", "v")


# ---- the synthetic grid that the driver's tables stand for


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 cells on a lattice of half degrees, one for each nation; regions are regions."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell_id"), F.col("n_regionkey").alias("gr_id"))
    row, col = F.floor(F.col("cell_id") / 5), F.col("cell_id") % 5
    n = n.withColumn("y", 46.0 - STEP * row).withColumn("x", 9.0 + STEP * col)
    border = (row == 0) | (row == 4) | (col == 0) | (col == 4)
    n = n.withColumn("mask_frac", F.when(F.col("cell_id") == 24, None).when(border, 0.5).otherwise(1.0))
    return n.withColumn("area", area_latlon(F.col("y"), STEP, STEP) * F.col("mask_frac")).filter("mask_frac > 0")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    x = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("s_nationkey").alias("cell_id"), F.to_date("l_shipdate").alias("d")).agg((F.max("l_extendedprice") / 1000).alias("v"))


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    x = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("s_nationkey").alias("cell_id"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("v"))


def altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A height and a share of land for each cell of the synthetic grid."""
    c = cells(spark, sf_dir)
    return c.select("cell_id", "y", "x", "mask_frac", "area", "gr_id", (F.col("cell_id") * 97 % 13 * 150.0).alias("altitude"), (F.col("cell_id") * 31 % 10 / 10.0).alias("lsm"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 25).cast("int").alias("cell_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("v"))
