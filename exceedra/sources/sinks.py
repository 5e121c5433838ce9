"""Sinks: rounded result tables under a fixed path grammar, with their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_name(level: str, parameter: str, region: str, period: str, dataset: str, first: int, last: int, scope: str = "") -> str:
    """DBV, CTP, DEC and AF tables are told apart by level, region, period and years."""
    return "_".join([level, parameter, *([scope] if scope else []), region, period, dataset, f"{first}to{last}"])


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to so many decimals, halves to even; -1 leaves them."""
    if digits < 0:
        return df
    return df.select(*[F.bround(f"`{c}`", digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def save(df: DataFrame, path: str, digits: int = 2, partition_by: tuple[str, ...] = ()) -> None:
    rounded(df, digits).write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def export_means(df: DataFrame, metric: str, path: str) -> None:
    """Regional mean of a metric by period as CSV with one decimal."""
    df.groupBy("p").agg(F.format_string("%.1f", F.avg(metric)).alias(metric)).orderBy("p").write.mode("overwrite").csv(path, header=True)


def with_means(dec: DataFrame, means: DataFrame, key: str) -> DataFrame:
    """A decadal table with the ``_CC`` and ``_ref`` means of its series beside each row; older ones are replaced."""
    keep = [c for c in dec.columns if c == key or c not in means.columns]
    return dec.select(*keep).join(means, key, "left")


def aggregate_columns(df: DataFrame, scope: str = "_agr") -> DataFrame:
    """Only the label and the columns of the aggregate scope."""
    return df.select("p", *[c for c in df.columns if scope in c])


def packed16(df: DataFrame, column: str, scale: float = 0.1, missing: int = -9999) -> DataFrame:
    """A double as a scaled 16-bit integer; missing values as ``missing``."""
    return df.withColumn(column, F.coalesce(F.bround(F.col(column) / scale), F.lit(missing)).cast("smallint"))


def unpacked16(df: DataFrame, column: str, scale: float = 0.1, missing: int = -9999) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) != missing, F.col(column) * F.lit(scale)))
