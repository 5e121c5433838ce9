"""Fields in many files: discovery by year, union of what they hold, one owner for each cell and day.

Files are Parquet, named with their variable and year somewhere in the name; a name with two
years or none holds what it holds.  Variables and coordinates may differ from file to file.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.functions.columns import MONTHS
from exceedra.operators.prepare import fill_gaps
from exceedra.sources.tables import station_csv

_YEAR = re.compile(r"(?<!\d)(\d{4})(?!\d)")


@dataclass(frozen=True)
class Found:
    """Files of a scan with the years in their names, and the years that no file is named for."""

    files: tuple[tuple[str, tuple[int, ...]], ...]
    missing: tuple[int, ...]

    @property
    def paths(self) -> list[str]:
        return [p for p, _ in self.files]


def years_in(name: str) -> tuple[int, ...]:
    """Years that a file's name covers: those in it, or all from the first to the last of ``1990to1994`` or ``1990-1994``."""
    span = re.search(r"(?<!\d)(\d{4})(?:to|-|_)(\d{4})(?!\d)", name)
    if span and int(span[1]) <= int(span[2]):
        return tuple(range(int(span[1]), int(span[2]) + 1))
    return tuple(int(y) for y in _YEAR.findall(name))


def discover(spark: SparkSession, path: str, parameter: str, first: int, last: int, seasonal: bool = False) -> Found:
    """Files below ``path`` for the years, a year before them, too, where winters are whole (``seasonal``).

    ``path`` may be a folder, a pattern or one file; patterns and files are taken as they are.
    Only names are listed.  Missing years are a warning and stay in the result.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    single = any(c in path for c in "*?[{") or (fs.exists(where) and fs.getFileStatus(where).isFile()) or path.endswith(".parquet")
    listed = fs.globStatus(where if single else jvm.org.apache.hadoop.fs.Path(where, f"*{parameter}*")) or []
    names = sorted(str(s.getPath().toString()) for s in listed)
    files = [(n, years_in(n.rsplit("/", 1)[-1])) for n in names]
    wanted = range(first - int(seasonal), last + 1)
    if not single:
        files = [(n, y) for n, y in files if set(y) & set(wanted)]
    held = {y for _, ys in files for y in ys}
    missing = () if single else tuple(y for y in wanted if y not in held)
    if missing:
        warnings.warn(f"no file of {parameter} below {path} for {', '.join(map(str, missing))}", stacklevel=2)
    return Found(tuple(files), missing)


def scan(spark: SparkSession, found: Found, keys: list[str], variables: list[str]) -> DataFrame:
    """Rows of all files by ``keys``, the day last, with the variables asked for; files that lack one give NULL for it.

    A file's rows are of the years in its name.

    Two files may hold the same cell and day: each variable is then taken from the last file,
    by name, that has a value.  Only rows of years that several files cover are grouped for
    this; files whose names tell no year count as covering every year.
    """
    if not found.files:
        raise FileNotFoundError("no file to scan")
    day = keys[-1]
    covers: dict[int, int] = {}
    for _, years in found.files:
        for y in years:
            covers[y] = covers.get(y, 0) + 1
    shared = sorted(y for y, n in covers.items() if n > 1)
    unnamed = any(not years for _, years in found.files)
    nan = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    raw = spark.read.option("mergeSchema", "true").parquet(*found.paths)
    known = [v for v in variables if v in raw.columns]
    lacking = sorted(set(variables) - set(known))
    if lacking:
        raise KeyError(f"no file has {', '.join(lacking)}")
    df = raw.select(*keys, *[nan(v) for v in known], F.col("_metadata.file_path").alias("_file"))
    if unnamed and len(found.files) > 1:
        return _owned(df, keys, known)
    if not shared:
        return df.drop("_file")
    doubtful = F.coalesce(F.year(day).isin(shared), F.lit(True))
    return df.filter(~doubtful).drop("_file").unionByName(_owned(df.filter(doubtful), keys, known))


def _owned(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """One row for each key: of each variable the value of the last file that has one."""
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct("_file", v))).alias(v) for v in variables]
    return df.groupBy(*keys).agg(*last)


def extract(df: DataFrame, period: str, first: int | None = None, last: int | None = None, day: str = "d") -> DataFrame:
    """Rows of the years and of the months of a period.

    ``seasonal`` runs from December before the first year to November of the last; without a
    first year it begins with March of the data's own, as its first winter is not whole.
    """
    if period == "seasonal" and first is None:
        start = df.agg(F.min(day).alias("_a"))
        return df.crossJoin(F.broadcast(start)).filter(F.col(day) >= F.make_date(F.year("_a"), F.lit(3), F.lit(1))).drop("_a")  # one row beside every row
    if first is not None and last is not None:
        begins = f"{first - 1}-12-01" if period == "seasonal" else f"{first}-01-01"
        ends = f"{last}-11-30" if period == "seasonal" else f"{last}-12-31"
        df = df.filter(F.to_date(day).between(F.lit(begins).cast("date"), F.lit(ends).cast("date")))
    return df.filter(F.month(day).isin(MONTHS[period])) if period in MONTHS else df


def fill_days(df: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """A row for every key and day of the span; days without one are NULL."""
    keys = df.select(key).distinct()
    spine = keys.select(key, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    return spine.join(df, [key, "d"], "left")


def choose(df: DataFrame, keys: Iterable[str], scope: str | None = None, metrics: Iterable[str] | None = None) -> DataFrame:
    """Keys and result columns of one scope (``cell``, ``gr``, ``agr``), or those of the metrics asked for."""
    keys = list(keys)
    wanted = [c for c in df.columns if c not in keys]
    if scope == "cell":
        wanted = [c for c in wanted if "_gr" not in c and "_agr" not in c]
    elif scope is not None:
        wanted = [c for c in wanted if f"_{scope}" in c]
    if metrics is not None:
        names = tuple(metrics)
        wanted = [c for c in wanted if any(c == m or c.startswith(m + "_") for m in names)]
    return df.select(*keys, *wanted)


def station_file(spark: SparkSession, folder: str, station: str, prefix: str, oldest: str = "18770101") -> str:
    """The CSV of a station: that of the longest record where its name tells one, else the first by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder, f"{prefix}_{station}*.csv")
    names = sorted(str(f.getPath().toString()) for f in where.getFileSystem(conf).globStatus(where) or [])
    if not names:
        raise FileNotFoundError(f"no file of station {station} below {folder}")
    return next((n for n in names if oldest in n.rsplit("/", 1)[-1]), names[0])


def station_series(spark: SparkSession, path: str, column: str, first: int, last: int, period: str = "annual", key: int = 0) -> DataFrame:
    """A station's days ``(cell_id, d, v)``: read, days without a row added, gaps filled by calendar day, cut to the period."""
    raw = station_csv(spark, path, column).withColumn("cell_id", F.lit(key)).filter("d is not null")
    span = raw.agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a is not null")
    days = span.select(F.lit(key).alias("cell_id"), F.explode(F.sequence("a", "b")).alias("d"))
    filled = fill_gaps(days.join(raw, ["cell_id", "d"], "left"))
    return extract(filled, period, first, last).select("cell_id", "d", "v")


def chosen_variable(df: DataFrame, names: dict[str, str], variable: str) -> DataFrame:
    """Renames columns of a raw hourly table and keeps its coordinates and one variable as ``v``."""
    renamed = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    return renamed.select("cell_id", "ts", F.col(variable).cast("double").alias("v"))
