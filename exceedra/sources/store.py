"""Stored levels: result tables partitioned by run and span, with pruning, precedence and upserts.

Layout: ``root/level/run=<name>/span=<YYYYtoYYYY>/``.  Saving a span replaces that span alone.
Loading prunes partitions by the overlap of spans with the years asked for; where stored spans
share years, one span wins for each key.  Columns carry their metadata through Parquet.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.sources.sinks import rounded

LEVELS = ("DBV", "CTP", "DEC", "AF", "STATIC")
REFERENCE = "ref"  # the span name of reference results, which no load by years takes
_LOCAL: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """A fresh folder below the shared one of ``spark.checkpoint.dir``; on a local master a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="levels-"))
        base = _LOCAL[0]
    path = f"{base.rstrip('/')}/levels-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and lost executors cost nothing but their tasks."""
    path = scratch_root(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def span_name(first: int, last: int) -> str:
    if first > last:
        raise ValueError(f"{first} to {last} runs backwards")
    return f"{first:04d}to{last:04d}"


def merge_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed full-outer merge; where both sides have a row, the left side's columns win.

    A column that both have takes the left value, and the right one only for keys that the
    left side lacks or where it is missing; columns of one side stay missing for the other's
    keys.  Null keys meet each other.  Keys are unique on either side; a repeated key would
    pair up with all rows of the other, so it is an error left to the caller's grouping.
    """
    met = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    both = left.alias("l").join(right.alias("r"), met, "full_outer")
    value = lambda c: F.coalesce(f"l.{c}", f"r.{c}") if c in left.columns and c in right.columns else F.col(f"l.{c}" if c in left.columns else f"r.{c}")
    meta = {f.name: f.metadata for x in (right, left) for f in x.schema}
    names = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    return both.select(*[value(c).alias(c, metadata=meta[c]) for c in names])


@dataclass(frozen=True)
class LevelStore:
    """Result tables of one output folder."""

    spark: SparkSession
    root: str

    def path(self, level: str) -> str:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}")
        return f"{self.root.rstrip('/')}/{level}"

    def spans(self, level: str, run: str) -> list[str]:
        """Stored spans of a run, from the folder names alone."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path(level)}/run={run}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(s.getPath().getName().removeprefix("span=") for s in fs.listStatus(folder) if s.getPath().getName().startswith("span="))

    def save(self, df: DataFrame, level: str, run: str, first: int, last: int, digits: int = -1, reference: bool = False) -> None:
        """Writes one span; partitions of other runs and spans are left as they are."""
        span = REFERENCE if reference else span_name(first, last)
        out = rounded(df, digits).withColumns({"run": F.lit(run), "span": F.lit(span)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("run", "span").parquet(self.path(level))

    def read(self, level: str, run: str, spans: Iterable[str]) -> DataFrame:
        """Rows of some spans with their ``span``; files of differing columns are merged."""
        spans = list(spans)
        if not spans:
            raise FileNotFoundError(f"no stored {level} of {run!r}")
        df = self.spark.read.option("mergeSchema", "true").parquet(self.path(level))
        return df.filter((F.col("run") == run) & F.col("span").isin(spans)).drop("run")

    def load(self, level: str, run: str, first: int, last: int, keys: list[str], label: str = "p") -> DataFrame:
        """Rows of all spans that overlap the years, one for each key and label.

        Years that one span covers are read as they are.  Rows of years in several spans, and
        of the year before each span's first (labels of winters lie there), are grouped, and
        the span that begins last wins, of equal ones the longer.
        """
        held = [s for s in self.spans(level, run) if s != REFERENCE and int(s[:4]) <= last and int(s[6:10]) >= first]
        df = self.read(level, run, held)
        covers = [set(range(int(s[:4]) - 1, int(s[6:10]) + 1)) for s in held]
        shared = sorted({y for i, a in enumerate(covers) for b in covers[:i] for y in a & b})
        if not shared:
            return df.drop("span")
        values = [c for c in df.columns if c not in (*keys, label, "span")]
        doubtful = F.coalesce(F.year(label).isin(shared), F.lit(True))
        rank = F.struct(F.substring("span", 1, 4), F.substring("span", 7, 4))
        winner = df.filter(doubtful).groupBy(*keys, label).agg(F.max_by(F.struct(*values), rank).alias("w"))
        meta = {f.name: f.metadata for f in df.schema}
        won = winner.select(*keys, label, *[F.col(f"w.{c}").alias(c, metadata=meta[c]) for c in values])
        return df.filter(~doubtful).drop("span").unionByName(won)

    def upsert(self, df: DataFrame, level: str, run: str, first: int, last: int, keys: list[str], digits: int = -1) -> None:
        """Merges rows into a stored span, the new ones winning; an absent span is created.

        The merged rows are written beside the table first, as a job cannot replace what it reads.
        """
        span = span_name(first, last)
        if span not in self.spans(level, run):
            return self.save(df, level, run, first, last, digits)
        old = self.read(level, run, [span]).drop("span")
        return self.save(written(merge_left(df, old, keys)), level, run, first, last, digits)

    def load_or_build(self, level: str, run: str, first: int, last: int, build, recalculate: bool = False, digits: int = -1) -> DataFrame:
        """A stored span, built and saved first where it is missing or has to be made anew."""
        span = span_name(first, last)
        if recalculate or span not in self.spans(level, run):
            self.save(build(), level, run, first, last, digits)
        return self.read(level, run, [span]).drop("span")

    def static(self, name: str) -> DataFrame | None:
        """A stored static table (mask, area, threshold) of no particular years; None where there is none."""
        held = self.spans("STATIC", name)
        return self.read("STATIC", name, held[-1:]).drop("span") if held else None

    def mask(self, dataset: str, kind: str = "polygon", region: str = "", corners: tuple[float, float, float, float] | None = None, altitude: int | None = None) -> DataFrame:
        """The stored mask of a named region, or of a box given by its ``corners`` (south, west, north, east)."""
        found = self.static(mask_name(dataset, kind, region, corners, altitude))
        if found is None:
            raise FileNotFoundError(f"no stored mask {mask_name(dataset, kind, region, corners, altitude)}")
        return found

    def land_sea_mask(self, dataset: str, region: str, altitude: int | None = None) -> DataFrame:
        """The mask that tells land from sea; every part of Europe uses that of the whole."""
        return self.mask(dataset, region="EUR" if "EUR" in region else region, altitude=altitude)


def mask_name(dataset: str, kind: str = "polygon", region: str = "", corners: tuple[float, float, float, float] | None = None, altitude: int | None = None) -> str:
    """Name of a mask by kind: ``polygon`` by region and height, ``corners`` and ``center`` by the box's corners."""
    if kind == "polygon":
        return "-".join(["mask", region, dataset, *([str(altitude)] if altitude is not None else [])])
    if kind not in ("corners", "center") or corners is None:
        raise ValueError(f"a mask of kind {kind!r} needs its corners")
    south, west, north, east = corners
    return f"mask-SW_{south:.1f}_{west:.1f}-NE_{north:.1f}_{east:.1f}-{dataset}"


def box_of(center: tuple[float, float], height: float, width: float) -> tuple[float, float, float, float]:
    """Corners of a box around its centre (latitude, longitude)."""
    return center[0] - height / 2, center[1] - width / 2, center[0] + height / 2, center[1] + width / 2
