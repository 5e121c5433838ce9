"""The aggregate of a lattice of regions: bias-scaled means, factors, spreads and percentiles in one chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exceedra.functions.columns import geometric_mean
from exceedra.operators import decadal, regions
from exceedra.sources.store import written

BASIC = ("ef", "ed_avg", "em_avg", "em_avg_md", "ea_avg")
COMPOUND = ("ed", "em", "em_md", "dm_avg", "es_avg", "tex")


@dataclass(frozen=True)
class Aggregate:
    """Means of each period with their spreads; factors; long percentiles; one row of references."""

    means: DataFrame
    factors: DataFrame
    percentiles: DataFrame
    references: DataFrame


def within(grid: DataFrame, y_range: tuple[float, float] | None = None, x_range: tuple[float, float] | None = None, mask: DataFrame | None = None) -> DataFrame:
    """Windows whose centre lies in a box or, by id, in a mask ``(gr_id, mask_frac)``."""
    for c, span in (("yc", y_range), ("xc", x_range)):
        if span is not None:
            grid = grid.filter(F.col(c).between(min(span), max(span)))
    return grid if mask is None else grid.join(mask.filter("mask_frac > 0").select("gr_id"), "gr_id", "left_semi")


def _inside(span: tuple[str, str]) -> Column:
    return F.col("p").between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))


def aggregate(windows: DataFrame, areas: DataFrame, ref: tuple[str, str], cc: tuple[str, str], min_duration: float = 0.0) -> Aggregate:
    """Everything about the aggregate from decadal metrics of windows, best read from a stored level.

    ``windows (gr_id, p, ..._gr)`` has the basic metrics; ``areas (gr_id, a)`` the windows that
    belong to the aggregate and have a threshold.  Means over windows keep the weight of a
    missing value.  The series of means is scaled so that its reference mean is the mean of the
    windows' own reference means; compounds come from the scaled basic metrics.  Spreads are
    those of the windows about the aggregate; a missing value weighs below.
    """
    basic = [f"{m}_gr" for m in BASIC]
    every = [*basic, *[f"{m}_gr" for m in COMPOUND]]
    full = decadal.compounds(windows.select("gr_id", "p", *basic)).join(areas.select("gr_id", "a"), "gr_id")
    own = written(decadal.reference_pair(full, "gr_id", every, ref, cc))
    weighed = own.join(areas.select("gr_id", "a"), "gr_id")
    mean = lambda c: F.sum(F.col("a") * F.col(c)) / F.sum("a")
    over_windows = weighed.agg(*[mean(f"{m}_ref").alias(f"_ref_{m}") for m in basic])
    series = regions.weighted_mean(full, *basic)
    over_time = series.agg(*[geometric_mean(F.when(_inside(ref), F.col(m))).alias(f"_own_{m}") for m in basic])
    scale = over_windows.crossJoin(over_time)  # one row beside one row
    scaled = series.crossJoin(F.broadcast(scale)).select("p", *[(F.col(m) * F.try_divide(F.col(f"_ref_{m}"), F.col(f"_own_{m}"))).alias(m) for m in basic])
    means = written(decadal.compounds(scaled))  # a row for each period, read by all that follows
    base = decadal.compounds(over_windows.select(*[F.col(f"_ref_{m}").alias(m) for m in basic]))
    recent = means.agg(*[geometric_mean(F.when(_inside(cc), F.col(m))).alias(m) for m in every])
    enough = F.col("ed_gr") >= min_duration / 10
    lasting = base.select(*[(F.when(enough, F.col(m)) if min_duration else F.col(m)).alias(f"{m}_base") for m in every])
    met = means.crossJoin(F.broadcast(lasting)).crossJoin(F.broadcast(recent.select(*[F.col(m).alias(f"{m}_recent") for m in every])))
    factors = written(met.select("p", *[F.try_divide(F.col(m), F.col(f"{m}_base")).alias(f"{m}_af") for m in every], *[F.try_divide(F.col(f"{m}_recent"), F.col(f"{m}_base")).alias(f"{m}_af_cc") for m in every]))
    own_af = full.join(own.select("gr_id", *[f"{m}_ref" for m in every]), "gr_id").select("gr_id", "a", "p", *[F.when(F.col(f"{m}_ref") > 0, F.try_divide(F.col(m), F.col(f"{m}_ref"))).alias(f"{m}_af") for m in every])
    named = means.join(spread_about(full, means, every), "p")
    factors = factors.join(spread_about(own_af, factors, [f"{m}_af" for m in every]), "p")
    percentiles = regions.all_percentiles(full, every).unionByName(regions.all_percentiles(own_af, [f"{m}_af" for m in every]))
    references = base.select(*[F.col(m).alias(f"{m}_ref") for m in every]).crossJoin(recent.select(*[F.col(m).alias(f"{m}_cc") for m in every]))
    rename = lambda df: df.select(*[F.col(c).alias(c.replace("_gr", "_agr")) for c in df.columns])
    return Aggregate(rename(named), rename(factors), percentiles.withColumn("metric", F.replace("metric", F.lit("_gr"), F.lit("_agr"))), rename(references))


def spread_about(windows: DataFrame, centre: DataFrame, metrics: list[str]) -> DataFrame:
    """Weighted deviations of all metrics above (or at) and below a given centre by period, in one aggregate."""
    met = windows.join(centre.select("p", *[F.col(m).alias(f"_{m}") for m in metrics]), "p")
    out = []
    for m in metrics:
        up = F.coalesce(F.col(m) >= F.col(f"_{m}"), F.lit(False))
        square = F.col("a") * F.pow(F.col(m) - F.col(f"_{m}"), 2)
        for name, on in (("supp", up), ("slow", ~up)):
            out.append(F.sqrt(F.try_divide(F.coalesce(F.sum(F.when(on, square)), F.lit(0.0)), F.sum(F.when(on, F.col("a"))))).alias(f"{m}_{name}"))
    return met.groupBy("p").agg(*out)


def wide_percentiles(long: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each period with ``_p05`` and ``_p95`` of the metrics named."""
    return long.groupBy("p").pivot("metric", metrics).agg(F.first("p05").alias("p05"), F.first("p95").alias("p95"))
