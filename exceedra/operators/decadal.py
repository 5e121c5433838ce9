"""Decadal means and spreads, reference means, amplification factors, natural variability.

Frames have a key, a label ``p`` and one column for each metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exceedra.functions.columns import DAYS_PER_MONTH, HEAT_CONTENT, geometric_mean

WINDOW = (10, 5, 4)  # rows, rows before, rows after
BASIC = ("ef", "ed_avg", "em_avg", "em_avg_md", "em_avg_max", "ea_avg", "doy_first", "doy_last", "aep", "h_avg", "h_rise_avg", "h_set_avg")


def decadal_means(df: DataFrame, key: str, metrics: list[str], window: tuple[int, int, int] = WINDOW) -> DataFrame:
    """Centred means over rows; the first and last rows of each series are missing."""
    rows, before, after = window
    w = Window.partitionBy(key).orderBy("p")
    frame, all_ = w.rowsBetween(-before, after), Window.partitionBy(key)
    df = df.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(all_))
    inside = (F.col("_n") > before) & (F.col("_n") <= F.col("_all") - after) & (F.col("_all") >= rows)
    return df.select(key, "p", *[F.when(inside, F.avg(m).over(frame)).alias(m) for m in metrics])


def compounds(df: DataFrame, suffix: str = "_gr") -> DataFrame:
    """Compound metrics rebuilt from averaged basic ones."""
    c = lambda n: F.col(n + suffix)
    rules = {
        "ed": lambda: c("ef") * c("ed_avg"), "em": lambda: c("ed") * c("em_avg"), "em_md": lambda: c("ed") * c("em_avg_md"), "dm_avg": lambda: c("ed_avg") * c("em_avg"),
        "em_max": lambda: c("ed") * c("em_avg_max"), "es_avg": lambda: c("dm_avg") * c("ea_avg"), "tex": lambda: c("ef") * c("es_avg"),
        "h_aehc_avg": lambda: HEAT_CONTENT * F.try_divide(c("es_avg"), c("ed_avg")), "h_aehc": lambda: HEAT_CONTENT * c("tex"),
        "htex": lambda: c("em") * c("h_avg"), "hes_avg": lambda: c("es_avg") * c("h_avg"), "htotal_ex": lambda: c("tex") * c("h_avg"),
    }
    needs = {"em_max": "em_avg_max", "es_avg": "ea_avg", "tex": "ea_avg", "h_aehc_avg": "ea_avg", "h_aehc": "ea_avg", "em_md": "em_avg_md", "htex": "h_avg", "hes_avg": "h_avg", "htotal_ex": "h_avg"}
    for name, rule in rules.items():
        if name not in needs or needs[name] + suffix in df.columns:
            df = df.withColumn(name + suffix, rule())
    return df


def spreads(df: DataFrame, key: str, metric: str, window: tuple[int, int, int] = WINDOW) -> DataFrame:
    """Upper and lower spread of each window about its centre mean, in one pass over the series.

    Years above the mean make the upper class; all others, missing ones too, the lower.
    """
    rows, before, after = window
    w = Window.partitionBy(key).orderBy("p")
    frame = w.rowsBetween(-before, after)
    n, size_ = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(key))
    whole = (n > before) & (n <= size_ - after) & (size_ >= rows)
    years = df.select(key, "p", F.collect_list(F.struct(F.col(metric).alias("x"))).over(frame).alias("a"), F.when(whole, F.avg(metric).over(frame)).alias("c"))
    up = lambda e: F.coalesce(e["x"] > F.col("c"), F.lit(False))
    squares = lambda cond: F.aggregate(F.filter("a", cond), F.lit(0.0), lambda s, e: s + F.coalesce(F.pow(e["x"] - F.col("c"), 2), F.lit(0.0)))
    size = lambda cond: F.greatest(F.size(F.filter("a", cond)), F.lit(1))
    down = lambda e: ~up(e)
    ok = F.col("c").isNotNull()
    return years.select(key, "p", F.when(ok, F.sqrt(squares(up) / size(up))).alias("supp"), F.when(ok, F.sqrt(squares(down) / size(down))).alias("slow"))


def rolling_full(df: DataFrame, key: str, metric: str, rows: int = 10) -> DataFrame:
    """Older running mean that is missing where any of its years is."""
    w = Window.partitionBy(key).orderBy("p").rowsBetween(-5, rows - 6)
    return df.select(key, "p", F.when(F.count(metric).over(w) == rows, F.avg(metric).over(w)).alias(metric))


def reference_pair(df: DataFrame, key: str, metrics: list[str], ref: tuple[str, str], cc: tuple[str, str]) -> DataFrame:
    """Geometric means over both spans in one aggregate: columns ``_ref`` and ``_cc``."""
    inside = lambda span: F.col("p").between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))
    each = [geometric_mean(F.when(inside(s), F.col(m))).alias(m + n) for n, s in (("_ref", ref), ("_cc", cc)) for m in metrics]
    return df.groupBy(key).agg(*each)


def centre_span(first_year: int, last_year: int, data_first: int, data_last: int, window: tuple[int, int, int] = WINDOW) -> tuple[str, str]:
    """First and last label of the centre years of a span of years: those whose window lies inside it."""
    if first_year < data_first or last_year > data_last:
        raise ValueError(f"{first_year} to {last_year} is not inside the data, {data_first} to {data_last}")
    _, before, after = window
    return f"{first_year + before}-01-01", f"{last_year - after}-12-31"


def annual_means(df: DataFrame, key: str, metrics: list[str], first: str, last: str, suffix: str = "_ref") -> DataFrame:
    """Arithmetic means of the labels from ``first`` to ``last``."""
    some = df.filter(F.col("p").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return some.groupBy(key).agg(*[F.avg(m).alias(m + suffix) for m in metrics])


def decadal_driver(df: DataFrame, key: str, metrics: list[str], window: tuple[int, int, int] = WINDOW, suffix: str = "_gr", spread_of: tuple[str, ...] = (), adjust: bool = True) -> DataFrame:
    """Means of basic metrics, compounds, tEX names and, where asked for, spreads: the decadal table of a series."""
    out = compounds(decadal_means(df, key, metrics, window), suffix)
    if adjust and {f"doy_first{suffix}", f"doy_last{suffix}", f"aep{suffix}"} <= set(metrics):
        out = adjust_days(out, suffix)
    if adjust and {f"h_avg{suffix}", f"h_rise_avg{suffix}", f"h_set_avg{suffix}"} <= set(metrics):
        out = adjust_hours(out, suffix)
    for m in spread_of:
        out = out.join(spreads(df, key, m, window).withColumnsRenamed({"supp": f"{m}_supp", "slow": f"{m}_slow"}), [key, "p"])
    return temporal_names(out)


def station_factors(df: DataFrame, key: str, basic: list[str], ref: tuple[str, str], cc: tuple[str, str]) -> DataFrame:
    """Factors of stations: each basic metric against its reference, compounds as products of the factors."""
    af = amplification(df, key, basic, ref, cc)
    for end in ("_af", "_af_cc"):
        c = lambda n, e=end: F.col(n + e)
        af = af.withColumn("ed" + end, c("ef") * c("ed_avg")).withColumn("em" + end, c("ef") * c("ed_avg") * c("em_avg"))
    return af


def adjust_days(df: DataFrame, s: str = "") -> DataFrame:
    """First and last day moved apart evenly until they span the exposure period."""
    off = 0.5 * (DAYS_PER_MONTH * F.col("aep" + s) - (F.col("doy_last" + s) - F.col("doy_first" + s) + 1))
    return df.withColumn("_o", off).withColumn("doy_first" + s, F.col("doy_first" + s) - F.col("_o")).withColumn("doy_last" + s, F.col("doy_last" + s) + F.col("_o")).drop("_o")


def adjust_hours(df: DataFrame, s: str = "") -> DataFrame:
    """Rise and set scaled so that they add up to the mean exposure."""
    k = F.try_divide(F.col("h_avg" + s), F.col("h_rise_avg" + s) + F.col("h_set_avg" + s))
    return df.withColumn("_k", k).withColumn("h_rise_avg" + s, F.col("h_rise_avg" + s) * F.col("_k")).withColumn("h_set_avg" + s, F.col("h_set_avg" + s) * F.col("_k")).drop("_k")


def amplification(dec: DataFrame, key: str, metrics: list[str], ref: tuple[str, str], cc: tuple[str, str], min_duration: float = 0.0) -> DataFrame:
    """Factors of each period and of the recent period against the reference period."""
    inside = lambda span: F.col("p").between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))
    means = [geometric_mean(F.when(inside(span), F.col(m))).alias(m + end) for end, span in (("_ref", ref), ("_cc", cc)) for m in metrics]
    ed = next((m for m in metrics if m.startswith("ed") and "avg" not in m), None) if min_duration else None
    least = [F.min(F.when(inside(ref), F.col(ed))).alias("_least")] if ed else []
    own = dec.groupBy(F.col(key).alias("_key")).agg(*means, *least)
    if ed:
        own = own.select("_key", *[F.when(F.col("_least") >= min_duration / 10, F.col(m + "_ref")).alias(m + "_ref") for m in metrics], *[m + "_cc" for m in metrics])
    joined = dec.select(key, "p", *metrics).join(own, F.col(key).eqNullSafe(F.col("_key")))
    factor = lambda a, m: F.when(F.col(m + "_ref") > 0, F.try_divide(F.col(a), F.col(m + "_ref")))
    return joined.select(key, "p", *[factor(m, m).alias(m + "_af") for m in metrics], *[factor(m + "_cc", m).alias(m + "_af_cc") for m in metrics])


def temporal_names(df: DataFrame) -> DataFrame:
    """EM columns again under their temporal-extremity names, where the extremity with area does not hold the name."""
    names = {c: "t" + c.replace("em", "ex", 1) for c in df.columns if c.split("_gr")[0] == "em"}
    return df.select("*", *[F.col(c).alias(n) for c, n in names.items() if n not in df.columns])


def natural_variability(df: DataFrame, key: str, group: str, metric: str, region: str) -> DataFrame:
    """Standard deviations in the reference frame and the region's scaling factor.

    ``df`` has rows of stations (``key``) in groups, ``region`` the column of the region's own series.
    """
    per_station = df.groupBy(group, key).agg(F.stddev_pop(metric).alias("s"))
    pooled = per_station.groupBy(group).agg(F.sqrt(F.sum(F.col("s") * F.col("s")) / F.count("s")).alias("s_station"))
    own = df.groupBy(group, "p").agg(F.first(region).alias("x")).groupBy(group).agg(F.stddev_pop("x").alias("s_region"))
    return own.join(pooled, group).withColumn("scale", F.try_divide("s_region", "s_station"))


def variability_bounds(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Upper and lower deviation about 1, pooled over time and stations."""
    x, up = F.col(metric), F.col(metric) >= 1
    part = lambda cond: F.sqrt(F.try_divide(F.sum(F.when(cond, F.pow(x - 1, 2))), F.count(F.when(cond, 1))))
    return df.groupBy(group).agg(part(up).alias("nv_upper"), part(~up).alias("nv_lower"))


def combined_variability(df: DataFrame, parts: list[str], out: str) -> DataFrame:
    """Quadrature sum of independent variabilities."""
    total = F.lit(0.0)
    for c in parts:
        total = total + F.col(c) * F.col(c)
    return df.withColumn(out, F.sqrt(total))
