"""Registered queries of stations: spans with gaps, natural variability with event area."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.operators import periods, stations
from exceedra.plans.queries import DBV, dbv, r6, region, register, sql6, sql_ctp_gr, sql_region
from exceedra.sources import tables

# ------------------------------------------------------------------ spans

SPAN_COLS = "ef, ed, ed_avg, em_avg, t_ex, fm"


def _span_sql(spans: str) -> str:
    return f"""WITH {DBV}, {spans},
m AS (SELECT cell_id, p, sum(dteec)::DOUBLE AS ef, sum(dtec)::DOUBLE AS ed, median(dtem) FILTER (WHERE dtem > 0) AS em FROM dbv JOIN span ON d BETWEEN first AND last GROUP BY ALL),
n AS (SELECT *, ed / nullif(ef, 0) AS ed_avg, last_value(CASE WHEN em IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pa, last_value(em IGNORE NULLS) OVER a AS va, first_value(CASE WHEN em IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pb, first_value(em IGNORE NULLS) OVER b AS vb
  FROM m WINDOW a AS (PARTITION BY cell_id ORDER BY p ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY cell_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT cell_id, p, ef, ed, ed_avg, coalesce(em, va + (p - pa) / greatest(pb - pa, 1)::DOUBLE * (vb - va)) AS em_avg FROM n),
z AS (SELECT *, ef * ed_avg * em_avg AS t_ex, ef * em_avg AS fm FROM o) """ + sql6(SPAN_COLS, "z", "cell_id, p")


@register("station_spans", _span_sql("span AS (SELECT make_date(y, 4, 1) AS p, make_date(y, 4, 1) AS first, make_date(y, 10, 31) AS last FROM (SELECT unnest(range((SELECT year(min(d)) FROM dbv), (SELECT year(max(d)) + 1 FROM dbv))) AS y))"))
def _(s, d):
    days = dbv(s, d)
    return r6(stations.span_metrics(days, stations.april_to_october(days), "cell_id").select("cell_id", "p", *SPAN_COLS.split(", ")))


@register("overlapping_station_spans", _span_sql("span AS (SELECT DATE '1995-01-10' + INTERVAL (9 * r) DAY AS p0, (DATE '1995-01-10' + INTERVAL (9 * r) DAY)::DATE AS p, (DATE '1995-01-10' + INTERVAL (9 * r) DAY)::DATE AS first, (DATE '1995-01-10' + INTERVAL (9 * r + 2 + r % 30) DAY)::DATE AS last FROM range(60) t(r))"))
def _(s, d):
    """Sixty spans of three to 32 days that begin every nine days, so that some overlap and some days are in none."""
    first = lambda r: F.date_add(F.lit("1995-01-10").cast("date"), (9 * r).cast("int"))
    r = F.col("id")
    spans = s.range(60).select(first(r).alias("p"), first(r).alias("first"), F.date_add(first(r), (2 + r % 30).cast("int")).alias("last"))
    return r6(stations.span_metrics(dbv(s, d), spans, "cell_id").select("cell_id", "p", *SPAN_COLS.split(", ")))


# ------------------------------------------------------------------ natural variability

FIRST, LAST, UNTIL = "1996-01-01", "1999-12-31", "2000-12-31"
NV_COLS = [*[f"scale_{m}" for m in stations.PARTS], "scale_ea_dm", *[f"nv_{m}_{e}" for m in (*stations.PARTS, "ea_avg", "es_avg", "tex") for e in ("upper", "lower")]]


def _about_mean(columns: list[str], key: str) -> str:
    return ", ".join(f"{c} / nullif(avg({c}) OVER (PARTITION BY {key}), 0) AS {c}" for c in columns)


NATURAL = f"""{DBV}, {sql_region(20.0)}, {sql_ctp_gr("annual")},
sy AS (SELECT cell_id, gr_id, date_trunc('year', d)::DATE AS p, sum(dteec)::DOUBLE AS ef, sum(dtec)::DOUBLE / nullif(sum(dteec), 0) AS ed_avg, sum(dtem) / nullif(sum(dtec), 0) AS em_avg FROM dbv GROUP BY ALL),
sf0 AS (SELECT gr_id, cell_id AS station, p, {_about_mean(["ef", "ed_avg"], "cell_id")}, CASE WHEN cell_id % 4 <> 1 THEN em_avg / nullif(avg(em_avg) OVER (PARTITION BY cell_id), 0) END AS em_avg FROM sy WHERE cell_id % 4 <> 2 OR year(p) >= 1997),
sf AS (SELECT *, ed_avg * em_avg AS dm_avg FROM sf0),
rf0 AS (SELECT gr_id, p, {_about_mean(["ef_gr", "ed_avg_gr", "em_avg_gr", "ea_avg_gr"], "gr_id")} FROM ctp),
rf AS (SELECT gr_id, p, ef_gr AS ef, ed_avg_gr AS ed_avg, em_avg_gr AS em_avg, ea_avg_gr AS ea_avg, ed_avg_gr * em_avg_gr AS dm_avg FROM rf0),
sd AS (SELECT gr_id, station, {", ".join(f"stddev_pop({m}) AS {m}" for m in stations.PARTS)} FROM sf WHERE p BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY ALL),
sp AS (SELECT gr_id, {", ".join(f"sqrt(sum({m} * {m}) / count(station)) AS {m}_s" for m in stations.PARTS)} FROM sd GROUP BY gr_id),
rd AS (SELECT gr_id, {", ".join(f"stddev_pop({m}) AS {m}_r" for m in stations.PARTS)}, sqrt(avg(pow(ea_avg - 1, 2))) / nullif(sqrt(avg(pow(dm_avg - 1, 2))), 0) AS scale_ea_dm FROM rf WHERE p BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY gr_id),
se AS (SELECT gr_id, station, {", ".join(f"sum(pow({m} - 1, 2)) FILTER (WHERE {m} {o} 1) / nullif(count(*) FILTER (WHERE {m} {o} 1), 0) AS {m}_{e}" for m in stations.PARTS for e, o in (("upper", ">="), ("lower", "<")))} FROM sf WHERE p <= DATE '{UNTIL}' GROUP BY ALL),
sm AS (SELECT gr_id, {", ".join(f"sqrt(avg({m}_{e})) AS {m}_{e}" for m in stations.PARTS for e in ("upper", "lower"))} FROM se GROUP BY gr_id),
n0 AS (SELECT gr_id, scale_ea_dm, {", ".join(f"{m}_r / nullif({m}_s, 0) AS scale_{m}" for m in stations.PARTS)}, {", ".join(f"{m}_{e} * ({m}_r / nullif({m}_s, 0)) AS nv_{m}_{e}" for m in stations.PARTS for e in ("upper", "lower"))} FROM sm JOIN sp USING (gr_id) JOIN rd USING (gr_id)),
n1 AS (SELECT *, {", ".join(f"scale_ea_dm * nv_dm_avg_{e} AS nv_ea_avg_{e}" for e in ("upper", "lower"))} FROM n0),
n2 AS (SELECT *, {", ".join(f"sqrt(pow(nv_dm_avg_{e}, 2) + pow(nv_ea_avg_{e}, 2)) AS nv_es_avg_{e}" for e in ("upper", "lower"))} FROM n1),
n3 AS (SELECT *, {", ".join(f"sqrt(pow(nv_ef_{e}, 2) + pow(nv_es_avg_{e}, 2)) AS nv_tex_{e}" for e in ("upper", "lower"))} FROM n2)"""


def _factors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    from pyspark.sql.window import Window

    return df.withColumns({c: F.try_divide(F.col(c), F.avg(c).over(Window.partitionBy(key))) for c in columns})


def station_factors(s: SparkSession, d: str) -> DataFrame:
    """Annual factors of all stations, united from three networks: one lacks magnitudes, one begins in 1997."""
    days = dbv(s, d).join(tables.cells(s, d).select("cell_id", "gr_id"), "cell_id")
    y = days.groupBy("gr_id", "cell_id", F.trunc("d", "year").alias("p")).agg(F.sum("dteec").cast("double").alias("ef"), F.try_divide(F.sum("dtec").cast("double"), F.sum("dteec")).alias("ed_avg"), F.try_divide(F.sum("dtem"), F.sum("dtec")).alias("em_avg"))
    of = lambda k: y.filter(F.col("cell_id") % 4 == k)
    columns = ["gr_id", "cell_id", "ef", "ed_avg", "em_avg"]
    united = stations.station_union([("plain", y.filter((F.col("cell_id") % 4).isin(0, 3)), None), ("counts", of(1).drop("em_avg"), None), ("late", of(2), 1997)], columns)
    return _factors(united.drop("station").withColumnRenamed("cell_id", "station"), "station", ["ef", "ed_avg", "em_avg"]).withColumn("dm_avg", F.col("ed_avg") * F.col("em_avg"))


@register("natural_bounds", f"WITH {NATURAL} " + sql6(", ".join(NV_COLS), "n3", "gr_id"))
def _(s, d):
    own = periods.region_periods(region(s, d, 20.0), "annual").select("gr_id", "p", *[F.col(f"{m}_gr").alias(m) for m in ("ef", "ed_avg", "em_avg", "ea_avg")])
    own = _factors(own, "gr_id", ["ef", "ed_avg", "em_avg", "ea_avg"]).withColumn("dm_avg", F.col("ed_avg") * F.col("em_avg"))
    return r6(stations.natural_bounds(station_factors(s, d), own, "gr_id", FIRST, LAST, UNTIL).select("gr_id", *NV_COLS))
