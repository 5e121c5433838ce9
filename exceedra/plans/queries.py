"""Registered queries on the synthetic grid, each beside the SQL that expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.functions.columns import PERIODS, area_cartesian, primary
from exceedra.operators import analysis, daily, decadal, periods, prepare, regions, spatial
from exceedra.sources import tables

TIE = 1.23e-9
REF, CC = ("1995-06-01", "1998-05-01"), ("1998-06-01", "2001-05-01")
QUANTILE, REF_DAYS = 0.9, ("1995-01-01", "1998-12-31")
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, -0 as 0: coarser than summation noise, with exact decimal ties moved off the middle."""
    return df.select(*[(F.round(F.col(c) + TIE, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql6(cols: str, source: str, plain: str = "") -> str:
    """Select with the same rounding."""
    parts = [f"round({c.strip()} + {TIE}::DOUBLE, 6) + 0.0::DOUBLE AS {c.strip()}" for c in cols.split(",") if c.strip()]
    return "SELECT " + ", ".join([*(p.strip() for p in plain.split(",") if p.strip()), *parts]) + f" FROM {source}"


CELL = """cell AS (
  SELECT cell_id, gr_id, y, x, mask_frac,
    0.5 * 40008.0::DOUBLE / 360 * (0.5 * 40075.0::DOUBLE / 360 * cos(radians(y))) / 100 * mask_frac AS area
  FROM (SELECT n_nationkey AS cell_id, n_regionkey AS gr_id, 46.0::DOUBLE - 0.5 * (n_nationkey // 5) AS y, 9.0::DOUBLE + 0.5 * (n_nationkey % 5) AS x,
    CASE WHEN n_nationkey = 24 THEN NULL WHEN n_nationkey // 5 IN (0, 4) OR n_nationkey % 5 IN (0, 4) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS mask_frac FROM nation)
  WHERE mask_frac > 0)"""
DAILY = """daily AS (
  SELECT s_nationkey AS cell_id, l_shipdate::DATE AS d, max(l_extendedprice) / 1000 AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
RAIN = """rain AS (
  SELECT s_nationkey AS cell_id, l_shipdate::DATE AS d, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
THR = """thr AS (
  SELECT cell_id, quantile_cont(v, 0.9) AS thr FROM daily WHERE d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY cell_id)"""
SPINE = """days AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM daily),
field AS (SELECT c.cell_id, days.d, v FROM cell c CROSS JOIN days LEFT JOIN daily USING (cell_id, d))"""


def sql_exceed(low: bool = False) -> str:
    diff = "thr - v" if low else "v - thr"
    return f"""x AS (
  SELECT cell_id, d, gr_id, area, v, thr, CASE WHEN {diff} <= 0 THEN 0.0::DOUBLE ELSE {diff} END AS dtem FROM field JOIN cell USING (cell_id) JOIN thr USING (cell_id)),
dbv0 AS (SELECT *, CASE WHEN dtem IS NOT NULL THEN (dtem > 0)::INT END AS dtec, CASE WHEN dtem IS NOT NULL THEN (dtem > 0)::INT * area END AS dtea FROM x)"""


def sql_events(source: str, key: str, flag: str, out: str, name: str) -> str:
    return f"""{name}_a AS (SELECT *, row_number() OVER w AS rn, coalesce({flag}, 0) AS on_, row_number() OVER w - sum(coalesce({flag}, 0)) OVER (PARTITION BY {key} ORDER BY d ROWS UNBOUNDED PRECEDING) AS run
  FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY d)),
{name} AS (SELECT * EXCLUDE (rn, on_, run), (on_ = 1 AND rn = floor((min(rn) OVER r + max(rn) OVER r) / 2))::INT AS {out} FROM {name}_a WINDOW r AS (PARTITION BY {key}, on_, run))"""


DBV = ",\n".join([CELL, DAILY, THR, SPINE, sql_exceed(), sql_events("dbv0", "cell_id", "dtec", "dteec", "dbv")])


def sql_region(min_area: float = 0.0001) -> str:
    return f"""gr0 AS (SELECT gr_id, d, coalesce(sum(dtea), 0) AS dtea_gr, coalesce(sum(dtem * area), 0) AS ma, coalesce(max(dtem), 0) AS top FROM dbv0 GROUP BY ALL),
gr1 AS (SELECT gr_id, d, dtea_gr, (dtea_gr >= {min_area})::INT AS dtec_gr, CASE WHEN dtea_gr >= {min_area} AND dtea_gr > 0 THEN ma / dtea_gr ELSE 0 END AS dtem_gr,
  CASE WHEN dtea_gr >= {min_area} THEN top ELSE 0 END AS dtem_max_gr FROM gr0),
gr2 AS (SELECT *, dtem_gr * dtea_gr AS dtema_gr FROM gr1),
""" + sql_events("gr2", "gr_id", "dtec_gr", "dteec_gr", "gr")


GR = DBV + ",\n" + sql_region()
LABEL = {
    k: f"(date_trunc('{u}', date_trunc('month', d) - INTERVAL ({o}) MONTH) + INTERVAL ({o}) MONTH)::DATE" for k, (o, u) in PERIODS.items()
}
IN = {k: "true" for k in PERIODS} | {"WAS": "month(d) BETWEEN 4 AND 10", "ESS": "month(d) BETWEEN 5 AND 9", "JJA": "month(d) IN (6, 7, 8)", "MAM": "month(d) IN (3, 4, 5)", "SON": "month(d) IN (9, 10, 11)", "EWS": "month(d) IN (11, 12, 1, 2, 3)", "DJF": "month(d) IN (12, 1, 2)"}
CELL_METRICS = "ed, em, em_avg_md, ef, ed_avg, em_avg, em_md, dm_avg, aep"
GR_METRICS = "ed_gr, ef_gr, em_gr, em_avg_md_gr, em_max_gr, tex_gr, ed_avg_gr, em_avg_gr, em_md_gr, dm_avg_gr, aep_gr, em_avg_max_gr, ea_avg_gr, es_avg_gr, h_aehc_avg_gr, h_aehc_gr"


def sql_trim(period: str, key: str, source: str) -> str:
    if period not in ("EWS", "DJF"):
        return source
    return f"(SELECT * FROM (SELECT *, min(p) OVER k AS pa, max(p) OVER k AS pb FROM {source} WINDOW k AS (PARTITION BY {key})) WHERE p <> pa AND p <> pb)"


def sql_ctp_gr(period: str) -> str:
    return f"""cg0 AS (
  SELECT gr_id, {LABEL[period]} AS p, sum(dtec_gr)::DOUBLE AS ed_gr, sum(dteec_gr)::DOUBLE AS ef_gr, sum(dtem_gr) AS em_gr,
    coalesce(median(dtem_gr) FILTER (WHERE dtem_gr > 0), 0) AS em_avg_md_gr, sum(dtem_max_gr) AS em_max_gr, sum(dtema_gr) AS tex_gr,
    min(dayofyear(d)) FILTER (WHERE dteec_gr > 0)::INT AS doy_first_gr, max(dayofyear(d)) FILTER (WHERE dteec_gr > 0)::INT AS doy_last_gr
  FROM gr WHERE {IN[period]} GROUP BY ALL),
cg1 AS (SELECT *, CASE WHEN ef_gr = 0 THEN 0 ELSE ed_gr / ef_gr END AS ed_avg_gr, CASE WHEN ed_gr = 0 THEN 0 ELSE em_gr / ed_gr END AS em_avg_gr,
    ed_gr * em_avg_md_gr AS em_md_gr, CASE WHEN ef_gr = 0 THEN 0 ELSE (doy_last_gr - doy_first_gr + 1) / 30.5::DOUBLE END AS aep_gr,
    CASE WHEN ed_gr > 0 THEN em_max_gr / ed_gr END AS em_avg_max_gr, CASE WHEN em_gr = 0 THEN 0 ELSE tex_gr / em_gr END AS ea_avg_gr FROM cg0),
cg2 AS (SELECT *, ed_avg_gr * em_avg_gr AS dm_avg_gr, ed_avg_gr * em_avg_gr * ea_avg_gr AS es_avg_gr, 0.1507::DOUBLE * tex_gr AS h_aehc_gr FROM cg1),
ctp AS (SELECT *, CASE WHEN ed_avg_gr <> 0 THEN 0.1507::DOUBLE * (es_avg_gr / ed_avg_gr) END AS h_aehc_avg_gr FROM {sql_trim(period, 'gr_id', 'cg2')})"""


def sql_ctp_cell(period: str) -> str:
    return f"""cc0 AS (
  SELECT cell_id, {LABEL[period]} AS p, CASE WHEN count(dtec) = count(*) THEN sum(dtec)::DOUBLE END AS ed, sum(dteec)::DOUBLE AS ef0,
    CASE WHEN count(dtem) = count(*) THEN sum(dtem) END AS em, coalesce(median(dtem) FILTER (WHERE dtem > 0), 0) AS em_avg_md,
    min(dayofyear(d)) FILTER (WHERE dteec > 0)::INT AS doy_first, max(dayofyear(d)) FILTER (WHERE dteec > 0)::INT AS doy_last
  FROM dbv WHERE {IN[period]} GROUP BY ALL),
cc1 AS (SELECT * EXCLUDE (ef0), CASE WHEN ed IS NOT NULL THEN coalesce(ef0, 0) END AS ef FROM cc0),
cc2 AS (SELECT *, CASE WHEN ef = 0 THEN 0 ELSE ed / ef END AS ed_avg, CASE WHEN ed = 0 THEN 0 ELSE em / ed END AS em_avg, ed * em_avg_md AS em_md,
    CASE WHEN ef = 0 THEN 0 ELSE (doy_last - doy_first + 1) / 30.5::DOUBLE END AS aep FROM cc1),
cc3 AS (SELECT *, ed_avg * em_avg AS dm_avg FROM cc2),
ctpc AS (SELECT * FROM {sql_trim(period, 'cell_id', 'cc3')})"""


# ------------------------------------------------------------------ Spark side of the same chain


def grid(s: SparkSession, d: str, how: str = "inner") -> DataFrame:
    """Cells with their threshold; ``how`` ``left`` keeps those without one."""
    thr = prepare.percentile_threshold(tables.daily(s, d), QUANTILE, *REF_DAYS, shared=True)
    return tables.cells(s, d).join(thr, "cell_id", how)


def spine(s: SparkSession, d: str) -> DataFrame:
    return daily.on_spine(tables.daily(s, d), tables.cells(s, d))


def dbv(s: SparkSession, d: str, low: bool = False) -> DataFrame:
    x = daily.cell_exceedance(spine(s, d), grid(s, d), low)
    return daily.mark_events(x, "cell_id", "dtec", "dteec")


def dbv_plain(s: SparkSession, d: str, low: bool = False) -> DataFrame:
    return daily.cell_exceedance(spine(s, d), grid(s, d), low)


def region(s: SparkSession, d: str, min_area: float = daily.MIN_AREA) -> DataFrame:
    days = daily.region_series(tables.daily(s, d), grid(s, d), min_area)
    return daily.mark_events(days, "gr_id", "dtec_gr", "dteec_gr")


def ctp(s: SparkSession, d: str, period: str = "monthly") -> DataFrame:
    return periods.region_periods(region(s, d), period)


@register("area_grid", f"WITH {CELL} " + sql6("y, x, mask_frac, area", "cell", "cell_id"))
def _(s, d):
    return r6(tables.cells(s, d).select("cell_id", "y", "x", "mask_frac", "area"))


@register("area_cartesian", f"WITH {CELL} SELECT cell_id, round(mask_frac * 0.25 + 1.23e-9::DOUBLE, 6) AS area FROM cell")
def _(s, d):
    return r6(tables.cells(s, d).select("cell_id", (F.lit(area_cartesian(5000.0, 5000.0)) * F.col("mask_frac")).alias("area")))


@register("gr_size", f"WITH {CELL}, {DAILY}, {THR}, g AS (SELECT gr_id, sum(area) AS gr_size, coalesce(sum(thr * area), 0) / sum(area) AS threshold_avg_gr FROM cell LEFT JOIN thr USING (cell_id) GROUP BY gr_id) " + sql6("gr_size, threshold_avg_gr", "g", "gr_id"))
def _(s, d):
    return r6(daily.region_sizes(grid(s, d, "left")))


@register("dbv_cell", f"WITH {DBV} " + sql6("dtem, dtea", "dbv", "cell_id, d, dtec, dteec"))
def _(s, d):
    return r6(dbv(s, d).select("cell_id", "d", "dtec", "dteec", "dtem", "dtea"))


@register("low_extreme", "WITH " + ",\n".join([CELL, DAILY, THR, SPINE, sql_exceed(True)]) + " " + sql6("dtem, dtea", "dbv0", "cell_id, d, dtec"))
def _(s, d):
    return r6(dbv_plain(s, d, True).select("cell_id", "d", "dtec", "dtem", "dtea"))


@register("primary_threshold", "WITH " + ",\n".join([CELL, DAILY, THR, SPINE]) + ", z AS (SELECT cell_id, d, CASE WHEN v IS NULL THEN NULL WHEN v >= 30 THEN v ELSE thr END AS v FROM field JOIN thr USING (cell_id)) " + sql6("v", "z", "cell_id, d"))
def _(s, d):
    x = spine(s, d).join(grid(s, d).select("cell_id", "thr"), "cell_id")
    return r6(x.select("cell_id", "d", primary(F.col("v"), F.col("thr"), 30.0).alias("v")))


@register("dbv_gr", f"WITH {GR} " + sql6("dtea_gr, dtem_gr, dtem_max_gr, dtema_gr", "gr", "gr_id, d, dtec_gr, dteec_gr"))
def _(s, d):
    return r6(region(s, d).select("gr_id", "d", "dtec_gr", "dteec_gr", "dtea_gr", "dtem_gr", "dtem_max_gr", "dtema_gr"))


@register("min_area", f"WITH {DBV},\n{sql_region(20.0)} " + sql6("dtea_gr, dtem_gr, dtem_max_gr, dtema_gr", "gr", "gr_id, d, dtec_gr, dteec_gr"))
def _(s, d):
    return r6(region(s, d, 20.0).select("gr_id", "d", "dtec_gr", "dteec_gr", "dtea_gr", "dtem_gr", "dtem_max_gr", "dtema_gr"))


@register("network_days", f"WITH {DBV}, g AS (SELECT gr_id, d, max(dtec) AS dtec_gr, coalesce(sum(dtem), 0) AS dtem_gr FROM dbv0 GROUP BY ALL) " + sql6("dtem_gr", "g", "gr_id, d, dtec_gr"))
def _(s, d):
    return r6(daily.network_days(dbv_plain(s, d).join(tables.cells(s, d).select("cell_id", "gr_id"), "cell_id")))


def _ctp_queries() -> None:
    for period in PERIODS:
        cols = [c.strip() for c in GR_METRICS.split(",")]

        def gr(s, d, period=period, cols=cols):
            return r6(ctp(s, d, period).select("gr_id", "p", "doy_first_gr", "doy_last_gr", *cols))

        register(f"ctp_gr_{period}", f"WITH {GR},\n{sql_ctp_gr(period)} " + sql6(GR_METRICS, "ctp", "gr_id, p, doy_first_gr, doy_last_gr"))(gr)
    for period in ("annual", "monthly", "WAS", "DJF"):
        cols = [c.strip() for c in CELL_METRICS.split(",")]

        def cell(s, d, period=period, cols=cols):
            return r6(periods.cell_periods(dbv(s, d), period).select("cell_id", "p", "doy_first", "doy_last", *cols))

        register(f"ctp_cell_{period}", f"WITH {DBV},\n{sql_ctp_cell(period)} " + sql6(CELL_METRICS, "ctpc", "cell_id, p, doy_first, doy_last"))(cell)


_ctp_queries()

# ------------------------------------------------------------------ thresholds and preparation


@register("threshold_p90", f"WITH {DAILY}, {THR} " + sql6("thr", "thr", "cell_id"))
def _(s, d):
    return r6(prepare.percentile_threshold(tables.daily(s, d), QUANTILE, *REF_DAYS))


@register("threshold_wetday", f"WITH {RAIN}, t AS (SELECT cell_id, quantile_cont(v, 0.9) AS thr FROM rain WHERE v > 0.99 AND d BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY cell_id) " + sql6("thr", "t", "cell_id"))
def _(s, d):
    return r6(prepare.percentile_threshold(tables.rain(s, d), QUANTILE, *REF_DAYS, 0.99))


@register("threshold_smooth", f"WITH {CELL}, {DAILY}, {THR}, k AS (SELECT cell_id, thr, cell_id // 5 AS iy, cell_id % 5 AS ix FROM cell JOIN thr USING (cell_id)), z AS (SELECT a.cell_id, avg(b.thr) AS smoothed FROM k a JOIN k b ON (a.iy - b.iy) * (a.iy - b.iy) + (a.ix - b.ix) * (a.ix - b.ix) < 2.25 GROUP BY 1) " + sql6("smoothed", "z", "cell_id"))
def _(s, d):
    g = grid(s, d).select("cell_id", "thr", F.floor(F.col("cell_id") / 5).alias("iy"), (F.col("cell_id") % 5).alias("ix"))
    return r6(prepare.smooth(g, 1))


HOURLY = """hourly AS (SELECT (user_id % 25)::INT AS cell_id, date_trunc('hour', ts) AS ts, avg(value) AS v FROM events GROUP BY ALL),
lonh AS (SELECT cell_id, ts, v, (cell_id - 12) * 15.0::DOUBLE AS lon FROM hourly)"""
OFFSET = "round_even(lon / 15, 0)::INT"


def _lon(df: DataFrame) -> DataFrame:
    return df.withColumn("lon", (F.col("cell_id") - 12) * F.lit(15.0))


@register("utc_offset", f"WITH {HOURLY} SELECT DISTINCT cell_id, round_even(lon * 0.7::DOUBLE / 15, 0)::INT AS hours FROM lonh")
def _(s, d):
    return _lon(tables.hourly(s, d)).select("cell_id", prepare.utc_offset(F.col("lon") * 0.7).alias("hours")).distinct()


@register("local_day_resample", f"WITH {HOURLY}, z AS (SELECT cell_id, (ts + INTERVAL ({OFFSET}) HOUR)::DATE AS d, avg(v - 273.15) AS t, min(v - 273.15) AS tn, max(v - 273.15) AS tx FROM lonh GROUP BY ALL) " + sql6("t, tn, tx", "z", "cell_id, d"))
def _(s, d):
    return r6(prepare.daily_temperature(_lon(tables.hourly(s, d))))


@register("precip_day", f"WITH {HOURLY}, z AS (SELECT cell_id, (ts + INTERVAL ({OFFSET} + 7) HOUR)::DATE AS d, sum(v * 1000) AS p24h, max(v * 1000) AS px1h FROM lonh GROUP BY ALL) " + sql6("p24h, px1h", "z", "cell_id, d"))
def _(s, d):
    return r6(prepare.daily_precipitation(_lon(tables.hourly(s, d)), True))


@register("wind_vector_mean", f"WITH {HOURLY}, z AS (SELECT cell_id, (ts + INTERVAL ({OFFSET}) HOUR)::DATE AS d, sqrt(pow(avg(v), 2) + pow(avg(v - 50), 2)) AS wind FROM lonh GROUP BY ALL) " + sql6("wind", "z", "cell_id, d"))
def _(s, d):
    h = _lon(tables.hourly(s, d)).withColumn("u", F.col("v")).withColumn("v", F.col("v") - 50)
    return r6(prepare.daily_wind(h))


@register("humidity", f"WITH {HOURLY}, e AS (SELECT cell_id, lon, ts, 270 + v / 10 AS dew, 90000 + v AS pr FROM lonh), f AS (SELECT *, 611.2::DOUBLE * exp(17.67 * (dew - 273.15) / (dew - 273.15 + 243.5)) AS e FROM e), z AS (SELECT cell_id, (ts + INTERVAL ({OFFSET}) HOUR)::DATE AS d, avg(pr) AS p, avg(0.6219569100577033::DOUBLE * e / (pr - (1 - 0.6219569100577033::DOUBLE) * e)) AS q FROM f GROUP BY ALL) " + sql6("p, q", "z", "cell_id, d"))
def _(s, d):
    h = _lon(tables.hourly(s, d)).select("cell_id", "lon", "ts", (270 + F.col("v") / 10).alias("dewpoint"), (90000 + F.col("v")).alias("pressure"))
    return r6(prepare.daily_humidity(h))


@register("accumulated_day", f"WITH {HOURLY}, a AS (SELECT cell_id, ts, (ts - INTERVAL 1 HOUR)::DATE AS d, v FROM hourly), b AS (SELECT *, v - coalesce(lag(v) OVER (PARTITION BY cell_id, d ORDER BY ts), 0) AS s FROM a), z AS (SELECT cell_id, d, max(v) * 1000 AS p24h, max(s) * 1000 AS px1h FROM b GROUP BY ALL) " + sql6("p24h, px1h", "z", "cell_id, d"))
def _(s, d):
    return r6(prepare.daily_accumulated(tables.hourly(s, d)))


@register("subdaily_max", f"WITH {HOURLY}, z AS (SELECT cell_id, ts::DATE AS d, max(v) AS v FROM hourly GROUP BY ALL) " + sql6("v", "z", "cell_id, d"))
def _(s, d):
    return r6(prepare.aggregate_days(tables.hourly(s, d), prepare.method_for("Tx")))


@register("mean_of_two", f"WITH {DAILY}, {RAIN}, z AS (SELECT cell_id, d, (daily.v + rain.v) / 2 AS v FROM daily JOIN rain USING (cell_id, d)) " + sql6("v", "z", "cell_id, d"))
def _(s, d):
    return r6(prepare.mean_of(tables.daily(s, d), tables.rain(s, d), ["cell_id", "d"]))


@register("altitude_lon", f"WITH {CELL} SELECT cell_id, round(y * 100 / 9.80665::DOUBLE + 1.23e-9, 6) AS altitude, round(CASE WHEN x * 30 > 180 THEN x * 30 - 360 ELSE x * 30 END + 1.23e-9::DOUBLE, 6) AS lon FROM cell")
def _(s, d):
    c = tables.cells(s, d)
    return r6(c.select("cell_id", prepare.altitude(F.col("y") * 100).alias("altitude"), prepare.signed_longitude(F.col("x") * 30).alias("lon")))


GAPS = "WITH " + ",\n".join([CELL, DAILY, SPINE]) + ", m AS (SELECT *, avg(v) OVER (PARTITION BY cell_id, month(d), day(d)) AS mv, min(d) FILTER (WHERE v IS NOT NULL) OVER (PARTITION BY cell_id) AS f FROM field), z AS (SELECT cell_id, d, CASE WHEN d >= f THEN coalesce(v, mv) ELSE v END AS v FROM m) "


@register("gap_fill", GAPS + sql6("v", "z", "cell_id, d"))
def _(s, d):
    return r6(prepare.fill_gaps(spine(s, d)))


@register("station_select", f"WITH {DAILY} " + sql6("v", "daily SEMI JOIN (SELECT cell_id FROM daily GROUP BY 1 HAVING year(min(d)) <= 1995) USING (cell_id)", "cell_id, d"))
def _(s, d):
    return r6(prepare.long_stations(tables.daily(s, d), 1995))


@register("monthly_anomaly", f"WITH {CELL}, {DAILY}, g AS (SELECT gr_id, date_trunc('month', d)::DATE AS d, sum(v) AS v FROM daily JOIN cell USING (cell_id) GROUP BY ALL), z AS (SELECT gr_id, d, v - avg(v) FILTER (WHERE year(d) BETWEEN 1995 AND 1998) OVER (PARTITION BY gr_id, month(d)) AS anomaly FROM g) " + sql6("anomaly", "z", "gr_id, d"))
def _(s, d):
    m = tables.daily(s, d).join(tables.cells(s, d).select("cell_id", "gr_id"), "cell_id").groupBy("gr_id", F.trunc("d", "month").alias("d")).agg(F.sum("v").alias("v"))
    return r6(prepare.monthly_anomaly(m, 1995, 1998).select("gr_id", "d", "anomaly"))


HOURS = f"""{CELL}, {HOURLY}, ht AS (SELECT cell_id, quantile_cont(v, 0.6) AS thr FROM hourly GROUP BY cell_id),
hm AS (SELECT h.cell_id, gr_id, area, ts::DATE AS d, hour(ts)::INT AS h, CASE WHEN v - thr <= 0 THEN 0 ELSE v - thr END AS m FROM hourly h JOIN ht USING (cell_id) JOIN cell USING (cell_id)),
hd0 AS (SELECT cell_id, gr_id, area, d, sum((m > 0)::INT)::DOUBLE AS nhours, min(h) FILTER (WHERE m > 0) AS t_hfirst, max(h) FILTER (WHERE m > 0) AS t_hlast,
  arg_min(h, (-m, h)) FILTER (WHERE m > 0) AS t_hmax FROM hm GROUP BY ALL),
hd AS (SELECT *, t_hmax - t_hfirst + 0.5::DOUBLE AS h_rise, t_hlast - t_hmax + 0.5::DOUBLE AS h_set FROM hd0)"""


def hourly_cells(s: SparkSession, d: str) -> DataFrame:
    h = tables.hourly(s, d)
    thr = h.groupBy("cell_id").agg(F.percentile("v", F.lit(0.6)).alias("thr"))
    return tables.cells(s, d).join(thr, "cell_id")


@register("hourly_cell", f"WITH {HOURS} " + sql6("nhours, h_rise, h_set", "hd", "cell_id, d, t_hfirst, t_hlast, t_hmax"))
def _(s, d):
    return r6(daily.hourly_days(tables.hourly(s, d), hourly_cells(s, d)).select("cell_id", "d", "t_hfirst", "t_hlast", "t_hmax", "nhours", "h_rise", "h_set"))


HOURS_GR = f"""{HOURS}, hw AS (SELECT *, CASE WHEN nhours > 0 THEN area ELSE 0 END AS a FROM hd),
hg0 AS (SELECT gr_id, d, coalesce(sum(nhours * a) / nullif(sum(a), 0), 0) AS nhours_gr, """ + ", ".join(f"sum({c} * a) / nullif(sum(a), 0) AS {c}_gr" for c in ("t_hfirst", "t_hlast", "t_hmax", "h_rise", "h_set")) + """ FROM hw GROUP BY ALL),
hg AS (SELECT gr_id, d, nhours_gr, """ + ", ".join(f"CASE WHEN nhours_gr > 0 THEN {c}_gr END AS {c}_gr" for c in ("t_hfirst", "t_hlast", "t_hmax", "h_rise", "h_set")) + " FROM hg0)"


def hourly_gr(s: SparkSession, d: str) -> DataFrame:
    c = hourly_cells(s, d)
    hours = daily.hourly_days(tables.hourly(s, d), c)
    area = hours.select("cell_id", "d", F.when(F.col("nhours") > 0, F.col("area")).otherwise(0.0).alias("dtea"))
    return daily.hourly_region(hours, area, c)


@register("hourly_gr", f"WITH {HOURS_GR} " + sql6("nhours_gr, t_hfirst_gr, t_hlast_gr, t_hmax_gr, h_rise_gr, h_set_gr", "hg", "gr_id, d"))
def _(s, d):
    return r6(hourly_gr(s, d))


@register("hourly_periods", f"WITH {HOURS_GR}, z AS (SELECT gr_id, date_trunc('month', d)::DATE AS p, coalesce(avg(nhours_gr) FILTER (WHERE nhours_gr > 0), 0) AS h_avg_gr, avg(h_rise_gr) AS h_rise_avg_gr, avg(h_set_gr) AS h_set_avg_gr FROM hg GROUP BY ALL) " + sql6("h_avg_gr, h_rise_avg_gr, h_set_avg_gr", "z", "gr_id, p"))
def _(s, d):
    return r6(periods.hourly_periods(hourly_gr(s, d), "gr_id", "monthly", "_gr"))


# ------------------------------------------------------------------ decades, references, factors

CTPM = GR + ",\n" + sql_ctp_gr("monthly")
DEC_COLS = ["ef_gr", "ed_avg_gr", "em_avg_gr", "em_avg_md_gr", "em_avg_max_gr", "ea_avg_gr", "doy_first_gr", "doy_last_gr", "aep_gr"]
DEC = CTPM + ", dn AS (SELECT *, row_number() OVER (PARTITION BY gr_id ORDER BY p) AS n, count(*) OVER (PARTITION BY gr_id) AS c FROM ctp),\nde AS (SELECT gr_id, p, " + ", ".join(f"CASE WHEN n > 5 AND n <= c - 4 AND c >= 10 THEN avg({m}) OVER w END AS {m}" for m in DEC_COLS) + " FROM dn WINDOW w AS (PARTITION BY gr_id ORDER BY p ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))"
COMP = DEC + """, df AS (SELECT *, ef_gr * ed_avg_gr AS ed_gr, ed_avg_gr * em_avg_gr AS dm_avg_gr FROM de),
dg AS (SELECT *, ed_gr * em_avg_gr AS em_gr, ed_gr * em_avg_md_gr AS em_md_gr, ed_gr * em_avg_max_gr AS em_max_gr, dm_avg_gr * ea_avg_gr AS es_avg_gr FROM df),
dec_ AS (SELECT *, ef_gr * es_avg_gr AS tex_gr, 0.1507::DOUBLE * (es_avg_gr / nullif(ed_avg_gr, 0)) AS h_aehc_avg_gr, 0.1507::DOUBLE * (ef_gr * es_avg_gr) AS h_aehc_gr FROM dg)"""
COMP_COLS = ["ed_gr", "em_gr", "em_md_gr", "dm_avg_gr", "em_max_gr", "es_avg_gr", "tex_gr", "h_aehc_avg_gr", "h_aehc_gr"]


def dec(s: SparkSession, d: str) -> DataFrame:
    return decadal.decadal_means(ctp(s, d), "gr_id", DEC_COLS)


@register("decadal_mean", f"WITH {DEC} " + sql6(", ".join(DEC_COLS), "de", "gr_id, p"))
def _(s, d):
    return r6(dec(s, d))


@register("decadal_compound", f"WITH {COMP} " + sql6(", ".join(COMP_COLS), "dec_", "gr_id, p"))
def _(s, d):
    return r6(decadal.compounds(dec(s, d)).select("gr_id", "p", *COMP_COLS))


@register("spread", f"WITH {DEC}, ys AS (SELECT a.gr_id, a.p, a.em_avg_gr AS c, b.em_avg_gr AS x FROM (SELECT de.*, dn.n FROM de JOIN dn USING (gr_id, p)) a JOIN dn b ON a.gr_id = b.gr_id AND b.n BETWEEN a.n - 5 AND a.n + 4), z AS (SELECT gr_id, p, CASE WHEN any_value(c) IS NOT NULL THEN sqrt(coalesce(sum(pow(x - c, 2)) FILTER (WHERE x > c), 0) / greatest(count(*) FILTER (WHERE x > c), 1)) END AS supp, CASE WHEN any_value(c) IS NOT NULL THEN sqrt(coalesce(sum(pow(x - c, 2)) FILTER (WHERE NOT coalesce(x > c, false)), 0) / greatest(count(*) FILTER (WHERE NOT coalesce(x > c, false)), 1)) END AS slow FROM ys GROUP BY ALL) " + sql6("supp, slow", "z", "gr_id, p"))
def _(s, d):
    return r6(decadal.spreads(ctp(s, d), "gr_id", "em_avg_gr"))


@register("rolling_full", f"WITH {CTPM}, z AS (SELECT gr_id, p, CASE WHEN count(em_avg_max_gr) OVER w = 10 THEN avg(em_avg_max_gr) OVER w END AS em_avg_max_gr FROM ctp WINDOW w AS (PARTITION BY gr_id ORDER BY p ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) " + sql6("em_avg_max_gr", "z", "gr_id, p"))
def _(s, d):
    return r6(decadal.rolling_full(ctp(s, d), "gr_id", "em_avg_max_gr"))


AF_COLS = ["ef_gr", "ed_gr", "em_gr", "tex_gr"]


def _gm(c: str, span: tuple[str, str]) -> str:
    return f"exp(avg(ln(CASE WHEN {c} > 0 THEN {c} END)) FILTER (WHERE p BETWEEN DATE '{span[0]}' AND DATE '{span[1]}'))"


REFS = COMP + ", ref AS (SELECT gr_id, " + ", ".join(f"{_gm(c, REF)} AS {c}_ref, {_gm(c, CC)} AS {c}_cc" for c in AF_COLS) + " FROM dec_ GROUP BY gr_id)"


@register("gmean_ref", f"WITH {REFS} " + sql6(", ".join(f"{c}_ref, {c}_cc" for c in AF_COLS), "ref", "gr_id"))
def _(s, d):
    return r6(decadal.reference_pair(decadal.compounds(dec(s, d)), "gr_id", AF_COLS, REF, CC))


@register("amplification", f"WITH {REFS}, z AS (SELECT gr_id, p, " + ", ".join(f"CASE WHEN {c}_ref > 0 THEN {c} / {c}_ref END AS {c}_af, CASE WHEN {c}_ref > 0 THEN {c}_cc / {c}_ref END AS {c}_af_cc" for c in AF_COLS) + " FROM dec_ JOIN ref USING (gr_id)) " + sql6(", ".join(f"{c}_af, {c}_af_cc" for c in AF_COLS), "z", "gr_id, p"))
def _(s, d):
    return r6(decadal.amplification(decadal.compounds(dec(s, d)), "gr_id", AF_COLS, REF, CC))


@register("doy_adjust", f"WITH {DEC}, o AS (SELECT *, 0.5::DOUBLE * (30.5 * aep_gr - (doy_last_gr - doy_first_gr + 1)) AS off FROM de), z AS (SELECT gr_id, p, doy_first_gr - off AS doy_first_gr, doy_last_gr + off AS doy_last_gr FROM o) " + sql6("doy_first_gr, doy_last_gr", "z", "gr_id, p"))
def _(s, d):
    return r6(decadal.adjust_days(dec(s, d), "_gr").select("gr_id", "p", "doy_first_gr", "doy_last_gr"))


@register("h_adjust", f"WITH {HOURS_GR}, z0 AS (SELECT gr_id, date_trunc('month', d)::DATE AS p, coalesce(avg(nhours_gr) FILTER (WHERE nhours_gr > 0), 0) AS h_avg_gr, avg(h_rise_gr) AS r, avg(h_set_gr) AS t FROM hg GROUP BY ALL), z AS (SELECT gr_id, p, r * (h_avg_gr / nullif(r + t, 0)) AS h_rise_avg_gr, t * (h_avg_gr / nullif(r + t, 0)) AS h_set_avg_gr FROM z0) " + sql6("h_rise_avg_gr, h_set_avg_gr", "z", "gr_id, p"))
def _(s, d):
    return r6(decadal.adjust_hours(periods.hourly_periods(hourly_gr(s, d), "gr_id", "monthly", "_gr"), "_gr").select("gr_id", "p", "h_rise_avg_gr", "h_set_avg_gr"))


# ------------------------------------------------------------------ lattices and aggregates

LATTICE = """lat AS (SELECT (iy * 3 + ix)::INT AS gr_id, 46.0::DOUBLE - iy AS yc, 9.0::DOUBLE + ix AS xc FROM range(3) t(iy), range(3) u(ix)),
ext AS (SELECT *, round_even(1.0 / cos(radians(yc)) / 0.25, 0) * 0.25 AS x_off, round_even(1.0 / cos(radians(yc)) / 0.25, 0) * 0.25 / (1.0 / cos(radians(yc))) AS area_frac FROM lat),
lnk AS (SELECT ext.gr_id, cell_id, area, area_frac FROM cell JOIN ext ON y > yc - 1 + 1e-9 AND y <= yc + 1 + 1e-9 AND x >= xc - x_off - 1e-9 AND x < xc + x_off - 1e-9)"""


def extent(s: SparkSession, d: str) -> DataFrame:
    return regions.with_extent(regions.lattice(tables.cells(s, d), 1.0), 2.0)


@register("gr_lattice", f"WITH {CELL}, {LATTICE} " + sql6("yc, xc, x_off, area_frac", "ext", "gr_id"))
def _(s, d):
    return r6(extent(s, d).select(F.col("gr_id").cast("int").alias("gr_id"), "yc", "xc", "x_off", "area_frac"))


@register("gr_cell_bridge", f"WITH {CELL}, {LATTICE} SELECT gr_id, cell_id FROM lnk")
def _(s, d):
    return regions.bridge(tables.cells(s, d), extent(s, d)).select(F.col("gr_id").cast("int").alias("gr_id"), "cell_id")


SUB = DBV + f", {LATTICE}" + """, wd0 AS (SELECT l.gr_id, x.d, coalesce(sum(l.area / area_frac) FILTER (WHERE dtem > 0), 0) AS dtea_gr, coalesce(sum(dtem * l.area / area_frac) FILTER (WHERE dtem > 0), 0) AS ma, coalesce(max(dtem), 0) AS top
  FROM lnk l JOIN dbv0 x USING (cell_id) GROUP BY ALL),
wd AS (SELECT gr_id, d, dtea_gr, (dtea_gr >= 0.0001)::INT AS dtec_gr, CASE WHEN dtea_gr >= 0.0001 THEN ma / dtea_gr ELSE 0 END AS dtem_gr, CASE WHEN dtea_gr >= 0.0001 THEN top ELSE 0 END AS dtem_max_gr FROM wd0)"""


def links(s: SparkSession, d: str) -> DataFrame:
    """Windows and their cells."""
    return regions.bridge(tables.cells(s, d), extent(s, d)).withColumn("gr_id", F.col("gr_id").cast("int"))


def windows(s: SparkSession, d: str) -> DataFrame:
    field, cells = tables.daily(s, d), grid(s, d)
    return regions.window_days(daily.cell_exceedance(field, cells), regions.valid_links(links(s, d), cells), field=field)


def window_weights(s: SparkSession, d: str) -> DataFrame:
    return regions.window_weights(links(s, d), grid(s, d))


@register("sub_gr", f"WITH {SUB} " + sql6("dtea_gr, dtem_gr, dtem_max_gr", "wd", "gr_id, d, dtec_gr"))
def _(s, d):
    return r6(windows(s, d).select("gr_id", "d", "dtec_gr", "dtea_gr", "dtem_gr", "dtem_max_gr"))


AGR = SUB + """, wa AS (SELECT gr_id, sum(area) AS a FROM lnk WHERE gr_id IN (SELECT gr_id FROM lnk SEMI JOIN thr USING (cell_id)) GROUP BY gr_id),
wp AS (SELECT gr_id, date_trunc('month', d)::DATE AS p, CASE WHEN sum(dtec_gr) > 0 THEN sum(dtem_gr) END AS em FROM wd GROUP BY ALL),
ag AS (SELECT * FROM wp JOIN wa USING (gr_id)), am AS (SELECT p, sum(a * em) / sum(a) AS m FROM ag GROUP BY p)"""


def agr(s: SparkSession, d: str) -> DataFrame:
    em = F.when(F.sum("dtec_gr") > 0, F.sum("dtem_gr")).alias("em")
    return windows(s, d).groupBy("gr_id", F.trunc("d", "month").alias("p")).agg(em).join(window_weights(s, d), "gr_id")


@register("agr_mean", f"WITH {AGR}, z AS (SELECT p, m AS em FROM am) " + sql6("em", "z", "p"))
def _(s, d):
    return r6(regions.weighted_mean(agr(s, d), "em"))


@register("agr_spread", f"WITH {AGR}, z AS (SELECT p, sqrt(sum(a * pow(em - m, 2)) FILTER (WHERE em >= m) / sum(a) FILTER (WHERE em >= m)) AS supp, sqrt(sum(a * pow(em - m, 2)) FILTER (WHERE NOT coalesce(em >= m, false)) / sum(a) FILTER (WHERE NOT coalesce(em >= m, false))) AS slow FROM ag JOIN am USING (p) GROUP BY p) " + sql6("supp, slow", "z", "p"))
def _(s, d):
    return r6(regions.weighted_spread(agr(s, d), "em"))


@register("agr_percentiles", f"WITH {AGR}, w0 AS (SELECT p, gr_id, em AS x, a / sum(a) OVER (PARTITION BY p) AS w FROM ag WHERE em IS NOT NULL), w1 AS (SELECT p, x, sum(w) OVER (PARTITION BY p ORDER BY x, gr_id ROWS UNBOUNDED PRECEDING) AS c FROM w0), w2 AS (SELECT p, coalesce(max(x) FILTER (WHERE c <= 0.05), min(x)) AS p05, arg_min(c, abs(c - 0.95)) AS cn, arg_min(x, abs(c - 0.95)) AS an, coalesce(min(x) FILTER (WHERE c >= 0.95), max(x)) AS above FROM w1 GROUP BY p), z AS (SELECT p, p05, CASE WHEN cn >= 0.95 THEN an ELSE above END AS p95 FROM w2) " + sql6("p05, p95", "z", "p"))
def _(s, d):
    return r6(regions.weighted_percentiles(agr(s, d), "em"))


@register("agr_dof", f"WITH {CELL}, z AS (SELECT greatest(sum(area) / pow(2 * pi() * 6371 / 360 * 2, 2) * 100, 1) AS n_dof FROM cell) " + sql6("n_dof", "z"))
def _(s, d):
    return r6(regions.degrees_of_freedom(tables.cells(s, d).withColumnRenamed("area", "gr_area"), 2.0))


@register("agr_blocks", f"WITH {CELL}, z AS (SELECT floor((46.0 - y) / 1.0 + 1e-9)::BIGINT AS yb, floor((x - 9.0) / 1.0 + 1e-9)::BIGINT AS xb, avg(CASE WHEN mask_frac > 0 THEN 1.0::DOUBLE ELSE 0 END) AS mask_frac, sum(area) AS gr_area FROM cell GROUP BY ALL) " + sql6("mask_frac, gr_area", "z", "yb, xb"))
def _(s, d):
    return r6(regions.blocks(tables.cells(s, d), 1.0, 46.0, 9.0))


# ------------------------------------------------------------------ masks, regridding, variability, analytics


@register("rect_mask", f"WITH {CELL}, z AS (SELECT cell_id, greatest(least(y + 0.25, 45.6) - greatest(y - 0.25, 44.4), 0) / 0.5 * (greatest(least(x + 0.25, 10.7) - greatest(x - 0.25, 9.3), 0) / 0.5) AS s FROM cell), y AS (SELECT cell_id, CASE WHEN s > 0 THEN s END AS mask_frac FROM z) " + sql6("mask_frac", "y", "cell_id"))
def _(s, d):
    return r6(prepare.rectangle_mask(tables.cells(s, d), 44.4, 45.6, 9.3, 10.7, 0.5))


@register(
    "polygon_mask",
    f"WITH {CELL}, k AS (SELECT unnest([9.1, 11.2, 10.2]::DOUBLE[]) AS x1, unnest([44.1, 44.3, 46.1]::DOUBLE[]) AS y1, unnest([11.2, 10.2, 9.1]::DOUBLE[]) AS x2, unnest([44.3, 46.1, 44.1]::DOUBLE[]) AS y2), e AS (SELECT cell_id, y - 0.25 AS base, greatest(least(x1, x2), x - 0.25) AS a, least(greatest(x1, x2), x + 0.25) AS b, x1, y1, (y2 - y1) / (x2 - x1) AS m, sign(x1 - x2) AS s FROM k, cell), h AS (SELECT cell_id, s, m, y1 + m * (a - x1) - base AS ha, y1 + m * (b - x1) - base AS hb FROM e WHERE b > a), z AS (SELECT cell_id, sum(s * (pow(greatest(hb, 0), 2) - pow(greatest(ha, 0), 2) - pow(greatest(hb - 0.5, 0), 2) + pow(greatest(ha - 0.5, 0), 2)) / 2 / m) / 0.25 AS f FROM h GROUP BY cell_id), y AS (SELECT cell_id, CASE WHEN f > 1e-9 THEN f END AS mask_frac FROM cell LEFT JOIN z USING (cell_id)) " + sql6("mask_frac", "y", "cell_id"),
)
def _(s, d):
    return r6(prepare.region_mask(tables.cells(s, d), "polygon", ring=[(9.1, 44.1), (11.2, 44.3), (10.2, 46.1)], step=0.5))


@register("bilinear", f"WITH {CELL}, {DAILY}, t AS (SELECT cell_id AS target_id, y - 0.2::DOUBLE AS ty, x + 0.1::DOUBLE AS tx FROM cell), w AS (SELECT target_id, c.cell_id, (1 - abs(ty - y) / 0.5) * (1 - abs(tx - x) / 0.5) AS w FROM t JOIN cell c ON abs(ty - y) < 0.5 - 1e-9 AND abs(tx - x) < 0.5 - 1e-9), z AS (SELECT target_id, d, CASE WHEN count(*) = 4 THEN sum(w * v) END AS v FROM w JOIN daily USING (cell_id) GROUP BY ALL) " + sql6("v", "z", "target_id, d"))
def _(s, d):
    c = tables.cells(s, d)
    t = c.select(F.col("cell_id").alias("target_id"), (F.col("y") - 0.2).alias("y"), (F.col("x") + 0.1).alias("x"))
    return r6(prepare.bilinear(tables.daily(s, d), prepare.bilinear_weights(c, t, 0.5)))


NAT = DBV + ", st AS (SELECT cell_id, gr_id, date_trunc('year', d)::DATE AS p, sum(dtem) AS em FROM dbv0 GROUP BY ALL), st2 AS (SELECT *, avg(em) OVER (PARTITION BY gr_id, p) AS em_gr FROM st)"


def stations(s: SparkSession, d: str) -> DataFrame:
    x = dbv_plain(s, d).join(tables.cells(s, d).select("cell_id", "gr_id"), "cell_id")
    a = x.groupBy("cell_id", "gr_id", F.trunc("d", "year").alias("p")).agg(F.sum("dtem").alias("em"))
    return a.join(a.groupBy("gr_id", "p").agg(F.avg("em").alias("em_gr")), ["gr_id", "p"])


@register("natural_variability", f"WITH {NAT}, a AS (SELECT gr_id, cell_id, stddev_pop(em) AS s FROM st2 GROUP BY ALL), b AS (SELECT gr_id, sqrt(sum(s * s) / count(s)) AS s_station FROM a GROUP BY gr_id), c AS (SELECT gr_id, stddev_pop(em_gr) AS s_region FROM (SELECT DISTINCT gr_id, p, em_gr FROM st2) GROUP BY gr_id), z AS (SELECT gr_id, s_region, s_station, s_region / s_station AS scale FROM b JOIN c USING (gr_id)) " + sql6("s_region, s_station, scale", "z", "gr_id"))
def _(s, d):
    return r6(decadal.natural_variability(stations(s, d), "cell_id", "gr_id", "em", "em_gr"))


@register("variability_bounds", f"WITH {NAT}, f AS (SELECT gr_id, em / em_gr AS f FROM st2 WHERE em_gr > 0), b AS (SELECT gr_id, sqrt(sum(pow(f - 1, 2)) FILTER (WHERE f >= 1) / count(*) FILTER (WHERE f >= 1)) AS nv_upper, sqrt(sum(pow(f - 1, 2)) FILTER (WHERE f < 1) / count(*) FILTER (WHERE f < 1)) AS nv_lower FROM f GROUP BY gr_id), z AS (SELECT *, sqrt(nv_upper * nv_upper + nv_lower * nv_lower) AS nv_both FROM b) " + sql6("nv_upper, nv_lower, nv_both", "z", "gr_id"))
def _(s, d):
    f = stations(s, d).filter("em_gr > 0").withColumn("f", F.col("em") / F.col("em_gr"))
    return r6(decadal.combined_variability(decadal.variability_bounds(f, "gr_id", "f"), ["nv_upper", "nv_lower"], "nv_both"))


@register("trend", f"WITH {CTPM}, t AS (SELECT gr_id, datediff('month', DATE '1995-01-01', p)::DOUBLE AS t, em_gr FROM ctp), g AS (SELECT gr_id, regr_slope(em_gr, t) AS slope, regr_intercept(em_gr, t) AS intercept, regr_sxx(em_gr, t) AS sxx, regr_syy(em_gr, t) AS syy, count(*) AS n FROM t GROUP BY gr_id), z AS (SELECT gr_id, slope, intercept, sqrt(greatest(syy - slope * slope * sxx, 0) / ((n - 2) * sxx)) AS slope_se FROM g) " + sql6("slope, intercept, slope_se", "z", "gr_id"))
def _(s, d):
    t = ctp(s, d).withColumn("t", F.months_between("p", F.lit("1995-01-01").cast("date")))
    return r6(analysis.trend(t, "gr_id", "t", "em_gr"))


@register("area_above", f"WITH {AGR}, z AS (SELECT p, coalesce(sum(a) FILTER (WHERE em > 8), 0) / sum(a) * 100 AS percent FROM ag GROUP BY p) " + sql6("percent", "z", "p"))
def _(s, d):
    return r6(analysis.share_above(agr(s, d), "em", 8.0))


@register("start_years", f"WITH {DAILY} SELECT year, count(*) AS n FROM (SELECT cell_id, min(year(d))::INT AS year FROM daily GROUP BY cell_id) GROUP BY year")
def _(s, d):
    return analysis.start_years(tables.daily(s, d))


@register(
    "compare_results",
    f"WITH {GR}, a AS (SELECT gr_id, date_trunc('month', d)::DATE AS p, sum(dtem_gr) AS em_gr, sum(dtec_gr)::DOUBLE AS ed_gr FROM gr GROUP BY ALL), b AS (SELECT gr_id, date_trunc('month', d)::DATE AS p, sum(CASE WHEN dtea_gr >= 20 THEN dtem_gr ELSE 0 END) AS em_gr, sum((dtea_gr >= 20)::INT)::DOUBLE AS ed_gr FROM gr WHERE gr_id < 4 GROUP BY ALL), j AS (SELECT a.em_gr AS e1, b.em_gr AS e2, a.ed_gr AS d1, b.ed_gr AS d2 FROM a FULL JOIN b USING (gr_id, p)), z AS (SELECT 'em_gr' AS metric, max(abs(e1 - e2)) AS gap, count(*) FILTER ((e1 IS NULL) <> (e2 IS NULL)) AS one_sided FROM j UNION ALL SELECT 'ed_gr', max(abs(d1 - d2)), count(*) FILTER ((d1 IS NULL) <> (d2 IS NULL)) FROM j), y AS (SELECT *, gap <= 5e-5 AND one_sided = 0 AS within FROM z) " + sql6("gap", "y", "metric, one_sided, within"),
)
def _(s, d):
    keys, metrics = ["gr_id", "p"], ["em_gr", "ed_gr"]
    a = ctp(s, d).select(*keys, *metrics)
    b = periods.region_periods(region(s, d, 20.0), "monthly").filter("gr_id < 4").select(*keys, *metrics)
    return r6(analysis.compare(a, b, keys, metrics))


@register("station_nearest", f"WITH {CELL}, c AS (SELECT n_nationkey AS station, 46.0::DOUBLE - 0.4 * (n_nationkey % 7) AS sy, 9.0::DOUBLE + 0.3 * (n_nationkey % 8) AS sx FROM nation), z AS (SELECT cell_id, arg_min(station, (round(abs(y - sy) + abs(x - sx), 9), station)) AS station, min(abs(y - sy) + abs(x - sx)) AS distance FROM cell, c GROUP BY cell_id) " + sql6("distance", "z", "cell_id, station"))
def _(s, d):
    k = F.col("n_nationkey")
    st = tables.read(s, d, "nation").select(k.alias("station"), (46.0 - 0.4 * (k % 7)).alias("sy"), (9.0 + 0.3 * (k % 8)).alias("sx"))
    return r6(spatial.nearest(tables.cells(s, d), st))


@register("rollup_regions", f"WITH {DBV}, z AS (SELECT gr_id, cell_id, sum(dtem) AS em, sum(dtec)::BIGINT AS ed FROM dbv0 GROUP BY ROLLUP (gr_id, cell_id)) " + sql6("em", "z", "gr_id, cell_id, ed"))
def _(s, d):
    x = dbv_plain(s, d).join(tables.cells(s, d).select("cell_id", "gr_id"), "cell_id")
    return r6(x.rollup("gr_id", "cell_id").agg(F.sum("dtem").alias("em"), F.sum("dtec").alias("ed")))
