"""Registered queries of longer chains: aggregates over lattices, drivers, masks, filters, analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.operators import analysis, daily, decadal, periods, prepare, regions
from exceedra.plans.queries import (
    AF_COLS, CC, CELL, COMP, CTPM, DAILY, DBV, DEC_COLS, GR, HOURS, HOURS_GR, LATTICE, RAIN, REF, SUB, THR,
    ctp, dbv_plain, dec, grid, hourly_cells, hourly_gr, r6, region, register, sql6, sql_ctp_gr, sql_events, sql_region, window_weights, windows,
)
from exceedra.sources import sinks, tables

# ------------------------------------------------------------------ windows of a lattice with all period metrics

AGR_METRICS = ["ed_gr", "ef_gr", "em_gr", "ed_avg_gr", "em_avg_gr", "dm_avg_gr", "em_avg_md_gr", "tex_gr"]
WINDOWS = SUB.replace("wd AS (", "wd_ AS (") + ", gr2 AS (SELECT *, dtem_gr * dtea_gr AS dtema_gr FROM wd_), " + sql_events("gr2", "gr_id", "dtec_gr", "dteec_gr", "gr") + ",\n" + sql_ctp_gr("monthly")
LINK_AREA = ", wa AS (SELECT gr_id, sum(area) AS a FROM lnk WHERE gr_id IN (SELECT gr_id FROM lnk SEMI JOIN thr USING (cell_id)) GROUP BY gr_id), ag AS (SELECT * FROM ctp JOIN wa USING (gr_id))"


def window_ctp(s: SparkSession, d: str) -> DataFrame:
    return regions.window_periods(windows(s, d), "monthly")


@register("agr_ctp", f"WITH {WINDOWS} " + sql6(", ".join(AGR_METRICS), "ctp", "gr_id, p"))
def _(s, d):
    return r6(window_ctp(s, d).select("gr_id", "p", *AGR_METRICS))


AGR_MEAN = WINDOWS + LINK_AREA + ", am AS (SELECT p, " + ", ".join(f"sum(a * {m}) / sum(a) AS {m}" for m in AGR_METRICS) + " FROM ag GROUP BY p)"


@register("agr_mean_all", f"WITH {AGR_MEAN} " + sql6(", ".join(AGR_METRICS), "am", "p"))
def _(s, d):
    return r6(regions.weighted_mean(window_ctp(s, d).join(window_weights(s, d), "gr_id"), *AGR_METRICS))


@register(
    "agr_percentiles_all",
    f"WITH {WINDOWS}{LINK_AREA}, lg AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, gr_id, a, p, {m} AS x FROM ag" for m in ("ed_gr", "em_gr", "tex_gr")) + "), w0 AS (SELECT metric, p, gr_id, x, a / sum(a) OVER (PARTITION BY metric, p) AS w FROM lg WHERE x IS NOT NULL), w1 AS (SELECT metric, p, x, sum(w) OVER (PARTITION BY metric, p ORDER BY x, gr_id ROWS UNBOUNDED PRECEDING) AS c FROM w0), w2 AS (SELECT metric, p, coalesce(max(x) FILTER (WHERE c <= 0.05), min(x)) AS p05, arg_min(c, abs(c - 0.95)) AS cn, arg_min(x, abs(c - 0.95)) AS an, coalesce(min(x) FILTER (WHERE c >= 0.95), max(x)) AS above FROM w1 GROUP BY metric, p), z AS (SELECT metric, p, p05, CASE WHEN cn >= 0.95 THEN an ELSE above END AS p95 FROM w2) " + sql6("p05, p95", "z", "metric, p"),
)
def _(s, d):
    return r6(regions.all_percentiles(window_ctp(s, d).join(window_weights(s, d), "gr_id"), ["ed_gr", "em_gr", "tex_gr"]))


BASE = ["ef_gr", "ed_avg_gr", "em_avg_gr"]
AGR_DEC = WINDOWS + LINK_AREA + ", am AS (SELECT 'agr' AS k, p, " + ", ".join(f"sum(a * {m}) / sum(a) AS {m}" for m in BASE) + " FROM ag GROUP BY p), an AS (SELECT *, row_number() OVER (ORDER BY p) AS n, count(*) OVER () AS c FROM am), ad AS (SELECT p, " + ", ".join(f"CASE WHEN n > 5 AND n <= c - 4 AND c >= 10 THEN avg({m}) OVER (ORDER BY p ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) END AS {m}" for m in BASE) + " FROM an), ae AS (SELECT p, ef_gr * ed_avg_gr AS ed_gr, ef_gr * ed_avg_gr * em_avg_gr AS em_gr FROM ad)"


@register(
    "agr_af",
    f"WITH {AGR_DEC}, rf AS (SELECT " + ", ".join(f"exp(avg(CASE WHEN {m} > 0 AND p BETWEEN DATE '{a}' AND DATE '{b}' THEN ln(CASE WHEN {m} > 0 THEN {m} END) END)) AS {m}{e}" for m in ("ed_gr", "em_gr") for e, (a, b) in (("_ref", REF), ("_cc", CC))) + " FROM ae), z AS (SELECT p, " + ", ".join(f"{m} / {m}_ref AS {m}_af, {m}_cc / {m}_ref AS {m}_af_cc" for m in ("ed_gr", "em_gr")) + " FROM ae, rf) " + sql6("ed_gr_af, ed_gr_af_cc, em_gr_af, em_gr_af_cc", "z", "p"),
)
def _(s, d):
    mean = regions.weighted_mean(window_ctp(s, d).join(window_weights(s, d), "gr_id"), *BASE).withColumn("k", F.lit("agr"))
    x = decadal.compounds(decadal.decadal_means(mean, "k", BASE))
    return r6(decadal.amplification(x, "k", ["ed_gr", "em_gr"], REF, CC).drop("k"))


@register(
    "agr_bias_scaled",
    f"WITH {AGR_MEAN}, o AS (SELECT exp(avg(ln(em_gr)) FILTER (WHERE em_gr > 0)) AS own, avg(em_gr) AS target FROM am), z AS (SELECT p, em_gr * (target / own) AS em_gr FROM am, o) " + sql6("em_gr", "z", "p"),
)
def _(s, d):
    mean = regions.weighted_mean(window_ctp(s, d).join(window_weights(s, d), "gr_id"), "em_gr")
    own = mean.agg(F.exp(F.avg(F.when(F.col("em_gr") > 0, F.ln(F.when(F.col("em_gr") > 0, F.col("em_gr")))))).alias("em_gr"))
    return r6(regions.scaled_to(mean, ["em_gr"], own, mean.agg(F.avg("em_gr").alias("em_gr"))))


# ------------------------------------------------------------------ hours

HOT = f"{HOURS}, dm AS (SELECT cell_id, gr_id, area, ts::DATE AS d, max(v) AS v FROM hourly JOIN cell USING (cell_id) GROUP BY ALL), de AS (SELECT dm.*, CASE WHEN v - thr <= 0 THEN 0 ELSE v - thr END AS dtem FROM dm JOIN ht USING (cell_id)), dg AS (SELECT gr_id, d FROM de GROUP BY ALL HAVING sum((dtem > 0)::INT * area) >= 75)"


def daily_of_hours(s: SparkSession, d: str) -> DataFrame:
    """Daily exceedance of the daily maximum of the hourly field."""
    top = tables.hourly(s, d).groupBy("cell_id", F.to_date("ts").alias("d")).agg(F.max("v").alias("v"))
    return daily.cell_exceedance(top, hourly_cells(s, d))


@register("hourly_on_days", f"WITH {HOT}, z AS (SELECT hd.* FROM hd SEMI JOIN dg ON hd.gr_id = dg.gr_id AND hd.d = dg.d) " + sql6("nhours, h_rise, h_set", "z", "cell_id, d, t_hfirst, t_hlast, t_hmax"))
def _(s, d):
    c = hourly_cells(s, d)
    days = daily.region_days(daily_of_hours(s, d), c, 75.0)
    return r6(daily.hourly_days(daily.on_exceedance_days(tables.hourly(s, d), days, c), c).select("cell_id", "d", "t_hfirst", "t_hlast", "t_hmax", "nhours", "h_rise", "h_set"))


@register("hourly_daily_weights", f"WITH {HOT}, x AS (SELECT hd.gr_id, hd.d, nhours, (dtem > 0)::INT * de.area AS a FROM hd JOIN de USING (cell_id, d)), z AS (SELECT gr_id, d, coalesce(sum(nhours * a) / nullif(sum(a), 0), 0) AS nhours_gr FROM x GROUP BY ALL) " + sql6("nhours_gr", "z", "gr_id, d"))
def _(s, d):
    c = hourly_cells(s, d)
    return r6(daily.hourly_region(daily.hourly_days(tables.hourly(s, d), c), daily_of_hours(s, d), c).select("gr_id", "d", "nhours_gr"))


HOURS_EX = f"""{HOURS_GR}, dm AS (SELECT cell_id, gr_id, area, ts::DATE AS d, max(v) AS v FROM hourly JOIN cell USING (cell_id) GROUP BY ALL), dbv0 AS (SELECT *, (dtem > 0)::INT * area AS dtea FROM (SELECT dm.*, CASE WHEN v - thr <= 0 THEN 0.0::DOUBLE ELSE v - thr END AS dtem FROM dm JOIN ht USING (cell_id))),
{sql_region()}, {sql_ctp_gr("monthly")}, hp AS (SELECT gr_id, date_trunc('month', d)::DATE AS p, coalesce(avg(nhours_gr) FILTER (WHERE nhours_gr > 0), 0) AS h FROM hg GROUP BY ALL)"""


@register("hours_times_extremity", f"WITH {HOURS_EX}, z AS (SELECT gr_id, p, em_gr * h AS htex_gr, tex_gr * h AS htotal_ex_gr, es_avg_gr * h AS hes_avg_gr FROM ctp LEFT JOIN hp USING (gr_id, p)) " + sql6("htex_gr, htotal_ex_gr, hes_avg_gr", "z", "gr_id, p"))
def _(s, d):
    """Period metrics of the daily maxima of the hourly field, times its hours of exposure."""
    c = hourly_cells(s, d)
    days = daily.mark_events(daily.region_days(daily_of_hours(s, d), c), "gr_id", "dtec_gr", "dteec_gr")
    hours = periods.hourly_periods(hourly_gr(s, d), "gr_id", "monthly", "_gr")
    return r6(periods.with_hours(periods.region_periods(days, "monthly"), hours, "gr_id", "_gr").select("gr_id", "p", "htex_gr", "htotal_ex_gr", "hes_avg_gr"))


# ------------------------------------------------------------------ decadal driver, references, factors


def _win(m: str, w: tuple[int, int, int]) -> str:
    return f"CASE WHEN n > {w[1]} AND n <= c - {w[2]} AND c >= {w[0]} THEN avg({m}) OVER (PARTITION BY gr_id ORDER BY p ROWS BETWEEN {w[1]} PRECEDING AND {w[2]} FOLLOWING) END AS {m}"


SIX = (6, 3, 2)


@register(
    "decadal_driver",
    f"WITH {CTPM}, dn AS (SELECT *, row_number() OVER (PARTITION BY gr_id ORDER BY p) AS n, count(*) OVER (PARTITION BY gr_id) AS c FROM ctp), de AS (SELECT gr_id, p, {_win('ef_gr', SIX)}, {_win('ed_avg_gr', SIX)}, {_win('em_avg_gr', SIX)}, {_win('aep_gr', SIX)}, {_win('doy_first_gr', SIX)}, {_win('doy_last_gr', SIX)} FROM dn), z AS (SELECT gr_id, p, ef_gr * ed_avg_gr AS ed_gr, ef_gr * ed_avg_gr * em_avg_gr AS em_gr, ef_gr * ed_avg_gr * em_avg_gr AS tex_gr, doy_first_gr - 0.5::DOUBLE * (30.5 * aep_gr - (doy_last_gr - doy_first_gr + 1)) AS doy_first_gr FROM de), y AS (SELECT gr_id, p, ed_gr, em_gr, em_gr AS texgr, doy_first_gr FROM z) " + sql6("ed_gr, em_gr, doy_first_gr", "y", "gr_id, p"),
)
def _(s, d):
    x = decadal.decadal_driver(ctp(s, d), "gr_id", ["ef_gr", "ed_avg_gr", "em_avg_gr", "aep_gr", "doy_first_gr", "doy_last_gr"], SIX)
    return r6(x.select("gr_id", "p", "ed_gr", "em_gr", "doy_first_gr"))


@register("temporal_extremity", f"WITH {CTPM} SELECT gr_id, p, round(em_gr + 1.23e-9::DOUBLE, 6) + 0.0::DOUBLE AS tex_gr FROM ctp")
def _(s, d):
    return r6(decadal.temporal_names(ctp(s, d).select("gr_id", "p", "em_gr")).select("gr_id", "p", "tex_gr"))


@register("annual_reference", f"WITH {CTPM}, z AS (SELECT gr_id, avg(ed_gr) AS ed_gr_ref, avg(em_gr) AS em_gr_ref FROM ctp WHERE p BETWEEN DATE '1995-06-01' AND DATE '1998-05-01' GROUP BY gr_id) " + sql6("ed_gr_ref, em_gr_ref", "z", "gr_id"))
def _(s, d):
    return r6(decadal.annual_means(ctp(s, d), "gr_id", ["ed_gr", "em_gr"], *REF))


@register("reference_columns", f"WITH {CTPM}, r AS (SELECT gr_id, exp(avg(ln(CASE WHEN ed_gr > 0 THEN ed_gr END)) FILTER (WHERE p BETWEEN DATE '{REF[0]}' AND DATE '{REF[1]}')) AS ed_gr_ref, exp(avg(ln(CASE WHEN ed_gr > 0 THEN ed_gr END)) FILTER (WHERE p BETWEEN DATE '{CC[0]}' AND DATE '{CC[1]}')) AS ed_gr_cc FROM ctp GROUP BY gr_id), z AS (SELECT gr_id, p, ed_gr, ed_gr_ref, ed_gr_cc FROM ctp LEFT JOIN r USING (gr_id)) " + sql6("ed_gr, ed_gr_ref, ed_gr_cc", "z", "gr_id, p"))
def _(s, d):
    x = ctp(s, d).select("gr_id", "p", "ed_gr")
    return r6(sinks.with_means(x, decadal.reference_pair(x, "gr_id", ["ed_gr"], REF, CC), "gr_id"))


STATION = DBV + ", sp AS (SELECT cell_id, date_trunc('month', d)::DATE AS p, sum(dteec)::DOUBLE AS ef, sum(dtec)::DOUBLE / nullif(sum(dteec), 0) AS ed_avg, sum(dtem) / nullif(sum(dtec), 0) AS em_avg FROM dbv GROUP BY ALL)"


def station_periods(s: SparkSession, d: str) -> DataFrame:
    x = daily.mark_events(dbv_plain(s, d), "cell_id", "dtec", "dteec").groupBy("cell_id", F.trunc("d", "month").alias("p"))
    return x.agg(F.sum("dteec").cast("double").alias("ef"), F.try_divide(F.sum("dtec").cast("double"), F.sum("dteec")).alias("ed_avg"), F.try_divide(F.sum("dtem"), F.sum("dtec")).alias("em_avg"))


@register(
    "station_af",
    f"WITH {STATION}, r AS (SELECT cell_id, " + ", ".join(f"exp(avg(ln(CASE WHEN {m} > 0 THEN {m} END)) FILTER (WHERE p BETWEEN DATE '{a}' AND DATE '{b}')) AS {m}{e}" for m in ("ef", "ed_avg", "em_avg") for e, (a, b) in (("_r", REF), ("_c", CC))) + " FROM sp GROUP BY cell_id), z AS (SELECT cell_id, p, ef / ef_r AS f, ed_avg / ed_avg_r AS da, em_avg / em_avg_r AS ma, ef_c / ef_r * (ed_avg_c / ed_avg_r) * (em_avg_c / em_avg_r) AS em_af_cc FROM sp JOIN r USING (cell_id)), y AS (SELECT cell_id, p, f * da AS ed_af, f * da * ma AS em_af, em_af_cc FROM z) " + sql6("ed_af, em_af, em_af_cc", "y", "cell_id, p"),
)
def _(s, d):
    return r6(decadal.station_factors(station_periods(s, d), "cell_id", ["ef", "ed_avg", "em_avg"], REF, CC).select("cell_id", "p", "ed_af", "em_af", "em_af_cc"))


@register("network_events", f"WITH {DBV}, g0 AS (SELECT gr_id, d, max(dtec) AS dtec_gr, coalesce(sum(dtem), 0) AS dtem_gr FROM dbv0 GROUP BY ALL), " + sql_events("g0", "gr_id", "dtec_gr", "dteec_gr", "g") + " " + sql6("dtem_gr", "g", "gr_id, d, dtec_gr, dteec_gr"))
def _(s, d):
    x = dbv_plain(s, d).join(tables.cells(s, d).select("cell_id", "gr_id"), "cell_id")
    return r6(daily.network_events(x).select("gr_id", "d", "dtec_gr", "dteec_gr", "dtem_gr"))


@register("relative_area", f"WITH {GR}, z AS (SELECT gr_id, d, 100 * dtea_gr / (SELECT sum(area) FROM cell c WHERE c.gr_id = gr.gr_id) AS dtea_rel_gr FROM gr) " + sql6("dtea_rel_gr", "z", "gr_id, d"))
def _(s, d):
    return r6(daily.relative_area(region(s, d), daily.region_sizes(grid(s, d, "left"))).select("gr_id", "d", "dtea_rel_gr"))


# ------------------------------------------------------------------ masks, filters, thresholds

LAND = CELL + ", land AS (SELECT *, (cell_id * 97 % 13) * 150.0::DOUBLE AS altitude, (cell_id * 31 % 10) / 10.0::DOUBLE AS lsm FROM cell)"


@register("land_mask", f"WITH {LAND} SELECT cell_id, CASE WHEN lsm > 0.3 AND altitude < 1500 THEN 1.0::DOUBLE END AS mask_frac FROM land")
def _(s, d):
    return prepare.region_mask(tables.altitude(s, d), "land", least=0.3, below=1500.0)


@register("crop_box", f"WITH {CELL} SELECT cell_id FROM cell WHERE y BETWEEN 44.5 AND 45.5 AND x BETWEEN 9.4 AND 10.6")
def _(s, d):
    return prepare.crop(tables.cells(s, d), 45.5, 44.5, 9.4, 10.6).select("cell_id")


@register("crop_margin", f"WITH {CELL}, b AS (SELECT floor(min(y) - 0.4) AS s, ceil(max(y) + 0.4) AS n, floor(min(x) - 0.4 / cos(radians(max(y)))) AS w, ceil(max(x) + 0.4 / cos(radians(max(y)))) AS e FROM cell WHERE gr_id = 2) SELECT cell_id FROM cell, b WHERE y BETWEEN s AND n AND x BETWEEN w AND e")
def _(s, d):
    c = tables.cells(s, d)
    return prepare.crop_to_mask(c, c.filter("gr_id = 2"), 0.4).select("cell_id")


@register("threshold_absolute", f"WITH {CELL}, {DAILY}, z AS (SELECT cell_id, d, CASE WHEN v - 50 <= 0 THEN 0 ELSE v - 50 END AS dtem FROM daily JOIN cell USING (cell_id)) " + sql6("dtem", "z", "cell_id, d"))
def _(s, d):
    c, x = tables.cells(s, d), tables.daily(s, d)
    return r6(daily.cell_exceedance(x, c.join(prepare.threshold_of(x, c, "abs", 50.0), "cell_id")).select("cell_id", "d", "dtem"))


@register("wet_days", f"WITH {RAIN} " + sql6("v", "rain WHERE v >= 30", "cell_id, d"))
def _(s, d):
    return r6(prepare.wet(tables.rain(s, d), 30.0).select("cell_id", "d", "v"))


@register("season_means", f"WITH {CELL}, {DAILY}, g AS (SELECT gr_id, d, sum(v) AS v FROM daily JOIN cell USING (cell_id) GROUP BY ALL), z AS (SELECT gr_id, year(d)::INT AS year, avg(v) AS v FROM g WHERE month(d) BETWEEN 4 AND 10 GROUP BY ALL) " + sql6("v", "z", "gr_id, year"))
def _(s, d):
    g = tables.daily(s, d).join(tables.cells(s, d), "cell_id").groupBy("gr_id", "d").agg(F.sum("v").alias("v"))
    return r6(prepare.season_means(g, 4, 10).select("gr_id", "year", "v"))


@register("packed_round_trip", f"WITH {DAILY}, z AS (SELECT cell_id, d, round_even(v / 0.1::DOUBLE, 0) * 0.1::DOUBLE AS v FROM daily) " + sql6("v", "z", "cell_id, d"))
def _(s, d):
    return r6(sinks.unpacked16(sinks.packed16(tables.daily(s, d), "v"), "v").select("cell_id", "d", "v"))


# ------------------------------------------------------------------ analytics


@register("trend_bounds", f"WITH {CTPM}, t AS (SELECT gr_id, datediff('month', DATE '1995-01-01', p)::DOUBLE AS t, em_gr FROM ctp), g AS (SELECT gr_id, regr_slope(em_gr, t) AS slope, regr_sxx(em_gr, t) AS sxx, regr_syy(em_gr, t) AS syy, count(*) AS n FROM t GROUP BY gr_id), z AS (SELECT gr_id, slope, sqrt(greatest(syy - slope * slope * sxx, 0) / ((n - 2) * sxx)) AS se FROM g), y AS (SELECT gr_id, slope - 1.645::DOUBLE * se AS slope_low, slope + 1.645::DOUBLE * se AS slope_high FROM z) " + sql6("slope_low, slope_high", "y", "gr_id"))
def _(s, d):
    t = ctp(s, d).withColumn("t", F.months_between("p", F.lit("1995-01-01").cast("date")))
    return r6(analysis.trend_bounds(t, "gr_id", "t", "em_gr").select("gr_id", "slope_low", "slope_high"))


@register("trend_ratio", f"WITH {CTPM}, g AS (SELECT gr_id, regr_slope(ed_gr, datediff('month', DATE '1995-01-01', p)::DOUBLE) AS slope FROM ctp GROUP BY gr_id), z AS (SELECT gr_id, slope / (SELECT slope FROM g WHERE gr_id = 2) AS ratio FROM g) " + sql6("ratio", "z", "gr_id"))
def _(s, d):
    t = ctp(s, d).withColumn("t", F.months_between("p", F.lit("1995-01-01").cast("date")))
    return r6(analysis.trend_ratio(t, "gr_id", "t", "ed_gr", 2))


@register("factor_spans", f"WITH {CTPM}, q AS (SELECT gr_id, n, exp(avg(ln(x))) AS factor, stddev_pop(x) / sqrt((SELECT greatest(sum(area) / pow(2 * pi() * 6371 / 360 * 1, 2) * 100, 1) FROM cell)) AS spread FROM (SELECT gr_id, em_gr AS x, CASE WHEN p <= DATE '1998-05-01' THEN 'early' ELSE 'late' END AS n FROM ctp WHERE em_gr > 0 AND p BETWEEN DATE '{REF[0]}' AND DATE '{CC[1]}') GROUP BY ALL) " + sql6("factor, spread", "(SELECT gr_id, n AS span, factor, spread FROM q)", "gr_id, span"))
def _(s, d):
    dof = regions.degrees_of_freedom(tables.cells(s, d).withColumnRenamed("area", "gr_area"), 1.0)
    return r6(analysis.factor_spans(ctp(s, d), "gr_id", "em_gr", [("early", *REF), ("late", *CC)], dof))


@register("row_means", f"WITH {CTPM}, n AS (SELECT gr_id, em_gr, row_number() OVER (PARTITION BY gr_id ORDER BY p) - 1 AS k, count(*) OVER (PARTITION BY gr_id) AS c FROM ctp), z AS (SELECT gr_id, avg(em_gr) AS em_gr FROM n WHERE k >= c - 10 AND k < c - 4 GROUP BY gr_id) " + sql6("em_gr", "z", "gr_id"))
def _(s, d):
    return r6(analysis.mean_of_rows(ctp(s, d), "gr_id", "em_gr", -10, -4))


@register("decade_pairs", f"WITH {DAILY}, {RAIN}, t AS (SELECT cell_id, quantile_cont(v, 0.9) AS t FROM daily GROUP BY cell_id), z AS (SELECT daily.cell_id, (year(daily.d) // 10 * 10)::INT AS decade, avg(daily.v) AS a, avg(rain.v) AS b, count(*) AS n FROM daily JOIN t USING (cell_id) JOIN rain USING (cell_id, d) WHERE daily.v >= t GROUP BY ALL) " + sql6("a, b", "z", "cell_id, decade, n"))
def _(s, d):
    return r6(analysis.decade_pairs(tables.daily(s, d), tables.rain(s, d), ["cell_id", "d"]).select("cell_id", "decade", "n", "a", "b"))


@register("factor_bands", f"WITH {CTPM}, v AS (SELECT gr_id, stddev_pop(em_gr) AS sigma FROM ctp GROUP BY gr_id), z AS (SELECT gr_id, 1 - 1.645::DOUBLE * sigma AS low90, 1 - sigma AS low, 1 + sigma AS high, 1 + 1.645::DOUBLE * sigma AS high90 FROM v) " + sql6("low90, low, high, high90", "z", "gr_id"))
def _(s, d):
    v = ctp(s, d).groupBy("gr_id").agg(F.stddev_pop("em_gr").alias("sigma"))
    return r6(analysis.bands(v, "em_gr", "sigma").drop("sigma"))


@register("log_products", f"WITH {CTPM}, z AS (SELECT gr_id, p, CASE WHEN ed_gr > 0 AND em_gr > 0 THEN ed_gr * em_gr END AS product FROM ctp) " + sql6("product", "z", "gr_id, p"))
def _(s, d):
    return r6(ctp(s, d).select("gr_id", "p", analysis.log_product(F.col("ed_gr"), F.col("em_gr")).alias("product")))


@register("box_mean", f"WITH {CELL}, {DAILY}, {THR}, z AS (SELECT avg(thr) AS thr FROM cell JOIN thr USING (cell_id) WHERE y BETWEEN 44.5 AND 45.5 AND x BETWEEN 9.4 AND 10.6) " + sql6("thr", "z"))
def _(s, d):
    return r6(analysis.box_mean(grid(s, d), 44.5, 45.5, 9.4, 10.6, "thr"))


@register("min_duration_af", f"WITH {COMP}, rf AS (SELECT gr_id, min(ed_gr) FILTER (WHERE p BETWEEN DATE '{REF[0]}' AND DATE '{REF[1]}') AS least, exp(avg(ln(CASE WHEN em_gr > 0 THEN em_gr END)) FILTER (WHERE p BETWEEN DATE '{REF[0]}' AND DATE '{REF[1]}')) AS r FROM dec_ GROUP BY gr_id), z AS (SELECT gr_id, p, CASE WHEN least >= 1.5 THEN em_gr / r END AS em_gr_af FROM dec_ JOIN rf USING (gr_id)) " + sql6("em_gr_af", "z", "gr_id, p"))
def _(s, d):
    return r6(decadal.amplification(decadal.compounds(dec(s, d)), "gr_id", ["ed_gr", "em_gr"], REF, CC, 15.0).select("gr_id", "p", "em_gr_af"))


@register("compare_relative", f"WITH {CTPM}, j AS (SELECT em_gr AS e2, em_gr * (1 + (gr_id + 1) / 200.0::DOUBLE) AS e1, ed_gr AS d2, CASE WHEN gr_id = 3 THEN ed_gr * 1.5 ELSE ed_gr END AS d1 FROM ctp), z AS (SELECT 'em_gr' AS metric, max(abs(CASE WHEN e2 = 0 THEN 0 ELSE (e1 - e2) / e2 END)) AS gap FROM j UNION ALL SELECT 'ed_gr', max(abs(CASE WHEN d2 = 0 THEN 0 ELSE (d1 - d2) / d2 END)) FROM j), y AS (SELECT *, 0::BIGINT AS one_sided, gap <= 0.05 AS within FROM z) " + sql6("gap", "y", "metric, one_sided, within"))
def _(s, d):
    """Metrics off by up to 2.5 percent are within 5 percent, those off by half are not."""
    x = ctp(s, d).select("gr_id", "p", "em_gr", "ed_gr")
    off = x.select("gr_id", "p", (F.col("em_gr") * (1 + (F.col("gr_id") + 1) / 200.0)).alias("em_gr"), F.when(F.col("gr_id") == 3, F.col("ed_gr") * 1.5).otherwise(F.col("ed_gr")).alias("ed_gr"))
    return r6(analysis.compare(off, x, ["gr_id", "p"], ["em_gr", "ed_gr"], relative=0.05))


@register("point_lookup", f"WITH {CELL}, {DAILY}, {THR}, z AS (SELECT cell_id, thr FROM cell JOIN thr USING (cell_id) ORDER BY round(abs(y - 44.9) + abs(x - 10.3), 9), cell_id LIMIT 1) " + sql6("thr", "z", "cell_id"))
def _(s, d):
    return r6(analysis.at_point(grid(s, d), 44.9, 10.3).select("cell_id", "thr"))


@register("inner_lattice", f"WITH {CELL}, b AS (SELECT max(y) AS top, min(y) AS low, min(x) AS l, max(x) AS r FROM cell), c AS (SELECT *, round(round_even(0.5 / cos(radians(top - 0.5)) / 0.25, 0) * 0.25, 2) AS wide FROM b), k AS (SELECT *, ceil((top - low + 0.25 - 1) / 0.25 - 1e-9)::INT AS ny, ceil((r - l + 0.25 - 2 * wide) / 0.25 - 1e-9)::INT AS nx FROM c), z AS (SELECT iy * nx + ix AS gr_id, top - 0.5 - iy * 0.25 AS yc, l + wide + ix * 0.25 AS xc FROM k, range(40) t(iy), range(40) u(ix) WHERE iy < ny AND ix < nx) " + sql6("yc, xc", "(SELECT gr_id::INT AS gr_id, yc, xc FROM z)", "gr_id"))
def _(s, d):
    return r6(regions.inner_lattice(tables.cells(s, d), 0.25, 1.0).select("gr_id", "yc", "xc"))


@register("reduced_region", f"WITH {CELL}, m AS (SELECT *, CASE WHEN cell_id = 0 THEN mask_frac END AS mf FROM cell), b AS (SELECT greatest(floor(min(y) FILTER (WHERE mf > 0) - 0.25), min(y)) AS s, least(ceil(max(y) FILTER (WHERE mf > 0) + 0.25), max(y)) AS n, min(x) FILTER (WHERE mf > 0) AS w, max(x) FILTER (WHERE mf > 0) AS e, min(x) AS w0, max(x) AS e0 FROM m), c AS (SELECT s, n, greatest(floor(w - 0.5 / cos(radians(n)) / 2), w0) AS w, least(ceil(e + 0.5 / cos(radians(n)) / 2), e0) AS e FROM b) SELECT cell_id FROM cell, c WHERE y BETWEEN s AND n AND x BETWEEN w AND e")
def _(s, d):
    c = tables.cells(s, d)
    return prepare.reduced(c, c.withColumn("mask_frac", F.when(F.col("cell_id") == 0, F.col("mask_frac"))), 0.5).select("cell_id")


HOURLY_DEC = f"{HOURS_EX}, hq AS (SELECT gr_id, date_trunc('month', d)::DATE AS p, avg(h_rise_gr) AS rise, avg(h_set_gr) AS sets FROM hg GROUP BY ALL), z AS (SELECT gr_id, p, ef_gr * ed_avg_gr * em_avg_gr * h AS htex_gr, ed_avg_gr * em_avg_gr * ea_avg_gr * h AS hes_avg_gr, ef_gr * ed_avg_gr * em_avg_gr * ea_avg_gr * h AS htotal_ex_gr, rise * (h / nullif(rise + sets, 0)) AS h_rise_avg_gr, sets * (h / nullif(rise + sets, 0)) AS h_set_avg_gr FROM ctp JOIN hp USING (gr_id, p) JOIN hq USING (gr_id, p)) "


@register("decadal_hours", f"WITH {HOURLY_DEC}" + sql6("htex_gr, hes_avg_gr, htotal_ex_gr, h_rise_avg_gr, h_set_avg_gr", "z", "gr_id, p"))
def _(s, d):
    """Hourly compounds and the adjusted hours of a decadal table whose windows are one row long."""
    c = hourly_cells(s, d)
    days = daily.mark_events(daily.region_days(daily_of_hours(s, d), c), "gr_id", "dtec_gr", "dteec_gr")
    x = periods.with_hours(periods.region_periods(days, "monthly"), periods.hourly_periods(hourly_gr(s, d), "gr_id", "monthly", "_gr"), "gr_id", "_gr")
    basic = ["ef_gr", "ed_avg_gr", "em_avg_gr", "ea_avg_gr", "h_avg_gr", "h_rise_avg_gr", "h_set_avg_gr"]
    return r6(decadal.decadal_driver(x.select("gr_id", "p", *basic), "gr_id", basic, (1, 0, 0)).select("gr_id", "p", "htex_gr", "hes_avg_gr", "htotal_ex_gr", "h_rise_avg_gr", "h_set_avg_gr"))


@register("coarse_blocks", f"WITH {CELL}, k AS (SELECT *, cell_id // 5 AS iy, cell_id % 5 AS ix FROM cell), z AS (SELECT (iy // 2)::BIGINT AS yb, (ix // 2)::BIGINT AS xb, count(*) FILTER (WHERE mask_frac > 0) / 4.0::DOUBLE AS mask_frac, sum(area) AS gr_area FROM k WHERE iy < 4 AND ix < 4 GROUP BY ALL) " + sql6("mask_frac, gr_area", "z", "yb, xb"))
def _(s, d):
    """Blocks of two by two of a lattice of five by five, whose last row and column are trimmed."""
    c = tables.cells(s, d).withColumn("iy", F.floor(F.col("cell_id") / 5)).withColumn("ix", (F.col("cell_id") % 5).cast("long"))
    return r6(regions.coarse_blocks(c, 2))


@register("areas_by_plane", f"WITH {CELL}, z AS (SELECT cell_id, area AS globe, 5.0::DOUBLE * 2 / 100 * mask_frac AS plane FROM cell) " + sql6("globe, plane", "z", "cell_id"))
def _(s, d):
    c = tables.cells(s, d).drop("area")
    globe = prepare.with_area(c, tables.STEP, tables.STEP).select("cell_id", F.col("area").alias("globe"))
    return r6(globe.join(prepare.with_area(c, 5000.0, 2000.0, True).select("cell_id", F.col("area").alias("plane")), "cell_id"))


@register("wrapped_land", f"WITH {LAND} SELECT cell_id, round((CASE WHEN x + 171 > 180 THEN x + 171 - 360 ELSE x + 171 END) + 1.23e-9::DOUBLE, 6) AS x, CASE WHEN cell_id % 3 > 0 THEN round(lsm + 1.23e-9::DOUBLE, 6) END AS lsm FROM land")
def _(s, d):
    """Longitudes beyond 180 are wrapped; a third of the cells has no share of land."""
    c = tables.cells(s, d).withColumn("x", F.col("x") + 171)
    land = tables.altitude(s, d).filter("cell_id % 3 > 0").select("cell_id", "lsm")
    return r6(prepare.with_land(c, land).select("cell_id", "x", "lsm"))
