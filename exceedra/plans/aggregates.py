"""Registered queries of the aggregate of a lattice, from daily values to factors."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.operators import aggregate, decadal, regions
from exceedra.plans import run as runs
from exceedra.plans.queries import SUB, extent, r6, register, sql6, sql_ctp_gr, sql_events, window_weights, windows
from exceedra.plans.registry import described
from exceedra.plans.spatial import LAND
from exceedra.plans.stored import CONFIG as ONE_RUN
from exceedra.plans.stored import fresh_store
from exceedra.sources import tables

REF, CC, SHAPE, LEAST = ("1996-01-01", "1997-12-31"), ("1999-01-01", "2000-12-31"), (3, 1, 1), 10.0
BASIC = [f"{m}_gr" for m in aggregate.BASIC]
EVERY = [*BASIC, *[f"{m}_gr" for m in aggregate.COMPOUND]]
SPREAD = ["ef_gr", "em_avg_gr", "tex_gr"]


def _compound(source: str, keys: str, name: str) -> str:
    """Compounds of basic columns as two steps of SQL."""
    k = f"{keys}, " if keys else ""
    return f"""{name}_0 AS (SELECT {k}{", ".join(BASIC)}, ef_gr * ed_avg_gr AS ed_gr, ed_avg_gr * em_avg_gr AS dm_avg_gr FROM {source}),
{name}_1 AS (SELECT *, ed_gr * em_avg_gr AS em_gr, ed_gr * em_avg_md_gr AS em_md_gr, dm_avg_gr * ea_avg_gr AS es_avg_gr FROM {name}_0), {name} AS (SELECT *, ef_gr * es_avg_gr AS tex_gr FROM {name}_1)"""


def _gmean(m: str, span: tuple[str, str]) -> str:
    return f"exp(avg(ln(CASE WHEN {m} > 0 THEN {m} END)) FILTER (WHERE p BETWEEN DATE '{span[0]}' AND DATE '{span[1]}'))"


def _spread(m: str, centre: str, area: str = "a") -> str:
    up = f"coalesce({m} >= {centre}, false)"
    part = lambda on: f"sqrt(coalesce(sum({area} * pow({m} - {centre}, 2)) FILTER (WHERE {on}), 0) / sum({area}) FILTER (WHERE {on}))"
    return f"{part(up)} AS {m}_supp, {part('NOT ' + up)} AS {m}_slow"


CHAIN = f"""{SUB.replace("wd AS (", "wd_ AS (")}, gr2 AS (SELECT *, dtem_gr * dtea_gr AS dtema_gr FROM wd_), {sql_events("gr2", "gr_id", "dtec_gr", "dteec_gr", "gr")},
{sql_ctp_gr("annual")},
dn AS (SELECT *, row_number() OVER (PARTITION BY gr_id ORDER BY p) AS n, count(*) OVER (PARTITION BY gr_id) AS c FROM ctp),
d0 AS (SELECT gr_id, p, {", ".join(f"CASE WHEN n > 1 AND n <= c - 1 AND c >= 3 THEN avg({m}) OVER (PARTITION BY gr_id ORDER BY p ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS {m}" for m in BASIC)} FROM dn),
wa AS (SELECT gr_id, sum(area) AS a FROM lnk WHERE gr_id IN (SELECT gr_id FROM lnk SEMI JOIN thr USING (cell_id)) GROUP BY gr_id),
{_compound("d0", "gr_id, p", "dc")}, full_ AS (SELECT * FROM dc JOIN wa USING (gr_id)),
own AS (SELECT gr_id, any_value(a) AS a, {", ".join(f"{_gmean(m, REF)} AS {m}" for m in EVERY)} FROM full_ GROUP BY gr_id),
rw AS (SELECT {", ".join(f"sum(a * {m}) / sum(a) AS {m}" for m in BASIC)} FROM own), {_compound("rw", "", "rc")},
mt AS (SELECT p, {", ".join(f"sum(a * {m}) / sum(a) AS {m}" for m in BASIC)} FROM full_ GROUP BY p),
tr AS (SELECT {", ".join(f"{_gmean(m, REF)} AS {m}" for m in BASIC)} FROM mt),
sc AS (SELECT p, {", ".join(f"mt.{m} * (rw.{m} / tr.{m}) AS {m}" for m in BASIC)} FROM mt, rw, tr), {_compound("sc", "p", "xs")},
xc AS (SELECT {", ".join(f"{_gmean(m, CC)} AS {m}" for m in EVERY)} FROM xs)"""
MEAN_COLS = [m.replace("_gr", "_agr") for m in EVERY]


def window_decades(s: SparkSession, d: str) -> DataFrame:
    return decadal.decadal_means(regions.window_periods(windows(s, d), "annual"), "gr_id", BASIC, SHAPE)


def stored_windows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Decadal metrics of all windows and the windows' areas, as stored levels: the aggregate reads them often."""
    store = fresh_store(s)
    store.save(described(window_decades(s, d), "DEC", "degC"), "DEC", "lattice", 1995, 2001)
    areas = store.load_or_build("STATIC", "lattice-areas", 1995, 2001, lambda: window_weights(s, d))
    return store.load("DEC", "lattice", 1995, 2001, ["gr_id"]), areas


def whole(s: SparkSession, d: str) -> aggregate.Aggregate:
    windows_, areas = stored_windows(s, d)
    return aggregate.aggregate(windows_, areas, REF, CC, LEAST)


@register(
    "aggregate_means",
    f"WITH {CHAIN}, sp AS (SELECT p, {', '.join(_spread('f.' + m, 'x.' + m).replace(f'AS f.{m}', f'AS {m}') for m in SPREAD)} FROM full_ f JOIN xs x USING (p) GROUP BY p), z AS (SELECT p, {', '.join(f'{m} AS {a}' for m, a in zip(EVERY, MEAN_COLS, strict=True))}, {', '.join(f'{m}_{e} AS {m.replace("_gr", "_agr")}_{e}' for m in SPREAD for e in ('supp', 'slow'))} FROM xs JOIN sp USING (p)) "
    + sql6(", ".join([*MEAN_COLS, *[f"{m.replace('_gr', '_agr')}_{e}" for m in SPREAD for e in ("supp", "slow")]]), "z", "p"),
)
def _(s, d):
    return r6(whole(s, d).means.select("p", *MEAN_COLS, *[f"{m.replace('_gr', '_agr')}_{e}" for m in SPREAD for e in ("supp", "slow")]))


AF_COLS = [f"{m}_af{e}" for m in MEAN_COLS for e in ("", "_cc")]


@register(
    "aggregate_factors",
    f"WITH {CHAIN}, z AS (SELECT p, {', '.join(f'CASE WHEN rc.ed_gr >= 1 THEN xs.{m} / rc.{m} END AS {a}_af, CASE WHEN rc.ed_gr >= 1 THEN xc.{m} / rc.{m} END AS {a}_af_cc' for m, a in zip(EVERY, MEAN_COLS, strict=True))} FROM xs, rc, xc) " + sql6(", ".join(AF_COLS), "z", "p"),
)
def _(s, d):
    """Stored as a level and read back, as a run does."""
    store = fresh_store(s)
    store.save(described(whole(s, d).factors, "AF"), "AF", "lattice", 1995, 2001)
    return r6(store.load("AF", "lattice", 1995, 2001, []).select("p", *AF_COLS))


@register(
    "aggregate_references",
    f"WITH {CHAIN}, z AS (SELECT {', '.join(f'rc.{m} AS {a}_ref, xc.{m} AS {a}_cc' for m, a in zip(EVERY, MEAN_COLS, strict=True))} FROM rc, xc) " + sql6(", ".join(f"{a}_{e}" for a in MEAN_COLS for e in ("ref", "cc")), "z"),
)
def _(s, d):
    return r6(whole(s, d).references)


PERC = ["em_avg_gr", "tex_gr"]
_LONG = " UNION ALL ".join(f"SELECT '{m.replace('_gr', '_agr')}' AS metric, gr_id, a, p, {m} AS x FROM full_" for m in PERC)


@register(
    "aggregate_percentiles",
    f"WITH {CHAIN}, lg AS ({_LONG}), w0 AS (SELECT metric, p, gr_id, x, a / sum(a) OVER (PARTITION BY metric, p) AS w FROM lg WHERE x IS NOT NULL), w1 AS (SELECT metric, p, x, sum(w) OVER (PARTITION BY metric, p ORDER BY x, gr_id ROWS UNBOUNDED PRECEDING) AS c FROM w0), w2 AS (SELECT metric, p, coalesce(max(x) FILTER (WHERE c <= 0.05), min(x)) AS p05, arg_min(c, abs(c - 0.95)) AS cn, arg_min(x, abs(c - 0.95)) AS an, coalesce(min(x) FILTER (WHERE c >= 0.95), max(x)) AS above FROM w1 GROUP BY metric, p), w3 AS (SELECT metric, p, p05, CASE WHEN cn >= 0.95 THEN an ELSE above END AS p95 FROM w2), z AS (SELECT p, {', '.join(f"max({e}) FILTER (WHERE metric = '{m.replace('_gr', '_agr')}') AS {m.replace('_gr', '_agr')}_{e}" for m in PERC for e in ('p05', 'p95'))} FROM w3 GROUP BY p) "
    + sql6(", ".join(f"{m.replace('_gr', '_agr')}_{e}" for m in PERC for e in ("p05", "p95")), "z", "p"),
)
def _(s, d):
    return r6(aggregate.wide_percentiles(whole(s, d).percentiles, [m.replace("_gr", "_agr") for m in PERC]))


@register(
    "aggregate_in_box",
    f"WITH {CHAIN.replace('FROM lnk WHERE gr_id IN', 'FROM lnk JOIN lat USING (gr_id) WHERE yc BETWEEN 44.5 AND 46 AND xc BETWEEN 9 AND 10.5 AND gr_id IN')}, z AS (SELECT p, ef_gr AS ef_agr, tex_gr AS tex_agr FROM xs) " + sql6("ef_agr, tex_agr", "z", "p"),
)
def _(s, d):
    """The aggregate of the windows whose centres lie in a box."""
    inside = aggregate.within(extent(s, d).withColumn("gr_id", F.col("gr_id").cast("int")), (46.0, 44.5), (9.0, 10.5))
    decades, areas = stored_windows(s, d)
    areas = areas.join(inside.select("gr_id"), "gr_id", "left_semi")
    return r6(aggregate.aggregate(decades, areas, REF, CC, LEAST).means.select("p", "ef_agr", "tex_agr"))


@register("aggregate_degrees", f"WITH {CHAIN}, z AS (SELECT greatest(sum(a) / pow(2 * pi() * 6371 / 360 * 2, 2) * 100, 1) AS n_dof FROM wa) " + sql6("n_dof", "z"))
def _(s, d):
    return r6(regions.degrees_of_freedom(window_weights(s, d).withColumnRenamed("a", "gr_area"), 2.0))


# ------------------------------------------------------------------ from a configuration

CONFIG = dataclasses.replace(ONE_RUN, min_exceedance_area=0.0001, agr_size=2.0, land_frac_min=0.4)
LANDED = CHAIN.replace("FROM lnk WHERE gr_id IN", "FROM lnk WHERE gr_id IN (SELECT gr_id FROM wl WHERE land_share >= 0.4 - 1e-9) AND gr_id IN").replace("wa AS (", f"{LAND}, wa AS (", 1)
RUN_COLS = ["ef_agr_af", "tex_agr_af", "tex_agr_af_cc", "em_agr_af", "n_dof_agr"]


@register(
    "run_aggregate",
    f"WITH {LANDED}, dof AS (SELECT greatest(sum(a) / pow(2 * pi() * 6371 / 360 * 2, 2) * 100, 1) AS n FROM wa), z AS (SELECT p, n AS n_dof_agr, {', '.join(f'CASE WHEN rc.ed_gr >= 1 THEN xs.{m}_gr / rc.{m}_gr END AS {m}_agr_af' for m in ('ef', 'tex', 'em'))}, CASE WHEN rc.ed_gr >= 1 THEN xc.tex_gr / rc.tex_gr END AS tex_agr_af_cc FROM xs, rc, xc, dof) " + sql6(", ".join(RUN_COLS), "z", "p"),
)
def _(s, d):
    """A whole run of the aggregate over a store; windows with little land leave first."""
    store = fresh_store(s)
    land = tables.altitude(s, d).withColumn("land", F.when((F.col("lsm") > 0.3) & (F.col("altitude") < 1500), 1.0).otherwise(0.0))
    centres = regions.lattice(tables.cells(s, d), 1.0).withColumn("gr_id", F.col("gr_id").cast("int"))
    runs.run_aggregate(store, CONFIG, tables.daily(s, d), tables.cells(s, d), centres, land, tables.STEP)
    return r6(store.load("AF", "grid-agr-annual", 1995, 2001, []).select("p", *RUN_COLS))
