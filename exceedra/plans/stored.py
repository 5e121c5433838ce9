"""Registered queries of stored levels: each level is read from what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.operators import periods
from exceedra.plans import run as runs
from exceedra.plans.config import RunConfig
from exceedra.plans.queries import DBV, GR_METRICS, ctp, r6, region, register, sql6, sql_ctp_gr, sql_region
from exceedra.plans.registry import described, described_by
from exceedra.sources import tables
from exceedra.sources.store import LevelStore, merge_left, scratch_root

LEAST = 20.0
CONFIG = RunConfig.from_dict(
    {"parameter": "Tx", "threshold": 90.0, "start": 1995, "end": 2001, "ref_period": "1995-1998", "cc_period": "1998-2001", "decadal_window": "3,1,1", "min_exceedance_area": LEAST, "min_duration": 10.0, "name": "grid", "unit": "degC", "spreads": True}
)


def fresh_store(s: SparkSession) -> LevelStore:
    return LevelStore(s, scratch_root(s))


def whole_run(s: SparkSession, d: str) -> LevelStore:
    """A run over the synthetic field; only its stored levels are looked at afterwards."""
    store = fresh_store(s)
    runs.run(store, CONFIG, tables.daily(s, d), tables.cells(s, d))
    return store


ANNUAL = f"{DBV},\n{sql_region(LEAST)},\n" + sql_ctp_gr("annual")
CTP_COLS = [c.strip() for c in GR_METRICS.split(",")]


def _three(m: str) -> str:
    return f"CASE WHEN n > 1 AND n <= c - 1 AND c >= 3 THEN avg({m}) OVER (PARTITION BY gr_id ORDER BY p ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS {m}"


DEC = (
    ANNUAL
    + ", dn AS (SELECT *, row_number() OVER (PARTITION BY gr_id ORDER BY p) AS n, count(*) OVER (PARTITION BY gr_id) AS c FROM ctp), d0 AS (SELECT gr_id, p, "
    + ", ".join(_three(m) for m in runs.DECADAL)
    + """ FROM dn), d1 AS (SELECT *, ef_gr * ed_avg_gr AS ed_gr, ed_avg_gr * em_avg_gr AS dm_avg_gr, 0.5::DOUBLE * (30.5 * aep_gr - (doy_last_gr - doy_first_gr + 1)) AS off FROM d0),
d2 AS (SELECT * REPLACE (doy_first_gr - off AS doy_first_gr, doy_last_gr + off AS doy_last_gr), ed_gr * em_avg_gr AS em_gr, ed_gr * em_avg_md_gr AS em_md_gr, dm_avg_gr * ea_avg_gr AS es_avg_gr FROM d1),
dec_ AS (SELECT *, ef_gr * es_avg_gr AS tex_gr, 0.1507::DOUBLE * ef_gr * es_avg_gr AS h_aehc_gr FROM d2)"""
)
DEC_COLS = [*runs.DECADAL, "ed_gr", "em_gr", "em_md_gr", "dm_avg_gr", "es_avg_gr", "tex_gr", "h_aehc_gr"]


@register("run_ctp", f"WITH {ANNUAL} " + sql6(GR_METRICS, "ctp", "gr_id, p, doy_first_gr, doy_last_gr"))
def _(s, d):
    out = whole_run(s, d).load("CTP", "grid-annual", 1995, 2001, ["gr_id"])
    return r6(out.select("gr_id", "p", "doy_first_gr", "doy_last_gr", *CTP_COLS))


@register("run_dec", f"WITH {DEC} " + sql6(", ".join(DEC_COLS), "dec_", "gr_id, p"))
def _(s, d):
    return r6(whole_run(s, d).load("DEC", "grid-annual", 1995, 2001, ["gr_id"]).select("gr_id", "p", *DEC_COLS))


def _mean(m: str, a: int, b: int) -> str:
    return f"exp(avg(ln(CASE WHEN {m} > 0 THEN {m} END)) FILTER (WHERE year(p) BETWEEN {a} AND {b}))"


AF = (
    DEC
    + ", rf AS (SELECT gr_id, min(ed_gr) FILTER (WHERE year(p) BETWEEN 1996 AND 1997) AS least, "
    + ", ".join(f"{_mean(m, 1996, 1997)} AS {m}_ref, {_mean(m, 1999, 2000)} AS {m}_cc" for m in runs.FACTORS)
    + " FROM dec_ GROUP BY gr_id), af AS (SELECT gr_id, p, "
    + ", ".join(f"CASE WHEN least >= 1 AND {m}_ref > 0 THEN {m} / {m}_ref END AS {m}_af, CASE WHEN least >= 1 AND {m}_ref > 0 THEN {m}_cc / {m}_ref END AS {m}_af_cc" for m in runs.FACTORS)
    + " FROM dec_ JOIN rf USING (gr_id))"
)
AF_COLS = [f"{m}{e}" for m in runs.FACTORS for e in ("_af", "_af_cc")]


@register("run_af", f"WITH {AF} " + sql6(", ".join(AF_COLS), "af", "gr_id, p"))
def _(s, d):
    return r6(whole_run(s, d).load("AF", "grid-annual", 1995, 2001, ["gr_id"]).select("gr_id", "p", *AF_COLS))


SPREADS = ["em_avg_gr", "ed_avg_gr", "ef_gr"]


def _spread(m: str) -> str:
    up = f"coalesce(b.{m} > a.{m}, false)"
    part = lambda on: f"CASE WHEN any_value(a.{m}) IS NOT NULL THEN sqrt(coalesce(sum(pow(b.{m} - a.{m}, 2)) FILTER (WHERE {on}), 0) / greatest(count(*) FILTER (WHERE {on}), 1)) END"
    return f"{part(up)} AS {m}_supp, {part('NOT ' + up)} AS {m}_slow"


SPREAD_COLS = [f"{m}_{e}" for m in SPREADS for e in ("supp", "slow")]


@register("run_spreads", f"WITH {DEC}, z AS (SELECT a.gr_id, a.p, {', '.join(map(_spread, SPREADS))} FROM (SELECT d0.*, n FROM d0 JOIN dn USING (gr_id, p)) a JOIN dn b ON a.gr_id = b.gr_id AND b.n BETWEEN a.n - 1 AND a.n + 1 GROUP BY ALL) " + sql6(", ".join(SPREAD_COLS), "z", "gr_id, p"))
def _(s, d):
    return r6(whole_run(s, d).load("DEC", "grid-annual", 1995, 2001, ["gr_id"]).select("gr_id", "p", *SPREAD_COLS))


def small(s: SparkSession, d: str, least: float) -> DataFrame:
    return periods.region_periods(region(s, d, least), "annual").select("gr_id", "p", "ed_gr", "em_gr", "tex_gr")


def _narrow(least: float, name: str) -> str:
    """Annual sums of region days with a least area, written on their own."""
    return f"""{name} AS (SELECT gr_id, date_trunc('year', d)::DATE AS p, sum((a >= {least})::INT)::DOUBLE AS ed_gr, sum(CASE WHEN a >= {least} AND a > 0 THEN ma / a ELSE 0 END) AS em_gr, sum(CASE WHEN a >= {least} AND a > 0 THEN ma / a * a ELSE 0 END) AS tex_gr
  FROM (SELECT gr_id, d, coalesce(sum(dtea), 0) AS a, coalesce(sum(dtem * area), 0) AS ma FROM dbv0 GROUP BY ALL) GROUP BY ALL)"""


@register(
    "overlapping_spans",
    f"WITH {DBV}, {_narrow(0.0001, 'early')}, {_narrow(LEAST, 'late')}, z AS (SELECT * FROM early WHERE year(p) < 1998 UNION ALL SELECT * FROM late WHERE year(p) BETWEEN 1998 AND 2000) " + sql6("ed_gr, em_gr, tex_gr", "z", "gr_id, p"),
)
def _(s, d):
    """Two spans share 1998, of which the later wins; a third does not overlap the years asked for."""
    store = fresh_store(s)
    for least, first, last in ((0.0001, 1995, 1998), (LEAST, 1998, 2000), (LEAST, 2001, 2001)):
        own = small(s, d, least).filter(F.year("p").between(first, last))
        store.save(own, "CTP", "grid", first, last)
    store.save(small(s, d, 50.0), "CTP", "grid", 1995, 2001, reference=True)
    return r6(store.load("CTP", "grid", 1996, 2000, ["gr_id"]))


@register(
    "merge_left_wins",
    f"WITH {DBV}, {_narrow(LEAST, 'a0')}, {_narrow(0.0001, 'b0')}, a AS (SELECT gr_id, p, ed_gr, CASE WHEN gr_id = 2 THEN NULL ELSE em_gr END AS em_gr FROM a0 WHERE gr_id < 3), b AS (SELECT gr_id, p, em_gr, tex_gr FROM b0 WHERE gr_id > 0 AND year(p) < 2001), z AS (SELECT coalesce(a.gr_id, b.gr_id) AS gr_id, coalesce(a.p, b.p) AS p, ed_gr, coalesce(a.em_gr, b.em_gr) AS em_gr, tex_gr FROM a FULL JOIN b ON a.gr_id = b.gr_id AND a.p = b.p) " + sql6("ed_gr, em_gr, tex_gr", "z", "gr_id, p"),
)
def _(s, d):
    """Keys on the left side only (region 0, and 2001), on the right only (3 and 4) and on both."""
    a = small(s, d, LEAST).filter("gr_id < 3").select("gr_id", "p", "ed_gr", F.when(F.col("gr_id") != 2, F.col("em_gr")).alias("em_gr"))
    b = small(s, d, 0.0001).filter((F.col("gr_id") > 0) & (F.year("p") < 2001)).select("gr_id", "p", "em_gr", "tex_gr")
    return r6(merge_left(a, b, ["gr_id", "p"]))


@register(
    "upsert_span",
    f"WITH {DBV}, {_narrow(0.0001, 'old')}, {_narrow(LEAST, 'new')}, z AS (SELECT * FROM old WHERE gr_id < 4 AND NOT (gr_id > 1 AND year(p) >= 1998) UNION ALL SELECT * FROM new WHERE gr_id > 1 AND year(p) >= 1998) " + sql6("ed_gr, em_gr, tex_gr", "z", "gr_id, p"),
)
def _(s, d):
    """A stored span takes over rows of a later calculation, region 4 among them, which it did not hold."""
    store = fresh_store(s)
    store.save(small(s, d, 0.0001).filter("gr_id < 4"), "CTP", "grid", 1995, 2001)
    store.upsert(small(s, d, LEAST).filter((F.col("gr_id") > 1) & (F.year("p") >= 1998)), "CTP", "grid", 1995, 2001, ["gr_id", "p"])
    return r6(store.load("CTP", "grid", 1995, 2001, ["gr_id"]))


def metadata_rows(s: SparkSession, d: str) -> DataFrame:
    """Unit, level and scope of the stored monthly metrics as Parquet gives them back, beside the number of values."""
    store = fresh_store(s)
    store.save(described(ctp(s, d), "CTP", "degC"), "CTP", "grid-monthly", 1995, 2001)
    back = store.load("CTP", "grid-monthly", 1995, 2001, ["gr_id"])
    known = described_by(back)
    counts = back.agg(*[F.count(c).alias(c) for c in known])
    parts = [y for c, m in known.items() for y in (F.lit(c), F.lit(m["unit"]), F.lit(m["level"]), F.lit(m["scope"]), F.col(c))]
    return counts.select(F.stack(F.lit(len(known)), *parts).alias("metric", "unit", "level", "scope", "n"))


_UNITS = {
    "ed_gr": "d yr^-1", "ef_gr": "yr^-1", "em_gr": "degC d yr^-1", "em_avg_md_gr": "degC", "em_max_gr": "degC d yr^-1", "tex_gr": "100 km^2 degC d yr^-1", "ed_avg_gr": "d", "em_avg_gr": "degC",
    "em_md_gr": "degC d yr^-1", "dm_avg_gr": "degC d", "aep_gr": "months", "em_avg_max_gr": "degC", "ea_avg_gr": "100 km^2", "es_avg_gr": "100 km^2 degC d", "h_aehc_avg_gr": "PJ d^-1", "h_aehc_gr": "PJ yr^-1",
    "doy_first_gr": "1", "doy_last_gr": "1",
}


def _metadata_sql() -> str:
    from exceedra.plans.queries import CTPM

    parts = [f"SELECT '{c}' AS metric, '{u}' AS unit, 'CTP' AS level, 'GR' AS scope, count({c}) AS n FROM ctp" for c, u in _UNITS.items()]
    return f"WITH {CTPM} " + " UNION ALL ".join(parts)


register("stored_metadata", _metadata_sql())(metadata_rows)
