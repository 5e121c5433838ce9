"""One run from a configuration to stored factors: thresholds, daily values, periods, decades, factors.

Each level is computed from what the level before has stored, so a run that was stopped goes
on where it was, and :attr:`RunConfig.decadal_only` begins at the stored period metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exceedra.functions.columns import primary
from exceedra.operators import aggregate, daily, decadal, periods, prepare, regions, spatial
from exceedra.plans.config import RunConfig
from exceedra.plans.registry import described
from exceedra.sources.store import LevelStore

DECADAL = ["ef_gr", "ed_avg_gr", "em_avg_gr", "em_avg_md_gr", "em_avg_max_gr", "ea_avg_gr", "doy_first_gr", "doy_last_gr", "aep_gr"]
FACTORS = ["ef_gr", "ed_gr", "ed_avg_gr", "em_gr", "em_avg_gr", "dm_avg_gr", "ea_avg_gr", "es_avg_gr", "tex_gr"]


def _history(config: RunConfig) -> str:
    return f"{config.parameter}, threshold {config.threshold} ({config.threshold_type}), {config.period}, {config.start} to {config.end}"


def thresholds(store: LevelStore, config: RunConfig, field: DataFrame, cells: DataFrame) -> DataFrame:
    """Threshold of each cell: loaded, or computed from the reference years, smoothed where asked for, and stored."""

    def build() -> DataFrame:
        first, last = (f"{config.ref_period[0]}-01-01", f"{config.ref_period[1]}-12-31")
        some = field.filter(periods.in_period(F.col("d"), config.perc_period))
        thr = prepare.threshold_of(some, cells, config.threshold_type, config.threshold, first, last)
        if config.smoothing_radius:
            placed = cells.select("cell_id", "iy", "ix").join(thr, "cell_id")
            thr = prepare.smooth(placed, config.smoothing_radius).withColumnRenamed("smoothed", "thr")
        return thr

    return store.load_or_build("STATIC", f"{config.name}-threshold", *config.ref_period, build, config.recalc_threshold)


def daily_values(store: LevelStore, config: RunConfig, field: DataFrame, cells: DataFrame) -> DataFrame:
    """Stored days of regions, with any exceedance at all; the least area is applied by :func:`exceedance_days`."""

    def build() -> DataFrame:
        own = field.filter(F.year("d").between(config.start, config.end))
        placed = cells.join(thresholds(store, config, field, cells), "cell_id")
        days = daily.on_spine(own, cells)
        if config.primary_threshold is not None:
            kept = primary(F.col("v"), F.col("thr"), config.primary_threshold, config.low_extreme)
            days = days.join(placed.select("cell_id", "thr"), "cell_id").select("cell_id", "d", kept.alias("v"))
        found = daily.region_days(daily.cell_exceedance(days, placed, config.low_extreme), placed)
        return described(found, "DBV", config.unit, _history(config))

    return store.load_or_build("DBV", config.name, config.start, config.end, build, config.recalc_daily)


def exceedance_days(days: DataFrame, least: float) -> DataFrame:
    """Days with at least ``least`` of area, and their events; other days keep their area only."""
    on = F.col("dtea_gr") >= least
    off = {c: F.when(on, F.col(c)).otherwise(0.0) for c in ("dtem_gr", "dtem_max_gr", "dtema_gr")}
    return daily.mark_events(days.withColumns({**off, "dtec_gr": on.cast("int")}), "gr_id", "dtec_gr", "dteec_gr")


def period_metrics(store: LevelStore, config: RunConfig, days: DataFrame) -> None:
    ctp = periods.region_periods(exceedance_days(days, config.min_exceedance_area), config.period)
    store.save(described(ctp, "CTP", config.unit, _history(config)), "CTP", f"{config.name}-{config.period}", config.start, config.end)


def decades(store: LevelStore, config: RunConfig) -> None:
    ctp = store.load("CTP", f"{config.name}-{config.period}", config.start, config.end, ["gr_id"])
    of = ("em_avg_gr", "ed_avg_gr", "ef_gr") if config.spreads else ()
    dec = decadal.decadal_driver(ctp.select("gr_id", "p", *DECADAL), "gr_id", DECADAL, config.decadal_window, spread_of=of)
    store.save(described(dec, "DEC", config.unit, _history(config)), "DEC", f"{config.name}-{config.period}", config.start, config.end)


def factors(store: LevelStore, config: RunConfig) -> None:
    dec = store.load("DEC", f"{config.name}-{config.period}", config.start, config.end, ["gr_id"])
    spans = [decadal.centre_span(*span, config.start, config.end, config.decadal_window) for span in (config.ref_period, config.cc_period)]
    af = decadal.amplification(dec, "gr_id", FACTORS, *spans, config.min_duration)
    store.save(described(af, "AF", "", _history(config)), "AF", f"{config.name}-{config.period}", config.start, config.end)


def run(store: LevelStore, config: RunConfig, field: DataFrame | None = None, cells: DataFrame | None = None) -> None:
    """Everything that ``config`` asks for, level by level, into ``store``.

    ``field (cell_id, d, v)`` and ``cells (cell_id, gr_id, area, ...)`` are not needed where
    period metrics are stored already (``decadal_only``).
    """
    config.check()
    if not config.decadal_only:
        if field is None or cells is None:
            raise ValueError("a run from the beginning needs a field and its cells")
        period_metrics(store, config, daily_values(store, config, field, cells))
    decades(store, config)
    factors(store, config)


def run_aggregate(store: LevelStore, config: RunConfig, field: DataFrame, cells: DataFrame, grid: DataFrame | None = None, land: DataFrame | None = None, step: float = 0.5) -> None:
    """The aggregate of a lattice of overlapping regions: periods and decades of every window, then its means and factors.

    ``grid (gr_id, yc, xc)`` is by default the lattice inside the cells; ``land (cell_id, y, x,
    land)`` with 1 for land lets windows below ``land_frac_min`` leave before anything is
    computed for them.  Each level is read from the one stored before; the aggregate is stored
    beside the windows' levels under the run's name with ``-agr``.
    """
    config.check()
    windows, name = f"{config.name}-windows-{config.period}", f"{config.name}-agr-{config.period}"
    own = field.filter(F.year("d").between(config.start, config.end))
    placed = cells.join(thresholds(store, config, field, cells), "cell_id", "left")
    centres = regions.inner_lattice(cells, config.agr_spacing, config.agr_size) if grid is None else grid
    grid = regions.with_extent(aggregate.within(centres, config.agr_y_range, config.agr_x_range), config.agr_size)
    if land is not None and config.land_frac_min > 0:
        enough = spatial.land_windows(spatial.window_sums(land, grid, step, ["land"]), config.land_frac_min)
        grid = grid.join(enough.select("gr_id"), "gr_id", "left_semi")
    links = regions.bridge(cells, grid)
    days = regions.window_days(daily.cell_exceedance(own, placed.filter("thr is not null"), config.low_extreme), regions.valid_links(links, placed), config.min_exceedance_area, own)
    ctp = regions.window_periods(days, config.period)
    store.save(described(ctp, "CTP", config.unit, _history(config)), "CTP", windows, config.start, config.end)
    areas = store.load_or_build("STATIC", f"{windows}-areas", config.start, config.end, lambda: regions.window_weights(links, placed), True)
    basic = [f"{m}_gr" for m in aggregate.BASIC]
    dec = decadal.decadal_means(store.load("CTP", windows, config.start, config.end, ["gr_id"]), "gr_id", basic, config.decadal_window)
    store.save(described(dec, "DEC", config.unit, _history(config)), "DEC", windows, config.start, config.end)
    spans = [decadal.centre_span(*span, config.start, config.end, config.decadal_window) for span in (config.ref_period, config.cc_period)]
    found = aggregate.aggregate(store.load("DEC", windows, config.start, config.end, ["gr_id"]), areas, *spans, config.min_duration)
    dof = regions.degrees_of_freedom(areas.withColumnRenamed("a", "gr_area"), config.agr_size)
    beside = lambda df: df.crossJoin(F.broadcast(dof.withColumnRenamed("n_dof", "n_dof_agr")))  # noqa: E731  (one row)
    store.save(described(beside(found.means.crossJoin(F.broadcast(found.references))), "DEC", config.unit, _history(config)), "DEC", name, config.start, config.end)
    store.save(described(beside(found.factors), "AF", "", _history(config)), "AF", name, config.start, config.end)
    store.save(found.percentiles, "STATIC", f"{name}-percentiles", config.start, config.end)
