"""Run configuration: typed keys, defaults and checks."""

from __future__ import annotations

import dataclasses
import datetime
from dataclasses import dataclass

from exceedra.functions.columns import PERIODS


def _pair(value) -> tuple[int, int] | None:
    """``1961-1990`` or a list as two years."""
    if value is None or isinstance(value, tuple):
        return value
    parts = value.replace("-", ",").split(",") if isinstance(value, str) else value
    a, b = (int(p) for p in parts)
    if a > b:
        raise ValueError(f"period {a}-{b} ends before it begins")
    return a, b


@dataclass(frozen=True)
class RunConfig:
    parameter: str
    threshold: float
    threshold_type: str = "perc"
    low_extreme: bool = False
    start: int = 1961
    end: int = 2024
    period: str = "annual"
    perc_period: str = "annual"
    ref_period: tuple[int, int] = (1961, 1990)
    cc_period: tuple[int, int] = (2010, 2024)
    decadal_window: tuple[int, int, int] = (10, 5, 4)
    min_exceedance_area: float = 1.0
    min_duration: float = 0.0
    smoothing_radius: int = 0
    significant_digits: int = 3
    name: str = "region"
    unit: str = "1"
    primary_threshold: float | None = None
    recalc_threshold: bool = False
    recalc_daily: bool = False
    decadal_only: bool = False
    spreads: bool = False
    agr_spacing: float = 0.5
    agr_size: float = 2.0
    agr_y_range: tuple[float, float] | None = None
    agr_x_range: tuple[float, float] | None = None
    land_frac_min: float = 0.0
    unknown: tuple[str, ...] = ()

    @classmethod
    def from_dict(cls, given: dict) -> RunConfig:
        names = {f.name for f in dataclasses.fields(cls)} - {"unknown"}
        known = {k: v for k, v in given.items() if k in names}
        for k in ("ref_period", "cc_period"):
            if k in known:
                known[k] = _pair(known[k])
        if isinstance(known.get("decadal_window"), str):
            known["decadal_window"] = tuple(int(x) for x in known["decadal_window"].split(","))
        elif "decadal_window" in known:
            known["decadal_window"] = tuple(known["decadal_window"])
        config = cls(**known, unknown=tuple(sorted(set(given) - names)))
        config.check()
        return config

    def check(self) -> None:
        if self.threshold < 0 or round(self.threshold, 1) != self.threshold:
            raise ValueError("a threshold is not negative and has at most one decimal")
        if self.threshold_type not in ("perc", "abs"):
            raise ValueError("threshold_type is perc or abs")
        for p in (self.period, self.perc_period):
            if p not in PERIODS:
                raise ValueError(f"unknown period {p!r}")
        if not 0 <= self.land_frac_min <= 1:
            raise ValueError("a share of land is between 0 and 1")
        if self.agr_spacing <= 0 or self.agr_size <= 0:
            raise ValueError("spacing and size of a lattice are positive")
        rows, before, after = self.decadal_window
        if rows != before + after + 1:
            raise ValueError("a decadal window has one row beside those before and after")
        if self.start > self.end or self.end > datetime.date.today().year:
            raise ValueError("years run forwards and end by this year")
