"""Column expressions: exceedance, areas, period labels and guarded arithmetic.

Missing values are NULL throughout, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months before the label's month to shift by, and the unit of the period.
PERIODS = {
    "annual": (0, "year"), "seasonal": (-1, "quarter"), "monthly": (0, "month"), "WAS": (3, "year"), "ESS": (4, "year"),
    "JJA": (5, "year"), "MAM": (2, "year"), "SON": (8, "year"), "EWS": (10, "year"), "DJF": (11, "year"),
}
MONTHS = {"WAS": [4, 5, 6, 7, 8, 9, 10], "ESS": [5, 6, 7, 8, 9], "JJA": [6, 7, 8], "MAM": [3, 4, 5], "SON": [9, 10, 11], "EWS": [11, 12, 1, 2, 3], "DJF": [12, 1, 2]}
OVER_NEW_YEAR = ("EWS", "DJF")
AREAL_KM2 = 100.0
POLAR_KM, EQUATOR_KM = 40008.0, 40075.0
HEAT_CONTENT = 0.1507
DAYS_PER_MONTH = 30.5


def period_label(d: Column, period: str) -> Column:
    """First day of the climatic period that holds ``d``."""
    off, unit = PERIODS[period]
    return F.add_months(F.trunc(F.add_months(F.trunc(d, "month"), -off), unit), off)


def in_period(d: Column, period: str) -> Column:
    return F.month(d).isin(MONTHS[period]) if period in MONTHS else F.lit(True)


def exceedance(v: Column, thr: Column, low: bool = False) -> Column:
    """Magnitude beyond the threshold; 0 on the other side, NULL where either is missing."""
    over = thr - v if low else v - thr
    return F.when(over <= 0, 0.0).otherwise(over)


def exceeds(magnitude: Column) -> Column:
    return F.when(magnitude.isNotNull(), (magnitude > 0).cast("int"))


def primary(v: Column, thr: Column, limit: float, low: bool = False) -> Column:
    """Values on the wrong side of a primary threshold become the threshold, so they exceed nothing."""
    keep = v <= limit if low else v >= limit
    return F.when(v.isNull(), None).when(keep, v).otherwise(thr)


def area_latlon(lat: Column, dlat: float, dlon: float) -> Column:
    """Area of a cell in units of 100 km2."""
    return abs(dlat) * POLAR_KM / 360 * (abs(dlon) * EQUATOR_KM / 360 * F.cos(F.radians(lat))) / AREAL_KM2


def area_cartesian(dx: float, dy: float) -> float:
    return abs(dx) / 1000 * (abs(dy) / 1000) / AREAL_KM2


def per(num: Column, den: Column) -> Column:
    """Quotient that is 0 where the divisor is 0."""
    return F.when(den == 0, 0.0).otherwise(F.try_divide(num, den))


def full_sum(x: Column) -> Column:
    """Sum that is NULL if any value is."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def zero_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.when(x > 0, F.ln(F.when(x > 0, x)))))


def specific_humidity(dewpoint_k: Column, pressure_pa: Column) -> Column:
    """From dewpoint by the Bolton form of vapour pressure over water."""
    t = dewpoint_k - 273.15
    e = 611.2 * F.exp(17.67 * t / (t + 243.5))
    ratio = 0.6219569100577033
    return ratio * e / (pressure_pa - (1 - ratio) * e)
