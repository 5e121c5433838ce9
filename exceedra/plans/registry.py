"""Metrics: name, levels, scope, kind and unit, in place of conventions of names.

:func:`described` writes a metric's unit and level into the metadata of its column, which
Spark keeps in plans and in Parquet, and :func:`described_by` reads them back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    meaning: str
    levels: tuple[str, ...]
    scope: str
    kind: str
    unit: str


DAILY, RESULT, LATE = ("DBV",), ("CTP", "DEC", "AF"), ("DEC", "AF")

# Names, units and kinds of the metrics; U stands for the unit of the input.
_ALL = [
    Metric("DTEC", "whether the day exceeds the threshold", DAILY, "both", "", "1"),
    Metric("DTED", "hours of the day in exceedance", DAILY, "both", "", "h"),
    Metric("DTEM", "how far the day's value is beyond the threshold", DAILY, "both", "", "U"),
    Metric("DTEA", "area in exceedance on the day", DAILY, "both", "", "100 km^2"),
    Metric("DTEMA", "the day's magnitude times its area", DAILY, "GR", "", "100 km^2 U"),
    Metric("DTEM_Max", "the day's largest magnitude of any cell", DAILY, "GR", "", "U"),
    Metric("DTEEC", "mark of the middle day of an event", DAILY, "both", "", "1"),
    Metric("EF", "events in the period", RESULT, "both", "basic", "yr^-1"),
    Metric("doy_first", "day of the year of the first event", RESULT, "both", "basic", "1"),
    Metric("doy_last", "day of the year of the last event", RESULT, "both", "basic", "1"),
    Metric("AEP", "time from the first to the last event", RESULT, "both", "basic", "months"),
    Metric("ED", "days of all events together", RESULT, "both", "compound", "d yr^-1"),
    Metric("ED_avg", "days of an event on average", RESULT, "both", "basic", "d"),
    Metric("EM", "magnitude summed over all event days", RESULT, "both", "compound", "U d yr^-1"),
    Metric("EM_avg", "magnitude of an event day on average", RESULT, "both", "basic", "U"),
    Metric("threshold_avg", "mean threshold of the region", RESULT, "GR", "basic", "U"),
    Metric("EM_avg_Md", "median magnitude of an event day", RESULT, "both", "basic", "U"),
    Metric("EM_Md", "event days times their median magnitude", RESULT, "both", "compound", "U d yr^-1"),
    Metric("EM_Max", "largest cell magnitudes summed over event days", RESULT, "GR", "compound", "U d yr^-1"),
    Metric("EM_avg_Max", "largest cell magnitude of an event day on average", RESULT, "GR", "basic", "U"),
    Metric("EA_avg", "area of an event day on average", RESULT, "GR", "basic", "100 km^2"),
    Metric("DM_avg", "duration times magnitude of an event on average", RESULT, "both", "compound", "U d"),
    Metric("TEX", "magnitude times area summed over all event days", RESULT, "GR", "compound", "100 km^2 U d yr^-1"),
    Metric("hTEX", "the same weighted by hours of exposure", RESULT, "GR", "compound", "100 km^2 U h yr^-1"),
    Metric("ES_avg", "severity of an event on average", RESULT, "GR", "compound", "100 km^2 U d"),
    Metric("hES_avg", "severity of an event weighted by hours of exposure", RESULT, "GR", "compound", "100 km^2 U h"),
    Metric("tEX", "extremity in time, without area", LATE, "both", "compound", "U d yr^-1"),
    Metric("htEX", "extremity in time weighted by hours of exposure", RESULT, "both", "compound", "U h yr^-1"),
    Metric("H_AEHC_avg", "heat content of an event day on average", RESULT, "GR", "compound", "PJ d^-1"),
    Metric("H_AEHC", "heat content of all event days", RESULT, "GR", "compound", "PJ yr^-1"),
    Metric("Nhours", "hours of exposure on the day", DAILY, "both", "", "h"),
    Metric("h_avg", "hours of exposure of an event day on average", RESULT, "both", "basic", "h"),
    Metric("t_hfirst", "first hour of the day in exceedance", DAILY, "both", "basic", "h"),
    Metric("t_hlast", "last hour of the day in exceedance", DAILY, "both", "basic", "h"),
    Metric("t_hmax", "hour of the day's largest exceedance", DAILY, "both", "basic", "h"),
    Metric("h_rise_avg", "hours from the first to the largest exceedance on average", RESULT, "both", "basic", "h"),
    Metric("h_set_avg", "hours from the largest to the last exceedance on average", RESULT, "both", "basic", "h"),
]
METRICS = {m.name: m for m in _ALL}
# Result columns are in lower case, where the extremities over time and over area would meet.
_BY_COLUMN = {m.name.lower(): m for m in _ALL if m.name not in ("tEX", "TEX", "htEX", "hTEX")} | {"tex": METRICS["tEX"], "htex": METRICS["htEX"], "htotal_ex": METRICS["hTEX"]}
_SCOPES = ("_agr", "_gr")


def metric_of(column: str) -> tuple[Metric, str] | None:
    """The metric of a result column and the rest of its name: scope and kind of statistic."""
    for name in sorted(_BY_COLUMN, key=len, reverse=True):
        if column == name or column.startswith(name + "_"):
            rest = column[len(name) :]
            return (METRICS["TEX"] if name == "tex" and any(s in rest for s in _SCOPES) else _BY_COLUMN[name]), rest
    return None


def metadata(name: str, unit: str = "") -> dict[str, str]:
    """Column metadata of a metric for an input in ``unit``."""
    m = METRICS[name]
    return {"long_name": m.meaning, "unit": m.unit.replace("U", unit) if unit else m.unit, "metric_type": m.kind}


def described(df: DataFrame, level: str, unit: str = "", history: str = "") -> DataFrame:
    """The same columns with name, unit, level and scope as metadata where they are metrics.

    Factors have no unit.  Columns that are no metric keep the metadata they have.
    """
    out = []
    for field in df.schema:
        found = metric_of(field.name)
        if found is None:
            out.append(F.col(f"`{field.name}`"))
            continue
        metric, rest = found
        meta = metadata(metric.name, unit) | {"level": level, "scope": next((s[1:].upper() for s in _SCOPES if s in rest), "cell")}
        if "_af" in rest:
            meta["unit"] = "1"
        if history:
            meta["history"] = history
        out.append(F.col(f"`{field.name}`").alias(field.name, metadata=dict(field.metadata) | meta))
    return df.select(*out)


def described_by(df: DataFrame) -> dict[str, dict]:
    """Metadata of every described column, as read from a plan or a Parquet table."""
    return {f.name: dict(f.metadata) for f in df.schema if f.metadata and "level" in f.metadata}
