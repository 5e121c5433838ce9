"""Registered queries of streams, read from files that are written from the synthetic field first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.plans.queries import DBV, HOURLY, dbv_plain, r6, register, sql6
from exceedra.sources import tables
from exceedra.sources.store import scratch_root
from exceedra.streaming import events as streams
from exceedra.streaming import hourly as hours


def streamed(s: SparkSession, rows: DataFrame, part: Column, build) -> DataFrame:
    """What ``build`` gives for a stream of ``rows``, one file for each value of ``part`` in turn, and all the stream held."""
    root = scratch_root(s)
    rows = rows.withColumn("part", part)
    for k in sorted(r[0] for r in rows.select("part").distinct().collect()):  # a few years or weeks
        rows.filter(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{root}/in/{k}")
    source = s.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    out = build(source)
    query = out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").start(f"{root}/out")
    query.awaitTermination()
    return s.read.schema(out.schema).parquet(f"{root}/out")


def sentinel(s: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows and one far behind them that lets the watermark pass all others."""
    last = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).alias("cell_id"), (F.col("ts") + F.expr("interval 1000 days")).alias("ts"), *[F.lit(0).cast(t).alias(c) for c, t in rows.dtypes if c not in ("cell_id", "ts")])
    return rows.unionByName(last)


@register(
    "stream_events",
    f"WITH {DBV}, o AS (SELECT cell_id, d, dtem, d - (row_number() OVER (PARTITION BY cell_id ORDER BY d))::INT AS run FROM dbv WHERE dtec = 1), z AS (SELECT cell_id, min(d) AS first, max(d) AS last, count(*)::INT AS days, min(d) + ((max(d) - min(d)) // 2)::INT AS middle, sum(dtem) AS em FROM o GROUP BY cell_id, run) " + sql6("em", "z", "cell_id, first, last, days, middle"),
)
def _(s, d):
    """Events of the whole field as a stream, a year at a time; the middle of an even number of days is its first half's last."""
    x = dbv_plain(s, d).select("cell_id", F.col("d").cast("timestamp").alias("ts"), "dtec", "dtem")
    got = streamed(s, sentinel(s, x), F.year("ts").cast("string"), lambda rows: streams.events(rows))
    return r6(got)


@register("stream_daily_maxima", f"WITH {HOURLY}, z AS (SELECT cell_id, ts::DATE AS d, max(v) AS v FROM hourly GROUP BY ALL), t AS (SELECT cell_id, d, CASE WHEN v - 40 <= 0 THEN 0.0 ELSE v - 40 END AS dtem FROM z), y AS (SELECT *, (dtem > 0)::INT AS dtec FROM t) " + sql6("dtem", "y", "cell_id, d, dtec"))
def _(s, d):
    """Daily maxima of the hourly field as a stream with exceedances of a fixed threshold."""
    x = tables.hourly(s, d).select("cell_id", "ts", "v")
    cells = x.select("cell_id").distinct().withColumn("thr", F.lit(40.0))
    week = F.date_format(F.trunc("ts", "week"), "yyyy-MM-dd")
    got = streamed(s, sentinel(s, x), week, lambda rows: hours.exceedances(hours.daily_maxima(rows), cells))
    return r6(got.filter("cell_id >= 0").select("cell_id", "d", "dtec", "dtem"))
