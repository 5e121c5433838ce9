"""Events of a stream against those of a batch."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from exceedra.operators.daily import mark_events
from exceedra.streaming import events as stream

DAY = dt.datetime(2000, 1, 1)
SCHEMA = "cell_id int, ts timestamp, dtec int, dtem double"


def test_steps_by_hand():
    closed, held = stream.step((None, None, 0.0, {}), [(5, 1.0), (3, 2.0), (4, 1.0), (9, 4.0)], 6)
    assert closed == [] and held == (3, 5, 4.0, {9: 4.0})  # day 6 may still come
    closed, held = stream.step(held, [(6, 1.0), (9, 1.0), (4, 7.0)], 9)
    assert closed == [(3, 6, 5.0)] and held == (None, None, 0.0, {9: 4.0})
    assert stream.step(held, [], 100) == ([(9, 9, 4.0)], (None, None, 0.0, {}))


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for cell in range(6):
        on = 0
        for i in range(120):
            on = rng.random() < (0.8 if on else 0.25)
            rows.append((cell, DAY + dt.timedelta(days=i), int(on), float(on * rng.randrange(1, 5))))
    batch = spark.createDataFrame(rows, SCHEMA)
    marked = mark_events(batch.withColumn("d", F.to_date("ts")), "cell_id", "dtec", "dteec").filter("dteec = 1").collect()
    files = {}
    for r in rows:
        late = rng.choice([0, 0, 0, 1, 2])  # out of order by up to two days, three are allowed
        files.setdefault((r[1] + dt.timedelta(days=late)).date().toordinal() // 7, []).append(r)
    folder = f"{tmp_path}/in"
    for n, k in enumerate(sorted(files)):
        own = files[k]
        rng.shuffle(own)
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(f"{folder}/part={n:03d}")
    spark.createDataFrame([(-1, DAY + dt.timedelta(days=400), 0, 0.0)], SCHEMA).coalesce(1).write.parquet(f"{folder}/part=998")
    spark.createDataFrame([(0, DAY + dt.timedelta(days=3), 1, 99.0)], SCHEMA).coalesce(1).write.parquet(f"{folder}/part=999")  # far too late
    source = spark.readStream.schema(SCHEMA + ", part string").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{folder}/*")
    query = stream.events(source.drop("part")).writeStream.format("memory").queryName("found_events").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.awaitTermination(240)
    got = {(r.cell_id, r.middle) for r in spark.table("found_events").collect()}
    assert got == {(r.cell_id, r.d) for r in marked}
    total = {r.cell_id: r.em for r in spark.table("found_events").groupBy("cell_id").agg(F.sum("em").alias("em")).collect()}
    assert total == {r.cell_id: r.em for r in batch.groupBy("cell_id").agg(F.sum("dtem").alias("em")).collect()}
