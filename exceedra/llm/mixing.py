"""Operator 5: mixing sources to target weights along a curriculum, DataFrame expressions only.

Sources share all words by weight; a target stops at three times the source's size and the
excess is shared again by weight.  Within a source, documents stand in an order that a hash
of their id fixes, and the source is read through up to three times until its target is met.

The curriculum varies each source's rate over training time ``t`` from 0 to 1: the rate is
``target * (1 + slope * (2 t - 1))``, whose integral is the demand up to ``t``.  A copy whose
middle lies ``x`` words into its source gets the ``t`` at which the demand is ``x``; the mix
is range-sorted by it.

Prefix sums are taken in two steps, over hash buckets of a source and inside each bucket, so
no window holds more than one bucket's rows, however large a source is.

Defined cases: a null or blank text has size 0 and is never taken; null is a source of its
own, ranked last; a source of size 0 has target 0; repeated rows stand next to each other
and each return a row; an empty table gives no rows; other columns pass through
:func:`mix_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exceedra.llm.common import free_prefix, materialize, read_table, shuffle_partitions

WEIGHTS = (1, 2, 3)
MAX_TIMES = 3
# Slope of the rate of a source over training time, by weight: light sources early, heavy ones late.
SLOPES = (-0.5, 0.0, 0.5)
BUCKET_BITS = 12
KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    """60 bits of the md5 of the id: the order of documents within a source."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string")), 1, KEY_BITS // 4), 16, 10).cast("long"), F.lit(0))


def ranked(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``rank`` from 0 in the order of ``by``, nulls last, without one task seeing all rows."""
    n = shuffle_partitions(df.sparkSession)
    order = F.col(by).asc_nulls_last()
    placed = materialize(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    counts = sorted(placed.groupBy("_part").count().collect())  # one row per partition
    at, before = 0, []
    for part, c in counts:
        before += [F.lit(part), F.lit(at)]
        at += c
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    if not before:
        return placed.withColumn("rank", F.lit(0).cast("long")).drop("_part")
    return placed.withColumn("rank", (F.element_at(F.create_map(*before), F.col("_part")) + inside).cast("long")).drop("_part")


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``weight`` and ``target`` to ``sources (source, source_size)``.

    A round finds the share per weight of the sources not yet at their limit; the share only
    rises, so the rounds end.  Each round is one aggregate over the sources.
    """
    weights = F.array(*map(F.lit, WEIGHTS))
    t = materialize(ranked(sources, "source").withColumn("weight", F.get(weights, (F.col("rank") % len(WEIGHTS)).cast("int")).cast("long")))
    limit = MAX_TIMES * F.col("source_size")
    total, heavy = t.agg(F.sum("source_size"), F.sum("weight")).first()
    share = total / heavy if heavy else 0.0
    while heavy:
        above = F.col("weight") * F.lit(float(share)) > limit
        full, left = t.agg(F.sum(F.when(above, limit).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        new = (total - full) / left if left else share
        if new <= share:
            break
        share = new
    return t.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), limit.cast("double")))


def placed_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, key, source_size, weight, target, before, copies.

    ``before`` is the words of the source ahead of the document.
    """
    base = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id")).alias("key")))
    base = base.withColumn("bucket", F.shiftrightunsigned("key", KEY_BITS - BUCKET_BITS))
    buckets = materialize(base.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("ahead"))
    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")))
    ahead = ahead.alias("a").join(sources.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source"))).select("a.*", "source_size", "weight", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ahead = materialize(ahead.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "ahead", "source_size", "weight", "target"))
    rows = rows.join(ahead, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")
    rows = rows.withColumn("before", F.col("ahead") + F.col("inside"))
    return rows.withColumn("copies", copies_of(F.col("before"), F.col("size"))).drop("ahead", "inside", "bucket")


def copies_of(before: Column, size: Column) -> Column:
    """Times the source is read through this document's middle before its target is met."""
    middle = before + size / F.lit(2.0)
    times = [F.when(middle + F.lit(k) * F.col("source_size") < F.col("target"), 1).otherwise(0) for k in range(MAX_TIMES)]
    return F.when(size > 0, sum(times[1:], times[0])).otherwise(0)


def training_time(x: Column, weight: str = "weight", target: str = "target") -> Column:
    """Inverse of a source's demand at ``x`` words, between 0 and 1."""
    slope = F.get(F.array(*map(F.lit, SLOPES)), (F.col(weight) - 1).cast("int"))
    flat, u = 1 - slope, x / F.col(target)
    return 2 * u / (flat + F.sqrt(flat * flat + 4 * slope * u))


def first_position(rows: DataFrame) -> DataFrame:
    return rows.withColumn("position", F.when(F.col("copies") > 0, training_time(F.col("before") + F.col("size") / F.lit(2.0))))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Pipeline form: the rows of ``docs``, each as often as the mix takes it, in training order.

    Places are found on narrow rows; texts move once to meet them and once in the range
    exchange.  Rows that agree in id, source and size share one place, the
    first; no column name of ``docs`` clashes.
    """
    rows = materialize(placed_documents(docs.select("doc_id", "source", "text")))
    x = free_prefix(docs)
    own = rows.filter("copies > 0").groupBy("doc_id", "source", "size", "source_size", "weight", "target").agg(F.min(F.struct("before", "copies")).alias("b"))
    place = own.select(*[F.col(c).alias(x + c) for c in ("doc_id", "source", "size", "source_size", "weight", "target")], F.col("b.before").alias(f"{x}before"), F.col("b.copies").alias(f"{x}copies"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{x}doc_id")) & F.col("source").eqNullSafe(F.col(f"{x}source")) & (word_count(F.col("text")) == F.col(f"{x}size"))
    joined = docs.join(place, same).withColumn(f"{x}k", F.explode(F.sequence(F.lit(0), F.col(f"{x}copies") - 1)))
    middle = F.col(f"{x}before") + F.col(f"{x}k") * F.col(f"{x}source_size") + F.col(f"{x}size") / F.lit(2.0)
    timed = joined.withColumn(f"{x}t", training_time(middle, f"{x}weight", f"{x}target"))
    return timed.select(*[f"`{c}`" for c in docs.columns], f"{x}t").repartitionByRange(shuffle_partitions(docs.sparkSession), f"{x}t").sortWithinPartitions(f"{x}t").drop(f"{x}t")


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = materialize(first_position(placed_documents(docs)))
    out = rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "position", "key")
    order = [F.col("position").asc_nulls_last(), F.col("key")]  # documents not taken have no position; the key deals them out
    return out.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("key")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS k FROM s),
c AS (
  SELECT *, (SELECT sum(source_size) FROM s) AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM o),
lam AS (
  SELECT (total - capped)::DOUBLE / left_weight::DOUBLE AS share FROM c
  WHERE (total - capped)::DOUBLE / left_weight::DOUBLE * weight <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, weight, least(weight * (SELECT share FROM lam), 3.0::DOUBLE * source_size) AS target FROM s),
p AS (
  SELECT d.*, source_size, weight, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (
  SELECT *, before + size / 2.0::DOUBLE AS middle, CASE WHEN size = 0 THEN 0 ELSE
    (before + size / 2.0::DOUBLE < target)::INT + (before + size / 2.0::DOUBLE + source_size < target)::INT
    + (before + size / 2.0::DOUBLE + 2 * source_size < target)::INT END AS copies,
    (weight - 2) * 0.5::DOUBLE AS slope FROM p)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN 2 * (middle / target)
    / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (middle / target))) END AS position
FROM m
"""
