"""Shared pieces of the corpus operators: scratch tables and vectorised text handling.

Scratch tables go to the folder that ``spark.checkpoint.dir`` names, which every
executor can read, so a lost executor never costs more than the tasks it ran.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of anything but space and the five ASCII control blanks.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 2 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOCAL_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one; removed when the JVM ends.

    Without ``spark.checkpoint.dir`` a temporary folder serves a local master; on a cluster
    that would be a different disk on each machine, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
        base = _LOCAL_SCRATCH[0]
    path = f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a scratch table and read it back: lineage is cut, the files are shared."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame) -> None:
    """Delete a scratch table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hpath = jvm.org.apache.hadoop.fs.Path(name)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps now and not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- numpy side


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with about ``limit`` bytes of text each; a longer text is alone."""
    _, offsets = text_buffer(batch.column(text))
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the buffer, and each document's first word (n + 1 entries)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_BLANK[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span (none empty, none overlapping, in order)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    local = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    at = local + np.repeat(starts, size)
    power = np.full(int(size.max()), 0xD1342543DE82EF95, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    code = _BYTE_CODE[_LOWER[buf[at]] if lower else buf[at]]
    return mix64(np.add.reduceat(code * power[local], first) + size.astype(np.uint64) * _GOLDEN)


_COMBINE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each document; a shorter document is one shingle."""
    out = []
    n = len(words)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * _COMBINE[j % 8]
    rolled = mix64(rolled)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= k:
            s = np.sort(rolled[lo : hi - k + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif hi > lo:
            part = words[lo:hi] * _COMBINE[: hi - lo]
            out.append(mix64(np.array([part.sum() + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node in ``edges (a long, b long)``: columns node, component.

    Alternates the large-star and small-star steps, each a grouped aggregate and a join,
    until no label moves; rounds grow with the logarithm of the longest path.  A node of
    very high degree is no single group: its neighbours are never listed, only joined.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        free(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = materialize(small.filter("u <> v").distinct())
        free(low), free(large), free(e)
        e = new
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def no_clash(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the columns that an operator reads, so that no extra column can clash."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def free_prefix(df: DataFrame) -> str:
    """A beginning that no column name of ``df`` has, for columns beside the input's own."""
    prefix = "_x_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_x" + prefix
    return prefix


def local_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
