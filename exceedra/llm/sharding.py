"""Operator 7: sharding by histogram sort, DataFrame expressions only.

Documents are ordered by a 64-bit hash of their text, then by one of their id, so equal texts
stand together.  Splitters between shards are found before anything moves: each round counts
the exact bytes in equal slices of the key range, keeps for every splitter the one slice in
which its target falls, and slices only those further, until a slice edge is close enough or
the key is spelled out.  Then documents are exchanged once.

The law is ``bytes``: shard sizes are near equal.  A splitter that falls into a group of equal
texts goes to an edge of the group where that is within ``balance`` of a shard's bytes, a
parameter; else it cuts the group by the hash of the id, so one group with a third of all
rows spreads over as many shards, and a group of any size lies in neighbouring shards.

The exchange is by range of shard and key, into as many tasks as the bytes need; each task
sorts its rows and numbers them, and slots follow from the rows of a shard in earlier tasks.

Defined cases: a null text has size 1; repeated rows share one key, stay together and get
slots of their own; a null id hashes as null does; with fewer documents than shards some
shards are empty; an empty table gives no rows; other columns pass through, whatever their
names, but for ``shard`` and ``slot``, which the new ones replace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from exceedra.llm.common import free_prefix, materialize, read_table, shuffle_partitions

SHARDS = 16
TASK_BYTES = 128 << 20
TOLERANCE = 0.001  # of a shard's bytes, for a splitter between texts
BALANCE = 0.01  # of a shard's bytes, for keeping a group of equal texts whole
FIRST_BITS = 12
STEP_BITS = 8


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def id_key() -> Column:
    return F.xxhash64(F.col("doc_id"))


def byte_size() -> Column:
    return (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long")


def _digits(k1: str, k2: str, bits: int) -> Column:
    """The first ``bits`` of the 128-bit key, as (hash of text, hash of id) cut short and kept signed."""
    if bits <= 64:
        return F.struct(F.shiftright(F.col(k1), 64 - bits).alias("a"), F.lit(0).cast("long").alias("b"))
    return F.struct(F.col(k1).alias("a"), F.shiftright(F.col(k2), 128 - bits).alias("b"))


def _edge(slice_: tuple[int, int], bits: int) -> tuple[int, int]:
    """The smallest full key in a slice."""
    a, b = slice_
    low = -(1 << 63)
    return (a << (64 - bits), low) if bits <= 64 else (a, b << (128 - bits))


def find_splitters(keys: DataFrame, goals: list[float], tolerance: float, group_tolerance: float) -> list[tuple[int, int]]:
    """For each goal a key with about that many bytes below it; ``keys (k1, k2, size)``.

    A round groups by slices, at most ``len(goals) * 2**STEP_BITS`` of them, and brings their
    byte counts to the driver.  ``group_tolerance`` is how far off an edge of a group of equal
    texts may be.
    """
    open_ = {j: ((0, 0), 0.0) for j in range(len(goals))}  # goal: its slice and the bytes below
    done: dict[int, tuple[int, int]] = {}
    bits = 0
    while open_:
        old, bits = bits, min(bits + (FIRST_BITS if not bits else STEP_BITS), 64 if bits < 64 else 128)
        rows = keys.withColumn("slice", _digits("k1", "k2", bits))
        if old:
            slices = sorted({s for s, _ in open_.values()})
            rows = rows.filter(_digits("k1", "k2", old).isin([F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in slices]))
        else:
            slices = [(0, 0)]
        found: dict[tuple[int, int], list[tuple[tuple[int, int], int, bool, bool]]] = {s: [] for s in slices}
        one_text, one_id = F.min("k1") == F.max("k1"), F.min("k2") == F.max("k2")
        for r in rows.groupBy("slice").agg(F.sum("size").alias("n"), one_text.alias("text"), (one_text & one_id).alias("key")).collect():
            a, b = r["slice"]["a"], r["slice"]["b"]
            if not old:
                parent = (0, 0)
            elif old < 64:
                parent = (a >> (bits - old), 0)
            else:
                parent = (a, 0 if old == 64 else b >> (bits - old))
            found[parent].append(((a, b), r["n"], r["text"], r["key"]))
        for v in found.values():
            v.sort()
        for j, (parent, below) in list(open_.items()):
            for slice_, n, one_text, one_key in found[parent]:
                if below + n > goals[j]:
                    break
                below += n
            else:  # the goal lies past the last key
                done[j] = (1 << 63, 0)
                del open_[j]
                continue
            first, last = goals[j] - below, below + n - goals[j]
            limit = group_tolerance if one_text else tolerance
            if first <= limit or last <= limit or one_key or bits == 128:
                if first <= last:
                    done[j] = _edge(slice_, bits)
                else:
                    a, b = slice_
                    done[j] = _edge((a + 1, 0), bits) if bits <= 64 else ((a, (b + 1) << (128 - bits)) if bits < 128 else _after(a, b))
                del open_[j]
            else:
                open_[j] = (slice_, below)
    return [done[j] for j in range(len(goals))]


def _after(a: int, b: int) -> tuple[int, int]:
    return (a, b + 1) if b + 1 < 1 << 63 else (a + 1, -(1 << 63))


def _interval(splitters: list[tuple[int, int]], first: str, second: str) -> Column:
    """How many splitters are at or below a row's key: a balanced tree of comparisons."""
    top = (1 << 63) - 1

    def at_least(s: tuple[int, int]) -> Column:
        a, b = s
        if a > top:
            return F.lit(False)
        k1, k2 = F.col(first), F.col(second)
        whole = b <= -(1 << 63)
        if whole:
            return k1 >= F.lit(a)
        if b > top:
            return k1 > F.lit(a)
        return (k1 > F.lit(a)) | ((k1 == F.lit(a)) & (k2 >= F.lit(b)))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(at_least(splitters[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(splitters))


def shard_column(keys: DataFrame, shards: int = SHARDS, balance: float = BALANCE) -> tuple[Callable[[str, str], Column], int]:
    """The shard as a function of the key's two columns, and all bytes of ``keys (k1, k2, size)``."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    whole = total / shards
    found = find_splitters(keys, [whole * j for j in range(1, shards)], TOLERANCE * whole, balance * whole)
    return lambda k1, k2: _interval(sorted(found), k1, k2).cast("int"), total


def place(rows: DataFrame, shard: Column, total: int, prefix: str = "") -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` behind ``prefix``: one exchange, sorted and numbered within tasks.

    ``rows`` has ``k1``, ``k2`` and the id behind ``prefix``.  A task's number is in the upper
    bits of Spark's increasing row number, so rows of a shard ahead of a task are counted from
    one row for each task and shard.
    """
    spark = rows.sparkSession
    at, task, first, ahead = (f"{prefix}{c}" for c in ("at", "task", "first", "ahead"))
    key = [f"{prefix}shard", f"{prefix}k1", f"{prefix}k2"]
    n = max(shuffle_partitions(spark), -(-total // TASK_BYTES))
    dealt = rows.withColumn(key[0], shard).repartitionByRange(n, *key).sortWithinPartitions(*key, f"{prefix}id")
    placed = materialize(dealt.withColumn(at, F.monotonically_increasing_id()))
    tasks = placed.groupBy(key[0], F.shiftright(at, 33).alias(task)).agg(F.min(at).alias(first), F.count("*").alias("n"))
    earlier = Window.partitionBy(key[0]).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)  # over a row for each task
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col(first)
    starts = F.broadcast(tasks.select(F.col(key[0]).alias(f"{prefix}s"), F.col(task).alias(f"{prefix}t"), before.alias(ahead)))  # tasks and shards, no more rows
    met = placed.join(starts, (F.col(key[0]) == F.col(f"{prefix}s")) & (F.shiftright(at, 33) == F.col(f"{prefix}t")))
    return met.withColumn(f"{prefix}slot", F.col(at) + F.col(ahead))


def shard_documents(docs: DataFrame, shards: int = SHARDS, balance: float = BALANCE) -> DataFrame:
    """``docs (doc_id, text, ...)`` with ``shard`` and ``slot``; texts move once."""
    prefix = free_prefix(docs)
    keys = materialize(docs.select(text_key().alias("k1"), id_key().alias("k2"), byte_size().alias("size")))
    shard, total = shard_column(keys, shards, balance)
    keyed = docs.withColumns({f"{prefix}k1": text_key(), f"{prefix}k2": id_key(), f"{prefix}id": F.col("doc_id")})
    placed = place(keyed, shard(f"{prefix}k1", f"{prefix}k2"), total, prefix)
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.select(*[f"`{c}`" for c in own], F.col(f"{prefix}shard").alias("shard"), F.col(f"{prefix}slot").alias("slot"))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    keys = materialize(docs.select(F.col("doc_id").alias("id"), byte_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), text_key().alias("k1"), id_key().alias("k2")))
    shard, _ = shard_column(keys)
    out = place(keys, shard("k1", "k2"), 64 * keys.count())
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
