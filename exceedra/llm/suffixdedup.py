"""Operator 8: removal of repeated byte strings with suffix arrays built by linear grouping.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id.

Only places where texts can agree are suffix-sorted.  The smallest 16-byte gram of each
50-byte window anchors it; neighbouring windows share anchors, and equal windows have equal
anchors.  A run is an anchor with its windows, 50 to 84 bytes in all.

1. Runs are hashed to blocks by anchor, packed, with a 64-bit hash of all their bytes beside 40
   bits of the anchor's.  A run whose bytes also stand in a smaller document is removed whole.  Where an anchor is shared but
   the bytes around it differ, the first holder of each variant goes on.
2. The bytes of those variants are fetched.  A window that two of them share holds one of four
   strings of 42 or 43 bytes about the anchor, by how far the anchor is into it; variants
   that share none are let go.  Each block of the others gets a suffix array, and windows
   that agree come together in it; those with a smaller document among them go.
3. Each document cuts its own bytes.

The suffix array is built by Lyndon groups, of many variants side by side.  The longest Lyndon
word from each place reaches to the next smaller suffix: places point there, from the last to
the first, by way of the pointers behind them.  Suffixes are grouped by these words, groups
are in the words' order, and in a group the suffixes behind the words decide, along the
pointers, twice as many words in each round, up to a window's bytes.

Defined cases: null and empty texts have no bytes; texts under 50 bytes lose nothing;
repeated rows and rows that share an id do not count against each other; a row with a null
id neither loses nor lends; of documents that share bytes only the order of their ids
decides, so nothing ties; a text of any length is read whole, above a batch's bytes in one of
its own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import arrow_map, chunks, materialize, mix64, no_clash, read_table, shuffle_partitions, text_buffer, tidy

WINDOW = 50
GRAM = 16
SPREAD = WINDOW - GRAM + 1  # grams in a window
BLOCK_RUNS = 800_000
BLOCK_BYTES = 2_000_000


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the 16-byte gram at each place, from those of 2, 4 and 8 bytes."""
    h = buf.astype(np.uint64) + np.uint64(1)
    for step, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93)):
        h = (h[:-step] * np.uint64(odd)) ^ ((h[step:] << np.uint64(23)) | (h[step:] >> np.uint64(41)))
    return mix64(h)


def runs_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first window, last window, anchor place and anchor hash of each run, and all gram hashes."""
    empty = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    count = np.maximum(sizes - WINDOW + 1, 0)
    if not count.any():
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = gram_hashes(buf)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span, low = 1, key
    while span * 2 <= SPREAD:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < SPREAD:
        rest = SPREAD - span
        low = np.minimum(low[:-rest], low[rest:])
    doc = np.repeat(np.arange(len(sizes)), count)
    first = np.cumsum(count) - count
    start = np.arange(int(count.sum())) - np.repeat(first - offsets[:-1], count)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return doc[begin], start[begin], start[end], at[begin], h[at[begin]], h


def run_hashes(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of all bytes of each run and of where its anchor stands."""
    size = hi - lo + WINDOW
    out = mix64((size * 128 + (at - lo)).astype(np.uint64))
    for j in range(6):
        out = mix64(out ^ h[lo + np.minimum(GRAM * j, size - GRAM)])
    return out


_FIELDS = ("anchor", "bytes", "doc", "ord", "ids", "ths")
_KINDS = (np.uint64, np.uint64, np.uint32, np.uint32, np.int64, np.int64)


def _narrow(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, byte plane by byte plane."""
    return x.view(np.uint8).reshape(len(x), -1)[:, :size].T.tobytes()


def _wide(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view(np.uint64).ravel()


def pack_runs(docs: DataFrame, blocks: int) -> DataFrame:
    """Runs of ``docs (doc_id, th, text)``: a row for each batch and block of anchors."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ths = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in range(4)]
        for lo, hi in chunks(batch, 2, 1 << 20):
            doc, first, last, at, anchor, h = runs_of(*text_buffer(batch.column(2).slice(lo, hi - lo)))
            if not len(doc):
                continue
            order = np.arange(len(doc)) - np.searchsorted(doc, doc)
            for p, v in zip(parts, (anchor, run_hashes(h, first, last, at), (doc + lo).astype(np.uint32), order.astype(np.uint32)), strict=True):
                p.append(v)
        if not parts[0]:
            return
        anchor, whole, doc, order = (np.concatenate(p) for p in parts)
        block = (anchor % np.uint64(blocks)).astype(np.int64)
        by = np.argsort(block, kind="stable")
        held, starts = np.unique(block[by], return_index=True)
        out: list[list] = [[] for _ in range(7)]
        for b, k in zip(held.tolist(), np.split(by, starts[1:]), strict=True):
            who, local = np.unique(doc[k], return_inverse=True)
            values = (_narrow(anchor[k] // np.uint64(blocks), 5), _narrow(whole[k], 8), _narrow(local.astype(np.uint64), 3), order[k].tobytes(), ids[who].tobytes(), ths[who].tobytes())
            for c, v in zip(out, (b, *values), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["block", *_FIELDS])

    return arrow_map(docs, run, "block int, " + ", ".join(f"{f} binary" for f in _FIELDS))


def judge_runs(table: pa.Table) -> pa.Table:
    """Runs of a block that are removed whole (``anchor`` null), or that go on to be compared."""
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    for anchor, whole, local, order, ids, ths in zip(*(table.column(f).to_pylist() for f in _FIELDS), strict=True):
        local = _wide(local, 3).astype(np.int64)
        values = (_wide(anchor, 5), _wide(whole, 8), np.frombuffer(order, np.uint32), np.frombuffer(ids, np.int64)[local], np.frombuffer(ths, np.int64)[local])
        for p, v in zip(parts, values, strict=True):
            p.append(v)
    anchor, whole, order, ids, ths = (np.concatenate(p) for p in parts)
    by = np.lexsort((ids, whole, anchor))
    anchor, whole, order, ids, ths = (v[by] for v in (anchor, whole, order, ids, ths))
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new_bytes = new_anchor | np.r_[True, whole[1:] != whole[:-1]]
    variant = np.cumsum(new_bytes) - 1
    least = ids[new_bytes][variant]
    full = ids > least
    # An anchor goes on if its variants are first held by different documents.
    group = np.cumsum(new_anchor) - 1
    holder = ids[new_bytes]
    of_variant = group[new_bytes]
    starts = np.flatnonzero(np.r_[True, of_variant[1:] != of_variant[:-1]])
    on = (np.minimum.reduceat(holder, starts) != np.maximum.reduceat(holder, starts))[group] & ~full
    keep = full | on
    block = int(table.column("block")[0].as_py())
    return pa.table(
        {
            "doc_id": ids[keep],
            "th": ths[keep],
            "ord": order[keep].astype(np.int32),
            "anchor": pa.array(group[keep] + (block << 32), pa.int64(), mask=full[keep]),
        }
    )


def _eights(raw: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place to the end of its row, as a number that sorts as they do."""
    n = len(raw)
    h = np.zeros(n + 8, np.uint64)
    h[:n] = raw
    for step in (1, 2, 4):
        h[:-step] = (h[:-step] << np.uint64(8 * step)) | h[step:]
    return h[:n] & _HEADS[np.minimum(end - np.arange(n), 8)]


_HEADS = np.array([0, *(((1 << 8 * k) - 1) << (64 - 8 * k) for k in range(1, 9))], np.uint64)


def lyndon_ends(eights: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place ends, which is at the next smaller suffix of its row.

    Rows go side by side from their last place to the first: a place points behind itself and
    follows the pointers there while they lead to greater suffixes.
    """
    by = np.argsort(-size, kind="stable")
    begin, size = begin[by], size[by]
    stop = begin + size
    to = np.zeros(len(eights), np.int64)
    for k in range(int(size[0]) - 1, -1, -1):
        here = begin[: np.searchsorted(-size, -k)] + k
        next_ = here + 1
        go = np.flatnonzero(next_ < stop[: len(here)])
        while len(go):
            mine, other = here[go], next_[go]
            x, y = eights[mine], eights[other]
            more = y > x
            same = np.flatnonzero(x == y)
            depth = 8
            while len(same):
                same = same[other[same] + depth < stop[go[same]]]  # a suffix that ends is the smaller
                x, y = eights[mine[same] + depth], eights[other[same] + depth]
                more[same] = y > x
                same = same[x == y]
                depth += 8
            go, other = go[more], other[more]
            next_[go] = other = to[other]
            go = go[other < stop[go]]
        to[here] = next_
    return to


def _refine(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> None:
    """Splits whole groups, the places ``some``, by a key; a group's rank is the number of places in groups below."""
    small = key.dtype == np.int64  # no key is above the number of places
    order = np.argsort(rank[some] * (len(rank) + 1) + key) if small else np.lexsort((key, rank[some]))
    old, key = rank[some[order]], key[order]
    at = np.arange(len(order))
    new_group = np.r_[True, old[1:] != old[:-1]]
    new = new_group | np.r_[True, key[1:] != key[:-1]]
    first = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
    rank[some[order]] = old + first


def suffix_ranks(raw: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix from each place of rows that lie end to end (none empty).

    Suffixes that agree in ``depth`` bytes or to their ends may share a rank.
    """
    n = len(raw)
    end = np.repeat(begin + size, size)
    eights = _eights(raw, end)
    to = lyndon_ends(eights, begin, size)
    at = np.arange(n)
    length = to - at
    # Groups by Lyndon words, eight bytes at a time.
    key = eights & _HEADS[np.minimum(length, 8)]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, key[order[1:]] != key[order[:-1]]], at, 0))
    done = 8
    while True:
        longer = np.zeros(n + 1, bool)
        longer[rank[length > done]] = True
        some = np.flatnonzero(longer[rank])
        if not len(some):
            break
        left = np.clip(length[some] - done, 0, 8)
        _refine(rank, some, np.where(left > 0, eights[np.minimum(some + done, n - 1)], np.uint64(0)) & _HEADS[left])
        done += 8
    # In a group the suffixes behind the words decide; each round doubles the words looked at.
    while True:
        short = (to < end) & (to - at < depth)
        count = np.bincount(rank, minlength=n)
        open_ = np.zeros(n, bool)
        open_[rank[short & (count[rank] > 1)]] = True
        some = np.flatnonzero(open_[rank])
        if not len(some):
            return rank
        inside = to[some] < end[some]
        target = np.minimum(to[some], n - 1)
        key = np.where(inside, rank[target] + 1, 0)
        further = np.where(short, to[np.minimum(to, n - 1)], to)
        _refine(rank, some, key)
        to = further


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of a sequence of bytes in order."""
    if not text:
        return []
    n = len(text)
    return np.argsort(suffix_ranks(np.array(text, np.uint8), np.array([0]), np.array([n]), n)).tolist()


# First byte from the anchor, and length, of the strings of which a shared window holds one.
CORES = ((0, 42), (-9, 42), (-18, 42), (-27, 43))


def share_a_core(data: list[bytes], groups: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Variants that have a core in common with another variant of their anchor."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    size = np.fromiter(map(len, data), np.int64, len(data))
    begin = np.cumsum(size) - size
    h = gram_hashes(raw)
    keep = np.zeros(len(data), bool)
    for k, (first, length) in enumerate(CORES):
        at = np.flatnonzero((place + first >= 0) & (place + first + length <= size))
        here = begin[at] + place[at] + first
        key = mix64(groups[at].view(np.uint64) * np.uint64(4) + np.uint64(k))
        for step in (0, GRAM, length - GRAM):
            key = mix64(key ^ h[here + step])
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        keep[at] |= count[back] > 1
    return keep


def equal_windows(table: pa.Table) -> pa.Table:
    """Windows of the variants of a block that a smaller document also holds: (doc_id, th, ord, skip, n).

    ``skip`` is a window's place in its run, ``n`` how many follow on.
    """
    ids, order = table.column("doc_id").to_numpy(), table.column("ord").to_numpy()
    ths, data = table.column("th").to_numpy(), table.column("data").to_pylist()
    groups = table.column("anchor").to_numpy()
    some = np.flatnonzero(share_a_core(data, groups, table.column("place").to_numpy().astype(np.int64)))
    by = some[np.argsort(groups[some], kind="stable")]
    found: list[list[int]] = [[] for _ in range(3)]
    lo = 0
    while lo < len(by):  # whole anchors, up to a bounded number of bytes at a time
        hi, n = lo, 0
        while hi < len(by) and (n < BLOCK_BYTES or groups[by[hi]] == groups[by[hi - 1]]):
            n += len(data[by[hi]]) + 1
            hi += 1
        part = by[lo:hi].tolist()
        lo = hi
        raw = np.frombuffer(b"".join([data[i] for i in part]), np.uint8)
        size = np.array([len(data[i]) for i in part], np.int64)
        begin = np.cumsum(size) - size
        whose = np.repeat(np.arange(len(part)), size)
        skip = np.arange(len(raw)) - begin[whose]
        windows = np.flatnonzero(skip + WINDOW <= size[whose])
        windows = windows[np.argsort(suffix_ranks(raw, begin, size, WINDOW)[windows], kind="stable")]
        if not len(windows):
            continue
        rows = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)
        differ = np.ones(len(windows), bool)
        for a in range(1, len(windows), 200_000):
            b = min(a + 200_000, len(windows))
            differ[a:b] = (rows[windows[a:b]] != rows[windows[a - 1 : b - 1]]).any(1)
        owner = ids[np.array(part)][whose[windows]]
        least = np.minimum.reduceat(owner, np.flatnonzero(differ))[np.cumsum(differ) - 1]
        gone = np.sort(windows[owner > least])
        if not len(gone):
            continue
        start = np.r_[True, (gone[1:] != gone[:-1] + 1) | (whose[gone[1:]] != whose[gone[:-1]])]
        heads = gone[start]
        counts = np.diff(np.append(np.flatnonzero(start), len(gone)))
        found[0] += np.array(part)[whose[heads]].tolist()
        found[1] += skip[heads].tolist()
        found[2] += counts.tolist()
    k = np.array(found[0], np.int64)
    return pa.table({"doc_id": ids[k], "th": ths[k], "ord": order[k], "skip": pa.array(found[1], pa.int32()), "n": pa.array(found[2], pa.int32())})


def variant_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the runs that go on, and where the anchor is in them: (anchor, doc_id, th, ord, place, data)."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("ord", "anchor")).alias("runs"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in chunks(batch, 2, 1 << 20):
            part = batch.slice(lo, hi - lo)
            buf, offsets = text_buffer(part.column(2))
            doc, first, last, anchors, _, _ = runs_of(buf, offsets)
            begin = np.searchsorted(doc, np.arange(hi - lo))
            runs = part.column(3).combine_chunks() if isinstance(part.column(3), pa.ChunkedArray) else part.column(3)
            count = np.asarray(runs.value_lengths().fill_null(0))
            flat = runs.flatten()
            who = np.repeat(np.arange(hi - lo), count)
            order = np.asarray(flat.field("ord")).astype(np.int64)
            at = begin[who] + order
            data = buf.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("anchor"),
                    part.column(0).take(pa.array(who)),
                    part.column(1).take(pa.array(who)),
                    pa.array(order.astype(np.int32)),
                    pa.array((anchors[at] - first[at]).astype(np.int32)),
                    pa.array([data[a : b + WINDOW] for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)], pa.binary()),
                ],
                ["anchor", "doc_id", "th", "ord", "place", "data"],
            )

    met = docs.join(lists, ["doc_id", "th"]).select("doc_id", "th", "text", "runs")
    return arrow_map(met, run, "anchor long, doc_id long, th long, ord int, place int, data binary")


def cut(docs: DataFrame, spans: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """Each document without its spans of windows ``(doc_id, th, ord, skip, n)``; skip null: the whole run.

    ``keep_bytes`` adds what is left of the text.
    """
    lists = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("ord", "skip", "n")).alias("spans"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in chunks(batch, 1, 1 << 20):
            part = batch.slice(lo, hi - lo)
            buf, offsets = text_buffer(part.column(1))
            spans_ = part.column(2)
            count = np.asarray(spans_.value_lengths().fill_null(0)).astype(np.int64)
            touched = np.flatnonzero(count)
            gone = np.zeros(len(buf) + 1, np.int32)
            if len(touched):
                doc, first, last, _, _, _ = runs_of(buf, offsets)
                begin = np.searchsorted(doc, np.arange(hi - lo))
                flat = spans_.flatten()
                who = np.repeat(np.arange(hi - lo), count)
                at = begin[who] + np.asarray(flat.field("ord")).astype(np.int64)
                whole = np.asarray(flat.field("skip").is_null())
                skip = np.asarray(flat.field("skip").fill_null(0)).astype(np.int64)
                n = np.asarray(flat.field("n").fill_null(0)).astype(np.int64)
                a = np.where(whole, first[at], first[at] + skip)
                b = np.where(whole, last[at], first[at] + skip + n - 1) + WINDOW
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
            removed = np.cumsum(gone[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            n_removed = total[offsets[1:]] - total[offsets[:-1]]
            heads = removed.copy()
            heads[1:] &= ~removed[:-1]
            heads[offsets[:-1][offsets[:-1] < len(buf)]] |= removed[offsets[:-1][offsets[:-1] < len(buf)]]
            head_total = np.concatenate([[0], np.cumsum(heads)])
            n_spans = head_total[offsets[1:]] - head_total[offsets[:-1]]
            kept = buf[~removed].tobytes()
            place = offsets - total[offsets]
            sha = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            columns = [part.column(0), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(n_spans), pa.array(sha)]
            if keep_bytes:
                columns.append(pa.array([kept[x:y] for x, y in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    names = [f.split(" ")[0] for f in schema.split(", ")]
    met = docs.join(lists, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return arrow_map(met, run, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans of windows to remove from ``docs (doc_id, th, text)``."""
    spark = docs.sparkSession
    some = docs.filter("doc_id is not null")
    n_bytes = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(shuffle_partitions(spark), -(-int(n_bytes) * 2 // (SPREAD * BLOCK_RUNS)))
    packed = pack_runs(some, blocks)
    judged = materialize(packed.groupBy("block").applyInArrow(judge_runs, "doc_id long, th long, ord int, anchor long"))
    tidy(spark)
    on = judged.filter("anchor is not null")
    variants = materialize(variant_bytes(some, on))
    tidy(spark)
    n_bytes = variants.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    n = max(shuffle_partitions(spark), -(-int(n_bytes) // BLOCK_BYTES))
    dealt = variants.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n)))
    windows = materialize(dealt.groupBy("block").applyInArrow(equal_windows, "doc_id long, th long, ord int, skip int, n int"))
    none = F.lit(None).cast("int")
    return judged.filter("anchor is null").select("doc_id", "th", "ord", none.alias("skip"), none.alias("n")).unionByName(windows)


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept) of every row of ``docs (doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    docs = no_clash(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    return cut(docs, repeated_spans(docs), keep_bytes)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
