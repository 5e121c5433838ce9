"""Operator 10: fuzzy line deduplication over the whole corpus.

Lines are compared as lower-case words with digits as 0 and no punctuation.  Equal lines are
one node, whatever their length.  Lines link when their edit distance is at most a tenth of
the longer.  Candidates share a block key; a line has keys of two kinds:

* A 64-bit SimHash of its words, cut into ``m`` blocks of bits: a key for each choice of
  ``m - 3`` blocks.  By the pigeonhole principle lines whose hashes differ in at most three
  bits agree in one of them.  ``m`` grows with the number of lines to keep blocks small and
  does not change which pairs are found.
* Its character q-grams in ``PICKS`` ranges of hash values: the least hash of each range is a
  key.  One edit of a letter changes a whole word, and with it many bits of the SimHash of a
  short line, but few q-grams: lines that have the share ``J`` of their q-grams in common
  agree in each key with chance ``J``.  ``CLASSES`` has ``q`` by the longer line's length.

One pass over the texts deals all keys to buckets.  A bucket keeps those members of a block
that have a partner near enough in size (or in SimHash), which is linear in its rows.  Their
texts are fetched once.  Sizes, counts of characters and minima of shorter q-grams, 40 bytes
a line, go to the blocks first: a member stays in a block if these allow a link with another
one there that it meets in no earlier block.  Texts follow for those that stay.  Each member
is first held against the block's most frequent line; then members that are not connected by
now meet those of near size, each two in the first of their common blocks only.  Banded edit
distance decides, and only links that connect something become rows.  A large block is dealt
over a triangle of cells.  Of each connected group of lines the first occurrence in the
corpus, by document and line, stays and all others go.

Defined cases: null and empty texts have one empty line; lines without a letter or digit
always stay; lines with fewer than ``EDIT_SHARE`` compared characters link with equal ones
only; repeated rows and ids are told apart by a hash of the text, and rows equal in both lose
the same lines; rows with a null id keep all lines and lend none; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import arrow_map, chunks, connected_components, free, materialize, mix64, no_clash, read_table, shuffle_partitions, text_buffer, tidy
from exceedra.llm.decontaminate import END, _tables

MAX_DISTANCE = 3
NEAR_DISTANCE = 5  # differing bits of lines that meet in a block all the same
EDIT_SHARE = 10
GROUP_LINES = 2_048  # lines expected in a block by chance at most; each meets those of near size only
LARGE_BLOCK = 20_000  # members that are not looked at pair by pair while blocks are built
FEW_MEMBERS = 16  # in a cell where no pair is compared that an earlier block has
LARGE_GRAM_BLOCK = 2_000  # the same where a q-gram is the key
CELL_MEMBERS = 5_000  # of a block, before its pairs are dealt over cells
TILE_MEMBERS = 40_000  # expected in a task that compares texts
LEAST_ROUND = 1_000_000  # rows that are dealt at once in any case
MEMBER_BYTES = 400  # of the corpus for each signature that is dealt at once, so that exchanges take a share of its size
MEMBER_TEXT_BYTES = 1_600  # the same for each text
PAIRS_AT_ONCE = 100_000
BAND_SIZE = 3_000  # characters; longer lines are compared one pair at a time
BAND_CELLS = 600_000  # characters of pairs compared together
STRETCH = 8
FEW_PAIRS = 24  # fewer are compared one at a time
BUCKET_LINES = 100_000
BATCH_LINES = 50_000  # whose keys are packed together
LINE_BUCKETS = 4  # groups of packed lines for each bucket of keys
TEXT_BYTES = 1 << 18  # of texts whose keys are made together, within a processor's cache
LINE_BYTES = 200  # expected; sets the number of blocks and buckets only
MAX_BROADCAST_ROWS = 2_000_000
# Least length of the longer line and q of each class.
CLASSES = ((EDIT_SHARE, 4), (20, 6), (40, 10), (100, 16))
PICKS = 6
ANYWHERE = 65_535  # place of a q-gram that a line has twice
BINS = 16
SKETCH_Q = (4, 8)  # for lines below SKETCH_SIZE, and others
SKETCH_SIZE = 40
SKETCH_SHARE = 6
LIKELY = 1.7  # lines with the inverse of this share of minima in common are aligned before the table
SIGNATURE = tuple(f"s{k}" for k in range(2 * BINS // 8))  # columns of eight bytes of a signature each
_STEP = np.uint64(0xD1342543DE82EF95)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _letter_hashes() -> np.ndarray:
    return mix64(np.arange(0x110000, dtype=np.uint64))


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order-aware hash of consecutive stretches of hashed values, ``size`` of each."""
    first = np.cumsum(size) - size
    local = np.arange(len(values)) - np.repeat(first, size)
    return mix64(np.add.reduceat(values * _powers(int(size.max()))[local], first) + size.astype(np.uint64))


@cache
def _folded() -> np.ndarray:
    """Compared form of each code point: 32 where it is no letter, mark or number, ``END`` for a line's end."""
    lower, solid = _tables()
    out = np.where(solid, lower, 32).astype(np.uint32)
    out[(out >= 48) & (out <= 57)] = 48
    out[10] = END
    return out


def line_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, line number, first, last + 1) of lines with a letter or digit, and the compared text.

    A line is compared without the spaces at its ends.
    """
    data = buf.tobytes()
    docs = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    n_lines = np.array([d.count(b"\n") + 1 for d in docs])
    docs.append(b"")
    x = _folded()[np.frombuffer(b"\n".join(docs).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    blank = x == 32
    again = blank[1:] & blank[:-1]
    if again.any():
        x = x[np.r_[True, ~again]]
    ends = np.flatnonzero(x == END)
    begin = np.concatenate([[0], ends[:-1] + 1])
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    number = np.arange(len(ends)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    begin = begin + (x[np.minimum(begin, len(x) - 1)] == 32)
    ends = ends - ((ends > begin) & (x[np.maximum(ends - 1, 0)] == 32))
    some = ends > begin
    return doc[some], number[some], begin[some], ends[some], x


def sim_hashes(words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Majority of each bit over stretches of hashed values, ``count`` of each.

    Up to 255 values are counted in the bytes of eight integers at once.
    """
    first = np.cumsum(count) - count
    sim = np.zeros(len(count), np.uint64)
    ones = np.uint64(0x0101010101010101)
    half = (count // 2).astype(np.uint8)[:, None]
    for k in range(8):
        total = np.add.reduceat(words >> np.uint64(k) & ones, first).view(np.uint8).reshape(-1, 8)
        sim |= (total > half).astype(np.uint8).view(np.uint64).ravel() << np.uint64(k)
    for i in np.flatnonzero(count > 255).tolist():
        bits = np.unpackbits(words[first[i] : first[i] + count[i]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        sim[i] = np.packbits(2 * bits > count[i], bitorder="little").view(np.uint64)[0]
    return sim


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, line number, hash, SimHash, first, last + 1) of lines with a letter or digit, and the compared text."""
    doc, number, begin, ends, x = line_bounds(buf, offsets)
    none = np.zeros(0, np.uint64)
    if not len(doc):
        return doc, number, none, none, begin, ends, x
    letter = (x != 32) & (x != END)
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1  # the text ends with a mark, and so with no word
    if letter[0]:
        edges = np.r_[0, edges]
    s, e = edges[::2], edges[1::2]
    words = _sums(_letter_hashes()[x[letter]], e - s)
    count = np.searchsorted(s, ends) - np.searchsorted(s, begin)  # every word is in a line
    return doc, number, _sums(words, count), sim_hashes(words, count), begin, ends, x


def blocks_for(n: int) -> int:
    """Number of blocks so that chance alone puts at most ``GROUP_LINES`` lines in a joined group."""
    m = MAX_DISTANCE + 1
    while m < 8 and n > GROUP_LINES << (64 * (m - MAX_DISTANCE) // m):
        m += 1
    return m


def block_keys(sim: np.ndarray, m: int) -> Iterator[np.ndarray]:
    """For every choice of ``m - 3`` blocks, the hash's bits in them."""
    cuts = [64 * i // m for i in range(m + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for chosen in combinations(masks, m - MAX_DISTANCE):
        yield sim & np.uint64(sum(chosen))


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place of an array of code points, from those of half its length."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    power = _powers(17)
    own, size, out, done = x.astype(np.uint64), 1, None, 0  # own: polynomials of ``size`` characters; out: of ``done``
    while True:
        if q & size:
            n = len(x) - done - size + 1
            out, done = (own, size) if out is None else (out[:n] * power[size] + own[done : done + n], done + size)
        if done == q:
            return mix64(out)
        own = own[:-size] * power[size] + own[size:]
        size *= 2


def range_minima(x: np.ndarray, begin: np.ndarray, end: np.ndarray, q: int, ranges: int, where: np.ndarray | None = None) -> np.ndarray:
    """The least q-gram hash of each line in each range of hash values; all bits set where there is none.

    ``where`` gets the place of its q-gram in the line, or ``ANYWHERE`` if the line has it again.
    """
    low = np.full(len(begin) * ranges, _NONE, np.uint64)
    count = end - begin - q + 1
    own = np.flatnonzero(count > 0)
    count = count[own]
    if len(own) and 2 * int((count + q).sum()) < len(x):  # few of the characters: hash those only
        size = end[own] - begin[own]
        first = np.cumsum(size) - size
        x = x[np.arange(int(size.sum())) + np.repeat(begin[own] - first, size)]
        begin = begin.copy()
        begin[own] = first
    if len(own):
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - begin[own], count)
        g = gram_hashes(x, q)[at]
        place = np.repeat(own * ranges, count) + ((g & np.uint64(0xFFFF)) * np.uint64(ranges) >> np.uint64(16)).astype(np.int64)
        np.minimum.at(low, place, g)
        if where is not None:
            hit = np.flatnonzero(g == low[place])
            place = place[hit]
            where[place] = np.minimum(at[hit] - begin[place // ranges], ANYWHERE)
            where[np.bincount(place, minlength=len(where)) > 1] = ANYWHERE
    return low.reshape(-1, ranges)


def picked_grams(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, place) of the least q-gram hash of each range in each line, for every class that the line can be in."""
    size = end - begin
    lines, keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    for c, (least, q) in enumerate(CLASSES):
        most = CLASSES[c + 1][0] if c + 1 < len(CLASSES) else 1 << 40
        # The shorter line of a pair may lack a tenth of the longer.
        own = np.flatnonzero((size >= least - least // EDIT_SHARE) & (size < most) & (size >= q))
        if len(own):
            where = np.zeros(len(own) * PICKS, np.uint16)
            low = range_minima(x, begin[own], end[own], q, PICKS, where).ravel()
            held = np.flatnonzero(low != _NONE)
            lines.append(own[held // PICKS])
            keys.append(mix64(low[held] + np.uint64(q)))
            places.append(where[held])
    return np.concatenate(lines), np.concatenate(keys), np.concatenate(places)


_FIELDS = ("key", "h", "size", "place")
_KINDS = (np.uint64, np.int64, np.uint32, np.uint16)


def planes(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each value, byte plane by byte plane."""
    return x.view(np.uint8).reshape(len(x), -1)[:, :size].T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    """Values from all their byte planes."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def line_blocks(docs: DataFrame, m: int, buckets: int) -> DataFrame:
    """Packed rows of ``docs (doc_id, th, text)``: a batch's keys in a bucket, or a batch's lines, in a bucket below 0.

    Buckets below ``buckets`` hold q-gram keys; those above hold SimHashes by choice of blocks.
    """
    names = ["bucket", "b_key", "b_h", "b_size", "b_place", "b_line", "b_own", "b_id", "b_th"]

    def packed(bucket: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
        if not len(bucket):
            return
        order = np.argsort(bucket, kind="stable")
        held, starts = np.unique(bucket[order], return_index=True)
        for b, k in zip(held.tolist(), np.split(order, starts[1:]), strict=True):
            yield (b, *(planes(v[k], v.dtype.itemsize) for v in values), *[None] * 4)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        ids, ths = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0, *[len(w[0]) for w in waiting]])
            h, size, sim, number, doc, where = (np.concatenate([w[k] for w in waiting]) for k in (0, 1, 2, 5, 6, 7))
            line = np.concatenate([w[3] + b for w, b in zip(waiting, base[:-1], strict=True)])
            key = np.concatenate([w[4] for w in waiting])
            waiting.clear()
            if not len(h):
                return
            who, own = np.unique(doc, return_inverse=True)
            spread = -1 - int(h.view(np.uint64)[0] % np.uint64(LINE_BUCKETS * buckets))
            rows = [(spread, None, h.tobytes(), None, None, planes(number, 4), planes(own.astype(np.uint32), 4), ids[who].tobytes(), ths[who].tobytes())]
            _, once = np.unique(h, return_index=True)
            place = np.full(len(h), -1)
            place[once] = np.arange(len(once))
            held = place[line] >= 0
            line, key, where = place[line[held]], key[held], where[held]
            h, size, sim = h[once], size[once], sim[once]
            rows += packed((key % np.uint64(buckets)).astype(np.int64), key, h[line], size[line], where)
            some = np.flatnonzero(size >= EDIT_SHARE)
            for c, k in enumerate(block_keys(sim[some], m)):
                rows += packed(buckets * (c + 1) + (mix64(k) % np.uint64(buckets)).astype(np.int64), sim[some], h[some], size[some], np.zeros(len(some), np.uint16))
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 8), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

        lines = 0
        for lo, hi in chunks(batch, 2, TEXT_BYTES):
            doc, number, whole, sim, begin, end, x = lines_of(*text_buffer(batch.column(2).slice(lo, hi - lo)))
            line, key, where = picked_grams(x, begin, end)
            waiting.append((whole.view(np.int64), (end - begin).astype(np.uint32), sim, line, key, number.astype(np.uint32), doc + lo, where))
            lines += len(doc)
            if lines > BATCH_LINES:
                yield from flush()
                lines = 0
        if waiting:
            yield from flush()

    return arrow_map(docs, run, "bucket int, " + ", ".join(f"{n} binary" for n in names[1:]))


def block_members(packed: DataFrame, m: int, buckets: int) -> DataFrame:
    """(block, h, n) of the lines that have a partner within the bounds in their block; ``n`` is how many batches hold them.

    With ``block`` null, every line (doc_id, th, line, h): both leave by the one exchange of the packed rows.
    """

    def lines(table: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[] for _ in range(4)]
        for h, number, own, ids, ths in zip(*(table.column(f"b_{f}").to_pylist() for f in ("h", "line", "own", "id", "th")), strict=True):
            own = from_planes(own, np.uint32)
            values = (np.frombuffer(ids, np.int64)[own], np.frombuffer(ths, np.int64)[own], from_planes(number, np.uint32).astype(np.int32), np.frombuffer(h, np.int64))
            for p, v in zip(parts, values, strict=True):
                p.append(v)
        doc_id, th, number, h = (np.concatenate(p) for p in parts)
        nothing = pa.nulls(len(h), pa.int64())
        return pa.table({"doc_id": doc_id, "th": th, "line": number, "h": h, "block": nothing, "n": nothing})

    nobody = pa.schema([(c, pa.int32() if c == "line" else pa.int64()) for c in ("doc_id", "th", "line", "h", "block", "n")]).empty_table()

    def run(table: pa.Table) -> pa.Table:
        bucket = int(table.column("bucket")[0].as_py())
        if bucket < 0:
            return lines(table)
        choice = bucket // buckets - 1
        parts: list[list[np.ndarray]] = [[] for _ in _FIELDS]
        for row in zip(*(table.column(f"b_{f}").to_pylist() for f in _FIELDS), strict=True):
            for p, v, k in zip(parts, row, _KINDS, strict=True):
                p.append(from_planes(v, k))
        value, h, size, place = (np.concatenate(p) for p in parts)
        key = value if choice < 0 else list(block_keys(value, m))[choice]
        order = np.argsort(key)
        again = key[order[1:]] == key[order[:-1]]
        order = order[np.r_[False, again] | np.r_[again, False]]  # a line alone in its block has no partner
        if not len(order):
            return nobody
        order = order[np.lexsort((h[order], size[order], key[order]))]
        new = np.r_[True, (key[order[1:]] != key[order[:-1]]) | (h[order[1:]] != h[order[:-1]])]
        n = np.diff(np.append(np.flatnonzero(new), len(order)))
        order = order[new]
        key, value, h, size, place = key[order], value[order], h[order], size[order].astype(np.int64), place[order].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        in_block = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
        stays = np.zeros(len(key), bool)
        large = in_block > LARGE_BLOCK
        if choice < 0:  # sizes rise in a block, so the nearest size is next to a line
            large = in_block > LARGE_GRAM_BLOCK
            near = large[1:] & (key[1:] == key[:-1]) & (size[1:] - size[:-1] <= size[1:] // EDIT_SHARE)
            stays[1:] |= near
            stays[:-1] |= near
        else:
            stays |= large
        left, d = np.flatnonzero(~large), 1
        while len(left):
            left = left[left + d < len(key)]
            left = left[(key[left] == key[left + d]) & (size[left + d] - size[left] <= size[left + d] // EDIT_SHARE)]
            right = left + d
            if choice < 0:  # edits move a q-gram that they spare by their number at most
                fits = (np.abs(place[left] - place[right]) <= size[right] // EDIT_SHARE) | (place[left] == ANYWHERE) | (place[right] == ANYWHERE)
            else:
                fits = np.bitwise_count(value[left] ^ value[right]) <= NEAR_DISTANCE
            stays[left[fits]] = True
            stays[right[fits]] = True
            d += 1
        block = mix64(key + np.uint64(choice + 1)).view(np.int64)
        k = int(stays.sum())
        nothing = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int32())]
        return pa.table([*nothing, h[stays], block[stays], n[stays]], names=nobody.column_names)

    return packed.groupBy("bucket").applyInArrow(run, "doc_id long, th long, line int, h long, block long, n long")


def signatures(texts: list[str]) -> np.ndarray:
    """Characters of each text by ``BINS`` classes, 255 at most, and a byte for each of ``BINS`` q-gram minima, 0 for none."""
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bins = (mix64(codes.astype(np.uint64)) >> np.uint64(60)).astype(np.int64)
    out = np.zeros((len(texts), 2 * BINS), np.uint8)
    out[:, :BINS] = np.minimum(np.bincount(np.repeat(np.arange(len(texts)), size) * BINS + bins, minlength=len(texts) * BINS), 255).reshape(-1, BINS)
    end = np.cumsum(size)
    for q, some in ((SKETCH_Q[0], size < SKETCH_SIZE), (SKETCH_Q[1], size >= SKETCH_SIZE)):
        own = np.flatnonzero(some)
        low = range_minima(codes, end[own] - size[own], end[own], q, BINS)
        out[own, BINS:] = np.where(low == _NONE, 0, mix64(low) % np.uint64(255) + np.uint64(1))
    return out


def _byte_sums(x: np.ndarray) -> np.ndarray:
    """Sum of the 16 bytes in each row of two integers."""
    low = np.uint64(0x00FF00FF00FF00FF)
    x = (x & low) + (x >> np.uint64(8) & low)
    return ((x[:, 0] + x[:, 1]) * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


def _byte_count(x: np.ndarray) -> np.ndarray:
    """How many of the 16 values of each row are true."""
    return np.bitwise_count(x.view(np.uint64)).sum(1, dtype=np.int64)


def shared_minima(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many q-gram minima pairs of signatures have in common, and how many either has."""
    x, y = one[:, BINS:], two[:, BINS:]
    none = _byte_count((x | y) == 0)
    return _byte_count(x == y) - none, BINS - none


def can_link(one: np.ndarray, two: np.ndarray, size_one: np.ndarray, size_two: np.ndarray) -> np.ndarray:
    """Whether pairs of lines can be within the budget, by their sizes and signatures.

    An edit moves one character class up and one down.  Pairs must also agree in a sixth of
    the q-gram minima that either has; lines on two sides of ``SKETCH_SIZE`` are not held to that.
    """
    budget = np.maximum(size_one, size_two) // EDIT_SHARE
    same, used = shared_minima(one, two)
    ok = (np.abs(size_one - size_two) <= budget) & ((SKETCH_SHARE * same >= used) | ((size_one < SKETCH_SIZE) != (size_two < SKETCH_SIZE)))
    some = np.flatnonzero(ok)
    x, y = one[some, :BINS], two[some, :BINS]
    top = np.maximum(x, y)
    ok[some] = np.maximum(_byte_sums((top - y).view(np.uint64)), _byte_sums((top - x).view(np.uint64))) <= budget[some]
    return ok


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most ``limit``: bit-parallel columns over the differing middle."""
    if abs(len(a) - len(b)) > limit:
        return False
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = sorted((a[lo : len(a) - hi], b[lo : len(b) - hi]), key=len)
    if not a:
        return len(b) <= limit
    if len(b) - len(a) > limit:
        return False
    if 2 * limit + 1 < len(a):
        return _in_band(a, b, limit)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, up, down, score = (1 << len(a)) - 1, (1 << len(a)) - 1, 0, len(b) - len(a)
    for row, c in enumerate(b, len(a) - len(b)):
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        if row >= 0 and not diagonal >> row & 1:  # the diagonal that ends in the distance never falls
            score += 1
            if score > limit:
                return False
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
    return score <= limit


def _in_band(a: str, b: str, limit: int) -> bool:
    """``within`` for a longer ``b`` over the band of the table that the limit leaves, as in ``_banded``."""
    where: dict[str, int] = {}
    for i, c in enumerate(b, limit):
        where[c] = where.get(c, 0) | 1 << i
    full, up, down, far = (1 << (2 * limit + 1)) - 1, ((1 << (limit + 1)) - 1) << limit, 0, len(b) - len(a)
    bit = limit + far
    for i, c in enumerate(a):
        same = where.get(c, 0) >> i & full
        diagonal = ((((same & up) + up) ^ up) | same | down) & full
        if not diagonal >> bit & 1:
            far += 1
            if far > limit:
                return False
        right, left = down | (full ^ (diagonal | up)), diagonal & up
        diagonal >>= 1
        up, down = left | (full ^ (diagonal | right)), diagonal & right
    return True


def line_texts(lines: DataFrame, needed: DataFrame, docs: DataFrame) -> DataFrame:
    """h, compared text t, its size and signature (``SIGNATURE``) of the lines ``needed (h)``, each from one of its occurrences.

    A line is there again for every repetition of the row it is taken from.
    """
    few = needed.count() <= MAX_BROADCAST_ROWS
    some = lines.join(F.broadcast(needed) if few else needed, "h", "left_semi")
    first = some.groupBy("h").agg(F.min(F.struct("doc_id", "th", "line")).alias("p"))
    lists = materialize(first.groupBy("p.doc_id", "p.th").agg(F.collect_list(F.struct("p.line", "h")).alias("lines")))
    few = lists.count() <= MAX_BROADCAST_ROWS // 10
    texts = docs.join(F.broadcast(lists) if few else lists, ["doc_id", "th"]).select("text", "lines")

    def fetch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in chunks(batch, 0, 1 << 20):
            held, hashes = [], []  # only the wanted lines are brought to their compared form
            for text, wanted in zip(batch.column(0).slice(lo, hi - lo).cast(pa.binary()).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                parts = text.split(b"\n")
                held += [parts[w["line"]] for w in wanted]
                hashes += [w["h"] for w in wanted]
            doc, _, begin, end, x = line_bounds(*text_buffer(pa.array(held, pa.binary()).view(pa.string())))
            found = [x[a:b].tobytes().decode("utf-32-le") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            signs = signatures(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.int64)[doc]), pa.array(found, pa.string()), pa.array((end - begin).astype(np.int32)), *[pa.array(c) for c in signs.T.copy()]], ["h", "t", "size", *SIGNATURE])

    texts = materialize(arrow_map(texts, fetch, "h long, t string, size int, " + ", ".join(f"{c} long" for c in SIGNATURE)))
    free(lists)
    return texts


def same_start(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def surely_within(a: str, b: str, limit: int) -> bool:
    """Whether an alignment that takes the next common stretch of ``STRETCH`` characters each time is in the limit.

    True proves that the edit distance is; False proves nothing.
    """
    i = j = cost = 0
    while True:
        k = same_start(a[i:], b[j:])
        i, j = i + k, j + k
        if i == len(a) or j == len(b):
            return cost + len(a) - i + len(b) - j <= limit
        for skip in range(limit - cost + 1):
            p = b.find(a[i + skip : i + skip + STRETCH], j, j + limit - cost + STRETCH) if i + skip + STRETCH <= len(a) else -1
            if p >= 0:
                break
        else:
            return cost + max(len(a) - i, len(b) - j) <= limit
        cost += max(skip, p - j)
        i, j = i + skip, p


def all_within(pairs: list[tuple[str, str]], likely: np.ndarray | None = None) -> np.ndarray:
    """Whether pairs of lines, the shorter one first, are within the budget of the longer.

    Most links are proved by a plain alignment, the rest by the table between the common ends.
    The alignment is left out where a link is not ``likely``.
    """
    likely = np.ones(len(pairs), bool) if likely is None else likely
    out = np.zeros(len(pairs), bool)
    left: list[tuple[str, str]] = []
    rows, limits = [], []
    for k, ((a, b), try_first) in enumerate(zip(pairs, likely.tolist(), strict=True)):
        limit = len(b) // EDIT_SHARE
        lo = same_start(a, b)
        a, b = a[lo:], b[lo:]
        hi = same_start(a[::-1], b[::-1])
        a, b = a[: len(a) - hi], b[: len(b) - hi]
        if len(b) <= limit or (try_first and surely_within(a, b, limit)):
            out[k] = True
        elif len(b) > BAND_SIZE:
            out[k] = within(a, b, limit)
        else:
            left.append((a, b))
            rows.append(k)
            limits.append(limit)
    out[np.array(rows, np.int64)] = _banded_parts(left, np.array(limits, np.int64))
    return out


def _banded_parts(pairs: list[tuple[str, str]], limit: np.ndarray) -> np.ndarray:
    """Whether edit distances are at most ``limit``, pairs of similar size and budget together."""
    out = np.zeros(len(pairs), bool)
    size = np.array([len(b) for _, b in pairs], np.int64)
    go = np.flatnonzero(size - np.array([len(a) for a, _ in pairs], np.int64) <= limit)
    if not len(go):
        return out
    words = 1 << np.ceil(np.log2(2 * limit[go] // 64 + 1)).astype(np.int64)  # of a band, in powers of two
    order = np.lexsort((size[go], words))
    go, words = go[order], words[order]
    starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    for lo, end in zip(starts.tolist(), np.append(starts[1:], len(go)).tolist(), strict=True):
        while lo < end:
            most = max(FEW_PAIRS, BAND_CELLS // int(size[go[min(lo + BAND_CELLS // 64, end) - 1]]))
            part = go[lo : min(lo + most, end)]
            some = [pairs[k] for k in part.tolist()]
            out[part] = [within(x, y, k) for (x, y), k in zip(some, limit[part].tolist(), strict=True)] if len(part) < FEW_PAIRS else _banded(some, limit[part])
            lo += most
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, code point) of every character."""
    size = np.array([len(t) for t in texts], np.int64)
    who = np.repeat(np.arange(len(texts)), size)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _banded(pairs: list[tuple[str, str]], limit: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs at once, the bits of a band of the table's columns in the words of a pair.

    At the shorter line's character ``i`` the band's top bit is the longer line's character
    ``i + k``.  ``far`` follows the diagonal that ends in the distance; it never falls there.
    """
    k = int(limit.max())
    words = 2 * k // 64 + 1
    bits, one, top = 64 * words, np.uint64(1), np.uint64(63)
    n, m = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    who, place, char = _codes([b for _, b in pairs])
    letters = np.unique(char)
    rows, wide = len(letters) + 1, int(m.max() + bits) // 64 + words + 2
    place = place + bits - k - 1
    same = np.zeros((len(pairs) * rows, wide), np.uint64)  # a row for each pair and letter, and one for others
    np.bitwise_or.at(same, (who * rows + np.searchsorted(letters, char), place >> 6), one << (place & 63).astype(np.uint64))
    same = same.ravel()
    who, place, char = _codes([a for a, _ in pairs])
    code = np.minimum(np.searchsorted(letters, char), rows - 2)
    code = np.where(letters[code] == char, code, rows - 1)
    row = ((np.arange(len(pairs)) + 1) * rows - 1 + np.zeros((max(int(n.max()), 1), 1), np.int64)) * wide
    row[place, who] = (who * rows + code) * wide
    mask = ((1 << (k + 1)) - 1) << (bits - 1 - k)
    up = np.array([[mask >> (64 * w) & (1 << 64) - 1] for w in range(words)], np.uint64) + np.zeros((1, len(pairs)), np.uint64)
    down = np.zeros_like(up)
    who, far = np.arange(len(pairs)), m - n
    out, bit = far <= limit, bits - 1 - k + far
    word, bit = bit >> 6, (bit & 63).astype(np.uint64)
    step = np.arange(words)[:, None]
    for i in range(int(n.max())):
        at = row[i] + (i >> 6) + step
        x = same[at] >> np.uint64(i & 63)
        if i & 63:
            x |= same[at + 1] << np.uint64(64 - (i & 63))
        diagonal = x & up
        total = diagonal + up
        for w in range(1, words):
            total[w] += (diagonal[w - 1] | (up[w - 1] & ~total[w - 1])) >> top
        total ^= up
        total |= x
        total |= down
        right, left = down | ~(total | up), total & up
        down = total >> one
        if words > 1:
            down[:-1] |= total[1:] << top
            last = total[word, np.arange(len(who))]
        else:
            last = total[0]
        far += (~(last >> bit) & one).view(np.int64) * (n > i)
        up = left | ~(down | right)
        down &= right
        if i % 16 == 15:
            alive = (n > i + 1) & (far <= limit)
            if int(n[alive].sum()) < FEW_PAIRS * (len(row) - i):  # too few for steps side by side
                out[who] = far <= limit
                for w, k in zip(who[alive].tolist(), limit[alive].tolist(), strict=True):
                    out[w] = within(*pairs[w], k)
                return out
            if 4 * int(alive.sum()) <= 3 * len(who):
                out[who] = far <= limit
                who, word, bit, far, limit, n = (v[alive] for v in (who, word, bit, far, limit, n))
                row, up, down = row[:, alive], up[:, alive], down[:, alive]
                if not len(who):
                    break
    out[who] = far <= limit
    return out


def _signs(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in SIGNATURE], 1).view(np.uint8)


def _earlier(table: pa.Table) -> np.ndarray:
    """The earlier blocks of each row, in order, and the largest number where there are no more."""
    lists = table.column("earlier").combine_chunks()
    count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(count), int(count.max(initial=0))), np.iinfo(np.int64).max)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out[np.repeat(np.arange(len(count)), count), place] = lists.flatten().to_numpy()
    return out


def meet_first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the members with the earlier blocks ``x`` and ``y`` have none in common."""
    first = np.ones(len(x), bool)
    for k in range(x.shape[1]):
        some = np.flatnonzero(first & (x[:, k] < np.iinfo(np.int64).max))
        if not len(some):
            break
        first[some] = ~(y[some] == x[some, k, None]).any(1)
    return first


def linked_members(table: pa.Table) -> pa.Table:
    """Members of one bucket's cells whose signature allows a link with another that they meet in no earlier block."""
    h, size = table.column("h").to_numpy(), table.column("size").to_numpy().astype(np.int64)
    _, cell = np.unique(table.column("cell").to_numpy(), return_inverse=True)
    order = np.lexsort((h, size, cell))
    h, size, cell, side, signs, earlier = h[order], size[order], cell[order], table.column("side").to_numpy()[order], _signs(table)[order], _earlier(table)[order]
    # Sizes rise in a cell, so those near enough stand together.
    wide = int(size.max()) + 1
    end = np.searchsorted(cell * wide + size - size // EDIT_SHARE, cell * wide + size, side="right")
    stays = np.zeros(len(h), bool)
    left, d = np.arange(len(h)), 1
    while len(left):
        left = left[left + d < end[left]]
        if d % 16 == 0:  # who stays already is only held against those that may not
            open_ = np.r_[0, np.cumsum(~stays)]
            left = left[~stays[left] | (open_[end[left]] > open_[np.minimum(left + d, end[left])])]
        s = left[~(stays[left] & stays[left + d]) & ((side[left] != side[left + d]) | (side[left] == 0))]
        for a in range(0, len(s), PAIRS_AT_ONCE):
            i = s[a : a + PAIRS_AT_ONCE]
            i = i[can_link(signs[i], signs[i + d], size[i], size[i + d])]
            i = i[meet_first(earlier[i], earlier[i + d])]
            stays[i] = stays[i + d] = True
        d += 1
    return table.select(["cell", "h", "n", "side", "earlier"]).take(pa.array(np.sort(order[stays])))


def block_links(table: pa.Table) -> pa.Table:
    """Links (a, b) of each connected line of the cells of one bucket to the least one of its group there."""
    cell, h, n, side = (table.column(c).to_numpy() for c in ("cell", "h", "n", "side"))
    names, node = np.unique(h, return_inverse=True)
    at = np.zeros(len(names), np.int64)
    at[node] = np.arange(len(h))
    texts = table.column("t").take(pa.array(at)).to_pylist()
    length = np.array([len(t) for t in texts], np.int64)
    bag = _signs(table)[at]
    order = np.lexsort((h, length[node], cell))
    cell, n, side, node, earlier = cell[order], n[order], side[order], node[order], _earlier(table)[order]
    size = length[node]
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def settle(one: np.ndarray, two: np.ndarray) -> bool:
        """Link pairs of nodes within the budget; ``one`` is no longer than ``two``."""
        pairs = np.unique(np.stack([one, two], 1), axis=0)
        pairs = pairs[can_link(bag[pairs[:, 0]], bag[pairs[:, 1]], length[pairs[:, 0]], length[pairs[:, 1]])]
        same, used = shared_minima(bag[pairs[:, 0]], bag[pairs[:, 1]])
        some = False
        for i, j in pairs[all_within([(texts[i], texts[j]) for i, j in pairs.tolist()], LIKELY * same >= used)].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                some = True
        return some

    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    members = np.diff(np.append(starts, len(cell)))
    of = np.repeat(np.arange(len(starts)), members)
    chief = np.lexsort((node, n, of))[np.append(starts[1:], len(cell)) - 1][of]
    hub = node[chief]
    long_ = length[hub] > size
    one, two = np.where(long_, node, hub), np.where(long_, hub, node)
    # A pair meets once; only in a cell of many lines each is held against the hub, whatever other blocks do.
    go = np.flatnonzero((node != hub) & ((members[of] > FEW_MEMBERS) | meet_first(earlier, earlier[chief])))
    for a in range(0, len(go), PAIRS_AT_ONCE):
        k = go[a : a + PAIRS_AT_ONCE]
        settle(one[k], two[k])

    label = np.array([root(i) for i in range(len(names))])[node]
    left, d, held = np.arange(len(node)), 1, 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    while len(left):
        left = left[left + d < len(node)]
        r = left + d
        left = left[(cell[left] == cell[r]) & (size[r] - size[left] <= size[r] // EDIT_SHARE)]
        s = left[(label[left] != label[left + d]) & ((side[left] != side[left + d]) | (side[left] == 0)) & (node[left] != hub[left]) & (node[left + d] != hub[left])]
        for a in range(0, len(s), PAIRS_AT_ONCE):
            i = s[a : a + PAIRS_AT_ONCE]
            i = i[can_link(bag[node[i]], bag[node[i + d]], size[i], size[i + d])]
            i = i[meet_first(earlier[i], earlier[i + d])]
            if len(i):
                waiting.append((node[i], node[i + d]))
                held += len(i)
        d += 1
        if waiting and (not len(left) or held > PAIRS_AT_ONCE // 4):
            x, y = (np.concatenate(v) for v in zip(*waiting, strict=True))
            waiting.clear()
            held = 0
            if settle(x, y):
                label = np.array([root(i) for i in range(len(names))])[node]
    first = np.array([root(i) for i in range(len(names))])
    some = np.flatnonzero(first != np.arange(len(names)))
    return pa.table({"a": names[first[some]], "b": names[some]})


def dealt_members(members: DataFrame, texts: DataFrame, n_bytes: int) -> Iterator[DataFrame]:
    """Members (block, h, n) with their signatures, their earlier blocks, and the cells of large blocks, in buckets.

    A block of ``c`` parts has a cell for each part and one for each two parts, whose members
    meet only those of the other side.  Buckets come in rounds, few for a corpus of ``n_bytes``.
    """
    large = materialize(members.groupBy("block").agg(F.count("*").alias("k")).withColumn("c", F.ceil(F.col("k") / CELL_MEMBERS).cast("int")).filter("c > 1"))
    n_rows = members.count() + large.agg(F.coalesce(F.sum(F.col("k") * (F.col("c") - 1)), F.lit(0))).first()[0]
    n = max(shuffle_partitions(members.sparkSession), -(-n_rows // TILE_MEMBERS))
    rounds = max(1, -(-n_rows // max(LEAST_ROUND, n_bytes // MEMBER_BYTES)))
    lists = members.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("own_blocks"))
    signs = texts.groupBy("h").agg(*[F.min(c).alias(c) for c in ("size", *SIGNATURE)])
    own = ["h", "size", *SIGNATURE]
    whole = lists.join(signs, "h")
    if rounds > 1:
        whole = materialize(whole)
        tidy(members.sparkSession)
    rows = whole.select(*own, F.col("own_blocks.block").alias("blocks"), F.posexplode("own_blocks").alias("k", "m"))
    rows = rows.select(*own, F.slice("blocks", F.lit(1), F.col("k")).alias("earlier"), "m.block", "m.n")
    rows = rows.join(large.select("block", "c"), "block", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("h"), F.col("c")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cell = F.when(F.col("c") == 1, F.col("block")).otherwise(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    cells = cells.select(cell.alias("cell"), "n", side.alias("side"), "earlier", *own).withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(n)))
    for r in range(rounds):
        yield cells if rounds == 1 else cells.filter(F.col("bucket") % rounds == r)
    if rounds > 1:
        free(whole)


def member_texts(near: DataFrame, texts: DataFrame, n_bytes: int) -> Iterator[DataFrame]:
    """The members that stay, with texts and signatures, in buckets; these come in rounds as in ``dealt_members``."""
    n_rows = near.count()
    n = max(shuffle_partitions(near.sparkSession), -(-n_rows // TILE_MEMBERS))
    rounds = max(1, -(-n_rows // max(LEAST_ROUND, n_bytes // MEMBER_TEXT_BYTES)))
    near = near.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(n)))
    for r in range(rounds):
        some = near if rounds == 1 else near.filter(F.col("bucket") % rounds == r)
        needed = some.select("h").distinct()
        few = n_rows // rounds <= MAX_BROADCAST_ROWS // 2
        yield some.join(texts.join(F.broadcast(needed) if few else needed, "h", "left_semi").dropDuplicates(["h"]), "h")


def in_rounds(rounds: Iterator[DataFrame], step: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``step`` makes of each bucket, one round after the other; a round's exchange goes before the next."""
    parts = []
    for part in rounds:
        parts.append(materialize(part.groupBy("bucket").applyInArrow(step, schema)))
        tidy(part.sparkSession)
    return reduce(DataFrame.unionByName, parts)


def line_groups(lines: DataFrame, members: DataFrame, docs: DataFrame, n_bytes: int) -> DataFrame:
    """First occurrence of the group of every line that has another occurrence or a near copy: (h, doc_id, th, line)."""
    spark = docs.sparkSession
    needed = materialize(members.select("h").distinct())
    texts = line_texts(lines, needed, docs)
    free(needed)
    tidy(spark)
    near = in_rounds(dealt_members(members, texts, n_bytes), linked_members, "cell long, h long, n long, side int, earlier array<long>")
    links = in_rounds(member_texts(near, texts, n_bytes), block_links, "a long, b long")
    free(texts), free(near)
    whole = materialize(connected_components(links))
    place = F.struct("doc_id", "line", "th")
    first = lines.groupBy("h").agg(F.min(place).alias("p"), F.count("*").alias("n"))
    placed = materialize(first.join(whole, F.col("h") == F.col("node"), "left").select("h", "n", "component", "p").filter("n > 1 or component is not null"))
    least = placed.filter("component is not null").groupBy("component").agg(F.min("p").alias("first"))
    near = whole.join(least, "component").select(F.col("node").alias("h"), "first")
    same = placed.filter("component is null").select("h", F.col("p").alias("first"))
    found = materialize(near.unionByName(same).select("h", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), F.col("first.line").alias("line")))
    free(placed), free(whole), free(links)
    return found


def dedup_lines(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (and kept) of every row of ``docs (doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    docs = no_clash(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    some = docs.filter("doc_id is not null")
    spark = docs.sparkSession
    n_bytes = some.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    m = blocks_for(int(n_bytes) // LINE_BYTES)
    buckets = max(-(-shuffle_partitions(spark) // 4), -(-int(n_bytes) // (LINE_BYTES * BUCKET_LINES)))
    found = materialize(block_members(line_blocks(some, m, buckets), m, buckets))
    tidy(spark)
    lines, members = found.filter("block is null").select("doc_id", "th", "line", "h"), found.filter("block is not null").select("block", "h", "n")
    first = line_groups(lines, members, some, int(n_bytes)).withColumnsRenamed({"doc_id": "_d", "th": "_t", "line": "_l", "h": "_h"})
    tidy(spark)
    met = lines.join(first, F.col("h") == F.col("_h"))
    gone = met.filter((F.col("doc_id") != F.col("_d")) | (F.col("line") != F.col("_l")) | (F.col("th") != F.col("_t")))
    lists = materialize(gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone")))
    free(found), free(first)
    tidy(spark)
    schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for i, t, g in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept = t
            if g:
                out = set(g)
                kept = b"\n".join(p for k, p in enumerate(t.split(b"\n")) if k not in out)
            row = (i, t.count(b"\n") + 1, len(g or ()), hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode()) if keep_text else row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [f.split(" ")[0] for f in schema.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return arrow_map(docs.join(lists.hint("shuffle_hash"), ["doc_id", "th"], "left").select("doc_id", "text", "gone"), run, schema)


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents"))
