"""Operator 3: benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared as lower-case letters and digits with single spaces
between.  An item of ``m`` characters may be off by ``e = m / 10`` edits.  Where a text holds
it, at least ``m - q + 1 - q * e`` of its q-grams are shared, and they lie on diagonals (place
in the text less place in the item) no more than ``e`` apart.  So shared q-grams are counted
in diagonal bands of width ``2 (e + 1)`` that overlap by half; a region that meets the bound
is verified by alignment along its band.  ``q`` is 8, or so much less for a short item that the
bound is at least one; below 10 characters no edit is allowed, and ``q`` is at most the item's
length.  The filter loses nothing within the budget.

Items are a stated query set: they are taken in blocks of bounded size, each block is
indexed once and broadcast, and every document passes every block without moving.

Defined cases: null and empty texts match nothing; an item shorter than ``Q`` matches whole
words only; one with fewer than ``MIN_ITEM`` letters and digits is no evidence and matches
nothing, null items neither; repeated items are one row
each; an item found twice in a text gives a row each time, overlapping finds give the best;
repeated rows are judged alike; other columns pass through :func:`drop_contaminated`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import chunks, materialize, mix64, no_clash, read_table, text_buffer

Q = 8
MIN_ITEM = 4
EDIT_SHARE = 10  # one edit in so many characters
BLOCK_CHARS = 4_000_000
END = 0x110000
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point where it is one code point, and whether it is a letter, mark or digit."""
    if not _TABLES:
        lower = np.arange(END + 1, dtype=np.uint32)
        solid = np.zeros(END + 1, bool)
        for c in range(END):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LMN":
                solid[c] = True
                small = ch.lower()
                if len(small) == 1:
                    lower[c] = ord(small)
        solid[END] = True
        _TABLES[:] = [lower, solid]
    return _TABLES[0], _TABLES[1]


def normalise(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal characters of an array of code points, and where in it each stands; end marks stay."""
    lower, solid = _tables()
    keep = solid[codes]
    space = ~keep
    if len(codes):
        space[1:] &= keep[:-1]
    at = np.flatnonzero(keep | space)
    out = lower[codes[at]]
    out[space[at]] = 32
    return out, at


def gram_hashes(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at each place; for q = 8 from those of 2 and 4 characters."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    h = x.astype(np.uint64)
    if q == 8:
        for step, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            h = (h[:-step] * np.uint64(odd)) ^ ((h[step:] << np.uint64(21)) | (h[step:] >> np.uint64(43)))
        return mix64(h)
    out = np.zeros(len(x) - q + 1, np.uint64)
    for j in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mix64(out)


def budget_of(m: int) -> int:
    """Edits that an item of ``m`` characters may be off by."""
    return m // EDIT_SHARE


def gram_size(m: int) -> int:
    """The largest q up to ``Q`` whose bound on shared q-grams is at least one for an item of ``m`` characters."""
    return min(Q, m // (budget_of(m) + 1))


class Index:
    """q-grams of a block of items, one part for each q in use."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids: list[int] = []
        by_q: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            x, _ = normalise(codes)
            while len(x) and x[0] == 32:
                x = x[1:]
            while len(x) and x[-1] == 32:
                x = x[:-1]
            if len(x) >= MIN_ITEM:
                by_q.setdefault(gram_size(len(x)), []).append((len(self.ids), x))
                self.ids.append(item_id)
        self.parts = [_Part(q, own) for q, own in sorted(by_q.items())]

    def find(self, x: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first, last + 1, edits) of what the normal characters ``x`` hold.

        ``ends`` are the places of the end marks, one for each document.
        """
        return [hit for part in self.parts for hit in part.find(x, ends)]


class _Part:
    """Items whose q-grams have one size."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray]]) -> None:
        self.q, self.number, self.texts = q, [k for k, _ in items], [x for _, x in items]
        self.size = np.array([len(x) for x in self.texts], np.int64)
        self.edit = np.array([budget_of(len(x)) for x in self.texts], np.int64)
        self.need = self.size - q + 1 - q * self.edit
        grams = [gram_hashes(x, q) for x in self.texts]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.gram = flat[order]
        self.owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g), dtype=np.int64) for g in grams])[order]
        self.bits = max(16, min(26, int(len(flat) * 64).bit_length()))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[flat >> np.uint64(64 - self.bits)] = True

    def find(self, x: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """As :meth:`Index.find`, of the items of this part."""
        h = gram_hashes(x, self.q)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - self.bits)])
        lo = np.searchsorted(self.gram, h[at], "left")
        n = np.searchsorted(self.gram, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return []
        post = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        item = self.owner[post]
        diagonal = np.repeat(at, n) - self.place[post]
        step = self.edit[item] + 1
        wide = np.int64(len(x) + 2 * int(self.size.max()) + 4)
        offset = int(self.size.max()) + 1  # diagonals may be negative
        key = item * wide + (diagonal + offset) // step
        by = np.argsort(key, kind="stable")
        places = self.place[post][by]
        cell, first, count = np.unique(key[by], return_index=True, return_counts=True)
        nxt = np.zeros(len(cell), np.int64)
        pair = np.flatnonzero(cell[1:] == cell[:-1] + 1)
        nxt[pair] = count[pair + 1]
        hits = []
        # A band is a cell and the next one; one that begins before the first cell is covered by it alone.
        for c in np.flatnonzero(count + nxt >= self.need[cell // wide]).tolist():
            k = int(cell[c] // wide)
            # A gram of the item counts once, however often the band repeats it.
            if len(set(places[first[c] : first[c] + count[c] + nxt[c]].tolist())) >= self.need[k]:
                hits.append((k, int(cell[c] % wide) * int(self.edit[k] + 1) - offset))
        best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k, begin in hits:
            width = 2 * (int(self.edit[k]) + 1)
            # Edits ahead of the first shared gram or behind the last lead off the band.
            edit = int(self.edit[k])
            lo_, hi_ = max(begin - edit, 0), min(begin + width + int(self.size[k]) + edit, len(x))
            first, last = np.searchsorted(ends, lo_), np.searchsorted(ends, max(hi_ - 1, lo_))
            for d in range(int(first), min(int(last), len(ends) - 1) + 1):
                a = max(lo_, int(ends[d - 1]) + 1 if d else 0)
                b = min(hi_, int(ends[d]))
                if len(self.texts[k]) < Q:
                    found = whole_words(self.texts[k], x[a:b], x[a - 1] if a else END, x[b] if b < len(x) else END)
                else:
                    found = align(self.texts[k], x[a:b], begin - a, width, edit)
                if found is not None:
                    best.setdefault((d, k), []).append((a + found[0], a + found[1], found[2]))
        out = []
        for (d, k), spans in best.items():
            spans.sort(key=lambda s: (s[2], s[0]))
            kept: list[tuple[int, int, int]] = []
            for s in spans:
                if all(s[1] <= t[0] or s[0] >= t[1] for t in kept):
                    kept.append(s)
            out += [(d, self.number[k], *s) for s in kept]
        return out


def whole_words(item: np.ndarray, text: np.ndarray, before: int, after: int) -> tuple[int, int, int] | None:
    """Where ``text``, between the characters ``before`` and ``after``, holds ``item`` exactly as whole words."""
    framed = np.concatenate([[before], text, [after]])
    for at in range(len(text) - len(item) + 1):
        if framed[at] in (32, END) and framed[at + len(item) + 1] in (32, END) and (text[at : at + len(item)] == item).all():
            return at, at + len(item), 0
    return None


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """Where ``text`` holds ``item`` with at most ``budget`` edits: first, last + 1 and edits.

    Only diagonals ``first`` to ``first + width`` are followed, and so many more as edits lead
    off them.  An exact occurrence is looked for first.
    """
    exact = text.tobytes().find(item.tobytes())
    while exact >= 0 and exact % 4:
        exact = text.tobytes().find(item.tobytes(), exact + 1)
    if exact >= 0:
        return exact // 4, exact // 4 + len(item), 0
    if budget == 0 or not len(text):
        return None
    end = _banded(item, text, first - budget, width + 2 * budget, budget, True)
    if end is None:
        return None
    at, edits = end
    back = _banded(item[::-1], text[:at][::-1], -budget, 2 * budget + 1, budget, False)
    if back is None:
        return None
    return at - back[0], at, edits


def _banded(item: np.ndarray, text: np.ndarray, first: int, width: int, budget: int, free: bool) -> tuple[int, int] | None:
    """Least edits of the item against a piece of the text: where the piece ends, and the edits.

    The piece begins anywhere on the band if ``free``, else at the text's start.
    """
    k = np.arange(width, dtype=np.int64)
    place = first + k  # place in the text before the row's character
    row = np.zeros(width, np.int64) if free else np.abs(place)
    far = np.int64(1 << 30)
    row = np.where((place < 0) | (place > len(text)), far, row)
    padded = np.concatenate([text.astype(np.int64), [-1]])
    for i, c in enumerate(item.tolist()):
        at = place + i
        inside = (at >= 0) & (at < len(text))
        same = padded[np.where(inside, at, len(text))] == c
        step = np.where(inside, row + ~same, far)
        skip = np.append(row[1:], far) + 1  # the item's character is missing from the text
        # On the next row a diagonal's place is one further.
        best = np.minimum(step, skip)
        best = np.where((at + 1 < 0) | (at + 1 > len(text)), far, best)
        row = np.minimum.accumulate(best - k) + k
        if row.min() > budget:
            return None
    ends = place + len(item)
    row = np.where((ends < 0) | (ends > len(text)), far, row)
    j = int(row.argmin())
    return (int(ends[j]), int(row[j])) if row[j] <= budget else None


def scan(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """(row, item id, first, last + 1, edits) of a column of texts, in code points of the text."""
    buf, offsets = text_buffer(column)
    data = buf.tobytes()
    end = np.array([END], np.uint32)
    parts, sizes = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        codes = np.frombuffer(data[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        parts += [codes, end]
        sizes.append(len(codes) + 1)
    flat = np.concatenate(parts)
    x, at = normalise(flat)
    starts = np.cumsum(sizes) - sizes
    found = index.find(x, np.flatnonzero(x == END))
    return [(d, index.ids[k], int(at[a] - starts[d]), int(at[b - 1] + 1 - starts[d]), e) for d, k, a, b, e in found]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``block_chars`` characters, brought to the driver one block at a time."""
    some = no_clash(items, ["item_id", "text"]).filter("text is not null")
    total = some.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    if n > 1:
        some = materialize(some.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))))
    for k in range(n):
        part = some.filter(F.col("block") == k) if n > 1 else some
        yield sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), key=lambda r: (r[0] is None, r))


def find_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits: each passage of an item in each document, in characters.

    With more than one block of items, the passages of each are written before the next block
    is indexed, so that one index at a time is held.
    """
    found, last = None, None
    for block in item_blocks(items):
        if last is not None:
            found = materialize(found)
            last.unpersist()
        last = shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for lo, hi in chunks(batch, 1):
                    hits = scan(index, batch.column(1).slice(lo, hi - lo))
                    if hits:
                        rows, *rest = zip(*hits, strict=True)
                        ids = batch.column(0).slice(lo, hi - lo).take(pa.array(rows, pa.int64()))
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(r, pa.int64()) for r in rest)], ["doc_id", "item_id", "start", "end", "edits"])

        part = no_clash(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline form: the rows of ``docs`` that hold no item, in one pass without an exchange."""
    text = docs.columns.index("text")
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in chunks(batch, text):
                    part = batch.slice(lo, hi - lo)
                    keep = np.ones(hi - lo, bool)
                    keep[[h[0] for h in scan(shared.value, part.column(text))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, start, end, edits, one row per passage."""
    return find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
