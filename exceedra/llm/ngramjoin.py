"""Operator 2: n-gram Jaccard join of documents, exact.

A document is the set of its distinct 5-word shingles; two link when 100 * intersection is at
least 80 * union.  Equal sets are one node, named by a 64-bit fingerprint, so thousands of
copies cost one entry.  Links are found in two passes:

1. Two quick turns tie each node to hubs, one and then six of the nodes that share one of its
   four smallest shingles.  They settle most groups of near copies with a number of pairs in line with the number of nodes.
2. The complete pass.  In any order of shingles, linked sets share one among the first fifth
   of the larger and the first ninth of the smaller.  Frequent shingles come last in the
   order, so the tiles that these prefixes make stay small.  A tile is one shingle with the
   sizes that can link: its members are sorted by size and each meets those up to 5/4 of its
   own.  Members that the quick turns already tied are not paired again.  The places of the
   shingle in both orders bound the overlap: where it is the first that two sets share, what
   stands before it on either side is not shared.  A pair that this bound lets go in a later
   tile has met the same bound, with smaller places, in its first one.  The tile of a shingle
   that is known to be in many documents is dealt over a triangle of cells, each for two
   parts of its members, so that no task holds it whole.

Each pair is bounded by bitmaps, in the tile where its shingle is known to be frequent and
beside the pair else: every shingle flips one bit of about twice as many as
the set has shingles, and the number of bits in which two bitmaps differ (the longer one
folded to the other's length) is a lower bound of the difference of the sets, hence an upper
bound of the overlap.  Pairs that pass are counted on the sorted arrays.  Components of the
links give each document the smallest reachable id.

Defined cases: a text without words, or null, has size 0, links with nothing and is its own
component; a shorter text than five words is one shingle; repeated rows and equal texts share
a component; rows with a null id share the component of equal texts and count for no
component's smallest id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import arrow_map, chunks, connected_components, free_prefix, materialize, mix64, no_clash, read_table, shingle_sets, shuffle_partitions, span_hashes, text_buffer, tidy, word_spans

WORDS = 5
LEAD = 4
HUBS = 6
COUNT_TOKENS = 1_000_000  # shingles counted at once when frequent ones are looked for
LOCAL_COUNT = 4
FREQUENT = 32  # documents
MAX_FREQUENT = 2_000_000  # shingles broadcast; beyond it the rarer of them keep their places in the order
MAX_BROADCAST_ROWS = 2_000_000
BUCKET_POSTINGS = 500_000
CELL_MEMBERS = 20_000  # of a tile, before it is dealt over cells


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """Sorted shingle hashes of each text of a column."""
    buf, offsets = text_buffer(column)
    s, e, first = word_spans(buf, offsets)
    return shingle_sets(span_hashes(buf, s, e, lower=True), first, WORDS)


def fingerprint(shingles: np.ndarray) -> int:
    """Name of a set; a set and its size make it."""
    return int((mix64(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))).view(np.int64)) if len(shingles) else 0


def signature_bits(n: int) -> int:
    """A power of two near twice the number of shingles, at least 64."""
    return max(64, 2 << round(float(np.log2(n))))


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the shingles over ``signature_bits`` bits."""
    bits = signature_bits(len(shingles))
    flips = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Bits in which two signatures differ, the longer folded onto the shorter."""
    if len(x) < len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), 0)
    return int(np.bitwise_count(a ^ b).sum())


def _frequent_here(sets: list[np.ndarray]) -> tuple[bytes, bytes]:
    v, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keep = c >= LOCAL_COUNT
    return v[keep].tobytes(), c[keep].astype(np.int64).tobytes()


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, th, n, fp, lead, sig of every row of ``docs (doc_id, text, th)``, and rows without n that carry frequent shingles."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        tokens = 0
        names = ["doc_id", "th", "n", "fp", "lead", "sig", "often", "times"]

        def counted() -> pa.RecordBatch:
            often, times = _frequent_here(list(held.values()))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())), pa.array([often], pa.binary()), pa.array([times], pa.binary())], names
            )

        for lo, hi in chunks(batch, 1):
            sets = sets_of(batch.column(1).slice(lo, hi - lo))
            fps = [fingerprint(s) for s in sets]
            for f, s in zip(fps, sets, strict=True):
                if len(s) and f not in held:
                    held[f] = s
                    tokens += len(s)
            nothing = pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    batch.column(2).slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(fps, pa.int64()),
                    pa.array([s[:LEAD].view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    nothing,
                    nothing,
                ],
                names,
            )
            if tokens > COUNT_TOKENS:
                yield counted()
                tokens = 0
        if held:
            yield counted()

    return arrow_map(docs, run, "doc_id long, th long, n int, fp long, lead array<long>, sig binary, often binary, times binary")


def frequent_shingles(meta: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in many documents, the most frequent last, at most ``MAX_FREQUENT``, and their counts.

    Every batch of documents reports what it saw four times.  Which shingles are known here
    sets the order and so the size of tiles, never the pairs that link.
    """

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for often, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(often, np.int64)), pa.array(np.frombuffer(times, np.int64))], ["s", "c"])

    rows = arrow_map(meta.filter("often is not null").select("often", "times"), spread, "s long, c long")
    often = rows.groupBy("s").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT)
    got = often.orderBy(F.desc("c"), "s").limit(MAX_FREQUENT).toArrow()
    return got.column("s").to_numpy().view(np.uint64)[::-1].copy(), got.column("c").to_numpy()[::-1].copy()


def quick_pairs(nodes: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Pairs of a node and the hub of one of its smallest shingles, where nothing ties them yet.

    A shingle has one hub in the first turn and ``HUBS`` others in the second.
    """
    named = nodes.select("fp", "n", "lead")
    if labels is None:
        named = named.withColumn("component", F.col("fp"))
    else:
        named = named.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    post = materialize(named.select("fp", "n", "component", F.explode("lead").alias("s")))
    member = lambda k: F.min(F.struct(F.xxhash64("fp", "s", F.lit(k)), "fp", "n", "component"))
    some = F.array(*[member(k) for k in range(HUBS)]) if turn else F.array(member(-1))
    hubs = post.groupBy("s").agg(some.alias("h"), F.count("*").alias("c")).filter("c > 1").select("s", F.explode(F.array_distinct("h")).alias("h"))
    hubs = materialize(hubs.select("s", F.col("h.fp").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.component").alias("hub_component")))
    met = post.join(hubs, "s").filter(F.col("component") != F.col("hub_component")).filter(can_link(F.col("n"), F.col("hub_n")))
    return met.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def can_link(n, m):
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def prefixes(docs: DataFrame, labels: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Packed prefixes: a row for each batch of documents and bucket of shingles that it has."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)
    few = labels.count() <= MAX_BROADCAST_ROWS
    joined = docs.join(F.broadcast(labels) if few else labels, "doc_id", "left").select("text", "fp", "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.argsort(shared.value[0], kind="stable")  # place in the order of frequency
        values = shared.value[0][rank]
        cells = -(-shared.value[1][rank] // CELL_MEMBERS)  # parts that a tile is dealt into
        seen: set[int] = set()
        for batch in batches:
            toks, place, docs_, fps, ns, labels_, sigs = [], [], [], [], [], [], []
            for lo, hi in chunks(batch, 0):
                sets = sets_of(batch.column(0).slice(lo, hi - lo))
                named = batch.column(1).slice(lo, hi - lo).to_pylist()
                label = batch.column(2).slice(lo, hi - lo).to_pylist()
                for s, f, c in zip(sets, named, label, strict=True):
                    n = len(s)
                    fp = fingerprint(s)
                    if not n or fp in seen:
                        continue
                    seen.add(fp)
                    length = n - -(-4 * n // 5) + 1
                    sig = b""
                    if len(values):
                        at = np.searchsorted(values, s)
                        at[at == len(values)] = 0
                        often = values[at] == s
                        if int((~often).sum()) < length:  # frequent shingles in the prefix: large tiles
                            sig = signature(s)
                        if often[:length].any():
                            s = np.concatenate([s[~often], s[often][np.argsort(rank[at[often]])]])
                    toks.append(s[:length])
                    place.append(np.arange(length, dtype=np.uint32))
                    docs_.append(np.full(length, len(fps), np.int32))
                    fps.append(fp)
                    ns.append(n)
                    sigs.append(sig)
                    labels_.append(c if c is not None and f == fp else fp)
            if len(seen) > 100_000:
                seen.clear()
            if not fps:
                continue
            tok, at_, doc = np.concatenate(toks), np.concatenate(place), np.concatenate(docs_)
            fps_, ns_, comps = np.array(fps, np.int64), np.array(ns, np.int32), np.array(labels_, np.int64)
            side = np.zeros(len(tok), np.uint8)
            if len(values) and cells.max() > 1:
                tok, at_, doc, side = dealt_over_cells(tok, at_, doc, fps_, values, cells)
            bucket = (tok % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            held, starts = np.unique(bucket[order], return_index=True)
            sig_of = np.array(sigs, object)
            out: list[list] = [[] for _ in range(9)]
            for b, k in zip(held.tolist(), np.split(order, starts[1:]), strict=True):
                who, local = np.unique(doc[k], return_inverse=True)
                parts = (tok[k], at_[k], side[k], local.astype(np.int32), fps_[who], ns_[who], comps[who])
                often = np.zeros(len(who), bool)
                if len(values):
                    near = np.searchsorted(values, tok[k])
                    near[near == len(values)] = 0
                    often[local[(values[near] == tok[k]) | (side[k] > 0)]] = True
                carried = b"".join(sig_of[w] if f else b"" for w, f in zip(who.tolist(), often.tolist(), strict=True))
                sized = np.where(often & np.array([bool(sig_of[w]) for w in who.tolist()]), ns_[who], -ns_[who])
                parts = (*parts[:5], sized.astype(np.int32), parts[6])
                for column, v in zip(out, (b, *(x.tobytes() for x in parts), carried), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", *_PACKED])

    return joined.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED))


def dealt_over_cells(tok: np.ndarray, place: np.ndarray, doc: np.ndarray, fps: np.ndarray, values: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """Postings with those of large tiles copied to their cells, under a name for each cell.

    A tile of ``c`` parts has a cell for each part (side 0) and one for each two parts (side 1
    and 2), whose members meet only those of the other side.  A member is in ``c`` cells.
    """
    at = np.searchsorted(values, tok)
    at[at == len(values)] = 0
    large = np.flatnonzero((values[at] == tok) & (cells[at] > 1))
    small = np.ones(len(tok), bool)
    small[large] = False
    c = cells[at[large]]
    part = (mix64(fps[doc[large]].view(np.uint64)) % c.astype(np.uint64)).astype(np.int64)
    copy = np.repeat(large, c)
    own, other = np.repeat(part, c), np.arange(len(copy)) - np.repeat(np.cumsum(c) - c, c)
    low, high = np.minimum(own, other), np.maximum(own, other)
    name = mix64(tok[copy] ^ mix64((low << 32 | high).astype(np.uint64)))
    side = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)
    return np.concatenate([tok[small], name]), np.concatenate([place[small], place[copy]]), np.concatenate([doc[small], doc[copy]]), np.concatenate([np.zeros(int(small.sum()), np.uint8), side])


# ``ns`` is negative where a document's signature is not in ``sigs``.
_PACKED = ("tok", "place", "side", "doc", "fps", "ns", "comps", "sigs")
_KINDS = (np.uint64, np.uint32, np.uint8, np.int32, np.int64, np.int32, np.int64, np.uint64)


def may_link(words: np.ndarray, at_one: np.ndarray, at_two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """False where the signatures of both, of one width, leave no room for a link."""
    out = np.ones(len(at_one), bool)
    both = np.flatnonzero((at_one >= 0) & (at_two >= 0))
    if not len(both):
        return out
    bits = np.maximum(64, 2 << np.round(np.log2(np.stack([n_one[both], n_two[both]]))).astype(np.int64))
    for w in np.unique(bits[0]).tolist():
        same = both[(bits[0] == w) & (bits[1] == w)]
        span = np.arange(w // 64)
        for a in range(0, len(same), 20_000):
            i = same[a : a + 20_000]
            differ = np.bitwise_count(words[at_one[i, None] + span] ^ words[at_two[i, None] + span]).sum(1, dtype=np.int64)
            out[i] = 9 * differ <= n_one[i] + n_two[i]
    return out


def tile_pairs(table: pa.Table) -> pa.Table:
    """Candidate pairs of one bucket of packed prefixes, within the bounds by sizes and places."""
    parts: list[list[np.ndarray]] = [[] for _ in range(8)]
    words = 0
    for row in zip(*(table.column(c).to_pylist() for c in _PACKED), strict=True):
        tok, place, side, doc, fps, ns, comps, sigs = (np.frombuffer(v, k) for v, k in zip(row, _KINDS, strict=True))
        wide = np.array([signature_bits(n) // 64 if n > 0 else 0 for n in ns.tolist()], np.int64)
        at = words + np.cumsum(wide) - wide
        words += len(sigs)
        for p, v in zip(parts, (tok, place, side, fps[doc], np.abs(ns)[doc], comps[doc], np.where(wide > 0, at, -1)[doc], sigs), strict=True):
            p.append(v)
    tok, place, side, fp, n, comp, sig_at, sig_words = (np.concatenate(p) for p in parts)
    order = np.lexsort((fp, n, tok))
    keep = np.ones(len(tok), bool)
    keep[1:] = (tok[order[1:]] != tok[order[:-1]]) | (fp[order[1:]] != fp[order[:-1]])
    order = order[keep]
    starts = np.flatnonzero(np.r_[True, tok[order[1:]] != tok[order[:-1]]])
    mixed = np.minimum.reduceat(comp[order], starts) != np.maximum.reduceat(comp[order], starts)
    order = order[np.repeat(mixed, np.diff(np.append(starts, len(order))))]
    tok, place, side, fp, n, comp = tok[order], place[order].astype(np.int64), side[order], fp[order], n[order].astype(np.int64), comp[order]
    sig_at = sig_at[order]
    ahead = n - place  # shingles from here on
    found = [np.zeros((0, 2), np.int64)]
    waiting = 0
    left = np.arange(len(tok))
    d = 1
    while len(left):
        left = left[left + d < len(tok)]
        right = left + d
        ok = (tok[left] == tok[right]) & (n[left] * 5 >= n[right] * 4)
        left, right = left[ok], right[ok]
        new = (comp[left] != comp[right]) & ((side[left] != side[right]) | (side[left] == 0))
        new &= 9 * np.minimum(ahead[left], ahead[right]) >= 4 * (n[left] + n[right])
        one, two = left[new], right[new]
        fits = may_link(sig_words, sig_at[one], sig_at[two], n[one], n[two])
        a, b = fp[one[fits]], fp[two[fits]]
        if len(a):
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            waiting += len(a)
            if waiting > 1_000_000:
                found, waiting = [np.unique(np.concatenate(found), axis=0)], 0
        d += 1
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose bitmaps leave room for a link."""
    one = nodes.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = nodes.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        one, two = batch.column(3), batch.column(5)
        wide = np.asarray(pa.compute.binary_length(one))
        same = wide == np.asarray(pa.compute.binary_length(two))
        differ = np.zeros(batch.num_rows, np.int64)
        for w in np.unique(wide[same]).tolist():
            at = np.flatnonzero(same & (wide == w))
            x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1) for c in (one, two))
            differ[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        for i in np.flatnonzero(~same).tolist():
            differ[i] = least_difference(one[i].as_py(), two[i].as_py())
        size = batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
        keep = pa.array(9 * differ <= size)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    met = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "sa", "nb", "sb")
    return arrow_map(met, run, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that link, counted on the sorted arrays of both."""
    pairs = materialize(bounded(pairs, nodes))
    tidy(docs.sparkSession)
    ids = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    needed = materialize(nodes.join(ids, "fp", "left_semi").select("doc_id", "fp"))
    few = needed.count() <= MAX_BROADCAST_ROWS
    texts = docs.join(F.broadcast(needed) if few else needed, "doc_id").select("fp", "text")

    def arrays(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in chunks(batch, 1):
            sets = sets_of(batch.column(1).slice(lo, hi - lo))
            named = batch.column(0).slice(lo, hi - lo).to_pylist()
            own = [(f, s.tobytes()) for f, s in zip(named, sets, strict=True) if fingerprint(s) == f]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], ["fp", "s"])

    sets = materialize(arrow_map(texts, arrays, "fp long, s binary"), "none")

    def exact(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        flags = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(flags), batch.column(1).filter(flags)], ["a", "b"])

    one, two = sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), sets.select(F.col("fp").alias("b"), F.col("s").alias("y"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return materialize(arrow_map(met, exact, "a long, b long").distinct())


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (fp, component) of known components and new links."""
    if labels is not None:
        links = links.unionByName(labels.filter("fp <> component").select(F.col("fp").alias("a"), F.col("component").alias("b")))
    return materialize(connected_components(links).withColumnRenamed("node", "fp"))


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, th, n, fp) of ``docs (doc_id, text)``, nodes (fp, doc_id) and components (fp, component) of linked nodes."""
    spark = docs.sparkSession
    docs = no_clash(docs, ["doc_id", "text"]).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    meta = materialize(describe(docs))
    own = meta.filter("n is not null").select("doc_id", "th", "n", "fp", "lead", "sig")
    first = own.filter("n > 0").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n", "lead", "sig")).alias("r"))
    nodes = materialize(first.select("fp", "r.doc_id", "r.n", "r.lead", "r.sig"))
    shingles = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    known = nodes.filter("doc_id is not null")
    labels = None
    for turn in range(2):
        labels = joined(labels, verified(quick_pairs(known, labels, turn), known, docs))
    by_doc = materialize(own.select("doc_id", "fp").join(labels, "fp"))
    tidy(spark)

    buckets = max(shuffle_partitions(spark), -(-int(shingles) // (5 * BUCKET_POSTINGS)))
    packed = prefixes(docs, by_doc, frequent_shingles(meta), buckets)
    tiles = materialize(packed.groupBy("bucket").applyInArrow(tile_pairs, "a long, b long"))
    tidy(spark)
    more = verified(tiles.distinct(), known, docs)
    return own.select("doc_id", "th", "n", "fp"), nodes.select("fp", "doc_id"), joined(labels, more)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs (doc_id, text)``."""
    own, nodes, whole = linked_sets(docs)
    least = whole.join(nodes, "fp").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_linked = whole.join(least, "component").select("fp", "component_id")
    alone = nodes.join(whole, "fp", "left_anti").select("fp", F.col("doc_id").alias("component_id"))
    ids = materialize(of_linked.unionByName(alone))
    out = own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "fp").join(ids, "fp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """Pipeline form: of each component one row, the one with the smallest id.

    Rows with a null id come after all others; among rows of one id the smallest hash of the
    text decides, and of rows equal in id and text any one stays.  Texts without words stay,
    all of them.  Other columns pass through, whatever their names.
    """
    own, _, whole = linked_sets(docs)
    named = own.filter("n > 0").join(whole, "fp", "left").select(F.coalesce("component", "fp").alias("c"), F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th").alias("k"))
    groups = materialize(named.groupBy("c", "k").count())
    first = groups.groupBy("c").agg(F.min("k").alias("f"))
    judged = materialize(groups.join(first, "c").select("k", (F.col("k") == F.col("f")).alias("stays"), "count"))
    x = free_prefix(docs)
    key = [F.col("k.doc_id").alias(f"{x}id"), F.col("k.th").alias(f"{x}th")]
    gone, again = judged.filter("not stays").select(*key), judged.filter("stays and count > 1").select(*key)
    of_text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].eqNullSafe(F.col(f"{x}id")) & (of_text == F.col(f"{x}th"))
    kept = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept
    repeated = docs.join(again, same, "left_semi").withColumn(f"{x}th", of_text).dropDuplicates(["doc_id", f"{x}th"]).drop(f"{x}th")
    return kept.join(again, same, "left_anti").unionByName(repeated)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS pos FROM w WHERE len(words) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
"""
