"""Operator 13: byte-level BPE encoding by content-defined chunks, and decoding.

Texts are cut where a rolling hash of their last 32 bytes has its low bits clear, so that
copies of a passage are cut alike wherever they stand.  A chunk is encoded once for each
worker process that meets it; its ids and the places where a piece begins are kept under its
bytes.  A new chunk is cut into pieces as the library's splitter does, and the tokenizers
library encodes each different piece once; a chunk with a special string goes to it whole.

Chunk ends are not the library's piece ends, so each join is repaired.  A window of the text
from the last piece that the left chunk settles to a piece of the right chunk is encoded
again.  The two agree where a piece of the window, itself settled, begins at the same byte as
a piece of the right chunk: a splitter without memory goes on alike from there, and merges
never leave a piece.  A window that does not agree grows on the right, and swallows the
window before it on the left, until it agrees or ends with its text.

A piece is settled ``SETTLED`` bytes before the end of what was encoded: no rule of the
splitter looks further ahead, and no special string is longer.

Defined cases: null and empty texts have no ids and decode to the empty text; special strings
inside a text are their own ids, as the library does by default; repeated rows and ids each
return a row, and rows have no order that could tie; a text longer than ``CHUNK_BYTES`` is a
batch of its own and is encoded chunk by chunk, whole; an empty table returns no row; other
columns are not looked at.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import arrow_map, chunks, local_path, no_clash, read_table, text_buffer
from exceedra.llm.tokencount import byte_alphabet, equal_pieces, piece_starts

VOCABULARY = "byte_bpe_50k.json"
BATCH_BYTES = 1 << 20
LEAST, MEAN, MOST = 256, 1024, 8192
KEPT_BYTES = 96 << 20
MAX_PIECES = 400_000
SETTLED, AHEAD = 16, 32

_GEAR = np.random.default_rng(20260113).integers(0, 2**32, 256, dtype=np.uint32)


def rolling_hash(buf: np.ndarray) -> np.ndarray:
    """For each byte, a 32-bit hash of the 32 bytes that end there, by doubling the span."""
    h = _GEAR[buf]
    span = 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def cut_points(buf: np.ndarray, offsets: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Ends of all chunks of the texts, each text's end included.

    A cut falls between characters, at least ``LEAST`` bytes after the one before, so the
    hash at a cut never reaches into another text.
    """
    lead = (buf & 0xC0) != 0x80
    hits = np.flatnonzero((rolling_hash(buf)[:-1] & np.uint32(mean - 1)) == 0) + 1 if len(buf) else np.zeros(0, np.int64)
    hits = hits[lead[hits]]
    first = np.searchsorted(hits, offsets)
    out = []
    for k in range(len(offsets) - 1):
        at, end = int(offsets[k]), int(offsets[k + 1])
        if end == at:
            continue
        for h in hits[first[k] : first[k + 1]].tolist():
            while h - at > MOST:
                at += MOST
                while not lead[at]:
                    at += 1
                out.append(at)
            if h - at >= LEAST and end - h >= LEAST:
                out.append(h)
                at = h
        while end - at > MOST:
            at += MOST
            while at < end and not lead[at]:
                at += 1
            if at < end:
                out.append(at)
        out.append(end)
    return np.array(out, np.int64)


class Codec:
    """Encoder and decoder of one vocabulary, with the chunks that it has met."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed = json.loads(spec)
        to_byte = byte_alphabet()
        added = {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
        if any(len(x) > SETTLED for x in added.values()):
            raise ValueError("a special string is longer than the settled distance")
        vocabulary = parsed["model"]["vocab"]
        self.bytes_of = [b""] * (max([*vocabulary.values(), *added]) + 1)
        for token, k in vocabulary.items():
            self.bytes_of[k] = added[k] if k in added else bytes(to_byte[c] for c in token)
        for k, token in added.items():
            self.bytes_of[k] = token
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.special = list(added.values())
        self.mark_id = next(iter(added))
        self.forget_pieces()
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0
        self.encoded = 0  # bytes that the library has seen

    def library(self, parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each part, and which of them begin a piece."""
        out = []
        self.encoded += sum(map(len, parts))
        for e in self.tokenizer.encode_batch([p.decode("utf-8") for p in parts], add_special_tokens=False):
            piece = np.array(e.word_ids, np.int32)
            begins = np.ones(len(piece), bool)
            begins[1:] = piece[1:] != piece[:-1]
            out.append((np.array(e.ids, np.int32), begins))
        return out

    def forget_pieces(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.starts = array("i"), array("q", [0])

    def learn(self, pieces: list[bytes]) -> None:
        """Adds pieces: one call for all, with a special string between them, whose id parts them."""
        self.encoded += sum(map(len, pieces))
        mark = self.special[0]
        ids = np.array(self.tokenizer.encode_batch_fast([mark.join(pieces).decode("utf-8")], add_special_tokens=False)[0].ids, np.int32)
        own = ids != self.mark_id
        ends = np.append(np.cumsum(own)[~own], np.count_nonzero(own)) + self.starts[-1]
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        self.flat.frombytes(ids[own].tobytes())
        self.starts.frombytes(ends.astype(np.int64).tobytes())

    def by_pieces(self, parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of parts without special strings, each different piece by the library."""
        if not parts:
            return []
        if len(self.number) > MAX_PIECES:
            self.forget_pieces()
        data = b"".join(parts)
        buf = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        lead = np.flatnonzero((buf & 0xC0) != 0x80)  # the byte at which each character begins
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        stops = np.searchsorted(lead, ends)
        begins = piece_starts(np.insert(codes, stops, 0x110000))
        at = np.insert(lead, stops, ends)[begins]  # end marks begin a piece of no bytes
        keep = np.append(at[1:] != at[:-1], False) if len(at) else np.zeros(0, bool)
        lo, hi = at[keep], np.append(at[1:], len(buf))[keep]
        first, back = equal_pieces(buf, lo, hi)
        pieces = [data[a:b] for a, b in zip(lo[first].tolist(), hi[first].tolist(), strict=True)]
        known = self.number
        new = list(dict.fromkeys(p for p in pieces if p not in known))
        for lo_ in range(0, len(new), 4000):
            self.learn(new[lo_ : lo_ + 4000])
        place = np.frombuffer(self.starts, np.int64)
        which = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))[back]
        size = place[which + 1] - place[which]
        upto = np.cumsum(size)
        total = int(upto[-1])
        ids = np.frombuffer(self.flat, np.int32)[np.arange(total) - np.repeat(upto - size - place[which], size)]
        begins = np.zeros(total, bool)
        begins[upto - size] = True
        cut = np.append(0, upto)[np.searchsorted(lo, ends)].tolist()
        return [(ids[a:b].copy(), begins[a:b].copy()) for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def chunk_ids(self, parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same by chunk: each is encoded when it is first met."""
        new = list(dict.fromkeys(p for p in parts if p not in self.known))
        if self.held > KEPT_BYTES:
            self.known.clear()
            self.held = 0
            new = list(dict.fromkeys(parts))
        special = [p for p in new if any(x in p for x in self.special)]
        plain = [p for p in new if not any(x in p for x in self.special)] if special else new
        for p, found in [*zip(special, self.library(special), strict=True), *zip(plain, self.by_pieces(plain), strict=True)]:
            self.known[p] = found
            self.held += len(p) + 5 * len(found[0]) + 300
        return [self.known[p] for p in parts]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's first (n + 1 entries)."""
        cuts = cut_points(buf, offsets)
        if not len(cuts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        data = buf.tobytes()
        begins = np.concatenate([[0], cuts[:-1]]) if offsets[0] == 0 else np.concatenate([[offsets[0]], cuts[:-1]])
        parts = [data[a:b] for a, b in zip(begins.tolist(), cuts.tolist(), strict=True)]
        found = self.chunk_ids(parts)
        ids = np.concatenate([f[0] for f in found])
        flags = np.concatenate([f[1] for f in found])
        at = np.cumsum(self.length[ids])
        if at[-1] != len(buf):
            raise ValueError("ids do not cover the text")
        at -= self.length[ids]
        joins = cuts[~np.isin(cuts, offsets)]
        if len(joins):
            lo, hi, new_ids, new_at = self.repair(data, offsets, joins, at[flags])
            a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
            gone = np.zeros(len(at) + 1, np.int64)
            np.add.at(gone, a, 1)
            np.add.at(gone, b, -1)
            left = np.cumsum(gone[:-1]) == 0
            ids, at = ids[left], at[left]
            place = np.searchsorted(at, new_at)
            ids, at = np.insert(ids, place, new_ids), np.insert(at, place, new_at)
        return ids, np.searchsorted(at, offsets)

    def repair(self, data: bytes, offsets: np.ndarray, joins: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of bytes whose ids are replaced, and their ids with places.

        ``starts``: where pieces begin, chunk by chunk.  Every join's first window is encoded
        in one call; the texts in which one disagrees are gone through join by join.
        """
        is_start = np.zeros(len(data) + 1, bool)
        is_start[starts] = True
        is_start[offsets] = True
        starts = np.flatnonzero(is_start)
        doc = np.searchsorted(offsets, joins, side="right") - 1
        first, end = offsets[doc], offsets[doc + 1]
        lo = np.maximum(starts[np.maximum(np.searchsorted(starts, joins - SETTLED, side="right") - 1, 0)], first)
        hi = np.minimum(starts[np.minimum(np.searchsorted(starts, joins + AHEAD), len(starts) - 1)], end)
        found = self.library([data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        stop = np.array([self.agreement(f, a, e, b, z, is_start) for f, a, e, b, z in zip(found, lo.tolist(), joins.tolist(), hi.tolist(), end.tolist(), strict=True)], np.int64)
        bad = stop < 0
        bad[1:] |= (doc[1:] == doc[:-1]) & (lo[1:] < stop[:-1])
        odd = np.isin(doc, doc[bad])
        out = [(a, q, f) for a, q, f in zip(lo[~odd].tolist(), stop[~odd].tolist(), [found[k] for k in np.flatnonzero(~odd)], strict=True)]
        for d in np.unique(doc[bad]).tolist():
            out += self.repair_text(data, joins[doc == d].tolist(), int(offsets[d]), int(offsets[d + 1]), starts, is_start)
        out.sort(key=lambda x: x[0])
        ids, places = [], []
        for a, q, f in out:
            at = a + np.cumsum(self.length[f[0]]) - self.length[f[0]]
            ids.append(f[0][at < q])
            places.append(at[at < q])
        return np.array([x[0] for x in out]), np.array([x[1] for x in out]), np.concatenate(ids), np.concatenate(places)

    def agreement(self, found: tuple[np.ndarray, np.ndarray], lo: int, join: int, hi: int, end: int, is_start: np.ndarray) -> int:
        """Where a window's pieces meet the chunk's, behind the join; -1 if nowhere."""
        ids, begins = found
        at = lo + np.cumsum(self.length[ids])[:-1]
        at = at[begins[1:]]
        at = at[(at >= join) & (at <= hi - SETTLED)]
        met = at[is_start[at]]
        return int(met[0]) if len(met) else end if hi == end else -1

    def repair_text(self, data: bytes, joins: list[int], first: int, end: int, starts: np.ndarray, is_start: np.ndarray) -> list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]:
        """The windows of one text, each grown until it agrees."""
        out: list[tuple[int, int, tuple[np.ndarray, np.ndarray]]] = []
        for e in joins:
            if out and e < out[-1][1]:
                continue  # inside what the window before has replaced
            lo = max(int(starts[max(int(np.searchsorted(starts, e - SETTLED, side="right")) - 1, 0)]), first)
            while out and lo < out[-1][1]:
                lo = out.pop()[0]
            ahead, stop = AHEAD, -1
            while stop < 0:
                hi = min(int(starts[min(int(np.searchsorted(starts, e + ahead)), len(starts) - 1)]), end)
                window = self.library([data[lo:hi]])[0]
                stop = self.agreement(window, lo, e, hi, end, is_start)
                ahead *= 4
            out.append((lo, stop, window))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special ones included; bytes that are no character become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec_of(spec: str) -> Codec:
    """One codec per process and vocabulary."""
    key = hash(spec)
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``doc_id long, ids array<int>`` of ``docs (doc_id, text)``; with ``decoded`` also the text
    that the ids give back.  One narrow pass, nothing is shuffled."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for lo, hi in chunks(batch, 1, BATCH_BYTES):
            part = batch.slice(lo, hi - lo)
            ids, first = codec.encode(*text_buffer(part.column(1)))
            columns = [part.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                columns.append(pa.array([codec.decode(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return arrow_map(no_clash(docs, ["doc_id", "text"]), run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id long, text string`` of ``encoded (doc_id, ids)``; null ids give the empty text."""
    with open(path, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        texts = [codec.decode(np.array(x if x is not None else [], np.int64)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(no_clash(encoded, ["doc_id", "ids"]), run, "doc_id long, text string")


def op13_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode_documents(read_table(spark, sf_dir, "documents"), local_path(VOCABULARY), decoded=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


__all__ = ["Codec", "cut_points", "decode_documents", "encode_documents", "op13_bpe_chunks", "rolling_hash"]
