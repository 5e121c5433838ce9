"""Operator 4: token ids in files of fixed-width packed integers.

The file format, one file per range of documents, little-endian throughout:

==========  =====================================================================
bytes       content
==========  =====================================================================
0-7         magic ``PKIDS001``
8-11        uint32 bits per id, the fewest that hold the vocabulary's largest id
12-15       uint32 ids per block
16-23       uint64 number of ids
24-31       uint64 number of documents
then        int64 per document: its id; uint32 per document: its ids with the end id
then        uint64 per block, and one more: offset of the block's first byte in the file
then        the blocks, each padded to a whole byte
==========  =====================================================================

Blocks are found by their offsets, so any id is read without unpacking more than a block.
Files travel as rows ``(part, number, before, n_ids, file)`` through Spark's own writers: their
commit protocol survives lost executors, and any store that Spark writes to will do.
:func:`export_files` puts the same bytes into plain files.

Ids come from the tokenizers library.  Its splitter drops white space and no rule looks
across it, so the library encodes each distinct run of other characters once and the ids of
a text are those of its runs in order.

Defined cases: null and empty texts are a lone end id; repeated rows and ids each have
their own entry; a null id sorts first and is stored as the least int64; rows that tie in id
are ordered by their text; a text of any length is encoded whole, above ``CHUNK_BYTES`` in a
batch of its own; an empty table gives no file; other columns are not looked at.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import _IS_BLANK, chunks, local_path, materialize, no_clash, read_table, shuffle_partitions, text_buffer, word_spans

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 4096
FILE_IDS = 2_000_000
MAX_RUNS = 1_200_000
STOPS = b".,;:!?"
MAGIC = b"PKIDS001"
NULL_ID = -(2**63)


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids as a little-endian stream of ``bits`` bits each, padded to a whole byte."""
    if bits == 16:
        return ids.astype("<u2").view(np.uint8)
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little")


def unpack(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed stream."""
    if bits == 16:
        return data[: 2 * n].view("<u2").astype(np.uint32)
    flags = np.unpackbits(data, count=n * bits, bitorder="little").reshape(n, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_file(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    head = MAGIC + np.array([bits, block], "<u4").tobytes() + np.array([len(ids), len(doc_ids)], "<u8").tobytes()
    head += doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes()
    first = len(head) + 8 * (len(blocks) + 1)
    offsets = first + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    return b"".join([head, offsets.astype("<u8").tobytes(), *(b.tobytes() for b in blocks)])


class PackedFile:
    """Reader of one file's bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.raw = np.frombuffer(data, np.uint8)
        self.bits, self.block = (int(x) for x in self.raw[8:16].view("<u4"))
        self.n_ids, self.n_docs = (int(x) for x in self.raw[16:32].view("<u8"))
        at = 32 + 8 * self.n_docs
        self.doc_ids = self.raw[32:at].copy().view("<i8")
        self.sizes = self.raw[at : at + 4 * self.n_docs].copy().view("<u4").astype(np.int64)
        at += 4 * self.n_docs
        self.offsets = self.raw[at : at + 8 * (-(-self.n_ids // self.block) + 1)].copy().view("<u8").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi``: only the blocks that hold them are unpacked."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        out = [
            unpack(self.raw[self.offsets[b] : self.offsets[b + 1]].copy(), min(self.block, self.n_ids - b * self.block), self.bits)
            for b in range(first, last + 1)
        ]
        return np.concatenate(out)[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """Encodes texts by their distinct runs between ASCII blanks."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        special = parsed["added_tokens"][0]
        self.mark = special["content"], special["id"]
        suffix = parsed["model"]["end_of_word_suffix"]
        vocabulary = parsed["model"]["vocab"]
        self.last = np.zeros(max(*vocabulary.values(), special["id"]) + 1, bool)
        self.last[[k for piece, k in vocabulary.items() if piece.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = array("I")
        self.starts = array("q", [0])

    def simple(self, run: bytes) -> tuple[bytes, bytes]:
        """A run as a word in lower case and the stops after it, where they are encoded apart.

        The splitter ends a piece between a letter and a stop, and lower-cases all but its
        special strings, which contain ``<``.
        """
        if b"<" in run:
            return run, b""
        word = run.rstrip(STOPS)
        if len(word) < len(run) and word[-1:].isalpha():
            return word.lower(), run[len(word) :]
        return run.lower(), b""

    def learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Adds words of letters alone by the library and returns the others.

        Such a word is one piece, and the last id of a piece ends a word in the vocabulary, so
        words go parted by spaces.  Where there are not as many ends as words nothing is added.
        """
        texts = b"\n".join(words).decode("utf-8").split("\n") if words else []
        plain = [t.isalpha() for t in texts]
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        words, texts = list(compress(words, plain)), list(compress(texts, plain))
        lines = [" ".join(texts[lo : lo + 200]) for lo in range(0, len(texts), 200)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        for lo, found in zip(range(0, len(words), 200), ids, strict=True):
            part = words[lo : lo + 200]
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(part) and ends[-1] == len(found):
                self.add_all(part, found, ends)
            else:
                rest += part
        return rest

    def learn_plain(self, runs: list[bytes]) -> None:
        """Adds runs by the library: many at once, parted by a special string and cut at its id."""
        mark, mark_id = self.mark
        plain = self.learn_letters([r for r in runs if b"<" not in r])
        for lo in range(0, len(plain), 4000):
            part = plain[lo : lo + 4000]
            ids = np.array(self.tokenizer.encode(mark.join([r.decode("utf-8") for r in part]), add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(ids == mark_id)
            self.add_all(part, ids[ids != mark_id], np.append(marks - np.arange(len(marks)), len(ids) - len(marks)))
        for r in runs:
            if b"<" in r:
                self.add(r, self.tokenizer.encode(r.decode("utf-8"), add_special_tokens=False).ids)

    def learn(self, runs: list[bytes]) -> None:
        """Adds runs that are not known yet."""
        known = self.number
        parts = [self.simple(r) for r in runs]
        self.learn_plain(list({x for p in parts for x in p if x and x not in known}))
        flat, starts = self.flat, self.starts
        for run, (word, stops) in zip(runs, parts, strict=True):
            if run not in known:
                k = known[word]
                known[run] = len(known)
                flat.extend(flat[starts[k] : starts[k + 1]])
                if stops:
                    k = known[stops]
                    flat.extend(flat[starts[k] : starts[k + 1]])
                starts.append(len(flat))

    def add_all(self, runs: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        """Adds runs whose ids lie end to end."""
        self.number.update(zip(runs, range(len(self.number), len(self.number) + len(runs)), strict=True))
        self.starts.frombytes((ends + self.starts[-1]).astype(np.int64).tobytes())
        self.flat.frombytes(ids.tobytes())

    def add(self, run: bytes, ids) -> None:
        self.number[run] = len(self.number)
        self.flat.extend(ids)
        self.starts.append(len(self.flat))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and how many each has."""
        return self.encode_buffer(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    def encode_buffer(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that lie end to end; each distinct run of a call is looked up once."""
        if len(self.number) > MAX_RUNS:
            self.clear()
        s, e, first = word_spans(buf, offsets)
        ends = np.concatenate([[0], np.cumsum(e - s)]).astype(np.int32)
        data = buf[~_IS_BLANK[buf]]
        coded = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        runs = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.number
        numbers = list(map(known.get, runs))
        new = [r for r, k in zip(runs, numbers, strict=True) if k is None]
        if new:
            self.learn(new)
            numbers = [known[r] if k is None else k for r, k in zip(runs, numbers, strict=True)]
        starts = np.frombuffer(self.starts, np.int64)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        which = np.array(numbers, np.int64)[coded.indices.to_numpy()]
        n_texts = len(offsets) - 1
        size = starts[which + 1] - starts[which]
        owner = np.repeat(np.arange(n_texts), np.diff(first))
        per_doc = np.bincount(owner, weights=size, minlength=n_texts).astype(np.int64) + 1
        ends = np.cumsum(per_doc)
        out = np.full(int(ends[-1]) if len(ends) else 0, END_ID, np.uint32)
        total = int(size.sum())
        if total:
            local = np.arange(total) - np.repeat(np.cumsum(size) - size - starts[which], size)
            place = np.arange(total) + np.repeat(owner, size)  # one end id for each document before
            out[place] = flat[local]
        return out, per_doc


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def vocabulary_bits(spec: str) -> int:
    parsed = json.loads(spec)
    largest = max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"]), END_ID])
    return max(int(largest).bit_length(), 1)


def encode_files(docs: DataFrame, path: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Files of packed ids: rows (part int, number int, before long, n_ids long, file binary),
    ``before`` being the ids of earlier files of the part.

    Documents are range-partitioned by id and sorted, so parts and numbers are in order; a
    file closes once it has ``file_ids`` ids, and a task holds one file at a time.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    bits = vocabulary_bits(spec)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    ordered = no_clash(docs, ["doc_id", "text"]).repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = encoder_of(shared.value)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = before = 0

        def close() -> pa.RecordBatch:
            docs_, sizes, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
            data = write_file(docs_, sizes, ids, bits)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before]), pa.array([len(ids)]), pa.array([data], pa.binary())],
                ["part", "number", "before", "n_ids", "file"],
            )

        for batch in batches:
            for lo, hi in chunks(batch, 1):
                rows = batch.slice(lo, hi - lo)
                buf, offsets = text_buffer(rows.column(1))
                ids, sizes = encoder.encode_buffer(buf, offsets)
                held.append((rows.column(0).fill_null(NULL_ID).to_numpy(), sizes, ids))
                n += len(ids)
                if n >= file_ids:
                    yield close()
                    number, before, n = number + 1, before + n, 0
        if held:
            yield close()

    return ordered.mapInArrow(run, "part int, number int, before long, n_ids long, file binary")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    ``start`` needs the totals of earlier parts: one row per partition of the writing job.
    """
    before, at = {}, 0
    for r in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        before[r["part"]] = at
        at += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, earlier, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                f = PackedFile(data)
                start = before[part] + earlier + f.starts[:-1]
                flat = f.ids(0, f.n_ids).astype("<u4")
                crc = [zlib.crc32(flat[a:b].data) for a, b in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True)]
                ids = pa.array(f.doc_ids, mask=f.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(f.sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "before", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_files(files: DataFrame, folder: str) -> None:
    """The same files as plain ones, written by the executors below a folder that all share."""

    def put(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for r in rows:
            name = f"{base}/ids-{r['part']:06d}-{r['number']:04d}.bin"
            with store.open_output_stream(name + ".new") as out:
                out.write(r["file"])
            store.move(name + ".new", name)

    files.select("part", "number", "file").foreachPartition(put)


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = encode_files(read_table(spark, sf_dir, "documents"), local_path(VOCABULARY))
    return read_files(materialize(files, "none"))


__all__ = ["Encoder", "PackedFile", "encode_files", "export_files", "op4_packed_ids", "pack", "read_files", "unpack", "write_file"]
