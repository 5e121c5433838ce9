"""Operator 11: phrases that occur together, by Toivonen mining.

1.  A sample of the documents, one in ``SAMPLE`` by a hash of the id, counts all its phrases
    and proposes those above a lowered count.  Proposals only steer: whatever the sample
    misses is found below, so every result is exact.
2.  A pass over all documents bounds the counts of the proposals and of their negative
    border: every phrase whose first and last k - 1 words are both proposals (each single
    word, for k = 1).  It adds up 64-bit hashes, so a sum is never below a phrase's count.
3.  A phrase of the border whose bound is high enough is a failure: longer phrases over it
    were not counted.  A second pass counts exactly, by the phrases themselves, all whose
    bound is high enough and, where there are failures, every phrase that the first pass left
    out and no part of which is known to be rare.  What it counts is closed: a frequent
    phrase has only frequent parts, so one that neither pass met would have a rare part.

Proposals and frequent phrases reach the tasks as a Bloom filter of ``BLOOM_BITS`` bits,
whatever the corpus: a false member makes a task count a phrase too many, never too few.
Counts are added inside a task first and then by Spark; no hash decides a count.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows
and ids count each; equal scores rank by frequency and then by the bytes of the phrase; a
text longer than ``CHUNK_BYTES`` is counted alone and whole; an empty table gives no row;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exceedra.llm.common import arrow_map, chunks, materialize, mix64, no_clash, read_table, span_hashes, text_buffer

LONGEST = 5
LEAST_COUNT = 100
SAMPLE = 32
LOWERED = 0.6
BLOOM_BITS = 1 << 27
TOP = 2000
CHUNK_BYTES = 2 << 20
ROWS = 100_000

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)  # 0 within a word, 1 between words, 2 between pieces
_KIND[list(b"\x20\x09")] = 1
_KIND[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9] = 32
_FOLD = np.uint64(0xD6E8FEB86659FD93)


class Bloom:
    """A set of 64-bit hashes without false absences, two bits each."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells
        self.mask = np.uint64(len(cells) * 64 - 1)

    @staticmethod
    def places(h: np.ndarray, bits: int) -> np.ndarray:
        return np.concatenate([h, h >> np.uint64(32)]) & np.uint64(bits - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            out &= ((self.cells[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def gather_bloom(hashes: DataFrame, bits: int) -> np.ndarray:
    """Cells of the filter over ``hashes (h long)``; at most ``bits / 64`` rows reach the driver."""

    def cells(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = np.unique(Bloom.places(batch.column(0).to_numpy().view(np.uint64), bits))
        cell, first = np.unique(at >> np.uint64(6), return_index=True)
        word = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(word.view(np.int64))], ["cell", "word"])

    found = arrow_map(hashes, cells, "cell long, word long").groupBy("cell").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    if found.num_rows:
        out[found.column("cell").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return out


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, a place of each, and which of them each place has."""
    order = np.argsort(key)
    in_order = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return in_order[new], order[new], inverse


def same_spans(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the span that ``other`` names."""
    size = hi - lo
    if not (size == size[other]).all():
        return False
    local = np.arange(int(size.sum()), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    return bool((buf[local + np.repeat(lo.astype(np.int32), size)] == buf[local + np.repeat(lo[other].astype(np.int32), size)]).all())


class Phrases:
    """The words of some texts and, level by level, the phrases that begin at each of them."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        raw, offsets = text_buffer(texts)
        self.buf = _LOWER[raw]
        kind = _KIND[raw]
        solid = kind == 0
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        starts, ends = solid.copy(), solid.copy()
        if len(raw):
            starts[1:] &= ~solid[:-1] | edge[1:-1]
            ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.lo, self.hi = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        doc = np.searchsorted(offsets, self.lo, side="right") - 1
        self.piece = np.cumsum(kind == 2)[self.lo] + doc if len(raw) else self.lo
        codes = langs.dictionary_encode()
        self.langs = codes.dictionary
        self.lang = codes.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        self.n = len(self.lo)
        if not self.n:
            return
        name, name_at = text_buffer(self.langs)
        filled = np.flatnonzero(np.diff(name_at) > 0)
        of_lang = np.zeros(len(self.langs), np.uint64)
        of_lang[filled] = span_hashes(name, name_at[:-1][filled], name_at[1:][filled])
        named = mix64(span_hashes(self.buf, self.lo, self.hi) + of_lang[self.lang] * _FOLD)
        key, at, self.word = ranked(named)
        if not (same_spans(self.buf, self.lo, self.hi, at[self.word]) and (self.lang == self.lang[at[self.word]]).all()):
            data, number = self.buf.tobytes(), {}  # two words share a hash: the words themselves tell them apart
            self.word = np.array([number.setdefault((g, data[a:b]), len(number)) for g, a, b in zip(self.lang.tolist(), self.lo.tolist(), self.hi.tolist(), strict=True)], np.int64)
            _, at, self.word = ranked(self.word)
        self.at = at  # one place of each different word or, later, phrase
        self.words = len(at)
        self.word_hash = named[at]
        self.k, self.id, self.hash, self.count = 1, self.word, self.word_hash, np.bincount(self.word)

    def longer(self, usable: np.ndarray) -> None:
        """Go on to phrases of one word more, both parts of which are ``usable`` (by id).

        ``id`` is -1 where no such phrase begins.
        """
        k = self.k + 1
        m = max(self.n - k + 1, 0)
        good = np.zeros(self.n + 1, bool)
        good[: self.n] = self.id >= 0
        good[: self.n][good[: self.n]] = usable[self.id[good[: self.n]]]
        here = np.flatnonzero(good[:m] & good[1 : m + 1] & (self.piece[:m] == self.piece[k - 1 : k - 1 + m])) if m else np.zeros(0, np.int64)
        key = self.id[here] * self.words + self.word[here + k - 1]
        key, at, inverse = ranked(key)
        before, last = self.id[here][at], self.word[here + k - 1][at]
        self.head, self.tail = before, self.id[here[at] + 1] if len(at) else before
        self.hash = mix64(self.hash[before] * _FOLD + self.word_hash[last])
        self.id = np.full(self.n, -1, np.int64)
        self.id[here] = inverse
        self.at, self.count, self.k = here[at], np.bincount(inverse, minlength=len(key)), k

    def texts(self, which: np.ndarray) -> pa.Array:
        """Space-joined phrases."""
        at = self.at[which]
        lo, hi = self.lo[at], self.hi[at + self.k - 1]
        size = hi - lo
        words = sum((self.hi[at + j] - self.lo[at + j] for j in range(self.k)), np.zeros(len(at), np.int64))
        wide = np.flatnonzero(size != words + self.k - 1)
        offsets = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        flat = self.buf[np.arange(int(offsets[-1]), dtype=np.int32) + np.repeat((lo - offsets[:-1]).astype(np.int32), size)]
        out = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        if len(wide):  # more than one blank between words
            fixed = [" ".join(w for w in x.split(" ") if w) for x in out.take(pa.array(wide)).to_pylist()]
            mask = np.zeros(len(at), bool)
            mask[wide] = True
            out = pc.replace_with_mask(out, pa.array(mask), pa.array(fixed, pa.large_string()))
        return out.cast(pa.string())

    def rows(self, which: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Language, phrase and count of some phrases."""
        for i in range(0, len(which), ROWS):
            some = which[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[self.at[some]])), self.texts(some), pa.array(self.count[some].astype(np.int64))], ["lang", "phrase", "n"])


def _parts(batch: pa.RecordBatch) -> Iterator[Phrases]:
    for lo, hi in chunks(batch, 1, CHUNK_BYTES):
        p = Phrases(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))
        if p.n:
            yield p


def sample_hashes(texts: DataFrame, longest: int) -> DataFrame:
    """Hash and count of every phrase of ``texts (lang, text)``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for p in _parts(batch):
            for k in range(1, longest + 1):
                if k > 1:
                    p.longer(np.ones(len(p.hash), bool))
                yield pa.RecordBatch.from_arrays([pa.array(p.hash.view(np.int64)), pa.array(p.count.astype(np.int64))], ["h", "n"])

    return arrow_map(texts, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def border_bounds(texts: DataFrame, longest: int, proposed: np.ndarray) -> DataFrame:
    """h and n, bounds of the counts of all proposals and their border in ``texts (lang, text)``."""
    shared = texts.sparkSession.sparkContext.broadcast(proposed)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sample = Bloom(shared.value)
        for p in _parts(batch):
            for k in range(1, longest + 1):
                if k > 1:
                    p.longer(sample.has(p.hash))
                yield pa.RecordBatch.from_arrays([pa.array(p.hash.view(np.int64)), pa.array(p.count.astype(np.int64))], ["h", "n"])

    return arrow_map(texts, run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def exact_counts(texts: DataFrame, longest: int, proposed: np.ndarray, possible: np.ndarray) -> DataFrame:
    """lang, phrase, n of all phrases whose bound is high enough, and of those that :func:`border_bounds`
    left out and whose parts may all be frequent; the empty phrase holds the words of each language."""
    context = texts.sparkSession.sparkContext
    first, second = context.broadcast(proposed), context.broadcast(possible)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sample, bound = Bloom(first.value), Bloom(second.value)
        for p in _parts(batch):
            total = np.bincount(p.lang, minlength=len(p.langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([p.langs, pa.array([""] * len(total)), pa.array(total)], ["lang", "phrase", "n"])
            bounded = np.ones(len(p.hash), bool)  # the first pass met it: all words, and what has two proposals as parts
            for k in range(1, longest + 1):
                if k > 1:
                    p.longer(alive)
                    bounded = grows[p.head] & grows[p.tail]
                alive = ~bounded | bound.has(p.hash)
                grows = bounded & sample.has(p.hash)
                yield from p.rows(np.flatnonzero(alive))

    return arrow_map(texts, run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, sample: int = SAMPLE, bits: int = BLOOM_BITS) -> DataFrame:
    """Exact counts of all phrases of 1 to ``longest`` words with ``least`` occurrences or more in
    ``docs (doc_id, text, lang)``: lang, k, phrase, n; and with k = 0 the words of each language."""
    base = no_clash(docs, ["doc_id", "lang", "text"]).withColumn("lang", F.coalesce("lang", F.lit("und")))
    texts = base.select("lang", "text")
    lowered = max(2, int(LOWERED * least / sample))
    some = base.filter(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0).select("lang", "text")
    proposed = gather_bloom(sample_hashes(some, longest).filter(F.col("n") >= lowered).select("h"), bits)
    possible = gather_bloom(border_bounds(texts, longest, proposed).filter(F.col("n") >= least).select("h"), bits)
    found = materialize(exact_counts(texts, longest, proposed, possible).filter((F.col("phrase") == "") | (F.col("n") >= least)))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1)
    return found.withColumn("k", words)


def collocations(frequent: DataFrame, top: int | None = TOP, share: int = 100) -> DataFrame:
    """Scored and ranked phrases from :func:`frequent_phrases`.

    The lowest score over all cuts counts.  A phrase goes if a phrase of one word more around
    it has at least ``share`` percent of its occurrences; a longer one cannot have more than
    that, so it need not be looked at.
    """
    counts = frequent.select("lang", "phrase", F.col("n").alias("f"), "k")
    candidates = counts.filter("k >= 2").withColumnRenamed("f", "a")
    total = materialize(counts.filter("k = 0").select("lang", F.col("f").alias("n")))
    parts = counts.filter("k >= 1").drop("k")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(total, "lang")
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * big["a"] * big["n"]).cast("decimal(38,0)"), (big["l"] * big["r"]).cast("decimal(38,0)"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    around = candidates.filter("k >= 3").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(read_table(spark, sf_dir, "documents")))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
cuts AS (SELECT c.*, j, array_to_string(ws[1:j], ' ') AS p1, array_to_string(ws[j + 1:], ' ') AS p2 FROM cand c, range(1, 5) t(j) WHERE j < k),
scored AS (SELECT c.lang, c.phrase, c.k, c.a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = p1 JOIN f y ON y.lang = c.lang AND y.phrase = p2 JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT DISTINCT lang, a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM cand, range(2, 5) t(m), range(1, 5) u(i) WHERE m < k AND i + m - 1 <= k),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.longer >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

__all__ = ["Phrases", "border_bounds", "collocations", "exact_counts", "frequent_phrases", "op11_toivonen_phrases"]
