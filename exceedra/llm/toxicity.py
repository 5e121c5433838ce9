"""Operator 6: toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

Folding makes letters of other alphabets that look Latin, accents, digits and signs that
stand for letters inside a word, and the pair i/l one letter each.  Lexicon entries are the
beginnings of folded words (four letters or more) or whole words.  They are learnt from
labelled documents: an entry's weight is its log odds among toxic against other documents,
and a longer entry is left out where a shorter one it begins with is as clear.  Phrases that
begin with an entry and that only other documents use are exceptions: where one matches, the
entry inside it does not count.  A document's hits, one per word, are summed by weight and
divided by its words; a logistic curve over the sum and the rate gives the score.

Counts run over all labelled training documents.  An entry is in the share ``MIN_SHARE`` of
the toxic documents at least, so candidates are no more than the entries of a mean toxic
document by ``1 / MIN_SHARE``; an exception is in the share ``EXCEPTION_SHARE`` of the other
documents that have its entry, so there are at most ``1 / EXCEPTION_SHARE`` phrases of a
document for each entry.  ``MAX_FIT_ROWS`` bounds the labelled rows to which the curve is
fitted, chosen by a hash of the id.

Defined cases: null, empty and wordless texts score as a text without hits; documents
without a label are scored like others; a document labelled twice takes the larger label;
null labels are ignored; repeated rows score alike; without any toxic label the lexicon is
empty and all scores are 0; a text of any length is matched whole, above ``CHUNK_BYTES`` in
a batch of its own; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import arrow_map, chunks, materialize, no_clash, read_table, text_buffer

THRESHOLD = 0.7
MIN_PREFIX, MAX_PREFIX = 4, 8
MIN_SUPPORT = 3  # toxic documents, and at least MIN_SHARE of them
MIN_SHARE = 0.004
MIN_WEIGHT = 3.0
SAME_SHARE = 0.95
EXCEPTION_SHARE = 0.05
MAX_FIT_ROWS = 50_000
MAX_BROADCAST_ROWS = 2_000_000
END = 0x110000

# Look-alikes of Latin letters in Cyrillic and Greek.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ſ": "s",
}
# Digits and signs written for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}

_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded letter of each code point (space if none), the letter it stands for inside a word (0 if none), marks to skip."""
    if not _TABLES:
        letter = np.full(END + 1, 32, np.uint32)
        inside = np.zeros(END + 1, np.uint32)
        skip = np.zeros(END + 1, bool)
        for c in range(END):
            ch = chr(c)
            kind = unicodedata.category(ch)
            if kind[0] == "L":
                base = unicodedata.normalize("NFKD", ch)[0].lower()[:1]
                base = LOOK_ALIKES.get(base, base)
                letter[c] = ord("i" if base == "l" else base)
            elif kind == "Nd":
                letter[c] = ord("0") + unicodedata.digit(ch)
            elif kind == "Mn" or kind == "Cf":
                skip[c] = True
        for s, to in SUBSTITUTES.items():
            inside[ord(s)] = ord(to)
        letter[END] = END
        _TABLES[:] = [letter, inside, skip]
    return tuple(_TABLES)


def fold(codes: np.ndarray) -> np.ndarray:
    """Folded text with single spaces; end marks stay, and a space follows each."""
    letter, inside, skip = _tables()
    codes = codes[~skip[codes]]
    out = letter[codes]
    to = inside[codes]
    maybe = np.flatnonzero(to)
    if len(maybe):
        solid = (out != 32) & (out != END) & (to == 0)
        near = np.zeros(len(codes), bool)
        near[1:] |= solid[:-1] & (out[:-1] > 57)
        follows = np.zeros(len(codes), bool)
        follows[:-1] |= solid[1:] & (out[1:] > 57)
        # A sign that ends a word is a stop; digits count at either end.
        digit = (codes >= 48) & (codes <= 57)
        use = (to > 0) & np.where(digit, near | follows, follows)
        out[use] = to[use]
    keep = out != 32
    keep[:1] = True  # the space before the first text
    keep[1:] |= out[:-1] != 32
    return out[keep]


def folded_texts(column: pa.Array) -> tuple[str, np.ndarray]:
    """All texts of a column folded, each in spaces, joined by NUL; and where each begins (n + 1)."""
    buf, offsets = text_buffer(column)
    data = buf.tobytes()
    mark = np.array([32, END, 32], np.uint32)
    parts = [mark[2:]]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        parts += [np.frombuffer(data[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32), mark]
    x = fold(np.concatenate(parts))
    ends = np.flatnonzero(x == END)
    x[ends] = 0
    return x.tobytes().decode("utf-32-le"), np.concatenate([[0], ends + 1])


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of labelled documents outside the held-out third."""
    known = no_clash(labels, ["doc_id", "toxic"]).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = materialize(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    few = known.count() <= MAX_BROADCAST_ROWS
    return docs.join(F.broadcast(known) if few else known, "doc_id").select("doc_id", "text", "toxic")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _beginnings(word: str) -> list[str]:
    """The entries a word can match: its beginnings, and itself closed by a space."""
    return [word[:n] for n in range(MIN_PREFIX, min(MAX_PREFIX, len(word)) + 1)] + ([word + " "] if len(word) >= MIN_PREFIX - 1 else [])


def _document_words(column: pa.Array) -> Iterator[list[str]]:
    text, begins = folded_texts(column)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        yield text[a : b - 1].split(" ")


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    """Weights of the entries, and how many other documents have each; two passes, the first over toxic documents only."""
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic:
        return {}, {}
    least = max(MIN_SUPPORT, MIN_SHARE * n_toxic)

    def toxic_counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for lo, hi in chunks(batch, 0):
            for words in _document_words(batch.column(0).slice(lo, hi - lo)):
                counts.update({e for w in set(words) for e in _beginnings(w)})
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

    toxic = arrow_map(train.filter("toxic = 1").select("text"), toxic_counts, "entry string, n long")
    in_toxic = {r["entry"]: r["n"] for r in toxic.groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()}
    shared = train.sparkSession.sparkContext.broadcast(frozenset(in_toxic))

    def other_counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for lo, hi in chunks(batch, 0):
            for words in _document_words(batch.column(0).slice(lo, hi - lo)):
                counts.update({e for w in set(words) for e in _beginnings(w) if e in shared.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["entry", "n"])

    other = arrow_map(train.filter("toxic = 0").select("text"), other_counts, "entry string, n long")
    in_other = {r["entry"]: r["n"] for r in other.groupBy("entry").agg(F.sum("n").alias("n")).collect()}  # the same entries
    weight = {e: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((in_other.get(e, 0) + 0.5) / (n_other + 1))) for e, n in in_toxic.items()}
    kept: dict[str, float] = {}
    closer: dict[str, int] = {}  # the most documents that any longer entry shares with its beginning
    for e, n in in_toxic.items():
        for k in range(MIN_PREFIX, len(e)):
            closer[e[:k]] = max(closer.get(e[:k], 0), n)
    for e in sorted(in_toxic, key=lambda e: (len(e), e)):
        # A longer entry that nearly all its documents have stands for it; so does a shorter one that is as clear.
        longer = closer.get(e, 0) >= SAME_SHARE * in_toxic[e]
        shorter = any(in_other.get(e[:k], 0) <= in_other.get(e, 0) for k in range(MIN_PREFIX, len(e)) if e[:k] in kept)
        if weight[e] >= MIN_WEIGHT and not longer and not shorter:
            kept[e] = weight[e]
    return kept, {e: in_other.get(e, 0) for e in kept}


def automaton_of(entries: dict[str, float], exceptions: tuple[str, ...]):
    """Entries and exception phrases as patterns that begin at a word's start."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for e, w in entries.items():
        found.add_word(" " + e, (len(e) + 1, w))
    for phrase in exceptions:
        found.add_word(" " + phrase + " ", (len(phrase) + 2, 0.0))
    if len(found):
        found.make_automaton()
    return found


def hits(automaton, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of each text's words that match, and its words."""
    text, begins = folded_texts(column)
    n = len(begins) - 1
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (raw == 32) | (raw == 0)
    starts = ~blank
    starts[1:] &= blank[:-1]
    places = np.flatnonzero(starts)
    words = np.diff(np.searchsorted(places, begins))
    total = np.zeros(n)
    if not len(automaton):
        return total, words
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(text):
        at = end - length + 1
        if weight:
            best[at] = max(best.get(at, 0.0), weight)
        else:
            excused.append((at, end))
    for a, b in excused:
        for at in [p for p in range(a, b) if p in best]:
            del best[at]
    if best:
        at = np.fromiter(best.keys(), np.int64)
        np.add.at(total, np.searchsorted(begins, at, side="right") - 1, np.fromiter(best.values(), np.float64))
    return total, words


def learn_exceptions(train: DataFrame, in_other: dict[str, int]) -> tuple[str, ...]:
    """Pairs of words led by an entry that no toxic document uses, but two or more others and a share of those with the entry."""
    if not in_other:
        return ()
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(frozenset(in_other))

    def phrases(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], list[int]] = {}
        for lo, hi in chunks(batch, 0):
            for toxic, words in zip(batch.column(1).slice(lo, hi - lo).to_pylist(), _document_words(batch.column(0).slice(lo, hi - lo)), strict=True):
                own = {(e, f"{w} {v}") for w, v in zip(words, words[1:], strict=False) if v for e in _beginnings(w) if e in shared.value}
                for p in own:
                    counts.setdefault(p, [0, 0])[1 if toxic else 0] += 1
        columns = [pa.array([e for e, _ in counts], pa.string()), pa.array([p for _, p in counts], pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(2))]
        yield pa.RecordBatch.from_arrays(columns, ["entry", "p", "other", "toxic"])

    rows = arrow_map(train.select("text", "toxic"), phrases, "entry string, p string, other long, toxic long").groupBy("entry", "p").agg(F.sum("other").alias("o"), F.sum("toxic").alias("t"))
    known = spark.createDataFrame(list(in_other.items()), "entry string, n long")
    good = rows.filter("o >= 2 and t = 0").join(F.broadcast(known), "entry").filter(F.col("o") >= EXCEPTION_SHARE * F.col("n"))
    return tuple(sorted({r["p"] for r in good.select("p").distinct().collect()}))


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    rate = 100 * total / np.maximum(words, 1)
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(rate)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.r_[0, w[1:]]
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - pull)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs (doc_id, text)``."""
    docs = no_clash(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    train = materialize(training(docs, labels))
    entries, in_other = learn_lexicon(train)
    phrases = (*exceptions, *learn_exceptions(train, in_other))
    shared = spark.sparkContext.broadcast((entries, phrases))
    cache: list = []

    def automaton():
        if not cache:
            cache.append(automaton_of(*shared.value))
        return cache[0]

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in chunks(batch, 0):
            total, words = hits(automaton(), batch.column(0).slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(words), *(batch.column(k).slice(lo, hi - lo) for k in (1, 2))], ["total", "words", "toxic", "doc_id"])

    measured = arrow_map(train.select("text", F.col("toxic").cast("int").alias("toxic"), "doc_id"), measure, "total double, words long, toxic int, doc_id long")
    sample = measured.orderBy(F.xxhash64("doc_id"), "total", "words").limit(MAX_FIT_ROWS).toArrow() if entries else None
    curve = None
    if sample is not None and sample.num_rows:
        curve = fit_curve(_features(sample.column(0).to_numpy(), sample.column(1).to_numpy()), sample.column(2).to_numpy().astype(float))

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in chunks(batch, 1):
            part = batch.slice(lo, hi - lo)
            total, words = hits(automaton(), part.column(1))
            p = np.zeros(hi - lo) if curve is None else 1 / (1 + np.exp(-np.clip(_features(total, words) @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), judge, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
