"""Operator 9: token counts from compiled finite-state transducers.

Two deterministic transducers run one after the other.

* The splitter reads one character class at a time and marks where pieces begin.  A batch is
  cut into chunks of equal length; each chunk's map from entry state to exit state is found
  for all states at once, the maps are composed by a parallel prefix scan, and a last pass
  from the known entry states writes the marks.
* The merger reads the bytes of a piece and annotates each transition with the change in the
  number of tokens that the text so far would give.  It is determinised as it is needed: a
  state holds the longest suffix that still can grow into a token and, for every place in
  it, the last token and the count there.  The encoding of a text is the one whose adjacent
  tokens all stay apart when merged as a pair, so the last token of each prefix is settled by
  one look at the last token where it begins.

Defined cases: null and empty texts have no tokens; the special string of the vocabulary is
one token where it occurs and separates its neighbours; repeated rows and ids each return a
row, and rows have no order that could tie; a text of any length is counted whole, above a
batch's bytes in one of its own; other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from exceedra.llm.common import arrow_map, chunks, local_path, no_clash, read_table, span_hashes, text_buffer

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CHUNK = 256
MAX_STATES = 250_000
MAX_PIECES = 400_000

# Character classes: letters that end a contraction are told apart.
LETTER, STMD, R, V, ELL, E, NUMBER, SPACE, BLANK, APOSTROPHE, OTHER, END = range(12)
_LETTERS = (LETTER, STMD, R, V, ELL, E)
# States of the splitter: what the open piece is.
CLOSED, WORD, DIGITS, SIGNS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK = range(12)
_N = 12
HERE, BEFORE = 1, 2  # a piece begins at this character; at the one before


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for state * 12 + class."""
    begin = {**dict.fromkeys(_LETTERS, WORD), NUMBER: DIGITS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, APOSTROPHE: QUOTE, OTHER: SIGNS, END: CLOSED}
    attach = {**dict.fromkeys(_LETTERS, WORD), NUMBER: DIGITS, APOSTROPHE: SIGNS, OTHER: SIGNS}
    step = {(s, c): (begin[c], HERE) for s in range(_N) for c in range(_N)}
    for c in _LETTERS:
        step[WORD, c] = (WORD, 0)
        for s in (QUOTE_R, QUOTE_V, QUOTE_L):
            step[s, c] = (WORD, BEFORE)
    for s in (QUOTE_R, QUOTE_V, QUOTE_L):
        for c in (NUMBER, SPACE, BLANK, APOSTROPHE, OTHER, END):
            step[s, c] = (begin[c], BEFORE | HERE)
    for s, c in ((QUOTE, STMD), (QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, ELL)):
        step[s, c] = (CLOSED, 0)
    step[QUOTE, R], step[QUOTE, V], step[QUOTE, ELL] = (QUOTE_R, 0), (QUOTE_V, 0), (QUOTE_L, 0)
    step[DIGITS, NUMBER] = (DIGITS, 0)
    for s in (SIGNS, QUOTE):
        for c in (OTHER, APOSTROPHE):
            step[s, c] = (SIGNS, 0)
    for s in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
        step[s, SPACE], step[s, BLANK] = (RUN_SPACE, 0), (RUN_BLANK, 0)
    for c, to in attach.items():
        step[ONE_SPACE, c] = (to, 0)
        step[RUN_SPACE, c] = (to, BEFORE)
        step[RUN_BLANK, c] = (begin[c], BEFORE | HERE)
    keys = [(s, c) for s in range(_N) for c in range(_N)]
    return np.array([step[k][0] for k in keys], np.uint8), np.array([step[k][1] for k in keys], np.uint8)


NEXT, MARK = _splitter()
_CLASS: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """Class of every code point, and of the end mark one past the last."""
    if not _CLASS:
        table = np.full(0x110001, OTHER, np.uint8)
        kind = {"L": LETTER, "N": NUMBER, "Z": BLANK}
        for c in range(0x110000):
            k = kind.get(unicodedata.category(chr(c))[0])
            if k is not None:
                table[c] = k
        table[[*range(9, 14), 0x85]] = BLANK
        for c, k in ((" ", SPACE), ("'", APOSTROPHE), ("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R), ("v", V), ("l", ELL), ("e", E)):
            table[ord(c)] = k
        table[0x110000] = END
        _CLASS.append(table)
    return _CLASS[0]


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return np.take_along_axis(then, first.astype(np.int64), axis=1)


def entry_states(classes: np.ndarray) -> np.ndarray:
    """Entry state of each chunk of ``classes (length, chunks)``, the first being CLOSED."""
    length, m = classes.shape
    maps = np.repeat(np.arange(_N, dtype=np.uint8)[:, None], m, 1)
    tail = min(32, length)
    for t in range(length - tail, length):
        maps = NEXT[maps * np.uint8(_N) + classes[t]]
    # Where all states already meet, the characters before cannot matter.
    open_ = np.flatnonzero((maps != maps[0]).any(0))
    if len(open_) and tail < length:
        some = np.repeat(np.arange(_N, dtype=np.uint8)[:, None], len(open_), 1)
        part = classes[:, open_]
        for t in range(length):
            some = NEXT[some * np.uint8(_N) + part[t]]
        maps[:, open_] = some
    scan = maps.T.copy()
    d = 1
    while d < m:
        scan[d:] = _compose(scan[:-d], scan[d:])
        d *= 2
    out = np.zeros(m, np.uint8)
    out[1:] = scan[:-1, CLOSED]
    return out


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where pieces begin in an array of code points whose segments end with the end mark."""
    n = len(codes)
    m = -(-n // CHUNK)
    classes = np.full(m * CHUNK, END, np.uint8)
    classes[:n] = character_classes()[codes]
    classes = classes.reshape(m, CHUNK).T.copy()
    state = entry_states(classes)
    marks = np.empty((CHUNK, m), np.uint8)
    for t in range(CHUNK):
        at = state * np.uint8(_N) + classes[t]
        marks[t] = MARK[at]
        state = NEXT[at]
    flat = marks.T.reshape(-1)[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The lazily determinised transducer of a byte-level merge vocabulary."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.id = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in set(self.special)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.prefixes = {k[:i] for k in self.id for i in range(1, len(k) + 1)}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[int, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(b"", ((0, None, 0),))]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """Merges by rank until none applies; for single tokens and pairs of them."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), sys.maxsize))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stays(self, before: bytes | None, token: bytes) -> bool:
        """Whether a token directly after another (or at the start) is left as it is."""
        key = (before or b"", token)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 600_000:
                self.apart.clear()
            found = self.apart[key] = self.merge(key[0] + token) == [x for x in key if x]
        return found

    def build(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state and a byte.

        A state is the longest suffix that begins some token, and each place in it from which
        the suffix does so too: how far back, the last token there, and the count relative to
        the count at the end.
        """
        suffix, places = self.states[state]
        text = suffix + bytes((byte,))
        end = len(text)
        for back, before, count in places:
            token = text[end - back - 1 :]
            if token in self.id and self.stays(before, token):
                break
        else:
            raise ValueError("a byte is missing from the vocabulary")
        gained = count + 1
        kept = [(back + 1, t, c - gained) for back, t, c in places if text[end - back - 1 :] in self.prefixes]
        kept.append((0, token, 0))
        new = (text[end - kept[0][0] :], tuple(kept))
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        self.step[state << 8 | byte] = (to, gained)
        return to, gained

    def count(self, piece: bytes) -> int:
        """Tokens of a piece: the sum of the annotations along its path."""
        if len(self.states) > MAX_STATES:
            self.reset()
        step, state, total = self.step, 0, 0
        for byte in piece:
            found = step.get(state << 8 | byte)
            if found is None:
                found = self.build(state, byte)
            state = found[0]
            total += found[1]
        return total

    def count_texts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a buffer."""
        n = len(offsets) - 1
        extra = np.zeros(n, np.int64)
        data = buf.tobytes()
        owner, texts = [], []
        hit = any(s.encode() in data for s in self.special)
        for i in range(n):
            text = data[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")
            parts = [text]
            if hit:
                for s in self.special:
                    parts = [x for p in parts for x in p.split(s)]
                extra[i] = len(parts) - 1
            owner += [i] * len(parts)
            texts += parts
        codes = []
        end = np.array([0x110000], np.uint32)
        for t in texts:
            codes += [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), end]
        if not codes:
            return extra
        size = np.array([len(t) + 1 for t in texts], np.int64)
        flat = np.concatenate(codes)
        starts = piece_starts(flat)
        width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
        width[flat == 0x110000] = 0
        at = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        lo, hi = at[starts], at[np.append(starts[1:], len(flat))]
        whose = np.repeat(np.array(owner), size)[starts]
        real = hi > lo
        lo, hi, whose = lo[real], hi[real], whose[real]
        if hit:
            data = "".join(texts).encode("utf-8", "surrogatepass")
            buf = np.frombuffer(data, np.uint8)
        first, back = equal_pieces(buf, lo, hi)
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        known = self.pieces
        counts = np.empty(len(first), np.int64)
        for i, (a, b) in enumerate(zip(lo[first].tolist(), hi[first].tolist(), strict=True)):
            piece = data[a:b]
            c = known.get(piece)
            if c is None:
                c = known[piece] = self.count(piece)
            counts[i] = c
        return extra + np.bincount(whose, weights=counts[back], minlength=n).astype(np.int64)


def equal_pieces(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first piece of each different one, and which of them each piece equals; hashes propose, bytes decide."""
    _, first, back = np.unique(span_hashes(buf, lo, hi), return_index=True, return_inverse=True)
    size = hi - lo
    if len(lo) and (size == size[first[back]]).all():
        local = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if (buf[local + np.repeat(lo, size)] == buf[local + np.repeat(lo[first[back]], size)]).all():
            return first, back
    whole = np.arange(len(lo))  # two pieces share a hash: each stands for itself
    return whole, whole


_MERGERS: dict[int, Merger] = {}


def merger_of(vocabulary: str) -> Merger:
    """One compiled transducer per process and vocabulary."""
    key = hash(vocabulary)
    if key not in _MERGERS:
        _MERGERS[key] = Merger(vocabulary)
    return _MERGERS[key]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of ``docs (doc_id, text)``; narrow, one pass."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        merger = merger_of(shared.value)
        for lo, hi in chunks(batch, 1, 1 << 20):
            part = batch.slice(lo, hi - lo)
            buf, offsets = text_buffer(part.column(1))
            tokens = merger.count_texts(buf, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(no_clash(docs, ["doc_id", "text"]), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), local_path(VOCABULARY))
