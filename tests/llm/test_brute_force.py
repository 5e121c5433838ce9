"""Operators against plain versions, libraries, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import sys
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from support import DATA, rows_of
from exceedra.llm import decontaminate, linededup, ngramjoin, sharding, suffixdedup, tokencount, tokenids, toxicity
from exceedra.llm.common import connected_components, local_path, text_buffer
from exceedra.llm.queries import ORACLE_SQL, QUERIES


def documents():
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(sorted(zip(t["doc_id"], t["text"], strict=True)))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, data, duck):
    assert rows_of(QUERIES[name](spark, data).toArrow()) == rows_of(duck.sql(ORACLE_SQL[name]).to_arrow_table())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def test_near_copies_link(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    for i in range(60, 100):
        texts[i] = " ".join(base[:40] + [f"q{rng.randrange(10**6)}" for _ in range(100)])
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    label = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    got = ngramjoin.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_passages_with_edits():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(k, words(rng.randint(6, 40))) for k in range(40)]
    index = decontaminate.Index(items)
    for _ in range(80):
        k, text = rng.choice(items)
        edited = list(text)
        for _ in range(rng.randint(0, len(text) // 10)):
            p = rng.randrange(len(edited))
            edited[p : p + 1] = rng.choice([[], ["z"], [edited[p], "y"]])
        host = words(50)
        hits = decontaminate.scan(index, pa.array([f"{host} {''.join(edited)} {host}"]))
        assert k in {h[1] for h in hits}
    assert not decontaminate.scan(index, pa.array([words(3000)]))


def test_packed_ids_round_trip(spark, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(local_path(tokenids.VOCABULARY))
    got = {r.doc_id: r for r in QUERIES["op4_packed_ids"](spark, data).collect()}
    start = 0
    for i, text in documents().items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, tokenids.END_ID], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 9001).astype(np.uint32)
    sizes = np.array([9000, 0, 1])
    f = tokenids.PackedFile(tokenids.write_file(np.array([5, 6, 7]), sizes, ids, bits, 100))
    assert (f.ids(0, 9001) == ids).all() and (f.ids(4321, 4990) == ids[4321:4990]).all()
    assert f.document(2).tolist() == ids[9000:].tolist() and not len(f.document(1))


def test_export(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hello world"), (2, "again")], "doc_id long, text string")
    files = tokenids.encode_files(docs, local_path(tokenids.VOCABULARY))
    tokenids.export_files(files, f"file://{tmp_path}/ids")
    found = [tokenids.PackedFile(p.read_bytes()) for p in sorted((tmp_path / "ids").iterdir())]
    assert sorted(i for f in found for i in f.doc_ids.tolist()) == [1, 2]


SPICE = ["a", "B", "s", "t", "re", "ve", "'", "'s", " ", "  ", "\n", "\t", "1", "23", "!", "é", "ß", "日本", " ", "　", "😀", "<|endoftext|>", "<|", "ll", "d", "m", "\x1c", "ing", " the", "²", "́", "\r\n", "Σ", "İ"]


def test_token_counts_equal_library():
    from tokenizers import Tokenizer

    path = local_path(tokencount.VOCABULARY)
    rng = random.Random(1)
    texts = ["".join(rng.choice(SPICE) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + list(documents().values()) + ["x" * 5000, " " * 700, "'" * 300]
    with open(path, encoding="utf-8") as f:
        merger = tokencount.Merger(f.read())
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert merger.count_texts(*text_buffer(pa.array(texts))).tolist() == want


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = local_path(tokenids.VOCABULARY)
    rng = random.Random(2)
    texts = ["".join(rng.choice([*SPICE, "."]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    with open(path, encoding="utf-8") as f:
        ids, sizes = tokenids.Encoder(f.read()).encode([t.encode() for t in texts])
    want = [[*e.ids, tokenids.END_ID] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_encoder_looks_up_each_run_once_a_call():
    from tokenizers import Tokenizer

    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

        def __iter__(self):
            raise AssertionError("walks over all known runs")

    path = local_path(tokenids.VOCABULARY)
    # Words that lower case, composition or the splitter turn into several pieces or none.
    odd = ["\u0130stanbul", "stra\u00dfe", "\u1112\u1161\u11ab", "e\u0301a", "\u00aa", "\u0e01\u0e33", "\u02bc", "\u3007", "\u00a0x", "we'll", "<a>", "x<", "..", "No.", "a1b", "\U0001d400b"]
    texts = ["Some words. " * 500 + " ".join(odd), "", "words " * 500, *odd, " ".join(f"{w}zq" for w in odd)]
    with open(path, encoding="utf-8") as f:
        encoder = tokenids.Encoder(f.read())
    encoder.encode(["Some words. words".encode()])
    encoder.number = Counted(encoder.number)
    ids, sizes = encoder.encode([t.encode() for t in texts])
    assert encoder.number.asked < 300
    want = [[*e.ids, tokenids.END_ID] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_held_out_toxicity(spark, data):
    got = {r.doc_id: r for r in QUERIES["op6_toxic_lexicon"](spark, data).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    clean = [i for i in truth if not truth[i]]
    assert sum(got[i].predicted for i in clean) <= 0.05 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_toxicity_learns_a_lexicon(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, f"{words(60)} {'stupid loser ' * (i % 2)}{words(5)}") for i in range(400)]
    rows += [(1001, "you st0pid l0ser " + words(10)), (1002, "ѕtuріd löser " + words(10)), (1003, words(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(400))
    assert (got[1001].predicted, got[1002].predicted, got[1003].predicted) == (1, 1, 0)
    excused = {r.doc_id: r for r in toxicity.score(docs, labels, ("stopid ioser", "stupid ioser")).collect()}
    assert excused[1001].predicted in (0, 1) and excused[1003].predicted == 0


def test_shards_are_even(spark, data):
    rows = QUERIES["op7_histogram_shards"](spark, data).collect()
    texts = documents()
    total = [0] * 16
    for r in rows:
        total[r.shard] += r.size
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    largest = max(len(t.encode()) + 1 for t in texts.values())
    assert max(total) - min(total) <= 2 * largest
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_hot_group_is_divided(spark):
    rows = [(i, "the same long text " * 20) for i in range(400)] + [(1000 + i, f"text {i} " * 30) for i in range(800)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    total = [sum(len(r.text) + 1 for r in got if r.shard == s) for s in range(8)]
    assert max(total) < 1.05 * sum(total) / 8


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(400):
        t = [rng.randint(0, rng.choice([1, 2, 5, 200])) for _ in range(rng.randint(0, 60))]
        assert suffixdedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffixes_of_many_rows():
    rng = random.Random(8)
    for depth in (3, 100):
        rows = [bytes(rng.choice([0, 0, 1, 2, 97]) for _ in range(rng.randint(1, 40))) for _ in range(200)]
        size = np.array([len(r) for r in rows])
        rank = suffixdedup.suffix_ranks(np.frombuffer(b"".join(rows), np.uint8), np.cumsum(size) - size, size, depth)
        heads = [r[k : k + depth] for r in rows for k in range(len(r))]
        in_order = [heads[k] for k in np.argsort(rank, kind="stable")]
        assert in_order == sorted(heads)
        if depth == 100:
            assert len(set(rank.tolist())) == len(set(heads))


def test_variants_are_not_sorted_byte_by_byte_in_python():
    rng = np.random.default_rng(4)
    rows, ids, anchors = [], [], []
    for k in range(700):
        row = bytes(rng.integers(97, 123, 70, dtype=np.uint8))
        for j in range(3):
            rows.append(row[: 69 - j] + bytes([48 + j]) + row[70 - j :])
            ids.append(int(rng.integers(1000)) * 3 + j)
            anchors.append(k)
    n = len(rows)
    table = pa.table({"doc_id": ids, "th": [0] * n, "ord": pa.array(range(n), pa.int32()), "data": pa.array(rows, pa.binary()), "anchor": anchors, "place": pa.array([20] * n, pa.int32())})
    lines = 0

    def trace(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return trace

    sys.settrace(trace)
    try:
        found = suffixdedup.equal_windows(table)
    finally:
        sys.settrace(None)
    want = set()
    for k in range(0, n, 3):
        first: dict[bytes, int] = {}
        for i in range(k, k + 3):
            for p in range(21):
                w = rows[i][p : p + 50]
                first[w] = min(first.get(w, ids[i]), ids[i])
        want |= {(i, p) for i in range(k, k + 3) for p in range(21) if first[rows[i][p : p + 50]] < ids[i]}
    got = {(o, s + j) for o, s, c in zip(*(found.column(c).to_pylist() for c in ("ord", "skip", "n")), strict=True) for j in range(c)}
    assert got == want
    assert lines < sum(map(len, rows)) / 4


def test_suffix_dedup(spark, data):
    got = {r.doc_id: r for r in QUERIES["op8_suffix_dedup"](spark, data).collect()}
    first: dict[bytes, int] = {}
    raw = {i: t.encode() for i, t in documents().items()}
    for i, b in raw.items():
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        kept = hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(gone.sum()), spans, kept)


def test_within():
    rng = random.Random(2)
    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert all(linededup.within(a, b, k) == (edit_distance(a, b) <= k) for k in (0, 1, 2, 5))
