"""Chunked encoding against the library, whole text by whole text."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from exceedra.llm import bpechunks
from exceedra.llm.common import local_path, text_buffer

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def spec():
    with open(local_path(bpechunks.VOCABULARY), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


PARTS = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "'ll", "é", "日本", "😀", "<|endoftext|>", "<|endof", "text|>", "1", "23", ".", "!?", "\t", "hello", " world", " ", "Zürich"]


def odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(2500))) for _ in range(120)]
    texts += ["a" * 30000, " " * 30000, "<|endoftext|>" * 900, "é" * 20000, "\n" * 9000 + "x", "'" * 5000, "ab " * 9000, "", "x", "'re" * 4000]
    texts += [" " * rng.randrange(200, 700) + "<|endoftext|>" + " " * rng.randrange(300) for _ in range(60)]
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_equals_library(spec, library, monkeypatch, small):
    if small:
        monkeypatch.setattr(bpechunks, "LEAST", 40)
        monkeypatch.setattr(bpechunks, "MOST", 200)
        monkeypatch.setattr(bpechunks.cut_points, "__defaults__", (64,))
    codec = bpechunks.Codec(spec)
    texts = odd_texts()
    for i in range(0, len(texts), 40):
        part = texts[i : i + 40]
        ids, first = codec.encode(*text_buffer(pa.array(part)))
        for k, text in enumerate(part):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[first[k] : first[k + 1]].tolist() == want
            assert codec.decode(np.array(want, int)) == library.decode(want, skip_special_tokens=False)


def test_copies_are_encoded_once(spec):
    codec = bpechunks.Codec(spec)
    rng = random.Random(2)
    body = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(4000))
    codec.encode(*text_buffer(pa.array([body])))
    once = codec.encoded
    codec.encode(*text_buffer(pa.array(["other start " * 40 + body, body])))
    assert codec.encoded - once < once / 2  # windows at joins and the start


def test_cuts_do_not_depend_on_neighbours():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é日") for _ in range(rng.randrange(6000))) for _ in range(30)]
    buf, offsets = text_buffer(pa.array(texts))
    together = bpechunks.cut_points(buf, offsets).tolist()
    apart = []
    for k, t in enumerate(texts):
        own = bpechunks.cut_points(*text_buffer(pa.array([t])))
        apart += (own + offsets[k]).tolist()
    assert together == apart
    for c in together:
        buf[:c].tobytes().decode("utf-8")  # between characters


def test_rolling_hash_is_of_32_bytes():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 256, 500, np.uint8), rng.integers(0, 256, 500, np.uint8)
    b[200:232] = a[100:132]
    assert bpechunks.rolling_hash(a)[131] == bpechunks.rolling_hash(b)[231]


def test_query_rows(spark, odd, nothing, library):
    path = local_path(bpechunks.VOCABULARY)
    got = bpechunks.encode_documents(odd, path, decoded=True).collect()
    assert len(got) == odd.count() and bpechunks.encode_documents(nothing, path).count() == 0
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, r.text or "")
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == texts[r.doc_id]
    back = bpechunks.decode_documents(bpechunks.encode_documents(odd, path), path)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((r.doc_id or -1, r.decoded) for r in got)


def test_query_digests(spark, data, library):
    from exceedra.llm.bpechunks import op13_bpe_chunks

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op13_bpe_chunks(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_long_text(spark, library):
    """A text of 3 MB is a batch of its own."""
    rng = random.Random(6)
    text = " ".join(rng.choice(["water", "Stein", "l'eau", "日本語", "12"]) + str(rng.randrange(999)) for _ in range(400_000))
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in bpechunks.encode_documents(df, local_path(bpechunks.VOCABULARY), decoded=True).collect()}
    assert got[1].decoded == text and got[2].decoded == "short"
    assert got[1].ids == library.encode(text, add_special_tokens=False).ids
