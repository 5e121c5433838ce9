"""Mined phrases against counting all phrases in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from exceedra.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, longest=5, share=100, top=2000):
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    frequent = {k: v for k, v in count.items() if v >= least}
    rows = {}
    for (lang, ws), a in frequent.items():
        if len(ws) < 2:
            continue
        if any(g == lang and len(x) > len(ws) and 100 * f >= share * a and any(x[i : i + len(ws)] == ws for i in range(len(x) - len(ws) + 1)) for (g, x), f in frequent.items()):
            continue
        best = min((1000 * a * total[lang] // (frequent[lang, ws[:k]] * frequent[lang, ws[k:]]), k) for k in range(1, len(ws)))
        left, right = frequent[lang, ws[: best[1]]], frequent[lang, ws[best[1] :]]
        rows.setdefault(lang, []).append((-best[0], -a, " ".join(ws).encode(), left, right, total[lang]))
    return {(g, i + 1, p.decode(), -a, le, r, n, -s) for g, x in rows.items() for i, (s, a, p, le, r, n) in enumerate(sorted(x)[:top])}


def random_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["Aa", "b", "CC", "dé", "e'", "日", "f", "g-h"]
    fixed = ["one two three four five six", "x y", "Aa  b\tCC"]
    docs = []
    for i in range(n):
        out = []
        for _ in range(rng.randrange(60)):
            out.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]))
        docs.append((i, "".join(out), rng.choice(["en", "de", None])))
    docs += [(n, None, "en"), (n + 1, "", None), (None, "x y x y", "en"), (n + 2, "rare " * 300, "fr"), (n + 2, "rare " * 300, "fr")]
    return docs


SCHEMA = "doc_id long, text string, lang string"


def found(spark, docs, least, **how):
    df = spark.createDataFrame(docs, SCHEMA)
    top, share = how.pop("top", 2000), how.pop("share", 100)
    got = collocations.collocations(collocations.frequent_phrases(df, least=least, **how), top, share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {tuple(r) for r in got.collect()}


@pytest.mark.parametrize(("seed", "least", "how"), [(1, 20, {}), (2, 8, {"sample": 4}), (3, 8, {"sample": 1}), (4, 12, {"bits": 1 << 10}), (5, 15, {"sample": 100_000}), (6, 10, {"share": 80}), (7, 10, {"top": 3})])
def test_equals_counting(spark, seed, least, how):
    """Samples of all, some and no documents, and a filter so small that nearly everything passes."""
    docs = random_docs(seed)
    want = brute([(g, t) for _, t, g in docs], least, share=how.get("share", 100), top=how.get("top", 2000))
    assert want and found(spark, docs, least, **dict(how)) == want


def test_border_failure_is_expanded(spark):
    """A phrase that is in one document alone, which the sample misses, is found with all its parts."""
    docs = [(i, "plain words here", "en") for i in range(64)] + [(1000, "quite unseen phrase of five. " * 50, "en")]
    want = brute([(g, t) for _, t, g in docs], 40)
    assert any(p == "quite unseen phrase of five" for _, _, p, *_ in want)
    assert found(spark, docs, 40, sample=100_000) == want


def test_nothing(spark, nothing, odd):
    assert collocations.collocations(collocations.frequent_phrases(nothing)).count() == 0
    got = collocations.collocations(collocations.frequent_phrases(odd, least=9000)).collect()
    assert {(r.lang, r.phrase, r.a) for r in got} == set() or all(r.a >= 9000 for r in got)


def test_equal_hashes_do_not_merge_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "span_hashes", lambda buf, lo, hi: np.full(len(lo), 7, np.uint64))
    p = collocations.Phrases(pa.array(["en", "en", "de"]), pa.array(["a b a", "b c", "a"]))
    got = {(p.langs[int(p.lang[at])].as_py(), p.texts(np.array([i]))[0].as_py()): int(n) for i, (at, n) in enumerate(zip(p.at, p.count, strict=True))}
    assert got == {("en", "a"): 2, ("en", "b"): 2, ("en", "c"): 1, ("de", "a"): 1}


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 0, "", big), ("en", 1, "a", 2_000_000_000), ("en", 1, "b", 1_000_000_007), ("en", 2, "a b", 999_999_937)]
    df = spark.createDataFrame([(g, p, n, k) for g, k, p, n in rows], "lang string, phrase string, n long, k int")
    r = collocations.collocations(df).first()
    assert r.score == 1000 * 999_999_937 * big // (2_000_000_000 * 1_000_000_007)
