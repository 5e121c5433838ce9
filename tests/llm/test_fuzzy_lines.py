"""Line deduplication against edit distance alone: nothing else goes, and nearly all of it does."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from support import DATA
from exceedra.llm import linededup


def compared(line):
    """Lower-case letters, marks and numbers, ASCII digits as 0, single spaces between."""
    out = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LMN" else " " for c in line)
    return " ".join("".join("0" if c in "0123456789" else c for c in out).split(" ")).strip() if out.strip() else ""


def test_within_agrees_with_the_table_of_edit_distances():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        for limit in (0, 1, 3, 8):
            assert linededup.within(a, b, limit) == (row[-1] <= limit)


def test_many_pairs_at_once_agree_with_one_at_a_time():
    rng = random.Random(5)
    pairs = [("", "aaaaaaaaaa"), ("a", "a"), ("b", "a")]
    for n in (3, 10, 40, 150, 500, 3_500):
        for _ in range(60 if n < 1_000 else 4):
            a = "".join(rng.choice("abcdé漢 ") for _ in range(n))
            b = list(a)
            for _ in range(rng.randint(0, max(1, n // 6))):
                p = rng.randrange(len(b))
                b[p : p + 1] = rng.choice([[], ["x"], [b[p], "y"]]) or ["z"]
            a, b = sorted((a, "".join(b)), key=len)
            if len(b) - len(a) <= len(b) // 10:
                pairs.append((a, b))
    want = [linededup.within(a, b, len(b) // 10) for a, b in pairs]
    assert linededup.all_within(pairs).tolist() == want
    assert 0 < sum(want) < len(want)


def removed_by_brute_force(texts):
    """Lines of each text that go, if every pair of different lines is held against the edit budget."""
    lines = [(i, c) for i, t in sorted(texts.items()) for line in t.split("\n") if (c := " ".join(compared(line).split()))]
    keys = sorted({t for _, t in lines}, key=len)
    letters = [{c: t.count(c) for c in set(t)} for t in keys]
    parent = list(range(len(keys)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for j, t in enumerate(keys):
        budget, i = len(t) // 10, j - 1
        while budget and i >= 0 and len(t) - len(keys[i]) <= budget:
            x, y = letters[i], letters[j]
            if sum(max(y[c] - x.get(c, 0), 0) for c in y) <= budget and linededup.within(keys[i], t, budget):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            i -= 1
    group, seen, removed = {t: root(k) for k, t in enumerate(keys)}, set(), dict.fromkeys(texts, 0)
    for i, t in lines:
        removed[i] += group[t] in seen
        seen.add(group[t])
    return removed


def edited(rng, text, edits):
    out = list(text)
    for p in sorted(rng.sample(range(1, len(out) - 1), edits), reverse=True):
        out[p : p + 1] = rng.choice([[], ["q"], [out[p], "x"]])
    return "".join(out)


def held(spark, texts):
    got = linededup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = removed_by_brute_force(texts)
    assert all(r.n_removed <= want[r.doc_id] for r in got)
    return sum(r.n_removed for r in got) / sum(want.values())


def test_few_edits_are_found(spark):
    """One edit in 50 characters, at least one: recall 0.98 or more."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = {}
    for i in range(150):
        base = words(rng.choice([5, 8, 12, 20, 40, 80, 200]))
        texts[2 * i], texts[2 * i + 1] = base, edited(rng, base, max(1, len(base) // 50))
    assert held(spark, texts) >= 0.98


def test_many_edits_are_mostly_found(spark):
    """One edit in 20 characters: recall 0.8 or more; a tenth of a long line is beyond the keys (see README)."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = {}
    for i in range(150):
        base = words(rng.choice([5, 8, 12, 20, 40, 80]))
        texts[2 * i], texts[2 * i + 1] = base, edited(rng, base, max(1, len(base) // 20))
    assert held(spark, texts) >= 0.8


def test_a_large_group_of_near_copies_keeps_one(spark):
    rng = random.Random(13)
    base = "the quick brown fox jumps over the lazy dog near the river bank while seven bright stars shine above it all tonight"
    texts = {0: base} | {i: edited(rng, base, rng.randint(1, 4)) for i in range(1, 1500)}
    got = linededup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in got) >= 1497


def test_short_equal_lines_go(spark):
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(spark.createDataFrame([(1, "ok"), (2, "OK!\nno"), (3, "...")], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_corpus_lines_by_edit_distance_alone(spark, data):
    t = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = {r.doc_id: r.n_removed for r in linededup.op10_fuzzy_lines(spark, data).collect()}
    want = removed_by_brute_force({i: x or "" for i, x in zip(t["doc_id"], t["text"], strict=True)})
    assert all(n <= want[i] for i, n in got.items())
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_keys_are_not_stored_before_their_exchange(spark, data, monkeypatch):
    stored, keep = [], linededup.materialize

    def recorded(df, *args):
        stored.append(df.columns)
        return keep(df, *args)

    monkeypatch.setattr(linededup, "materialize", recorded)
    docs = spark.createDataFrame([(1, "One line of some words here.\n77 others"), (2, "One line of some wards here."), (3, "One line of some words here."), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: (r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert rows == {1: (2, 0), 2: (1, 1), 3: (1, 1), 4: (1, 0)}
    assert stored and not any("bucket" in columns for columns in stored)


def test_equal_grams_at_far_places_make_no_members(spark):
    """A q-gram that two lines hold further apart than their budget leads to no texts and no comparison; near copies stay."""
    rng = random.Random(14)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    far, near = [], []
    for _ in range(20):
        shared = letters(90)
        far += [shared + letters(110), letters(110) + shared]
        near += [(base := letters(200)), base[:100] + "z" + base[101:]]

    def members(texts):
        docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, th long, text string")
        return linededup.block_members(linededup.line_blocks(docs, 4, 2), 4, 2).filter("block is not null").select("h").distinct().count()

    assert members(far) == 0
    assert members(near) == 40


def test_more_lines_do_not_soon_mean_more_keys():
    assert [linededup.blocks_for(n) for n in (1_000, 5_000_000, 100_000_000)] == [4, 4, 4]


def test_texts_go_only_where_a_link_can_be_made(spark, monkeypatch, tmp_path):
    """Equal beginnings of lines of other letters lead to no texts; a pair of near copies gets them in one of its common blocks."""
    rng = random.Random(15)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for _ in range(20):
        shared, base = some("abcdefghijklmnop", 60), some("abcdefghijklmnop", 200)
        texts += [shared + some("abcdefgh", 140), shared + some("ijklmnop", 140), base, base[:100] + "z" + base[101:]]
    folder, links = str(tmp_path), linededup.block_links

    def counted(table):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(table.num_rows))
        return links(table)

    monkeypatch.setattr(linededup, "block_links", counted)
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed} == {4 * k + 3 for k in range(20)}
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 40


def test_members_that_stay_are_those_of_a_possible_pair():
    """Cells of all kinds, held against each pair of their members."""
    rng = random.Random(16)
    draw = np.random.default_rng(16)
    rows = []
    for cell in range(60):
        base = draw.integers(0, 256, 2 * linededup.BINS)
        for _ in range(rng.choice([2, 3, 10, 60])):
            sign = base.copy()
            kind = rng.random()
            sign[draw.random(len(sign)) < (0.0 if kind < 0.2 else 0.95)] = rng.randrange(256)
            earlier = sorted(rng.sample(range(40), rng.choice([0, 0, 1, 3])))
            rows.append((cell, len(rows), 1, rng.choice([0, 0, 1, 2]), earlier, rng.randint(30, 300), *sign.astype(np.uint8).view(np.int64).tolist()))
    names = ["cell", "h", "n", "side", "earlier", "size", *linededup.SIGNATURE]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), *[pa.int64()] * 4]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    sign = np.array([r[6:] for r in rows], np.int64).view(np.uint8)
    want = set()
    for x in rows:
        for y in rows[: x[1]]:
            if x[0] == y[0] and (x[3] != y[3] or x[3] == 0) and not set(x[4]) & set(y[4]):
                i, j = [x[1]], [y[1]]
                if linededup.can_link(sign[i], sign[j], np.array([x[5]]), np.array([y[5]]))[0]:
                    want |= {x[1], y[1]}
    got = linededup.linked_members(table).column("h").to_pylist()
    assert len(got) == len(set(got)) and set(got) == want
    assert 50 < len(want) < len(rows) - 50


def test_rounds_lose_no_link(spark, data, monkeypatch):
    """Signatures and texts dealt in many rounds: the same rows, and less dealt at a time."""
    digest = lambda: sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in linededup.op10_fuzzy_lines(spark, data).collect())
    sizes, keep = [], linededup.in_rounds

    def counted(rounds, *args):
        rounds = list(rounds)
        sizes.append([df.count() for df in rounds])
        return keep(iter(rounds), *args)

    want = digest()
    for name, value in (("LEAST_ROUND", 60), ("MEMBER_BYTES", 1 << 40), ("MEMBER_TEXT_BYTES", 1 << 40)):
        monkeypatch.setattr(linededup, name, value)
    monkeypatch.setattr(linededup, "free", lambda df: None)
    monkeypatch.setattr(linededup, "in_rounds", counted)
    assert digest() == want
    assert len(sizes) == 2 and all(len(x) > 1 and max(x) < 0.8 * sum(x) for x in sizes)
