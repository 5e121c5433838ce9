"""Conversation repair against dynamic programming over all edits, in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from exceedra.llm import dialogue

STARTS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
OWED = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def edit(rows):
    """Least (cost, letters, lines) over all edits; ``rows``: (role, text, must go, truncated)."""

    def inserted(best):
        for _ in range(3):
            for s, (cost, letters, lines) in list(best.items()):
                t, new = OWED[s], (cost + 3, letters + "I", (*lines, NAMES[OWED[s]] + ":"))
                if t not in best or new[:2] < best[t][:2]:
                    best[t] = new
        return best

    best = {"": (0, "", ())}
    for role, text, gone, cut in rows:
        after = {}
        for s, (cost, letters, lines) in inserted(dict(best)).items():
            ways = [(s, cost + 4, letters + "D", lines)]
            if not gone:
                more = 3 if cut else 0
                if role[:1] in STARTS[s]:
                    ways.append((role[:1], cost + more, letters + "K", (*lines, f"{role}:{text}")))
                ways.append((OWED[s], cost + 3 + more, letters + "R", (*lines, f"{NAMES[OWED[s]]}:{text}")))
            for t, *new in ways:
                if t not in after or tuple(new[:2]) < after[t][:2]:
                    after[t] = tuple(new)
        best = after
    return min(v for s, v in inserted(best).items() if s in ("", "a"))


def expected(table):
    """Rows of the contract from (conv_id, turn, role, text)."""
    damaged = {}
    for conv, turn, role, text in table:
        show = lambda x: " " if x is None else str(x)
        role, text = show(role), show(text)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        own = damaged.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))  # noqa: B905
        turns = {t for t, *_ in rows if t is not None}
        cost, letters, lines = edit(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, table, monkeypatch=None, size=dialogue.SEGMENT):
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    turns = dialogue.turns_of(df)
    counts, repaired = dialogue.repair(dialogue.damage(turns), size)
    rows = {r.conv: r for r in counts.collect()}
    sha = {r.conv: r.sha for r in dialogue.text_digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    out = {}
    for conv in {t[0] for t in table}:
        key = " " if conv is None else str(conv)
        r = rows.get(key)
        out[conv] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(key, empty)) if r else (0, 0, 0, 0, 0, 0, "", empty)
    return out


def random_table(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    table = []
    texts = ["Fine.", "Cut off", "", " \t", "Really?", "The same words again!", "ends. \n"]
    for c in range(conversations):
        for t in range(rng.randrange(longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Under", "ü"])
            turn = None if rng.random() < 0.05 else t * rng.choice([1, 1, 2])
            table.append((None if c == 0 else c, turn, role, None if rng.random() < 0.05 else rng.choice(texts) + rng.choice(["", f" {t}."])))
    return table + table[:5]


@pytest.mark.parametrize("size", [dialogue.SEGMENT, 3, 1])
def test_equals_dynamic_programming(spark, size):
    table = random_table(size)
    assert result(spark, table, size=size) == expected(table)


def test_long_conversation(spark):
    """One conversation holds most rows; it is cut into many segments."""
    rng = random.Random(9)
    table = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "Perhaps so.", f"Number {t}."])) for t in range(3000)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Hello.")]
    assert result(spark, table) == expected(table)


def test_many_copies(spark):
    table = [(1, None, "user", "Same.")] * 400 + [(1, 5, "assistant", "Other.")]
    assert result(spark, table) == expected(table)


def test_auction_alone():
    rng = random.Random(2)
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]) for _ in range(rng.randrange(16)))
        rows = [("suat"[c & 3], "x", c >= 8, bool(c & 4) and c < 8) for c in codes]
        cost, letters, _ = edit(rows)
        assert dialogue.repair_codes(codes) == (letters, cost)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    counts, repaired = dialogue.repair(dialogue.turns_of(df))
    assert counts.count() == 0 and repaired.count() == 0


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = expected([tuple(r) for r in rows])
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.op12_auction_repair(spark, data).collect()}
    assert got == want
