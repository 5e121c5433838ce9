"""Passages whose edits lie at the item's edges."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from exceedra.llm import decontaminate


@pytest.mark.parametrize(("insert_at", "first"), [(1, 4), (4, 7), (96, 28), (99, 28)])
def test_insertion_at_the_edge_of_the_budget(insert_at, first):
    rng = random.Random(insert_at)
    for _ in range(8):
        item = "".join(rng.choice("abcdefghijklmnop") for _ in range(100))
        out = list(item)
        for p in range(first, first + 72, 8):
            out[p] = "z"
        text = "".join(out[:insert_at]) + "y" + "".join(out[insert_at:])
        index = decontaminate.Index([(5, item)])
        for offset in range(int(index.parts[0].edit[0]) + 1):
            for tail in ("", " " + "q" * 40):
                hits = decontaminate.scan(index, pa.array(["x" * offset + text + tail]))
                assert [(h[1], h[4]) for h in hits] == [(5, 10)], (offset, tail)
