"""Helpers that test modules share."""

from __future__ import annotations

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(table):
    """Column names, and rows as sorted tuples of text."""
    cols = sorted(table.column_names)
    lists = [table.column(c).to_pylist() for c in cols]
    return cols, sorted(tuple(repr(v) for v in row) for row in zip(*lists, strict=True))
