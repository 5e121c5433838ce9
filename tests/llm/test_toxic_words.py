"""Words at the edges of texts and batches."""

from __future__ import annotations

import pyarrow as pa

from exceedra.llm import toxicity


def test_first_word_of_a_batch_counts():
    automaton = toxicity.automaton_of({"stup": 4.0}, ())
    rows = ["stupid words here", "other words", "stupid words here"]
    total, words = toxicity.hits(automaton, pa.array(rows))
    assert total.tolist() == [4.0, 0.0, 4.0] and words.tolist() == [3, 2, 3]
    alone, _ = toxicity.hits(automaton, pa.array(rows[:1]))
    assert alone.tolist() == [4.0]
