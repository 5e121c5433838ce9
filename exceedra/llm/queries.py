"""Queries of the corpus operators and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from exceedra.llm import bpechunks, collocations, decontaminate, dialogue, linededup, mixing, ngramjoin, quality, sharding, suffixdedup, tokencount, tokenids, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_quality": quality.op1_host_quality,
    "op2_ngram_jaccard": ngramjoin.op2_ngram_jaccard,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_packed_ids": tokenids.op4_packed_ids,
    "op5_curriculum_mix": mixing.op5_curriculum_mix,
    "op6_toxic_lexicon": toxicity.op6_toxic_lexicon,
    "op7_histogram_shards": sharding.op7_histogram_shards,
    "op8_suffix_dedup": suffixdedup.op8_suffix_dedup,
    "op9_token_counts": tokencount.op9_token_counts,
    "op10_fuzzy_lines": linededup.op10_fuzzy_lines,
    "op11_toivonen_phrases": collocations.op11_toivonen_phrases,
    "op12_auction_repair": dialogue.op12_auction_repair,
    "op13_bpe_chunks": bpechunks.op13_bpe_chunks,
}

ORACLE_SQL: dict[str, str] = {
    "op1_host_quality": quality.SQL,
    "op2_ngram_jaccard": ngramjoin.SQL,
    "op5_curriculum_mix": mixing.SQL,
    "op11_toivonen_phrases": collocations.SQL,
    "op12_auction_repair": dialogue.SQL,
}
