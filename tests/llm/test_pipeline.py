"""The pipeline's stages on odd and empty tables, and on the smallest corpus against plain counts."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from exceedra.llm import decontaminate, mixing, ngramjoin, quality
from support import DATA


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_and_empty(spark, odd, nothing, name, stage):
    got = stage(spark, odd, DATA)
    if name == "shards":
        assert set(got.columns) == set(odd.columns)  # shard and slot are replaced
    else:
        assert got.columns == odd.columns
    rows = got.collect()
    assert all(r["size"] == "x" and r["key"] == "x" and r["fp"] == "x" and r["n"] == "x" and r["th"] == "x" for r in rows)
    assert stage(spark, nothing, DATA).count() == 0


def test_one_of_each_group_stays(spark, odd):
    kept = ids(ngramjoin.keep_one_each(odd))
    assert kept[1] == 1 and kept[2] == 0 and kept[3] == kept[4] == kept[5] == 1 and kept[None] == 1
    twice = odd.filter("doc_id = 2")
    assert ids(ngramjoin.keep_one_each(twice)) == Counter({2: 1})


def test_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = docs.join(quality.judge(docs.select("doc_id", "text", "source")).filter("kept").select("doc_id"), "doc_id", "left_semi").select(docs.columns).cache()
    one = ngramjoin.jaccard_components(good).filter("component_id = doc_id or n_shingles = 0").select("doc_id")
    single = good.join(one, "doc_id", "left_semi").cache()
    leaks = decontaminate.find_passages(single, spark.read.parquet(f"{DATA}/benchmark.parquet")).select("doc_id").distinct()
    clean = single.join(leaks, "doc_id", "left_anti").cache()
    copies = {r["doc_id"]: r["copies"] for r in mixing.placed_documents(clean.select("doc_id", "source", "text")).collect()}
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({i: c for i, c in copies.items() if c})
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
