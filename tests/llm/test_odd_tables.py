"""Every operator on odd rows and on an empty table."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from exceedra.llm import decontaminate, linededup, mixing, ngramjoin, quality, sharding, suffixdedup, tokencount, tokenids, toxicity
from exceedra.llm.common import local_path, materialize


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


OPS = {
    "quality": lambda d, i, t: quality.judge(d),
    "ngrams": lambda d, i, t: ngramjoin.jaccard_components(d),
    "ids": lambda d, i, t: tokenids.read_files(materialize(tokenids.encode_files(d, local_path(tokenids.VOCABULARY)))),
    "mix": lambda d, i, t: mixing.first_position(mixing.placed_documents(d)),
    "toxic": lambda d, i, t: toxicity.score(d, t),
    "shards": lambda d, i, t: sharding.shard_documents(d),
    "suffix": lambda d, i, t: suffixdedup.remove_repeats(d),
    "tokens": lambda d, i, t: tokencount.count_tokens(d, local_path(tokencount.VOCABULARY)),
    "lines": lambda d, i, t: linededup.dedup_lines(d),
}


@pytest.mark.parametrize("name", OPS)
def test_every_row_returns(name, odd, nothing, items, labels):
    assert ids(OPS[name](odd, items, labels).collect()) == ids(odd.collect())
    assert OPS[name](nothing, items, labels).count() == 0


def test_quality(odd):
    got = by_id(quality.judge(odd))
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[1].n_words == 22 and not got[1].base_failed
    assert got[9].n_dup_lines == 1 and got[9].n_repeat_words == 20 and got[9].base_failed
    assert got[7].n_repeat_words == got[7].n_words == 9000


def test_quality_filter_agrees(odd):
    want = Counter(r["doc_id"] for r in quality.judge(odd).collect() if r["kept"])
    kept = quality.apply_rules(odd)
    assert kept.columns == odd.columns and ids(kept.collect()) == want


def test_bad_host_loses_its_documents(spark):
    rows = [(i, "word " * 4, "bad") for i in range(50)] + [(50, "twelve quite different words that no rule at all would ever reject here", "bad")]
    rows += [(100 + i, f"twelve quite different words that no rule {i} at all would ever reject", "good") for i in range(60)]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not got[50].base_failed and not got[50].kept and got[100].kept


def test_components(odd):
    got = by_id(ngramjoin.jaccard_components(odd))
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3 and got[3].n_shingles == 0
    assert got[6].n_shingles == 1 and got[7].n_shingles == 1 and got[None].component_id is None


def test_mix(odd):
    rows = mixing.placed_documents(odd).collect()
    sizes = {r["source"]: r["source_size"] for r in rows}
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(sum(sizes.values()))
    assert all(r["target"] <= 3 * r["source_size"] and r["copies"] <= 3 for r in rows)
    assert mixing.mix_documents(odd).columns == odd.columns


def test_shards(odd):
    rows = sharding.shard_documents(odd, 4).collect()
    for s in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_passages(odd, nothing, items):
    got = decontaminate.find_passages(odd, items).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == {(1, 1, 0), (2, 1, 0)}
    left = decontaminate.drop_contaminated(odd, items)
    assert left.columns == odd.columns and ids(left.collect()) == ids(odd.filter("doc_id is null or doc_id > 2").collect())
    assert decontaminate.find_passages(nothing, items).count() == 0
    assert decontaminate.find_passages(odd, items.limit(0)).count() == 0


def test_suffix(odd):
    rows = suffixdedup.remove_repeats(odd, keep_bytes=True).collect()
    twos = [r for r in rows if r["doc_id"] == 2]
    assert all(r["n_removed"] == r["n_bytes"] and r["n_spans"] == 1 and r["kept"] == b"" for r in twos) and len(twos) == 2
    one = next(r for r in rows if r["doc_id"] == 1)
    assert one["n_removed"] == 0 and one["kept_sha256"] == hashlib.sha256(bytes(one["kept"])).hexdigest()


def test_lines(odd):
    got = by_id(linededup.dedup_lines(odd, keep_text=True))
    assert got[9].n_removed == 1 and got[9].kept == "same line that is long enough to compare with others"
    assert got[5].n_removed == 0 and got[1].n_removed == 0 and got[2].n_removed == 1


def test_no_toxic_label(odd, labels):
    got = toxicity.score(odd, labels.filter("toxic = 0")).select(F.max("score")).first()[0]
    assert got == 0.0


def test_stages_with_the_names_they_use(odd):
    """Columns named like the temporary ones of the stages pass through untouched, and reruns agree on repeated rows."""
    named = odd.withColumns({c: F.lit("own") for c in ("_m_t", "_m_k", "_m_key", "_x_t", "_x_k", "_x_size", "_one_id", "_one_th", "_x_id", "_x_th")})
    mixed = mixing.mix_documents(named)
    assert mixed.columns == named.columns and {r["_m_t"] for r in mixed.collect()} == {"own"}
    first, again = (Counter(map(str, mixing.mix_documents(odd).collect())) for _ in range(2))
    assert first == again
    kept = ngramjoin.keep_one_each(named)
    assert kept.columns == named.columns and {r["_one_id"] for r in kept.collect()} == {"own"}
