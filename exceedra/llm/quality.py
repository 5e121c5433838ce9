"""Operator 1: host-level quality rules, DataFrame expressions only.

Every document gets counts over its whole text and a base verdict.  Failures are summed per
host, each host's rate is shrunk towards the corpus with a beta prior whose two parameters
come from the hosts themselves, and hosts whose shrunk rate reaches ``max_host_rate`` lose
all their documents.

Defined cases: a null or blank text has no words and fails the base rule; a null host is a
host of its own; repeated rows and repeated ids each count and each return a row; an empty
table returns no rows; columns of the input other than id, text and host are not looked at,
and :func:`apply_rules` passes all columns on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from exceedra.llm.common import WORD_SPLIT, free_prefix, materialize, read_table, words_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_HOST_RATE = 0.5
SYMBOLS = "[#*$%&|<>]"


def _repeat_words(grams: Column) -> Column:
    """Words inside windows that occur twice or more, from the array of window hashes.

    The windows are sorted with their places; a window equal to a neighbour is repeated, and
    in order of place each repeated window adds the words up to the next one, at most five.
    """
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def covered(sorted_: Column) -> Column:
        def equal(x: Column, i: Column) -> Column:
            before, after = F.get(sorted_, i - 1)["g"] == x["g"], F.get(sorted_, i + 1)["g"] == x["g"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        same = F.filter(sorted_, equal)
        places = F.sort_array(F.transform(same, lambda x: x["i"]))
        return _gaps(places)

    return _let(placed, covered)


def _let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gaps(places: Column) -> Column:
    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda acc, s: acc + s)

    return _let(places, total)


def with_repeats(df: DataFrame, words: str, prefix: str = "") -> DataFrame:
    """Adds ``n`` and ``n_repeat_words``, behind ``prefix``, for the array column ``words``.

    Windows are compared by 64-bit hashes within one document.  Most documents repeat none,
    which a count of distinct hashes shows; only the others are sorted.
    """
    n, hashes, windows = f"{prefix}n", f"{prefix}_hw", f"{prefix}_grams"
    df = df.withColumn(n, F.size(words)).withColumn(hashes, F.when(F.size(words) > WINDOW, F.transform(words, lambda x: F.xxhash64(x))))
    hw = F.col(hashes)
    grams = F.transform(F.sequence(F.lit(0), F.col(n) - WINDOW), lambda i: F.xxhash64(*[F.get(hw, i + j) for j in range(WINDOW)]))
    df = df.withColumn(windows, F.when(F.col(n) > WINDOW, grams))
    g = F.col(windows)
    some = g.isNotNull() & (F.size(F.array_distinct(g)) < F.size(g))
    return df.withColumn(f"{prefix}n_repeat_words", F.when(some, _repeat_words(g)).otherwise(0).cast("long")).drop(hashes, windows)


def base_verdict(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def base_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, host, the counts and ``base_failed``; narrow, no shuffle.

    Lines are compared by 64-bit hashes within one document.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").alias("host"), text.alias("text"))
    one = one.withColumn("w", words_of(F.col("text")))
    one = with_repeats(one, "w")
    w, n = F.col("w"), F.col("n")
    lines = F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, WORD_SPLIT, "")) > 0),
        lambda x: F.xxhash64(x),
    )
    one = one.withColumn("lines", lines)
    out = one.select(
        "doc_id",
        "host",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return out.withColumn("base_failed", base_verdict(F.col("n_words"), F.col("n_repeat_words")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the prior by moments, over hosts weighted by their documents.

    The variance that sampling alone would give is taken off first; where nothing is left
    the hosts do not differ and the prior outweighs any host.
    """
    n, f = F.sum("host_docs"), F.sum("host_failed")
    rate = F.col("host_failed") / F.col("host_docs")
    row = hosts.agg(n.alias("n"), f.alias("f"), F.count("*").alias("k"), F.sum(F.col("host_docs") * rate * rate).alias("sq")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = row["f"] / row["n"]
    spread = mean * (1 - mean)
    between = row["sq"] / row["n"] - mean * mean - spread * row["k"] / row["n"]
    strength = min(max(spread / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)


def host_verdicts(metrics: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and whether the host is rejected.

    Partial sums leave each task with one row per host, so a host with a third of all rows
    costs no more than any other.
    """
    hosts = materialize(metrics.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")))
    a, b = beta_prior(hosts)
    rate = (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") >= max_host_rate)


def judge(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """All metrics and verdicts of ``docs (doc_id, text, source)``, one row per input row."""
    metrics = materialize(base_metrics(docs))
    hosts = host_verdicts(metrics, max_host_rate).withColumnRenamed("host", "h")
    joined = metrics.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def apply_rules(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Pipeline form: the rows of ``docs`` that the rules keep, with all their columns.

    The base verdict is found once and written beside the rows; hosts are summed from it, and
    only rejected hosts are joined.  A null or blank text goes; a null host is one host.
    """
    prefix = free_prefix(docs)
    failed, bad_host = f"{prefix}failed", f"{prefix}host"
    marked = materialize(with_base_verdict(docs, prefix))
    flags = marked.select(F.col("source").alias("host"), F.col(failed).alias("base_failed"))
    bad = materialize(host_verdicts(flags, max_host_rate).filter("host_rejected").select(F.col("host").alias(bad_host)))
    kept = marked.filter(~F.col(failed)).drop(failed)
    if bad.isEmpty():
        return kept
    return kept.join(bad, kept["source"].eqNullSafe(bad[bad_host]), "left_anti")


def with_base_verdict(docs: DataFrame, prefix: str) -> DataFrame:
    """``docs`` with a column ``failed`` behind ``prefix``: the base verdict beside the untouched columns."""
    marked = with_repeats(docs.withColumn(f"{prefix}w", words_of(F.col("text"))), f"{prefix}w", prefix)
    verdict = base_verdict(F.col(f"{prefix}n"), F.col(f"{prefix}n_repeat_words")).alias(f"{prefix}failed")
    return marked.select(*[f"`{c}`" for c in docs.columns], verdict)


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed"
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS pos, words FROM w WHERE len(words) >= 5),
gram AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 4], ' ') AS gram FROM g),
dup AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM gram) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS p FROM dup) GROUP BY doc_id),
line AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
host AS (
  SELECT source, count(*) AS host_docs, count(*) FILTER (WHERE base_failed) AS host_failed FROM v GROUP BY source),
tot AS (
  SELECT sum(host_docs)::DOUBLE AS n, sum(host_failed) / sum(host_docs)::DOUBLE AS mean, count(*) AS k,
         sum(host_docs * pow(host_failed / host_docs::DOUBLE, 2)) AS sq FROM host),
mom AS (SELECT *, mean * (1 - mean) AS spread, sq / n - mean * mean - mean * (1 - mean) * k / n AS btw FROM tot),
prior AS (
  SELECT mean, CASE WHEN btw > 0 THEN least(greatest(spread / btw - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM mom),
verdict AS (
  SELECT host.*, (host_failed + greatest(mean * strength, 1e-3))
         / (host_docs + greatest(mean * strength, 1e-3) + greatest((1 - mean) * strength, 1e-3)) >= 0.5 AS rejected
  FROM host, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept, host_docs::BIGINT AS host_docs, host_failed::BIGINT AS host_failed
FROM v JOIN verdict ON v.source IS NOT DISTINCT FROM verdict.source
"""
