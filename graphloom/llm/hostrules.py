"""Host-level quality rules: shrunken failure rates of whole hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import count_of, has_word, let, materialize, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"


def repeated_window_words(words: Column, width: int = 5) -> Column:
    """How many words stand in windows of `width` words that occur twice or more, all in the row's own array.

    Windows are compared by a 64-bit hash of their words: sorted by (hash, start), equal
    neighbours are repeats; the starts found, sorted again, cover words as intervals.
    """

    def covered(starts: Column) -> Column:
        gap = lambda s, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1) - s, F.lit(width)))
        return F.aggregate(F.transform(starts, gap), F.lit(0), lambda a, x: a + x)

    def repeats(sorted_: Column) -> Column:
        def keep(x: Column, i: Column) -> Column:
            h = x["h"]
            return F.coalesce(F.get(sorted_, i + 1)["h"] == h, F.lit(False)) | F.coalesce((i > 0) & (F.get(sorted_, F.greatest(i - 1, F.lit(0)))["h"] == h), F.lit(False))

        return let(F.array_sort(F.transform(F.filter(sorted_, keep), lambda x: x["s"])), covered)

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.cast("int").alias("s")))
        return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(let(F.sort_array(hashed), repeats))

    return let(words, windows)


def base_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the base figures of each row of docs."""
    raw = docs.select("doc_id", F.col(host).alias("host"), text_or_empty().alias("t"))
    raw = raw.select("doc_id", "host", "t", words_of(F.col("t")).alias("words"))
    lines = F.filter(F.split("t", "\n"), has_word)
    out = raw.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(base: DataFrame, limit: float = 0.5) -> DataFrame:
    """One row per host: docs, failures, its rate shrunk by a beta prior fitted to all hosts, and host_ok.

    The prior's mean is the share of failures over all documents; its weight comes from
    the spread of the hosts' rates (method of moments), bounded to 1 to 10,000. A null
    host is a host like any other.
    """
    per = base.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    prior = per.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
    ).select("m", F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), F.coalesce(F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1), F.lit(10_000.0)))).alias("weight"))
    shrunk = (F.col("host_failed") + F.col("m") * F.col("weight")) / (F.col("host_docs") + F.col("weight"))
    return per.join(F.broadcast(prior)).select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= limit).alias("host_ok"))


def host_rules(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """Base figures of every row and its verdict: kept if it passes itself and its host's shrunken failure rate is at most `limit`.

    Null text counts as no words (it fails); a null host is one host; repeated rows count
    each; an empty table gives an empty one; other columns are ignored. Failures are
    summed by host before any shuffle, and only one row per host is joined back.
    """
    base = materialize(base_rules(docs, host), "hostbase")
    verdict = materialize(host_verdicts(base, limit), "hosts")
    key = lambda d: d.select("*", F.coalesce("host", F.lit("")).alias("hk"), F.col("host").isNull().alias("hn"))
    met = key(base).join(key(verdict).drop("host"), ["hk", "hn"], "left")
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"), F.col("host"), "host_docs", "host_rate")
