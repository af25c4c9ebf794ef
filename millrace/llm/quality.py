"""Quality rules with host verdicts, in DataFrame functions alone.

Per document: counts and two base rules. Per host (the column source): the share of documents that
fail, shrunk towards the corpus by a beta prior whose strength is fitted to the spread between hosts.
Documents of a host whose shrunk share is above max_rate are rejected too.

Null texts have no words and fail; a null host is a host of its own; repeated rows count each. Texts are read
whole, however long; equal windows are told by 64-bit hashes, which confuse two of the windows of a text of n
words with a chance of n * n / 2 ** 65 (20,000 words: 1 in 10 ** 11). A rate of just max_rate (a tie) is kept.
An empty table gives an empty result. Only the named columns are read, so extra columns can't clash;
keep_good() gives back all columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import once
from millrace.llm.common import columns_of, materialize, spare, words

WINDOW = 5
#: Bounds of the prior's strength in documents, and its value where hosts show no spread.
LEAST_STRENGTH, MOST_STRENGTH, PLAIN_STRENGTH = 1.0, 1000.0, 10.0


def _window_hashes(w: Column) -> Column:
    """A hash of each WINDOW words: words are hashed once, then two neighbours, two pairs, and the fifth word to them,
    each a pass over the whole array, so that the work grows with the text."""
    after = lambda c, k: F.slice(c, k + 1, F.size(c))
    join = lambda a, b: F.xxhash64(a, b)
    one = F.transform(w, lambda x: F.xxhash64(x))

    def five(h: Column) -> Column:
        two = F.zip_with(h, after(h, 1), join)
        return once(two, lambda two: F.zip_with(F.zip_with(two, after(two, 2), join), after(h, 4), join))

    whole = once(one, lambda h: F.slice(five(h), 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))
    return F.when(F.size(w) >= WINDOW, whole).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort (hash, start), keep the starts
    that have an equal neighbour, and add up min(WINDOW, gap to the previous start)."""
    pairs = F.sort_array(F.transform(hashes, lambda h, j: F.struct(h.alias("h"), j.alias("j"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,j:int>"))

    def repeated(p: Column) -> Column:
        after, before = F.concat(F.slice(p, 2, F.size(p)), none), F.concat(none, F.slice(p, 1, F.size(p) - 1))
        seen = F.zip_with(p, after, lambda x, y: F.struct(x.h.alias("h"), x.j.alias("j"), x.h.eqNullSafe(y.h).alias("twice")))
        return F.sort_array(F.array_compact(F.zip_with(seen, before, lambda x, y: F.when(x.twice | x.h.eqNullSafe(y.h), x.j))))

    starts = once(pairs, repeated)
    total = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, j: F.struct(j.alias("last"), (acc.n + F.least(F.lit(WINDOW), j - acc.last)).alias("n")),
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total.n).otherwise(F.lit(0))


def base_failed(n_words: Column, n_repeat_words: Column, min_words: int, max_repeat_percent: int) -> Column:
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat_percent * n_words)


def measure(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """doc_id, source and the counts of each row of docs (doc_id, text, source); null text: zeros."""
    split = docs.select("doc_id", "source", "text", words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        "doc_id",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")), F.lit(0)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        _window_hashes(F.col("w")).alias("hashes"),
    ).select(
        "doc_id",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        _covered(F.col("hashes")).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn(
        "base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat_percent)
    )


def host_verdicts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """source, host_docs, host_failed, host_rate (shrunk), host_rejected: a row per host, written to the shared folder."""
    hosts = materialize(
        measured.groupBy("source").agg(
            F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
        )
    )
    prior = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
        F.var_samp(F.col("host_failed") / F.col("host_docs")).alias("v"),
    ).select(
        "m",
        F.when(
            F.col("v") > 0,
            F.greatest(
                F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)
            ),
        )
        .otherwise(F.lit(PLAIN_STRENGTH))
        .alias("s"),
    )
    rate = (F.col("host_failed") + prior.select(F.col("m") * F.col("s")).scalar()) / (
        F.col("host_docs") + prior.select("s").scalar()
    )
    return materialize(
        hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > F.lit(max_rate))
    )


def judge(docs: DataFrame, max_rate: float = 0.5, **rules) -> DataFrame:
    """measure() of each row, with the host's rate and the verdict kept."""
    measured = materialize(measure(docs, **rules))
    hosts = host_verdicts(measured, max_rate).withColumnRenamed("source", "host")
    return measured.join(hosts, measured.source.eqNullSafe(hosts.host), "left").select(
        *measured.columns, "host_rate", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept")
    )


def keep_good(docs: DataFrame, max_rate: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """The rows of docs that are kept, with all columns. The base rules are evaluated once, on the way to a
    table in the shared folder; host counts read its two short columns, and the rejected hosts come back."""
    w, hashes, failed, host = spare(docs, "__w", "__h", "__failed", "__host")
    columns = columns_of(docs)
    one = docs.withColumn(w, words(F.col("text"))).withColumn(hashes, _window_hashes(F.col(w)))
    verdict = base_failed(F.size(w), _covered(F.col(hashes)), min_words, max_repeat_percent)
    judged = materialize(one.select(*columns, verdict.alias(failed)))
    hosts = host_verdicts(judged.select("source", F.col(failed).alias("base_failed")), max_rate)
    bad = hosts.where("host_rejected").select(F.col("source").alias(host))
    good = judged.where(~F.col(failed))
    return good.join(bad, good["source"].eqNullSafe(bad[host]), "left_anti").select(*columns)
