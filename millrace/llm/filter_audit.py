"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, and what of that is owed to it.

A document is known by the set of filters that it fails. Let filter i be applied with chance x_i: the expected number
of removed documents is a multilinear polynomial in x, R(x) = sum over the sets T of a_T prod_{i in T} x_i, where a_T
is, with alternating sign, the number of documents that fail all of T. At a corner of the cube R counts what the filters
with x_i = 1 remove, in whatever order, and so every step of every order is a difference of two corners. A filter's
Shapley value is the integral of its partial derivative along the diagonal, the sum of a_T / |T| over the T with i: exact
rationals, whole numbers once they are multiplied by the number of orders.

Only counts by part and set leave the tasks, combined before the shuffle. A copy is told by SHA-256 of the whole
text; equal rows are counted before anything is joined, so a large group of copies is as many rows as it has ids.

Null texts are empty, a null part is the empty one. A document without id is no copy and no original, and has no
labels. Rows that share an id are documents of their own, copies of each other only if their ids differ. A document
with several label rows is good, or toxic, if one of them says so; null labels say nothing. An empty table has no parts.
Of documents doc_id, text and the part are read, of labels doc_id, quality and toxic, whatever other columns there are.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, words

#: What makes a text fail, of the text and its words.
FAILURES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The name of the filter that a document fails whose text a smaller id has too.
COPY = "E"
KINDS = ("n", "good", "toxic")


def distinct_rows(docs: DataFrame, part: str, failures: dict[str, Callable]) -> DataFrame:
    """doc_id, digest, part, mask (bit k: the text fails the k-th filter), n rows; written."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("words", words(F.col("text")))
    mask = F.lit(0)
    for k, fails in enumerate(failures.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0)
    narrow = named.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", mask.alias("mask"))
    return materialize(narrow.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", failures: dict[str, Callable] = FAILURES) -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail just the filters of the mask; the last bit is COPY's."""
    rows = distinct_rows(docs, part, failures)
    says = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias("good" if name == "quality" else name)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic"))
    named = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    flags = [F.coalesce(F.col(c) if c in named.columns else F.lit(False), F.lit(False)).alias(c) for c in ("good", "toxic")]
    labelled = named.select(*rows.columns, *flags).unionByName(rows.where("doc_id IS NULL").select(*rows.columns, *[F.lit(False).alias(c) for c in ("good", "toxic")]))
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = labelled.groupBy(*kind, "doc_id").agg(F.sum("n").alias("n"))
    has_id = F.col("doc_id").isNotNull()
    groups = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("with_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"),
    )
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    originals = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    copies = F.col("with_id") - originals
    copy_bit = 1 << len(failures)
    both = F.array(
        F.struct((F.col("mask") + copy_bit).alias("mask"), copies.alias("n")),
        F.struct(F.col("mask"), (F.col("n") - copies).alias("n")),
    )
    split = groups.join(first, "digest", "left").select("part", "good", "toxic", F.inline(both))
    weighed = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), weighed("good"), weighed("toxic"))


def polynomial(counts: DataFrame, n_filters: int) -> DataFrame:
    """part, t, total (documents, for t = 0 alone), and a_T of the polynomials of n, good and toxic, of mask counts: for
    each set T, as bits, that some document fails all of, and the empty one."""
    parts_of = F.expr(f"filter(sequence(0, {(1 << n_filters) - 1}), t -> mask & t = t)")
    sign = F.expr("CASE WHEN t = 0 THEN 0 WHEN bit_count(t) % 2 = 1 THEN 1 ELSE -1 END")
    failing = counts.select("*", F.explode(parts_of).alias("t")).groupBy("part", "t")
    sums = failing.agg(F.sum("n").alias("total"), *[F.sum(k).alias(k) for k in KINDS])
    return sums.select("part", "t", F.when(F.col("t") == 0, F.col("total")).alias("total"), *[(sign * F.col(k)).alias(k) for k in KINDS])


def corners(terms: DataFrame, n_filters: int) -> DataFrame:
    """part, total and removed, a map from each set of filters to the polynomials where these are applied (1) and
    the others are not (0)."""
    holding = F.expr(f"filter(sequence(0, {(1 << n_filters) - 1}), s -> s & t = t)")
    at = terms.select("*", F.explode(holding).alias("s")).groupBy("part", "s").agg(F.max("total").alias("total"), *[F.sum(k).alias(k) for k in KINDS])
    entries = F.collect_list(F.struct("s", F.struct(*KINDS)))  # 2 ^ n_filters of them
    return at.groupBy("part").agg(F.max("total").alias("total"), F.map_from_entries(entries).alias("removed"))


def shapley(terms: DataFrame, n_filters: int) -> DataFrame:
    """part and shapley, a map from each filter that removes something to the integral of its partial derivative from 0
    to 1 along the diagonal, times the number of orders."""
    # the derivative of a term has |T| - 1 factors; the orders are a multiple of every |T|
    weights = [factorial(n_filters) * Fraction(1, size) for size in range(1, n_filters + 1)]
    weight = F.element_at(F.array(*[F.lit(w.numerator) for w in weights if w.denominator == 1]), F.expr("bit_count(t)").cast("int"))
    own = F.expr(f"filter(sequence(0, {n_filters - 1}), i -> shiftright(t, i) & 1 = 1)")
    each = terms.where("t > 0").select("part", (F.col("n") * weight).alias("v"), F.explode(own).alias("i")).groupBy("part", "i").agg(F.sum("v").alias("v"))
    return each.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("shapley"))


def steps(letters: str) -> list[dict]:
    """Each step of each order: the filters before it as bits, and its own filter's number."""
    out = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": "".join(letters[k] for k in order), "step": step, "before": before, "filter": i})
            before |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", failures: dict[str, Callable] = FAILURES) -> DataFrame:
    """part, filter_order, step and the counts of the step: kept (after it), removed (by it), redundant (fail its
    filter, removed before), unique_fails (fail its filter alone), good_lost and toxic_lost (of the removed), and
    shapley (what the filter removes, summed over all orders)."""
    letters, n = "".join([*failures, COPY]), len(failures) + 1
    terms = materialize(polynomial(mask_counts(docs, labels, part, failures), n))
    known = corners(terms, n).join(shapley(terms, n), "part", "left")
    table = F.from_json(F.lit(json.dumps(steps(letters))), "array<struct<filter_order: string, step: int, before: int, filter: int>>")
    rows = known.select("*", F.inline(table)).withColumn("bit", F.expr("shiftleft(1, filter)"))
    removed = lambda s: F.element_at("removed", s)
    all_ = F.lit((1 << n) - 1)
    at = rows.select(
        "*",
        removed(F.col("before")).alias("was"),
        removed(F.col("before") + F.col("bit")).alias("now"),
        removed(F.col("bit")).alias("own"),
        (removed(all_)["n"] - removed(all_ - F.col("bit"))["n"]).alias("unique_fails"),
    )
    gone = lambda k: F.col(f"now.{k}") - F.col(f"was.{k}")
    return at.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("now.n")).alias("kept"),
        gone("n").alias("removed"),
        (F.col("own.n") - gone("n")).alias("redundant"),
        "unique_fails",
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.coalesce(F.try_element_at("shapley", F.col("filter")), F.lit(0)).cast("long").alias("shapley"),
    )
