"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times that one of its documents must appear for the source to get
its target share of the characters. A document's count inverts the Poisson distribution with that mean at
a uniform number taken from a hash of seed and document (doc_id, source and text), so it does not depend on
partitions or retries, and documents without id draw each for themselves. Copies are exploded and dealt to
partitions by a second hash: a global shuffle without a hot key and without sampling.

A null source is a source of its own; null texts have no characters, and read as empty in the hash; a source
without characters keeps rate 1; a source that weights does not name has weight 0. Texts are hashed whole,
however long. Rows that agree in doc_id, source and text are replicated each, with equal counts; ties in the
order key are ordered by doc_id and copy. An empty table gives an empty result. mix() keeps all columns, and
names its two own with more underscores where docs has columns of these names, such as its own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, materialize, spare

#: A rate above this is the sum of several Poisson numbers, as exp(-rate) must not vanish.
MOST_AT_ONCE = 500.0
ORDER_BITS = 60


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, total: int | None = None) -> DataFrame:
    """source, n_docs, n_chars, rate: a row per source, written to the shared folder. Without weights, a
    source's weight is its share of the characters to the power alpha. total: characters wanted, those of
    docs if None."""
    sums = materialize(
        docs.groupBy("source").agg(
            F.count("*").alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("n_chars")
        )
    )
    if weights is None:
        weight = F.pow(F.col("n_chars").cast("double"), F.lit(alpha))
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else None
        weight = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    named = sums.withColumn("w", F.when(F.col("n_chars") > 0, weight).otherwise(0.0))
    wanted = F.lit(total) if total is not None else named.agg(F.sum("n_chars")).scalar()
    share = F.try_divide("w", named.agg(F.sum("w")).scalar())
    rate = F.when(F.col("n_chars") > 0, share * wanted / F.col("n_chars")).otherwise(1.0)
    return materialize(named.select("source", "n_docs", "n_chars", F.coalesce(rate, F.lit(0.0)).alias("rate")))


def identity(doc_id: Column, source: Column, text: Column) -> Column:
    """The MD5 of what a document is."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, source, text)]))


def digits(name: Column, n: int) -> Column:
    """The number that the first n hexadecimal digits of the MD5 of name make."""
    return F.conv(F.substring(F.md5(name), 1, n), 16, 10).cast("long")


def uniform(seed: int, of: Column, piece: Column) -> Column:
    """[0, 1) from 52 bits."""
    return digits(F.concat_ws("|", F.lit(f"count {seed}"), of, piece.cast("string")), 13) / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """The cumulated Poisson probabilities of 0, 1, ... up to where nothing is left in a double."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    first = F.exp(-rate)
    run = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda acc, k: F.struct(
            (acc.p * rate / k).alias("p"), F.concat(acc.cdf, F.array(F.element_at(acc.cdf, -1) + acc.p * rate / k)).alias("cdf")
        ),
    )
    return run.cdf


def order_key(seed: int, of: Column, copy: Column) -> Column:
    return digits(F.concat_ws("|", F.lit(f"order {seed}"), of, copy.cast("string")), ORDER_BITS // 4)


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    total: int | None = None,
    seed: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """docs with __copy (1, 2, ...) and __key, each row as often as its count, in the global order of __key."""
    copy_no, key, host, cdf, pieces, of, draws, n = spare(docs, "__copy", "__key", "__source", "__cdf", "__pieces", "__of", "__draws", "__n")
    at_once = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_AT_ONCE)).cast("int")
    table = rates(docs.select("source", "text"), weights, alpha, total).select(F.col("source").alias(host), "rate", at_once.alias(pieces))
    table = table.withColumn(cdf, distribution(F.col("rate") / F.col(pieces))).drop("rate")
    named = docs.withColumn(of, identity(F.col("doc_id"), F.col("source"), F.col("text")))
    joined = named.join(table, named["source"].eqNullSafe(F.col(host)), "left")
    # a draw for each piece, then the place of each draw in the distribution
    drawn = joined.withColumn(draws, F.transform(F.sequence(F.lit(1), F.col(pieces)), lambda piece: uniform(seed, F.col(of), piece)))
    count = F.aggregate(draws, F.lit(0), lambda sum_, u: sum_ + F.size(F.filter(cdf, lambda c: c <= u)))
    copies = (
        drawn.withColumn(n, count)
        .where(F.col(n) > 0)
        .select(*columns_of(docs), of, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_no))
        .select(*columns_of(docs), copy_no, order_key(seed, F.col(of), F.col(copy_no)).alias(key))
    )
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col(key) / F.lit(float(1 << ORDER_BITS)) * parts).cast("int")
    return copies.repartitionById(parts, F.least(place, F.lit(parts - 1))).sortWithinPartitions(key, "doc_id", copy_no)
