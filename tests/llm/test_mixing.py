import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import mixing


def brute_count(row, rate, seed=0):
    name = hashlib.md5("|".join("" if x is None else str(x) for x in (row.doc_id, row.source, row.text)).encode()).hexdigest()
    n, pieces = 0, max(1, math.ceil(rate / 500))
    for piece in range(1, pieces + 1):
        u = int(hashlib.md5(f"count {seed}|{name}|{piece}".encode()).hexdigest()[:13], 16) / 2**52
        p = total = math.exp(-rate / pieces)
        k = 0
        while total <= u and k < rate / pieces + 12 * math.sqrt(rate / pieces) + 40:
            k += 1
            p *= rate / pieces / k
            total += p
            n += 1
    return n


def test_counts_against_brute_force(spark, docs):
    rates = {r.source: r.rate for r in mixing.rates(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    expected = {r.doc_id: brute_count(r, rates[r.source]) for r in docs.collect()}
    assert got == Counter({k: v for k, v in expected.items() if v})


def test_shares_meet_the_target_weights(spark):
    rows = [(i, "x" * 50, "ab"[i % 10 == 0]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = Counter(r.source for r in mixing.mix(df, {"a": 1.0, "b": 3.0}).select("source").collect())
    assert abs(mixed["b"] / (mixed["a"] + mixed["b"]) - 0.75) < 0.01
    assert abs(sum(mixed.values()) / 20_000 - 1) < 0.05


def test_large_rates_are_split(spark):
    rows = [(1, "xx", "small")] + [(i, "y" * 100_000, "large") for i in range(2, 42)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = {r.source: r.rate for r in mixing.rates(df, {"small": 1.0, "large": 1999.0}).collect()}
    n = mixing.mix(df, {"small": 1.0, "large": 1999.0}).where("source = 'small'").count()
    assert 900 < table["small"] < 1100
    assert n == brute_count(df.where("doc_id = 1").first(), table["small"]) and abs(n - table["small"]) < 200


def test_global_order_and_repeatability(spark, docs):
    first = [(r["__key"], r.doc_id, r["__copy"]) for r in mixing.mix(docs, partitions=3).collect()]
    assert first == sorted(first)
    assert sorted((r["__key"], r.doc_id, r["__copy"]) for r in mixing.mix(docs.repartition(7), partitions=5).collect()) == first


def test_edges(spark, edge_docs, no_docs):
    mixed = mixing.mix(edge_docs)
    assert mixed.columns == [*edge_docs.columns, "__copy", "__key"]
    twos = Counter(r.doc_id for r in mixed.collect())
    assert twos[2] % 2 == 0
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(edge_docs, {}).where("source = 's1'").count() == 0


def test_rows_without_id_draw_each_for_themselves(spark):
    rows = [(None, f"text {i} of many", "s") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, {"s": 1.0}, partitions=8)
    counts = Counter(r.text for r in mixed.collect())
    assert abs(sum(counts.values()) - 4000) < 250 and 0.33 < 1 - len(counts) / 4000 < 0.41  # a Poisson share of exp(-1) is left out
    assert min(Counter(r.p for r in mixed.select(F.spark_partition_id().alias("p")).collect()).values()) > 400


def test_columns_of_its_own_names(spark, docs):
    once = mixing.mix(docs.limit(50))
    twice = mixing.mix(once)
    assert twice.columns == [*once.columns, "__copy_", "__key_"] and twice.count() > 0
    named = docs.withColumns({n: F.lit(n) for n in ("__SOURCE", "__cdf", "__pieces", "__of", "__draws", "__n", "rate")})
    assert mixing.mix(named).columns == [*named.columns, "__copy", "__key"]
    assert mixing.mix(named).where("`__cdf` != '__cdf'").count() == 0 and mixing.mix(named).count() == mixing.mix(docs).count()
