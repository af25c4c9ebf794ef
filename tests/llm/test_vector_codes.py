import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import vector_codes

KIND = "vec_id long, embedding array<float>, label int, v string, code string, n string"


def brute(rows, parts=4, entries=5, rounds=2):
    """Plain Python, all distances as they are."""
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None and r[1] and len(r[1]) % parts == 0), key=lambda r: (r[0], r[1]))
    if not first:
        return [(i, None, None, None) for i, _, _ in kept], None
    width = len(first[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    fits = [(i, cut(v) if len(v) == parts * width else None, label) for i, v, label in kept]
    books = [[cut(r[1])[p] for r in first if len(r[1]) == parts * width][:entries] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, v, _ in fits:
            for p in range(parts if v else 0):
                held[p][near(p, v[p])[1]].append(v[p])
        books = [[[sum(c) // len(xs) for c in zip(*xs)] if xs else books[p][e] for e, xs in enumerate(held[p])] for p in range(parts)]
    coded = [(i, "".join(f"{near(p, v[p])[1]:02x}" for p in range(parts)) if v else None, sum(near(p, v[p])[0] for p in range(parts)) if v else None, label) for i, v, label in fits]
    return coded, books


def compressed(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], KIND).repartition(3)
    coded, books = vector_codes.compress(df, **sizes)
    return sorted(((r.vec_id, None if r.code is None else r.code.hex(), r.error, r.label) for r in coded.collect()), key=str), books


def test_against_plain_python(spark):
    r = random.Random(1)
    vectors = [[r.choice([-1.5, -0.26, 0.0, 0.25, 0.1, 3.0, r.gauss(0, 0.2)]) for _ in range(8)] for _ in range(60)]
    rows = [(i // 2, r.choice(vectors), r.choice([0, 1, None])) for i in range(150)]
    rows += [(900, None, 1), (901, [0.1] * 7 + [None], 1), (902, [0.1] * 7 + [float("nan")], 1), (903, [float("inf")] + [0.1] * 7, 1), (904, [0.5] * 3, 1), (905, [], 2), (-5, [0.5] * 3, 1), (None, [0.5] * 8, None)]
    want, books = brute(rows)
    got, found = compressed(spark, rows, parts=4, entries=5)
    assert got == sorted(want, key=str)
    assert found.entries.tolist() == books and len(got) == len(rows) - 4
    few = rows[:6]
    assert compressed(spark, few, parts=4, entries=64)[0] == sorted(brute(few, entries=64)[0], key=str)
    # nothing that fits, and nothing at all
    assert compressed(spark, [(1, [0.1] * 3, 1), (None, [0.1] * 8, 1)], parts=4)[0] == [(1, None, None, 1), (None, None, None, 1)]
    assert compressed(spark, []) == ([], None)


def test_codes_stand_for_entries_and_labels_sum(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(32)], r.choice([None, 1, 2, 2, 2])) for i in range(300)]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], KIND)
    coded, books = vector_codes.compress(df, rounds=1)
    again = {x.vec_id: x.v for x in coded.select("vec_id", vector_codes.decoder(books).alias("v")).collect()}
    sums = {}
    for x in (found := vector_codes.with_label_errors(coded).collect()):
        v = np.floor(np.array(rows[x.vec_id][1], dtype=np.float32).astype(float) * 256).astype(int)
        assert ((v - np.array(again[x.vec_id])) ** 2).sum() == x.error
        sums[x.label] = sums.get(x.label, 0) + x.error
    assert len(found) == 300 and all(x.label_error == sums[x.label] for x in found)


def test_labels_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "MANY", 4)
    labels = [None] * 60 + [1] * 50 + list(range(2, 60)) * 2
    coded = spark.createDataFrame([(i, k, i) for i, k in enumerate(labels)], "vec_id long, label int, error long")
    want = {k: sum(i for i, x in enumerate(labels) if x == k) for k in set(labels)}
    found = vector_codes.with_label_errors(coded).collect()
    assert len(found) == len(labels) and all(x.label_error == want[x.label] for x in found)


def test_large_numbers(spark):
    far = vector_codes.REACH / 256
    rows = [(0, [far] * 16, 0), (1, [-far] * 16, 0)]
    got, _ = compressed(spark, rows, entries=1, rounds=0)
    assert got[1][2] == 16 * (2 * vector_codes.REACH) ** 2
    with pytest.raises(Exception, match="a component beyond"):
        compressed(spark, [(0, [1e30] * 16, 0)])


def test_more_than_256_entries(spark):
    rows = [(i, [float(i)] * 16, 0) for i in range(300)]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], KIND)
    coded, books = vector_codes.compress(df, entries=300)
    again = coded.select("vec_id", vector_codes.decoder(books).alias("v")).where(F.col("v")[0] != F.col("vec_id") * 256)
    assert again.count() == 0 and coded.agg(F.sum("error")).first()[0] == 0
