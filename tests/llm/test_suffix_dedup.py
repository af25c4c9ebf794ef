import random

import numpy as np
import pytest

from millrace.llm import suffix_dedup


def brute(rows, n=50):
    """Words of each row that stand in a run of n words that an earlier place has too."""
    first, covered = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            if run in first:
                covered.setdefault(i, set()).update(range(k, k + n))
            else:
                first[run] = (i, k)
    return covered


def covered(found):
    out = {}
    for x in found:
        out.setdefault(x.doc_id, set()).update(range(x.start_word, x.end_word))
    return out


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert covered(suffix_dedup.spans(docs.coalesce(1).orderBy("doc_id")).collect()) == brute(rows)


def test_planted_lengths(spark):
    """Runs of 40 to 70 words, in two to five texts, at any place: found from 50 words on."""
    r = random.Random(2)
    v = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    rows, at = [], 0
    for n in range(40, 71):
        passage = text(n)
        for _ in range(r.randint(2, 5)):
            rows.append((at, f"{text(r.randint(0, 60))} {passage.upper() if r.random() < 0.3 else passage} {text(r.randint(0, 60))}"))
            at += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    found = suffix_dedup.spans(df).collect()
    texts = {i: t.lower().split() for i, t in rows}
    for x in found:
        run = texts[x.doc_id][x.start_word : x.end_word]
        assert len(run) >= 50 and " ".join(run) in " ".join(texts[x.other_doc_id])
    # partitions decide which row is earlier, not how many rows of a passage are later
    assert len(covered(found)) == len(brute(rows))


@pytest.mark.parametrize("partitions", [1, 7])
def test_copies_that_are_no_neighbours(spark, partitions):
    """Hundreds of copies of passages of 50 to 60 words between unrelated words, and templates that share one side:
    all but one copy of each run of 50 words is found."""
    r = random.Random(5)
    v = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    bodies = [text(n) for n in (50, 52, 55, 60)]
    rows = [f"{text(30)} {b} {text(30)}" for b in bodies for _ in range(200)]
    core, sides = text(30), [text(25) for _ in range(4)]
    for i in range(240):
        left, right = (sides[i % 4], text(30)) if i % 2 else (text(30), sides[i % 4])
        rows.append(f"{text(5)} {left} {core} {right} {text(5)}")
    r.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = suffix_dedup.spans(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = [t.split() for t in rows]
    for x in found:
        assert " ".join(texts[x.doc_id][x.start_word : x.end_word]) in rows[x.other_doc_id] and x.other_doc_id <= x.doc_id
    expected = brute(list(enumerate(rows)))
    assert len(expected) > 1000 and covered(found) == expected


def test_minimisers_of_a_shared_run_are_shared():
    r = np.random.default_rng(1)
    run = r.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = (np.concatenate([r.integers(0, 1 << 63, k).astype(np.uint64), run, r.integers(0, 1 << 63, 30).astype(np.uint64)]) for k in (17, 41))
    inside = lambda codes, k: {int(x) - k for x in suffix_dedup.minimisers(codes) if k + 19 <= x <= k + 60 - 26}
    assert inside(a, 17) == inside(b, 41)
    first = min(int(x) - 17 for x in suffix_dedup.minimisers(a) if x >= 17)
    assert first <= 19


def test_cut_and_edges(spark, edge_docs, no_docs):
    kept = suffix_dedup.cut(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert suffix_dedup.spans(no_docs).count() == 0
    assert {(x.doc_id, x.start_word, x.end_word) for x in suffix_dedup.spans(edge_docs).collect()} == {(2, 0, 120)}
