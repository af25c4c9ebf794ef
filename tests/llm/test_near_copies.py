import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import near_copies
from millrace.llm.common import components


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(r, words, share):
    """words with so many replaced, in a few places, as one editing does."""
    out = list(words)
    for at in r.sample(range(len(out)), round(share * len(out))):
        out[at] = f"new{r.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def planted():
    """Groups of copies with a share of words replaced, with texts that share a third, and single ones."""
    r = random.Random(4)
    rows, group = [], {}
    for g in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([60, 150, 400]))]
        for k in range(r.choice([1, 2, 3, 6])):
            text = base if k == 0 else edited(r, base, r.choice([0, 0.005, 0.01, 0.02]))
            group[len(rows)] = g
            rows.append((len(rows), " ".join(text)))
        other = base[: len(base) // 3] + [f"w{r.randrange(3000)}" for _ in range(2 * len(base) // 3)]
        group[len(rows)] = 1000 + g
        rows.append((len(rows), " ".join(other)))
    return rows, group


def test_bits_differ_by_similarity():
    """The share of differing bits is that of the formula."""
    r = random.Random(1)
    for share in (0.002, 0.01, 0.02, 0.04):
        got, said = [], []
        for _ in range(12):
            a = [f"w{r.randrange(10**6)}" for _ in range(500)]
            b = edited(r, a, share)
            prints = [near_copies.wide_print(near_copies.shingle_hashes(" ".join(x).encode(), 5, 42)) for x in (a, b)]
            got.append(sum(int(x).bit_count() for x in (prints[0] ^ prints[1]).view(np.uint64)))
            s = similarity(" ".join(a), " ".join(b))
            said.append(np.arccos(2 * s / (1 + s)) / np.pi * near_copies.BITS)
        assert abs(np.mean(got) - np.mean(said)) < 10


def test_keys_are_the_bits_of_the_print(spark):
    r = random.Random(2)
    rows = [tuple(r.getrandbits(64) - (1 << 63) for _ in near_copies.LONGS) for _ in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{w} long" for w in near_copies.LONGS))
    for row, got in zip(rows, df.select(near_copies.segment_keys().alias("k")).collect()):
        whole = sum((x & ((1 << 64) - 1)) << (64 * i) for i, x in enumerate(row))
        width = near_copies.WIDTH
        assert list(got.k) == [s << width | whole >> (s * width) & ((1 << width) - 1) for s in range(near_copies.SEGMENTS)]


def test_links_against_all_pairs_that_share_a_segment(spark):
    """What the tables connect is what all pairs that meet in a table and are near connect."""
    r = random.Random(3)
    bits, width = near_copies.BITS, near_copies.WIDTH
    prints = []
    for _ in range(12):
        base = r.getrandbits(bits)
        for _ in range(r.choice([1, 3, 15])):
            p = base
            for b in r.sample(range(bits), r.choice([0, 5, 40, 80, 100])):
                p ^= 1 << b
            prints.append(p)
    # many that share one value and are far apart otherwise
    prints += [r.getrandbits(bits) >> width << width | 77 for _ in range(30)]
    prints = list(dict.fromkeys(prints))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, *[signed(p >> (64 * k) & ((1 << 64) - 1)) for k in range(bits // 64)]) for i, p in enumerate(prints)]
    fps = spark.createDataFrame(rows, "id long, " + ", ".join(f"{w} long" for w in near_copies.LONGS))
    for most in (60, 90, 170):
        found = {x.node: x.component for x in components(near_copies.links(fps, most)).collect()}
        parent = list(range(len(prints)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, p in enumerate(prints):
            for j in range(i):
                d = p ^ prints[j]
                meet = any((d >> (s * width) & ((1 << width) - 1)).bit_count() <= 1 for s in range(near_copies.SEGMENTS))
                if meet and d.bit_count() <= most:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
        assert {i: found.get(i, i) for i in range(len(prints))} == {i: root(i) for i in range(len(prints))}


def test_planted_groups(spark, planted):
    rows, group = planted
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in near_copies.keep_one(df).collect()}
    texts = dict(rows)
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert set(first.values()) <= kept  # of each group the smallest id, and the texts that share a third, stay
    for i in set(texts) - kept:
        assert similarity(texts[i], texts[first[group[i]]]) > 0.65
    copies = [i for i, g in group.items() if i != first[g] and similarity(texts[i], texts[first[g]]) >= 0.8]
    assert len([i for i in copies if i not in kept]) >= 0.95 * len(copies) and len(copies) > 60


def test_recall_against_all_pairs(spark, docs):
    """Of the given documents: pairs of different texts at 0.8 and more are of one component, those at 0.6 or less are
    of none by themselves."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text is not null").collect()]
    sets = {d: shingles(t) for d, t in rows if len(t.split()) >= 20}
    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by_shingle.values() if 1 < len(ds) < 50 for a in ds for b in ds if a < b}
    near = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= 0.8}
    kept = {x.doc_id for x in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [p for p in near if not (p[0] in kept and p[1] in kept)]
    assert near and len(caught) >= 0.9 * len(near)
    alone = set(sets) - {d for p in pairs for d in p if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) > 0.6}
    assert alone <= kept


def test_edges(spark, edge_docs, no_docs):
    kept = near_copies.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert near_copies.keep_one(no_docs).count() == 0
    named = edge_docs.withColumns({n: F.lit(n) for n in ("__row", "place", "id", "component", "w0", "print")})
    assert near_copies.keep_one(named).columns == named.columns and near_copies.keep_one(named).count() == 6


def test_reused_ids_and_rows_without(spark):
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    shared = [(1, text(1, 30)), (2, text(1, 30)), (2, text(2, 30)), (2, text(3, 30)), (2, text(3, 30)), (3, text(2, 30)), (None, text(2, 30)), (None, None)]
    df = spark.createDataFrame(shared, "doc_id long, text string").repartition(3)
    got = sorted((tuple(x) for x in near_copies.keep_one(df).collect()), key=repr)
    assert got == sorted([(1, text(1, 30)), (2, text(2, 30)), (2, text(3, 30)), (None, text(2, 30)), (None, None)], key=repr)
