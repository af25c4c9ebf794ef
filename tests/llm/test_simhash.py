import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=2):
    """doc_id to component for prints (doc_id, fingerprint), by all pairs."""
    parent = {d: d for d, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if (p ^ q).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d, _ in prints}


def test_against_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in rows]
    expected = {d: (f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints).values())}
    linked = simhash.link(docs).select("doc_id", simhash.hex16(F.col("fp")), "component_id")
    assert {r[0]: (r[1], r[2]) for r in linked.collect()} == expected


@pytest.mark.parametrize(("bits", "most"), [(2, simhash.MOST), (2, 2), (2, 0), (1, 64), (1, 0), (0, 64)])
def test_links_of_planted_fingerprints(spark, bits, most):
    """Distances of 1 to 4 bits in one and in both segments; chains; what all pairs connect is connected, whether
    values are crowded or not."""
    r = random.Random(3)
    prints = []
    for _ in range(40):
        p = r.getrandbits(64)
        prints.append(p)
        for _ in range(3):
            q = p
            for b in r.sample(range(64), r.randint(1, 4)):
                q ^= 1 << b
            prints.append(q)
            p = r.choice([p, q])
    numbered = list(enumerate(dict.fromkeys(prints)))
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    fps = spark.createDataFrame([(sign(p),) for _, p in numbered], "fp long")
    from millrace.llm.common import components

    pairs = [tuple(x) for x in simhash.links(fps, bits, most).collect()]
    assert all(0 < ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits for a, b in pairs)
    found = {n.node: n.component for n in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    together = brute_components(numbered, bits)
    groups = {}
    for d, p in numbered:
        groups.setdefault(together[d], set()).add(found.get(sign(p), sign(p)))
    assert all(len(x) == 1 for x in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_a_crowded_segment_value(spark):
    """Hundreds of fingerprints that agree in one segment: the chains give what all pairs give."""
    r = random.Random(8)
    prints = list({(0xABCDEF01 << 32 | r.getrandbits(9) << r.choice([0, 20])) for _ in range(400)} | {r.getrandbits(64) >> 1 for _ in range(50)})
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    from millrace.llm.common import components

    numbered = [(p - (1 << 64) if p >> 63 else p, p) for p in sorted(prints)]
    found = {n.node: n.component for n in components(simhash.links(fps)).collect()}
    expected = brute_components(sorted(numbered))
    assert {d: found.get(d, d) for d, _ in numbered} == expected


def test_bits_beyond_reach_are_refused(spark):
    """Prints three bits apart share no entry; asked for them, links must not answer with none."""
    fps = spark.createDataFrame([(0,), (0b111,)], "fp long")
    assert simhash.links(fps, 2).count() == 0
    for bits in (-1, 3, 11):
        with pytest.raises(ValueError):
            simhash.links(fps, bits)


def test_nothing_exploded_is_broadcast(spark, monkeypatch):
    """Of a small table of prints the planner sees only its size, not how many keys and probes are made of each."""
    from millrace.llm import near_copies
    from millrace.operators.tables import materialize

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return materialize(df)

    monkeypatch.setattr(simhash, "materialize", noted)
    monkeypatch.setattr(near_copies, "materialize", noted)
    monkeypatch.setattr(near_copies, "components", lambda edges: edges.select(F.col("a").alias("node"), F.col("b").alias("component")))
    fps = materialize(spark.range(500).select(F.xxhash64("id").alias("fp")))
    for bits in (1, 2):
        plans.append(simhash.links(fps, bits, 0)._jdf.queryExecution().sparkPlan().toString())
    wide = materialize(spark.range(500).select("id", *[F.xxhash64("id", F.lit(w)).alias(w) for w in near_copies.LONGS]))
    near_copies.links(wide, 85)
    exploded = [p for p in plans if "Generate explode" in p]
    assert len(exploded) >= 6 and not any("BroadcastHashJoin" in p for p in exploded)


def test_balls_and_segments(spark):
    fp = 0x1234567890ABCDEF
    df = spark.createDataFrame([(fp,)], "fp long").select(F.explode(simhash.segments(F.col("fp"))).alias("key"))
    assert [r.key for r in df.collect()] == [0x90ABCDEF, 1 << 32 | 0x12345678]
    for key in (0x90ABCDEF, 1 << 32 | 0x12345678):
        got = spark.range(1).select(F.explode(simhash.ball(F.lit(key), 1)).alias("k")).where("k is not null").collect()
        assert sorted(r.k for r in got) == sorted([key, *[key | 1 << i for i in range(32) if not key >> i & 1]])


def test_edges(spark, edge_docs, no_docs):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.link(edge_docs).collect()}
    by_id = {d: (fp, c) for d, fp, c in got}
    assert by_id[3] == by_id[4] == by_id[5] == (0, 3)
    assert by_id[1][1] == by_id[2][1] == 1
    assert simhash.link(edge_docs).count() == edge_docs.count()
    assert simhash.link(no_docs).count() == 0
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert simhash.keep_one(no_docs).count() == 0


def test_rows_without_id_and_reused_ids(spark, monkeypatch):
    """A text that only a row without id has connects others; each text under a reused id keeps a copy."""
    text = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    base, other = 0x123456789ABCDEF0, 0xFEDCBA9876543210
    # the second is within two bits of the first and the third, which are four bits apart
    rows = [(base, 5), (base ^ 0b11, None), (base ^ 0b1111, 9), (other, 7)]
    signed = [(d, str(p - (1 << 64) if p >> 63 else p)) for p, d in rows]
    docs = spark.createDataFrame(signed, "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda d, n, seed: d.select("doc_id", F.col("text").cast("long").alias("fp")))
    got = {x.doc_id: x.component_id for x in simhash.link(docs).collect()}
    kept = sorted(x.doc_id or 0 for x in simhash.keep_one(docs).collect())
    monkeypatch.undo()
    assert got == {5: 5, None: 5, 9: 5, 7: 7} and kept == [0, 5, 7]
    shared = [(1, text(1, 30)), (2, text(1, 30)), (2, text(2, 30)), (2, text(3, 30)), (2, text(3, 30)), (3, text(2, 30))]
    df = spark.createDataFrame(shared, "doc_id long, text string").repartition(3)
    assert sorted(tuple(x) for x in simhash.keep_one(df).collect()) == [(1, text(1, 30)), (2, text(2, 30)), (2, text(3, 30))]
