import random
import re
from fractions import Fraction
from itertools import permutations

import pytest

from millrace.llm import filter_audit

DOCS = "doc_id long, text string, lang string, mask string, n string, part string"
LABELS = "doc_id long, quality int, toxic int, n string"


def brute(docs, labels):
    """Each order run over all documents, one filter after the other."""
    failing = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs):
            fails.add("E")
        good = any(x[0] == doc_id and x[1] == 1 for x in labels if doc_id is not None)
        toxic = any(x[0] == doc_id and x[2] == 1 for x in labels if doc_id is not None)
        failing.append((lang or "", fails, good, toxic))
    out, sums = {}, {}
    for part in {p for p, *_ in failing}:
        rows = [x for x in failing if x[0] == part]
        for order in permutations("ABCDE"):
            left, gone = list(rows), []
            for step, f in enumerate(order, 1):
                now = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left, gone = [x for x in left if f not in x[1]], gone + now
                sums[part, f] = sums.get((part, f), 0) + len(now)
                out[part, "".join(order), step] = [len(left), len(now), redundant, sum(x[1] == {f} for x in rows), sum(x[2] for x in now), sum(x[3] for x in now), f]
    return {k: (*v[:6], sums[k[0], v[6]]) for k, v in out.items()}


def audited(spark, docs, labels):
    df = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", [0, 1])
def test_against_every_order(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 5)))
    texts = [None, "", " \t\n ", "short", "UPPER CASE TEXT", "a | b", "#"]
    for _ in range(10):
        some = [word() for _ in range(r.randint(150, 260))]
        texts += [" ".join(some), " ".join(some[:30] * 8), " ".join(some).upper(), " ".join(some) + " & more"]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["en", "de", "", None]), "m", "n", "p") for _ in range(150)]
    docs += docs[:10]
    labels = [(r.choice([None, *range(80)]), r.choice([0, 1, None]), r.choice([0, 1, None]), "x") for _ in range(60)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    assert audited(spark, [], []) == {}
    fine = " ".join(f"word{i}" for i in range(300))
    found = audited(spark, [(1, fine, "en", None, None, None)], [])
    assert set(found.values()) == {(1, 0, 0, 0, 0, 0, 0)} and len(found) == 600
    copies = [(i, fine, "en", None, None, None) for i in range(1, 400)] + [(0, fine, "de", None, None, None)]
    found = audited(spark, copies, [(5, 1, 1, None)])
    assert found["en", "EABCD", 1] == (0, 399, 0, 399, 1, 1, 399 * 120) and found["de", "EABCD", 1] == (1, 0, 0, 0, 0, 0, 0)


def test_the_integrals_are_shapley_values(spark):
    counts = spark.createDataFrame([("p", m, (7 * m) % 11, 0, 0) for m in range(8)], "part string, mask int, n long, good long, toxic long")
    terms = filter_audit.polynomial(counts, 3)
    value = filter_audit.shapley(terms, 3).first().shapley
    n = {m: (7 * m) % 11 for m in range(8)}
    for i in range(3):
        shares = sum((Fraction(n[m], m.bit_count()) for m in range(8) if m >> i & 1), Fraction(0))  # each removal shared alike
        assert value[i] == 6 * shares
    removed = filter_audit.corners(terms, 3).first()
    assert {s: r.n for s, r in removed.removed.items()} == {s: sum(c for m, c in n.items() if m & s) for s in range(8)} and removed.total == sum(n.values())
