import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            v = words(t)
            windows = {tuple(v[i : i + n]) for i in range(max(1, len(v) - n + 1))} if v else set()
            for window in windows:
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        ids |= set() if item is None else {str(item)}
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


PASSAGE = "The quick, brown FOX jumps over the lazy dog and then it rests a while under an old Größe tree"
ITEMS = [(1, PASSAGE), (1, "also one, of item one"), (2, None), (3, "..."), (None, "tainted without an id"), (20, "the quick brown fox jumps over the lazy dog and then it rests"), (4, "zwei Wörter")]
TEXTS = [
    (1, "before " + PASSAGE + " after"),
    (2, "before The quick! brown fox; jumps over the lazy dog and more"),
    (3, "before quick brown fox jumps over the lazy dog"),
    (4, None),
    (5, ""),
    (6, "zwei wörter, zwei Wörter und tainted without an ID"),
    (7, ("filler words go on " * 3000) + PASSAGE),
    (7, "ALSO one of item one"),
    (8, PASSAGE[:20] + " " + PASSAGE),
]


def judged(spark, limit):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    v = decontaminate.scan(docs, items, max_broadcast_bytes=limit)
    return docs, items, sorted(((r.doc_id, r["__v"].n_words, r["__v"].n_hit, list(r["__v"]["items"])) for r in v.collect()), key=repr)


def test_broadcast_against_brute_force(spark):
    _, _, got = judged(spark, 1 << 20)
    assert got == brute(TEXTS, ITEMS)


def test_joined_against_brute_force(spark):
    _, _, got = judged(spark, 0)
    assert got == brute(TEXTS, ITEMS)


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_random_texts_against_brute_force(spark, limit):
    """Few different words, so that windows are shared between items and hits overlap."""
    r = random.Random(5)
    said = lambda n: " ".join(r.choice(["a", "B", "cc", "d-e", "ü"]) for _ in range(n))
    items = [(r.choice([1, 2, 3, 4, None]), said(r.choice([0, 1, 3, 5, 6, 12]))) for _ in range(25)]
    texts = [(i, said(r.choice([0, 2, 4, 9, 40, 90]))) for i in range(60)]
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for n in (1, 4, 6):
        got = decontaminate.scan(docs, table, n, limit).collect()
        assert sorted(((x.doc_id, x["__v"].n_words, x["__v"].n_hit, list(x["__v"]["items"])) for x in got), key=repr) == brute(texts, items, n)


def test_equal_hashes_are_told_by_the_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "codes_of", lambda w: np.zeros(len(w), dtype=np.uint64))
    tables = decontaminate.window_tables([("1", b"a b"), ("2", b"c d"), ("3", b"c d"), (None, b"e f")], 2)
    found = decontaminate.Windows(tables)
    assert found.find([b"c", b"d"])[1] == {"2", "3"} and found.find([b"a", b"b"])[1] == {"1"}
    hit, ids = found.find([b"x", b"e", b"f", b"y"])
    assert hit.tolist() == [False, True, True, False] and ids == set()
    assert found.find([b"b", b"a"]) == (None, set())


def test_the_size_of_the_tables_is_known_before(spark):
    items = [(str(i), " ".join(f"w{i}x{k}" for k in range(i))) for i in range(200)]
    table = spark.createDataFrame(items, "item_id string, text string").withColumn("text", F.col("text").cast("binary"))
    got = decontaminate.window_tables([(i, t.encode()) for i, t in items], 10)
    size = len(got["text"]) + sum(x.nbytes for t in got["lengths"].values() for x in t.values())
    assert size <= decontaminate.table_bytes(table, 10) < 2 * size + 40_000


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_columns_of_its_own_names(spark, limit):
    names = ["__v", "__row", "__items", "__hits", "__key", "hits", "key"]
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    v = decontaminate.verdict_of(docs)
    rows = decontaminate.scan(docs, items, max_broadcast_bytes=limit)
    assert rows.columns == [*docs.columns, v] and rows.where("`__v` != '__v' or `__row` != '__row'").count() == 0
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_clean_and_cut(spark):
    docs, items, _ = judged(spark, 1 << 20)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 4, 5]
    texts = {r.doc_id: r.text for r in decontaminate.cut(docs.where("doc_id < 7"), items).collect()}
    assert texts[1] == "before  after" and texts[2] == "before  more"
    assert texts[3] == TEXTS[2][1] and texts[4] is None and texts[6] == " und "


def test_edges(spark, edge_docs, no_docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.judge(edge_docs, empty)
    assert got.count() == edge_docs.count() and got.where("contaminated").count() == 0
    assert decontaminate.judge(no_docs, empty).count() == 0
    assert decontaminate.clean(edge_docs, empty).columns == edge_docs.columns
