import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chunks

TABLE = chunks.gear_table()


def brute_cuts(raw, reach, max_size):
    h, hashes = 0, []
    for b in raw:
        h = ((h << 1) + int(TABLE[b])) & 0xFFFFFFFF
        hashes.append(h)
    starts = {len(raw)} | {i for i, b in enumerate(raw) if not 0x80 <= b < 0xC0}
    start = lambda at: next((k for k in range(at, at + 3) if k in starts), min(at + 3, len(raw)))
    cuts, last = [], 0
    for i, h in enumerate(hashes):
        low = all(h < x for x in hashes[max(0, i - reach) : i]) and all(h <= x for x in hashes[i + 1 : i + 1 + reach])
        if low or i == len(raw) - 1:
            at = start(i + 1)
            while at - last > max_size:
                last = min(at, start(last + max_size))
                cuts.append(last)
            if at > last:
                last = at
                cuts.append(last)
    return cuts


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=700))
def test_cuts_against_brute_force(raw):
    assert chunks.cut_points(raw, TABLE, 20, 100) == brute_cuts(raw, 20, 100)


def test_an_insertion_moves_only_near_cuts():
    r = random.Random(1)
    raw = bytes(r.choice(b"abcdefghij ") for _ in range(5000))
    longer = raw[:2500] + b"inserted" + raw[2500:]
    a = {raw[x - 30 : x] for x in chunks.cut_points(raw, TABLE, 20, 512)}
    b = {longer[x - 30 : x] for x in chunks.cut_points(longer, TABLE, 20, 512)}
    assert len(a - b) <= 4


def brute_spans(rows, min_run):
    """Of rows in order (doc_id, bytes), by one dictionary: doc_id, start, end, other_doc_id of the parts of repeated runs."""
    first, out = {}, []
    for number, (doc, raw) in enumerate(rows):
        found, at = [], 0
        for end in brute_cuts(raw, chunks.REACH, chunks.MAX_SIZE):
            place = first.setdefault(raw[at:end], (number, at))
            if place != (number, at):
                found.append((at, end, *place))
            at = end
        parts = []
        for start, end, other, place in found:
            if parts and parts[-1][-1][1] == start:
                before = parts[-1][-1]
                if before[2] == other and before[3] + before[1] - before[0] == place:
                    parts[-1][-1] = (before[0], end, other, before[3])
                else:
                    parts[-1].append((start, end, other, place))
            else:
                parts.append([(start, end, other, place)])
        for run in parts:
            size = run[-1][1] - run[0][0]
            if size >= min_run or size == len(raw):
                out += [(doc, start, end, rows[other][0]) for start, end, other, _ in run]
    return sorted(out, key=str)


@pytest.mark.parametrize(("min_run", "hot"), [(chunks.MIN_RUN, 10_000), (0, 10_000), (60, 20), (chunks.MIN_RUN, 3)])
def test_whole_rows_against_brute_force(spark, monkeypatch, min_run, hot):
    """Copies, shared passages, lines that repeat within a text and across texts; most and few digests broadcast."""
    monkeypatch.setattr(chunks, "MOST_HOT", hot)
    r = random.Random(9)
    v = vocabulary(r, 60)
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    shared = [text(r.randint(20, 90)) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = [text(r.randint(0, 60)), r.choice(shared), text(r.randint(0, 30)), r.choice([*shared, ""]), "one line of many\n" * r.choice([0, 1, 9])]
        rows.append((r.choice([i, i, i, None]), r.choice([" ".join(parts), shared[0], rows[-1][1] if rows else ""])))
    rows += [(200, ""), (201, None), (202, "x"), (203, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(x) for x in chunks.spans(df, min_run).collect()), key=str)
    assert got == brute_spans([(d, (t or "").encode()) for d, t in rows], min_run) and len(got) > 200


def vocabulary(r, n=400):
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(n)]


def test_planted_passages_are_found_and_clean_texts_left(spark):
    r = random.Random(5)
    v = vocabulary(r)
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    passages = [text(60) for _ in range(20)]
    rows = [(i, f"{text(80)} {passages[i % 20]} {text(50)}") for i in range(40)]
    rows += [(i, text(150)) for i in range(40, 80)]
    rows += [(80, rows[45][1]), (81, "tiny copy"), (82, "tiny copy")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunks.spans(df).collect()
    pairs = {(x.doc_id, x.other_doc_id) for x in found}
    planted = {(i + 20, i) for i in range(20)} | {(80, 45), (82, 81)}
    # a part of the copy may stand in a text before that by chance
    assert planted <= pairs and {d for d, _ in pairs - planted} <= {80}
    texts = dict(rows)
    for x in found:
        piece = texts[x.doc_id].encode()[x.start_byte : x.end_byte]
        assert piece in texts[x.other_doc_id].encode()
    kept = {x.doc_id: x.text for x in chunks.cut(df).collect()}
    assert 80 not in kept and 82 not in kept and kept[81] == "tiny copy" and all(kept[i] == texts[i] for i in range(20))
    assert all(len(kept[i]) < len(texts[i]) - 112 for i in range(20, 40))


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрст", "éèàüöñçabcdefghi", "日本語漢字仮名文章😀🎉👍"])
def test_cut_leaves_whole_characters(spark, letters):
    """What is kept of a text is the text without its spans, to the character, whatever the characters are."""
    r = random.Random(len(letters))
    v = ["".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choices(v, k=n))
    passages = [text(70) for _ in range(10)]
    rows = [(i, f"{text(r.randint(20, 60))} {passages[i % 10]} {text(40)}") for i in range(60)]
    rows += [(60, "".join(r.choices(letters, k=3000)))]  # no blanks, cut at the largest size too
    rows += [(61, rows[60][1][:1500])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spans = {}
    for x in chunks.spans(df).collect():
        spans.setdefault(x.doc_id, []).append((x.start_byte, x.end_byte))
    kept, cut = {x.doc_id: x.text for x in chunks.cut(df).collect()}, 0
    for doc, whole in rows:
        raw, left, at = whole.encode(), b"", 0
        for a, b in sorted(spans.get(doc, [])):
            left, at, cut = left + raw[at:a], b, cut + 1
            raw[a:b].decode()
        left = (left + raw[at:]).decode()  # no half characters
        assert kept.get(doc, "") == (left if left.strip() else "") and "\ufffd" not in left
    assert cut > 40


def test_edges(spark, edge_docs, no_docs):
    found = Counter((x.doc_id, x.other_doc_id) for x in chunks.spans(edge_docs).collect())
    assert set(found) >= {(2, 1)} and all(d == 2 for d, _ in found)
    kept = chunks.cut(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    named = edge_docs.withColumns({n: F.lit(n) for n in ("__row", "__spans", "other", "at")})
    kept = chunks.cut(named)
    assert kept.columns == named.columns and kept.count() == 8 and kept.where("`__row` != '__row'").count() == 0
    assert chunks.spans(no_docs).count() == 0 and chunks.cut(no_docs).count() == 0


def test_window_min():
    x = np.array([5, 3, 8, 1, 9, 2], dtype=np.uint32)
    for n in range(1, 7):
        assert chunks.window_min(x, n).tolist() == [min(x[i : i + n]) for i in range(7 - n)]
