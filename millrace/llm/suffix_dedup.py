"""Substring dedup with a sparse suffix array.

Words are runs of anything but ASCII white space, with A-Z in lower case, each a 64-bit hash. Of all
suffixes of all texts only those at minimiser positions are kept: places whose hash of SHINGLE words is the
lowest of some window of WINDOW neighbours. A passage of min_words words that two texts share keeps the
same places in both, the first of them early enough for `anchor` words of the passage to follow it. The
suffixes are sorted over the whole cluster, by the hash of the anchor, then by hashes of ever longer
prefixes of what follows, then by place. Neighbours in this order that agree in the anchor are matches; those
on one diagonal of the same two texts are joined, then extended word by word to the left and right on the
texts themselves. Matches of min_words or more are repeated spans; of two rows, the later one has the span.

Of two suffixes of one anchor, that is all. Of three or more, copies of a passage need not be neighbours:
what follows the passage may sort others between them. So the runs of min_words words round such suffixes,
but for those inside a match with an earlier place, are sorted by hash and place, and each run but the first
of its hash is a repeated span of the first. The first place of a run is in no match, so none is missed.
Spans of one row may overlap, and one pair's may end where another pair's goes on: a match is extended by
CONTEXT words at most beyond what its suffixes join. All spans of a row together cover each repeated passage
of min_words or more to its ends.

Sorting by place too lets a hot passage spread over as many tasks as it needs, and comparing neighbours
keeps the matches in proportion to the suffixes. Texts are read whole, however long. Null texts and those of
fewer words have no spans; repeated rows are copies of each other; an empty table gives an empty result. Only
doc_id and text are read; cut() gives back all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, materialize, settled, spare

MIN_WORDS, SHINGLE, WINDOW = 50, 6, 20
#: Words compared beyond either end of a match; enough to decide whether it has min_words.
CONTEXT = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_codes(text: bytes | None) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A mixed hash of each n consecutive codes (none if there are fewer)."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(size, dtype=np.uint64)
    for i in range(n):
        h = h * _FACTOR + codes[i : i + size]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _window(h: np.ndarray, n: int, least) -> np.ndarray:
    m, width = h, 1
    while 2 * width <= n:
        m, width = least(m[:-width], m[width:]), 2 * width
    return least(m[: len(h) - n + 1], m[n - width :])


def minimisers(codes: np.ndarray, shingle: int = SHINGLE, window: int = WINDOW) -> np.ndarray:
    """Places that are lowest in some window of shingle hashes."""
    h = rolling(codes, shingle)
    if len(h) < window:
        return np.flatnonzero(h == h.min()) if len(h) else np.empty(0, dtype=np.int64)
    least = np.full(len(h) + window - 1, 0, dtype=np.uint64)
    edge = np.zeros(window - 1, dtype=np.uint64)
    least = np.concatenate([edge, _window(h, window, np.minimum), edge])
    return np.flatnonzero(_window(least, window, np.maximum) == h)


def _ladder(codes: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """A long for each place whose four 16-bit parts hash the next 1, 2, 3 and 4 steps of words after it;
    longs sort and group by how far the words agree."""
    padded = np.concatenate([codes, np.zeros(4 * step, dtype=np.uint64)])
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(1, 5):
        out = (out << np.uint64(16)) | (rolling(padded, k * step)[at] >> np.uint64(48))
    return out


def suffixes(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """place (row, at), anchor, after of the kept suffixes of rows (__row, text), written to the shared folder."""
    anchor, step = min_words - WINDOW - SHINGLE + 2, max(1, (WINDOW + SHINGLE) // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, n = [], 0
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                codes = word_codes(text.as_py())
                if len(codes) < min_words:
                    continue
                at = minimisers(codes)
                at = at[at + anchor <= len(codes)]
                parts.append(
                    (np.full(len(at), row), at.astype(np.int32), rolling(codes, anchor)[at], _ladder(codes, at + anchor, step))
                )
                n += len(at)
                if n > 100_000:
                    yield batch(parts)
                    parts, n = [], 0
            if parts:
                yield batch(parts)

    def batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*parts)]
        arrays = [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns]
        return pa.RecordBatch.from_arrays(arrays, ["row", "at", "anchor", "after"])

    found = rows.select("__row", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "row long, at int, anchor long, after long"
    )
    return materialize(found)


PAIR = "row long, at int, row2 long, at2 int, many boolean"


def neighbours(kept: DataFrame) -> DataFrame:
    """(row, at, row2, at2, many): each suffix and the one before it in the order of (anchor, after, row, at), where
    they agree in the anchor; many is false only if no third suffix does. Each task compares within its range; the
    first and last suffix of each range (two rows a task) are compared on the driver."""
    n = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["anchor", "after", "row", "at"]
    ranges = kept.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(3)[0].as_py()
            anchor, row, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if last is None:
                yield edge(part, 0, anchor[0], row[0], at[0])
            else:
                anchor, row, at = (np.concatenate([[x], y]) for x, y in zip(last, (anchor, row, at)))
            equal = anchor[1:] == anchor[:-1]
            same = np.flatnonzero(equal)
            if len(same):
                # a run at either end of a batch may go on in the next one
                beside = np.concatenate([[True], equal, [True]])
                many = (beside[:-2] | beside[2:])[same]
                none = pa.nulls(len(same), pa.int64())
                arrays = [pa.array(row[same + 1]), pa.array(at[same + 1].astype(np.int32)), pa.array(row[same]), pa.array(at[same].astype(np.int32)), pa.array(many), none, pa.nulls(len(same), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names)
            last = (anchor[-1], row[-1], at[-1])
        if last is not None:
            yield edge(part, 1, *last)

    names = ["row", "at", "row2", "at2", "many", "anchor", "edge"]

    def edge(part: int, end: int, anchor: int, row: int, at: int) -> pa.RecordBatch:
        arrays = [pa.array([int(row)]), pa.array([int(at)], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.bool_()), pa.array([int(anchor)]), pa.array([2 * part + end], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names)

    found = materialize(
        ranges.select("anchor", "row", "at", F.spark_partition_id().alias("part")).mapInArrow(run, PAIR + ", anchor long, edge int")
    )
    edges = sorted(found.where("edge is not null").select("edge", "anchor", "row", "at").collect())
    between = [(b.row, b.at, a.row, a.at, True) for a, b in zip(edges[1::2], edges[2::2]) if a.anchor == b.anchor]
    return found.where("edge is null").select("row", "at", "row2", "at2", "many").unionByName(
        kept.sparkSession.createDataFrame(between, PAIR)
    )


def firsts(runs: DataFrame) -> DataFrame:
    """(row, at, row2, at2): each place of runs (run, row, at) but the first of its run, and this first. Each task
    looks within its range; where the first run of a range began is found on the driver (two rows a task)."""
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["run", "row", "at"]
    ranges = runs.select(*keys).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    kind = "row long, at int, row2 long, at2 int, part int, run long, edge int"
    names = ["row", "at", "row2", "at2", "part", "run", "edge"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = lead = None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(3)[0].as_py()
            run, row, at = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if last is None:
                lead = run[0]
                yield edge(part, 0, run[0], row[0], at[0])
            # the first place of the run before stands in front, so that a run may go on in a later batch
            run, row, at = (np.concatenate([[x], y]) for x, y in zip(last or (run[0], row[0], at[0]), (run, row, at)))
            begins = np.concatenate([[True], run[1:] != run[:-1]])
            first = np.maximum.accumulate(np.where(begins, np.arange(len(run)), 0))
            # places of the run that leads the range wait for the driver, all others but the first are found
            led = run == lead
            later = np.flatnonzero(led | ~begins)
            later = later[later > 0]
            if len(later):
                arrays = [pa.array(row[later]), pa.array(at[later].astype(np.int32)), pa.array(row[first[later]]), pa.array(at[first[later]].astype(np.int32))]
                arrays += [pa.array(np.full(len(later), part, np.int32), mask=~led[later]), pa.nulls(len(later), pa.int64()), pa.nulls(len(later), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names)
            last = (run[-1], row[first[-1]], at[first[-1]])
        if last is not None:
            yield edge(part, 1, *last)

    def edge(part: int, end: int, run: int, row: int, at: int) -> pa.RecordBatch:
        arrays = [pa.array([int(row)]), pa.array([int(at)], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([part], pa.int32()), pa.array([int(run)]), pa.array([2 * part + end], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names)

    found = materialize(ranges.select(*keys, F.spark_partition_id().alias("part")).mapInArrow(find, kind))
    edges = sorted(found.where("edge is not null").select("edge", "run", "row", "at", "part").collect())
    origins, before = [], None
    for head, tail in zip(edges[::2], edges[1::2]):
        origin = before[1:] if before and before[0] == head.run else (head.row, head.at)
        origins.append((head.part, *origin))
        before = (tail.run, *(origin if tail.run == head.run else (tail.row, tail.at)))
    known = runs.sparkSession.createDataFrame(origins, "part int, row3 long, at3 int")
    pairs = found.where("edge is null").join(F.broadcast(known), "part", "left").select(
        "row", "at", F.coalesce("row3", "row2").alias("row2"), F.coalesce("at3", "at2").alias("at2")
    )
    return pairs.where("row != row2 or at != at2")


def matches(pairs: DataFrame, n: int) -> DataFrame:
    """(a, a_start, a_end, b, b_start): joined matches of the later place a with the earlier b, in words, of pairs
    that agree in n words."""
    later = F.struct("row", "at") > F.struct("row2", "at2")
    pairs = pairs.select(
        F.when(later, F.col("row")).otherwise(F.col("row2")).alias("a"),
        F.when(later, F.col("at")).otherwise(F.col("at2")).alias("at"),
        F.when(later, F.col("row2")).otherwise(F.col("row")).alias("b"),
        F.when(later, F.col("at") - F.col("at2")).otherwise(F.col("at2") - F.col("at")).alias("diagonal"),
    )
    # the places of one diagonal of two texts: at most as many as the shorter text keeps
    places = pairs.groupBy("a", "b", "diagonal").agg(F.sort_array(F.collect_set("at")).alias("places"))

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def runs(rows: pa.Array) -> pa.Array:
        at, cuts = rows.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *rows.value_lengths().to_pylist()])
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = np.diff(at) > n  # beyond the n words that the place before has
        begins[cuts[:-1]] = True
        first = np.flatnonzero(begins)
        ends = np.append(first[1:], len(at))[: len(first)] - 1
        spans = pa.StructArray.from_arrays([pa.array(at[first], pa.int32()), pa.array(at[ends] + n, pa.int32())], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, cuts), pa.int32()), spans)

    return places.select("a", "b", "diagonal", F.inline(runs("places"))).select(
        "a", F.col("start").alias("a_start"), F.col("end").alias("a_end"), "b", (F.col("start") - F.col("diagonal")).alias("b_start")
    )


def uncovered(size: int, places: set[int], known: list[tuple[int, int]], min_words: int) -> np.ndarray:
    """Starts of the runs of min_words words in a text of so many words that the anchor at one of the places is
    the first of, but for those inside a known (start, end)."""
    wanted = np.zeros(max(0, size - min_words + 1), dtype=bool)
    for p in places:
        wanted[max(0, p - WINDOW + 1) : p + 1] = True
    for start, end in known:
        wanted[start : max(start, end - min_words + 1)] = False
    return np.flatnonzero(wanted)


def extended(rows: DataFrame, found: DataFrame, pairs: DataFrame, min_words: int) -> DataFrame:
    """(a, start, end, b): matches extended on the texts of rows (__row, text), those of min_words or more, and
    the repeated runs of min_words words round suffixes of which there are many."""
    runs = materialize(found.withColumn("id", F.monotonically_increasing_id()))
    n = F.col("a_end") - F.col("a_start")
    wanted = runs.select(F.col("a").alias("__row"), "id", F.lit(True).alias("later"), F.col("a_start").alias("start"), n.alias("n")).unionByName(
        runs.select(F.col("b").alias("__row"), "id", F.lit(False).alias("later"), F.col("b_start").alias("start"), n.alias("n"))
    )
    place = F.explode(F.array(F.struct("row", "at"), F.struct(F.col("row2").alias("row"), F.col("at2").alias("at"))))
    many = pairs.where("many").select(place.alias("p")).select("p.*")
    none = F.lit(None)
    wanted = wanted.unionByName(
        many.select(F.col("row").alias("__row"), none.cast("long").alias("id"), none.cast("boolean").alias("later"), F.col("at").alias("start"), F.lit(0).alias("n"))
    )

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("id", pa.int64()), ("later", pa.bool_()), ("left", pa.binary()), ("right", pa.binary()), ("run", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])
        for b in batches:
            for row, text, wants in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                codes, out, wants = word_codes(text.as_py()), [], wants.as_py()
                places = {w["start"] for w in wants if w["id"] is None}
                if places:
                    at = uncovered(len(codes), places, [(w["start"], w["start"] + w["n"]) for w in wants if w["later"]], min_words)
                    values = {"run": rolling(codes, min_words)[at].view(np.int64), "row": np.full(len(at), row), "at": at.astype(np.int32)}
                    yield pa.RecordBatch.from_arrays([pa.array(values[f.name]) if f.name in values else pa.nulls(len(at), f.type) for f in kind], schema=kind)
                for w in wants:
                    if w["id"] is None:
                        continue
                    s, e = w["start"], w["start"] + w["n"]
                    out.append({"id": w["id"], "later": w["later"], "left": codes[max(0, s - CONTEXT) : s][::-1].tobytes(), "right": codes[e : e + CONTEXT].tobytes()})
                for at in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_pylist(out[at : at + 4096], kind)

    @F.arrow_udf("int")
    def agree(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            u, v = (np.frombuffer(z.as_py(), dtype=np.uint64) for z in (p, q))
            n = min(len(u), len(v))
            differ = np.flatnonzero(u[:n] != v[:n])
            out.append(int(differ[0]) if len(differ) else n)
        return pa.array(out, pa.int32())

    # the wishes of one row: at most as many as its suffixes have neighbours
    asked = wanted.groupBy("__row").agg(F.collect_list(F.struct("id", "later", "start", "n")).alias("wants"))
    texts = rows.select("__row", F.col("text").cast("binary").alias("text")).join(asked, "__row").select("__row", "text", "wants")
    sides = materialize(texts.mapInArrow(context, "id long, later boolean, left binary, right binary, run long, row long, at int"))
    again = matches(firsts(sides.where("run is not null")), min_words)
    a = sides.where("later").select("id", "left", "right")
    b = sides.where("not later").select("id", F.col("left").alias("left2"), F.col("right").alias("right2"))
    longer = a.join(b, "id").select("id", agree("left", "left2").alias("l"), agree("right", "right2").alias("r"))
    spans = runs.join(longer, "id").where(F.col("l") + n + F.col("r") >= min_words).select(
        "a", (F.col("a_start") - F.col("l")).alias("start"), (F.col("a_end") + F.col("r")).alias("end"), "b"
    )
    return spans.unionByName(again.select("a", F.col("a_start").alias("start"), F.col("a_end").alias("end"), "b"))


def row_spans(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(a, start, end, b) of rows (__row, text): words start to end (exclusive) of row a are in the earlier row b too."""
    if min_words < WINDOW + SHINGLE + 4:
        raise ValueError(f"min_words must be at least {WINDOW + SHINGLE + 4}")
    pairs = neighbours(suffixes(rows, min_words))
    return extended(rows, matches(pairs, min_words - WINDOW - SHINGLE + 2), pairs, min_words)


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start_word, end_word, other_doc_id: a row for each pair of repeated spans of docs (doc_id, text)."""
    rows = materialize(docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id()))
    names = rows.select("__row", "doc_id")
    return (
        settled(docs.sparkSession, lambda: row_spans(rows, min_words))
        .join(names.withColumnRenamed("__row", "a"), "a")
        .join(names.select(F.col("__row").alias("b"), F.col("doc_id").alias("other_doc_id")), "b")
        .select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "other_doc_id")
    )


def cut(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, with all columns, without the words of repeated spans and the white space between them; rows of
    which nothing is left go."""
    row, cuts = spare(docs, "__row", "__cuts")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = rows.select(F.col(row).alias("__row"), "text")
    found = settled(docs.sparkSession, lambda: row_spans(narrow, min_words)).groupBy(F.col("a").alias(row)).agg(F.collect_list(F.struct("start", "end")).alias(cuts))

    @F.arrow_udf("string")
    def without(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out, word = [], re.compile(rb"[^\x20\x09-\x0D]+")
        for text, spans in zip(texts, cuts.to_pylist(), strict=True):
            raw = text.as_py()
            if raw is not None and spans:
                places, at, parts = [m.span() for m in word.finditer(raw)], 0, []
                for s in sorted(spans, key=lambda s: s["start"]):
                    parts.append(raw[at : max(at, places[s["start"]][0])])
                    at = max(at, places[s["end"] - 1][1])
                raw = b"".join([*parts, raw[at:]])
            out.append(None if raw is None else raw.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    changed = rows.join(found, row, "left").withColumn("text", without(F.col("text").cast("binary"), F.col(cuts)))
    return changed.where(F.col(cuts).isNull() | (F.trim("text") != "")).select(*columns_of(docs))
