"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash h = (h << 1) + table[byte] in 32 bits depends on the last 32 bytes alone. A chunk ends where
the hash is lower than at the reach places before and no higher than at the reach places after, and at
max_size at the latest, and where that is within a character, behind it. So a cut depends on the bytes near it and on nothing else: an insertion moves no
other cuts, and a passage is cut alike wherever it stands. Chunks of all documents are grouped by a
128-bit digest.
The first place of a chunk, by row and start, keeps it; chunks at later places are repeated. Repeated chunks that
touch make a run; a run of min_run bytes or more, or of a whole text, is repeated text of its row, and is given
in parts, each with the row that has all of its bytes in one piece. Shorter runs are chance (words that often
meet); min_run=0 gives them too. What a passage loses are the bytes before its first cut and behind its last
(about 70 and a part of a chunk), so that a passage is found for sure from about min_run + 160 bytes on.

Null and empty texts have no chunks. Texts are read whole, however long. Repeated rows are copies of each other.
Rows without doc_id take part; their spans have a null doc_id. An empty table gives an empty result. Hot chunks
cost a row a place: they are counted before the shuffle, and the digests with more than a share of one in
MOST_HOT of all repeated places, which are fewer than MOST_HOT, are broadcast to the places instead of shuffling
these. spans() reads doc_id and text; cut() gives back all columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, materialize, spare

REACH, MAX_SIZE, MIN_RUN = 20, 512, 112
WINDOW = 32
#: Bound of the digests that are broadcast.
MOST_HOT = 10_000
SPANS = "array<struct<start: int, end: int, other: long>>"


def gear_table(seed: int = 0) -> np.ndarray:
    digests = b"".join(hashlib.sha256(b"gear %d %d" % (seed, i)).digest()[:4] for i in range(256))
    return np.frombuffer(digests, dtype="<u4").copy()


def gear_hashes(text: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hash after each byte, by doubling: a hash over 2n bytes is one over n plus one n bytes before, shifted by n."""
    h, n = table[text], 1
    while n < WINDOW:
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n)
        h, n = longer, 2 * n
    return h


def window_min(h: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values, by doubling."""
    m, width = h, 1
    while 2 * width <= n:
        m, width = np.minimum(m[:-width], m[width:]), 2 * width
    return np.minimum(m[: len(h) - n + 1], m[n - width :])


def character_start(raw: bytes, at: int) -> int:
    """The place, or the next one at which a character of UTF-8 begins; one is four bytes at most."""
    for _ in range(3):
        if at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
    return at


def cut_points(raw: bytes, table: np.ndarray, reach: int, max_size: int) -> list[int]:
    """The ends of the chunks of raw."""
    h = gear_hashes(np.frombuffer(raw, dtype=np.uint8), table)
    edge = np.full(reach, np.iinfo(np.uint32).max, dtype=np.uint32)
    least = window_min(np.concatenate([edge, h, edge]), reach)
    lowest = (h < least[: len(h)]) & (h <= least[reach + 1 :])
    ends, last = [], 0
    for at in [*(np.flatnonzero(lowest) + 1).tolist(), len(raw)]:
        at = character_start(raw, at)
        while at - last > max_size:
            last = min(at, character_start(raw, last + max_size))
            ends.append(last)
        if at > last:
            last = at
            ends.append(last)
    return ends


def chunk_table(rows: DataFrame, reach: int = REACH, max_size: int = MAX_SIZE) -> DataFrame:
    """__row, doc_id, start, end (bytes), d1 and d2 (the digest) and final of each chunk of rows (__row, doc_id, text),
    written to the shared folder."""
    doc_kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table()
        for b in batches:
            which, starts, ends, digests, final = [], [], [], [], []

            def batch() -> pa.RecordBatch:
                take = pa.array(which, pa.int64())
                digest = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                arrays = [b.column(0).take(take), b.column(1).take(take), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(final, pa.bool_())]
                return pa.RecordBatch.from_arrays(arrays, ["__row", "doc_id", "start", "end", "d1", "d2", "final"])

            for i, text in enumerate(b.column(2)):
                raw, start = text.as_py(), 0
                if not raw:
                    continue
                for end in cut_points(raw, table, reach, max_size):
                    which.append(i), starts.append(start), ends.append(end), final.append(end == len(raw))
                    digests.append(hashlib.blake2b(raw[start:end], digest_size=16).digest())
                    start = end
                if len(which) > 200_000:
                    yield batch()
                    which, starts, ends, digests, final = [], [], [], [], []
            yield batch()

    found = rows.select("__row", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"__row long, doc_id {doc_kind}, start int, end int, d1 long, d2 long, final boolean"
    )
    return materialize(found)


def repeated(chunks: DataFrame) -> DataFrame:
    """__row, doc_id, start, end, final, other, at of the chunks that an earlier place has too: the first, in row
    other from byte at on."""
    first = F.min(F.struct(F.col("__row").alias("other"), F.col("start").alias("at")))
    counted = materialize(chunks.groupBy("d1", "d2").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first.*", "n"))
    limit = counted.agg(F.sum("n") / MOST_HOT).scalar()
    keys, place = ["d1", "d2"], ["d1", "d2", "other", "at"]
    hot, rest = counted.where(F.col("n") > limit).select(*place), counted.where(F.col("n") <= limit).select(*place)
    met = chunks.join(F.broadcast(hot), keys).unionByName(chunks.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))
    return met.where("__row > other or start > at").drop(*keys)


def runs(places: pa.ListArray, min_run: int) -> pa.ListArray:
    """For each list of the repeated chunks (start, end, other, at, final) of a row, the parts of its runs in order."""
    row = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy(zero_copy_only=False))
    start, end, other, at, final = (x.to_numpy(zero_copy_only=False) for x in places.flatten().flatten())
    order = np.lexsort((start, row))
    row, start, end, other, at, final = (x[order] for x in (row, start, end, other, at, final))
    apart = np.ones(len(row), dtype=bool)  # where a run, or a part, begins
    parted = apart.copy()
    apart[1:] = (row[1:] != row[:-1]) | (start[1:] != end[:-1])
    parted[1:] = apart[1:] | (other[1:] != other[:-1]) | (at[1:] != at[:-1] + end[:-1] - start[:-1])
    first, part = np.flatnonzero(apart), np.flatnonzero(parted)
    last, part_last = (np.append(x[1:], len(row))[: len(x)] - 1 for x in (first, part))
    enough = (end[last] - start[first] >= min_run) | ((start[first] == 0) & final[last])
    kept = enough[np.searchsorted(first, part, side="right") - 1]
    part, part_last = part[kept], part_last[kept]
    spans = pa.StructArray.from_arrays([pa.array(start[part], pa.int32()), pa.array(end[part_last], pa.int32()), pa.array(other[part], pa.int64())], names=["start", "end", "other"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[part], np.arange(len(places) + 1)), pa.int32()), spans)


def row_spans(chunks: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """__row, doc_id and spans array<struct<start, end, other>> of the rows with repeated spans, in order; row other
    has the bytes of a span too."""
    places = F.collect_list(F.struct("start", "end", "other", "at", "final"))
    grouped = repeated(chunks).groupBy("__row", "doc_id").agg(places.alias("places"))

    @F.arrow_udf(SPANS)
    def joined(rows: pa.Array) -> pa.Array:
        return runs(rows, min_run)

    return grouped.select("__row", "doc_id", joined("places").alias("spans")).where(F.size("spans") > 0)


def spans(docs: DataFrame, min_run: int = MIN_RUN, **sizes: int) -> DataFrame:
    """doc_id, start_byte, end_byte, other_doc_id: a row for each part of a repeated span of docs (doc_id, text); the
    other document has its bytes too."""
    chunks = chunk_table(docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id()), **sizes)
    found = row_spans(chunks, min_run).select("doc_id", F.inline("spans"))
    names = chunks.where("start = 0").select(F.col("__row").alias("other"), F.col("doc_id").alias("other_doc_id"))
    return found.join(names, "other").select(
        "doc_id", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "other_doc_id"
    )


def cut(docs: DataFrame, min_run: int = MIN_RUN, **sizes: int) -> DataFrame:
    """docs, with all columns, without their repeated spans; rows of which nothing is left go."""
    row, cuts = spare(docs, "__row", "__spans")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = rows.select(F.col(row).alias("__row"), "doc_id", "text")
    found = row_spans(chunk_table(narrow, **sizes), min_run).select(F.col("__row").alias(row), F.col("spans").alias(cuts))

    @F.arrow_udf("binary")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, cuts in zip(texts, spans.to_pylist(), strict=True):
            raw, at, parts = text.as_py(), 0, []
            for s in cuts or []:
                parts.append(raw[at : s["start"]])
                at = s["end"]
            out.append(None if raw is None else b"".join([*parts, raw[at:]]))
        return pa.array(out, pa.binary())

    changed = rows.join(found, row, "left").withColumn("text", without(F.col("text").cast("binary"), F.col(cuts)).cast("string"))
    return changed.where(F.col(cuts).isNull() | (F.trim("text") != "")).select(*columns_of(docs))
