"""Benchmark decontamination with a broadcast hash set of normalised n-grams of the test items.

Words are runs of 0-9, a-z and all beyond ASCII, after A-Z went to lower case. A window is n consecutive
words of an item; an item of fewer words is one window. Each executor gets the sorted hashes of all different
windows once, with the place of one copy of each in the items' normalised text and the items that have it; a
task slides over the words of whole documents, looks up rolling hashes, and verifies each hit on the words
themselves. The set is broadcast only while its tables, whose size is counted first, are within
max_broadcast_bytes; beyond that the windows are a table, and documents meet it in a join on hashed windows.

Null texts have no words. Items without words are no items; an item without id taints words but is not
counted. Texts are read whole, however long. Repeated rows are judged each; equal ids of items count once;
windows that several items share count for each. An empty benchmark taints nothing; an empty table of
documents gives an empty result. Only the named columns are read; clean() and cut() give back all columns of
their input, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, columns_of, materialize, spare

N = 10
#: Bytes of the tables of a broadcast set; a worker needs that and at most 64 MB more for its sieve.
MAX_BROADCAST_BYTES = 64 << 20
#: Bytes of a window in the tables: hash, place, length, end of its items, one item.
WINDOW_BYTES = 32
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd; the usual multiplier of Fibonacci hashing
VERDICT = "struct<n_words: long, n_hit: long, n_items: long, items: array<string>, hits: array<struct<start: int, end: int>>>"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def codes_of(w: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))


def window_tables(items: list[tuple[str | None, bytes | None]], n: int) -> dict:
    """The windows of the items (id, text) as arrays. text: the items' words, joined; ids; and, by window length,
    hashes (sorted, each once), at and size (of a window in text), ends and items (the places in ids of the items
    of window k are items[ends[k - 1] : ends[k]]). odd: (window, ids) of those that share another's hash."""
    spoken = [(item, w) for item, text in items if (w := words(text))]
    blob, start = [], 0
    found: dict[int, list[np.ndarray]] = {}
    for number, (_, w) in enumerate(spoken):
        m = min(n, len(w))
        places = start + np.concatenate([[0], np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1)])
        size = (places[m:] - 1 - places[: len(places) - m]).astype(np.int32)
        found.setdefault(m, []).append((rolling(codes_of(w), m), places[: len(size)], size, np.full(len(size), number, dtype=np.int32)))
        blob.append(b" ".join(w))
        start = int(places[-1])
    text, lengths, odd = b" ".join(blob), {}, {}
    for m, parts in found.items():
        hashes, at, size, number = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((number, hashes))
        hashes, at, size, number = hashes[order], at[order], size[order], number[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        of = np.repeat(first, np.diff(np.concatenate([first, [len(hashes)]])))
        same = np.fromiter((text[a : a + s] == text[b : b + t] for a, s, b, t in zip(at, size, at[of], size[of])), dtype=bool, count=len(at))
        for k in np.flatnonzero(~same).tolist():
            odd.setdefault(text[at[k] : at[k] + size[k]], set()).add(spoken[number[k]][0])
        # each item of a window once, none for those without id
        named = np.fromiter((spoken[k][0] is not None for k in number), dtype=bool, count=len(number))
        again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (number[1:] == number[:-1])])
        kept = same & named & ~again
        ends = np.add.reduceat(kept.astype(np.int64), first).cumsum()
        lengths[m] = {"hashes": hashes[first], "at": at[first], "size": size[first], "ends": ends, "items": number[kept]}
    return {"text": text, "ids": [item for item, _ in spoken], "lengths": lengths, "odd": {k: sorted(v - {None}) for k, v in odd.items()}}


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n codes, put together from hashes of 1, 2, 4, ... codes."""
    size, out, done, power, width, factor = len(codes) - n + 1, None, 0, codes, 1, _FACTOR
    while True:
        if n & width:  # the next width codes after those done
            part = power[done : done + size]
            out = part if out is None else out * factor + part
            done += width
        if 2 * width > n:
            return out ^ (out >> np.uint64(29))
        power = power[:-width] * factor + power[width:]
        width, factor = 2 * width, np.uint64(int(factor) ** 2 % (1 << 64))


class Windows:
    """The set in a task: the tables, and a sieve of the hashes by window length."""

    def __init__(self, tables: dict):
        self.text, self.ids, self.lengths, self.odd = (tables[k] for k in ("text", "ids", "lengths", "odd"))
        self.sieves = {}
        for n, table in self.lengths.items():
            hashes = table["hashes"]
            # one in 64 places of the sieve is taken at most, up to 64 MB; each place stands for a hash's top bits
            bits = min(26, max(20, (64 * len(hashes)).bit_length()))
            sieve, shift = np.zeros(1 << bits, dtype=bool), np.uint64(64 - bits)
            sieve[(hashes >> shift).astype(np.int64)] = True
            self.sieves[n] = (sieve, shift)

    def find(self, w: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None if none is), and the ids of the items found."""
        hit, items = None, set()
        codes = codes_of(w) if self.lengths else None
        for n, table in self.lengths.items():
            if len(w) < n:
                continue
            hashes, (sieve, shift) = table["hashes"], self.sieves[n]
            h = rolling(codes, n)
            maybe = np.flatnonzero(sieve[(h >> shift).astype(np.int64)])
            if not len(maybe):
                continue
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            found = hashes[place] == h[maybe]
            seen = set()
            for i, k in zip(maybe[found].tolist(), place[found].tolist()):
                said, at = b" ".join(w[i : i + n]), table["at"][k]
                if said == self.text[at : at + table["size"][k]]:  # verified on the words
                    if k not in seen:
                        seen.add(k)
                        items.update(self.ids[x] for x in table["items"][table["ends"][k - 1] if k else 0 : table["ends"][k]])
                elif said in self.odd:
                    items.update(self.odd[said])
                else:
                    continue
                hit = np.zeros(len(w) + 1, dtype=np.int32) if hit is None else hit
                hit[i] += 1
                hit[i + n] -= 1
        return None if hit is None else np.cumsum(hit[:-1]) > 0, items


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


def verdict_of(docs: DataFrame) -> str:
    """The name that scan() gives its verdict, one that docs does not have."""
    return spare(docs, "__v")[0]


def table_bytes(items: DataFrame, n: int) -> int:
    """What the tables of a broadcast set of items (text) take at most."""
    spoken = F.coalesce(_count_words(F.col("text").cast("string")), F.lit(0))
    windows = F.when(spoken > 0, F.greatest(spoken - (n - 1), F.lit(1))).otherwise(0)
    r = items.agg(F.sum(F.length("text")).alias("b"), F.sum(windows).alias("w"), F.count("*").alias("n")).first()
    return (r.b or 0) + WINDOW_BYTES * (r.w or 0) + 100 * r.n


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """All columns of docs (text, and more) and a struct named by verdict_of(docs): n_words, n_hit, n_items, items
    (ids, sorted), hits (runs of hit words, end exclusive)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    if table_bytes(items, n) > max_broadcast_bytes:
        return _scan_joined(docs, items, n)
    tables = docs.sparkSession.sparkContext.broadcast(window_tables([tuple(r) for r in items.collect()], n))
    cached: list[Windows] = []

    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("n_items", pa.int64()),
            ("items", pa.list_(pa.string())),
            ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )

    @F.arrow_udf(VERDICT)
    def find(texts: pa.Array) -> pa.Array:
        if not cached:
            cached.append(Windows(tables.value))
        n_words, n_hit, items, hits = [], [], [], []
        for text in texts:
            w = words(text.as_py())
            hit, ids = cached[0].find(w)
            n_words.append(len(w)), n_hit.append(0 if hit is None else int(hit.sum()))
            items.append(sorted(ids)), hits.append([] if hit is None else _runs(hit))
        columns = [n_words, n_hit, list(map(len, items)), items, hits]
        arrays = [pa.array(x, f.type) for x, f in zip(columns, kind, strict=True)]
        return pa.StructArray.from_arrays(arrays, fields=list(kind))

    return docs.withColumn(verdict_of(docs), find(F.col("text").cast("binary")))


def _count_words(text: Column) -> Column:
    return F.regexp_count(ascii_lower(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def _hashed_windows(rows: DataFrame, key: str, n: int, short: bool) -> DataFrame:
    """(key, window bytes, start, len) of rows (key, text): each run of n words; with short, the whole text of fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, grams, starts, lengths = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words(t.as_py())
                sizes = [n] if len(w) >= n else []
                if short and 0 < len(w) < n:
                    sizes = [len(w)]
                for m in sizes:
                    for i in range(len(w) - m + 1):
                        keys.append(k), grams.append(hashlib.sha256(b" ".join(w[i : i + m])).digest()[:16])
                        starts.append(i), lengths.append(m)
                if len(keys) > 50_000:
                    yield _windows_batch(keys, grams, starts, lengths, b.schema.field(0).type)
                    keys, grams, starts, lengths = [], [], [], []
            yield _windows_batch(keys, grams, starts, lengths, b.schema.field(0).type)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, gram binary, start int, len int")


def _windows_batch(keys, grams, starts, lengths, kind) -> pa.RecordBatch:
    arrays = [pa.array(keys, kind), pa.array(grams, pa.binary()), pa.array(starts, pa.int32()), pa.array(lengths, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["key", "gram", "start", "len"])


def _scan_joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """As scan(), for a benchmark that is too large to broadcast: 128-bit digests of windows are joined.
    Items of fewer than n words are still matched by windows of each shorter length."""
    row = spare(docs, "__row")[0]
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    text = rows.select(F.col(row).alias("__row"), F.col("text").cast("binary").alias("text"))
    of_items = _hashed_windows(items, "item_id", n, True)
    table = materialize(of_items.groupBy("gram", "len").agg(F.collect_set("item_id").alias("ids")))
    lengths = [r.len for r in table.select("len").distinct().collect()]  # at most n numbers
    found = None
    for m in lengths:
        hits = _hashed_windows(text, "__row", m, False).join(table.where(F.col("len") == m).drop("len"), "gram")
        hits = hits.select("__row", "start", "len", "ids")
        found = hits if found is None else found.unionByName(hits)
    spans = "array<struct<start: int, end: int>>"
    if found is None:
        found = rows.select("__row", F.lit(0).alias("start"), F.lit(0).alias("len"), F.array().cast("array<string>").alias("ids")).limit(0)
    merged = found.groupBy("__row").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("s"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"),
    )

    @F.arrow_udf(spans)
    def joined(each: pa.Array) -> pa.Array:
        out = []
        for row_spans in each.to_pylist():
            runs: list[dict[str, int]] = []
            for x in row_spans:
                if runs and runs[-1]["end"] >= x["start"]:
                    runs[-1]["end"] = max(runs[-1]["end"], x["end"])
                else:
                    runs.append(x)
            out.append(runs)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    merged = merged.select("__row", "items", joined("s").alias("hits"))
    count = _count_words(rows["text"])
    none = F.array().cast("array<string>")
    found_items, found_hits, key = spare(rows, "__items", "__hits", "__key")
    merged = merged.select(F.col("__row").alias(key), F.col("items").alias(found_items), F.col("hits").alias(found_hits))
    return rows.join(merged, F.col(row) == F.col(key), "left").select(
        *columns_of(docs),
        F.struct(
            F.coalesce(count, F.lit(0)).cast("long").alias("n_words"),
            F.coalesce(F.aggregate(found_hits, F.lit(0), lambda a, x: a + x.end - x.start), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size(found_items), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce(found_items, none).alias("items"),
            F.coalesce(found_hits, F.array().cast(spans)).alias("hits"),
        ).alias(verdict_of(docs)),
    )


def judge(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids, comma-joined), contaminated of each row of docs."""
    v = scan(docs.select("doc_id", "text"), benchmark, n)
    return v.select(
        "doc_id",
        "__v.n_words",
        "__v.n_hit",
        "__v.n_items",
        F.sha2(F.array_join("__v.items", ","), 256).alias("items_sha256"),
        (F.col("__v.n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of docs, with all columns, in which no word is hit."""
    v = verdict_of(docs)
    return scan(docs, benchmark, n).where(F.col(f"{v}.n_hit") == 0).drop(v)


def cut(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """docs with each hit run of words, and what stands between its words, taken out of the text."""
    @F.arrow_udf("string")
    def without(text: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(text, hits.to_pylist(), strict=True):
            raw = t.as_py()
            if raw is not None and h:
                at = [m.span() for m in WORD.finditer(raw.translate(_TABLE))]
                cuts = [0] + [x for s in h for x in (at[s["start"]][0], at[s["end"] - 1][1])] + [len(raw)]
                raw = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            out.append(None if raw is None else raw.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    v = verdict_of(docs)
    return scan(docs, benchmark, n).withColumn("text", without(F.col("text").cast("binary"), F.col(f"{v}.hits"))).drop(v)
