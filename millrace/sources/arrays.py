"""A JSON document that is one long list, cut into its records by many tasks.

The document is read in pieces that end at a closing brace, which Spark's reader finds in any byte range of the file. What
a range does to what comes before it is a small function: whether a string is open at its end, and by how much the
brackets deepen, for either answer to whether one is open at its start. These are put together in the order of the ranges, on
the driver, a few numbers a range; after that each range knows where it stands and cuts its own records at the commas of
the list's depth. A record that goes over the end of a range is put together from its parts.

A list, or an object with the list under a key. What is not in the list is not looked at, but for its brackets and
strings, which must end where the document does. A record is no more than one value of one task; so is what has no
closing brace in it. An empty document has no records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import materialize

BUFFER = 1 << 20
SIGN = np.zeros(256, dtype=np.int64)
SIGN[list(b"{[")], SIGN[list(b"}]")] = 1, -1
MARKS = SIGN != 0
MARKS[list(b",:")] = True
PARTS = "block long, nth long, kind string, opens boolean, closes boolean, value string"


@dataclass
class Marks:
    """The brackets, commas and colons of a buffer outside strings: places, bytes; the quotes; is a string open at the end."""

    at: np.ndarray
    byte: np.ndarray
    quotes: np.ndarray
    inside: bool


def marks(buffer: bytes, inside: bool) -> Marks:
    a = np.frombuffer(buffer, dtype=np.uint8)
    quotes = np.flatnonzero(a == 34)
    back = a == 92
    if back.any():  # a quote behind an odd number of backslashes is a character of the string
        other = np.maximum.accumulate(np.where(back, -1, np.arange(len(a))))
        before = quotes - 1
        quotes = quotes[(before < 0) | ((before - other[before]) % 2 == 0)]
    at = np.flatnonzero(MARKS[a])
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    return Marks(at, a[at], quotes, bool((len(quotes) + inside) % 2))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """Block and bytes of pieces that follow each other, some BUFFER bytes; each piece has its brace again."""
    block, held, size = None, [], 0
    for b in batches:
        for at, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held and (at != block or size > BUFFER):
                yield block, b"".join(held)
                held, size = [], 0
            block = at
            held += [piece, b"}"]
            size += len(piece) + 1
    if held:
        yield block, b"".join(held)


def _blocks(pieces: DataFrame) -> list:
    """For each range: its bytes, the first that is no blank, are its quotes odd, and how much it deepens if no string
    is open at its start (d0) and if one is (d1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for block, buffer in _buffers(batches):
            sums = found.setdefault(block, [block, 0, "", False, [0, 0]])
            deepens = [int(SIGN[marks(buffer, s).byte].sum()) for s in (False, True)]
            head = buffer.removeprefix(b"\xef\xbb\xbf").strip()[:1]
            odd = sums[3]
            sums[1], sums[2] = sums[1] + len(buffer), sums[2] or head.decode("latin-1")
            sums[4] = [sums[4][0] + deepens[odd], sums[4][1] + deepens[not odd]]
            sums[3] = odd ^ marks(buffer, False).inside
        rows = list(found.values())
        yield pa.RecordBatch.from_pydict(
            {"block": [r[0] for r in rows], "bytes": [r[1] for r in rows], "head": [r[2] for r in rows], "odd": [r[3] for r in rows], "d0": [r[4][0] for r in rows], "d1": [r[4][1] for r in rows]},
            pa.schema([("block", pa.int64()), ("bytes", pa.int64()), ("head", pa.string()), ("odd", pa.bool_()), ("d0", pa.int64()), ("d1", pa.int64())]),
        )

    return sorted(pieces.mapInArrow(run, "block long, bytes long, head string, odd boolean, d0 long, d1 long").collect())


@dataclass
class Start:
    """Where a range stands: a string is open, the depth, the list is under the key that was last seen, and how many
    bytes there are to its end, where it is the last and has no brace of its own."""

    inside: bool
    depth: int
    listed: bool
    cut: int | None = None


def _keys(buffer: bytes, m: Marks, depth: np.ndarray, key: str) -> list[tuple[int, bool]]:
    """The colons at depth one, and whether each is between the key and a list."""
    out = []
    for at in m.at[(m.byte == 58) & (depth == 1)].tolist():
        end = np.searchsorted(m.quotes, at) - 1
        name = buffer[m.quotes[end - 1] : m.quotes[end] + 1] if end > 0 else b""
        try:
            fits = json.loads(name) == key
        except ValueError:
            fits = False
        out.append((at, fits and buffer[at + 1 :].lstrip()[:1] == b"["))
    return out


def _listed(pieces: DataFrame, starts: dict[int, Start], key: str) -> dict[int, bool]:
    """For the ranges with a key of the outer object: is the last one that of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, list] = {}
        last: dict[int, bool] = {}
        for block, buffer in _buffers(batches):
            state = states.setdefault(block, [starts[block].inside, starts[block].depth])
            m = marks(buffer, state[0])
            depth = state[1] + np.cumsum(SIGN[m.byte])
            for _, fits in _keys(buffer, m, depth, key):
                last[block] = fits
            states[block] = [m.inside, int(depth[-1]) if len(depth) else state[1]]
        yield pa.RecordBatch.from_pydict({"block": list(last), "fits": list(last.values())}, pa.schema([("block", pa.int64()), ("fits", pa.bool_())]))

    return dict(tuple(r) for r in pieces.mapInArrow(run, "block long, fits boolean").collect())


class _Cutter:
    """Cuts the records of one range."""

    def __init__(self, block: int, start: Start, of: int, key: str | None):
        self.block, self.inside, self.depth, self.listed, self.of, self.key = block, start.inside, start.depth, start.listed or key is None, of, key
        self.text: list[bytes] | None = [] if self.active else None  # of the record that is open
        self.begun, self.opens, self.nth, self.out = False, False, 0, []

    @property
    def active(self) -> bool:
        return self.depth >= self.of and self.listed

    def give(self, closes: bool, ended: bool) -> None:
        value, kind = b"".join(self.text or []), ("whole" if ended else "head") if self.begun else ("tail" if ended else "middle")
        if kind != "whole" or value.strip() or not (self.opens and closes):
            self.out.append((self.block, self.nth, kind, self.opens, closes, value.decode("utf-8", "replace")))
            self.nth += kind in ("whole", "head")

    def add(self, buffer: bytes) -> None:
        m = marks(buffer, self.inside)
        depth = self.depth + np.cumsum(SIGN[m.byte])
        listed = np.full(len(m.at), self.listed)
        if self.key is not None:
            for at, fits in _keys(buffer, m, depth, self.key):
                listed[m.at >= at] = fits
        elif self.depth == 0 or (depth == 0).any():
            self.check(buffer, m, depth)
        opened = (m.byte == 91) & (depth == self.of) & listed
        comma = (m.byte == 44) & (depth == self.of) & listed
        closed = (m.byte == 93) & (depth == self.of - 1) & listed
        done = 0
        for at, byte in zip(m.at[opened | comma | closed].tolist(), m.byte[opened | comma | closed].tolist()):
            if byte != 91 and self.text is not None:
                self.text.append(buffer[done:at])
                self.give(byte == 93, True)
            self.text = None if byte == 93 else []
            self.begun, self.opens, done = True, byte == 91, at + 1
        if self.text is not None:
            self.text.append(buffer[done:])
        self.inside = m.inside
        if len(depth):
            self.depth, self.listed = int(depth[-1]), bool(listed[-1])

    def check(self, buffer: bytes, m: Marks, depth: np.ndarray) -> None:
        """Nothing but blanks stands before and behind the list."""
        edges = [0, *(m.at + 1).tolist(), len(buffer)]
        before = [self.depth, *depth.tolist()]
        for k, d in enumerate(before):
            gap = buffer[edges[k] : edges[k + 1] - (k + 1 < len(before))]
            mark = buffer[edges[k + 1] - 1 : edges[k + 1]] if k + 1 < len(before) else b""
            if d == 0 and (gap.removeprefix(b"\xef\xbb\xbf").strip() or mark not in (b"[", b"")):
                self.out.append((self.block, -1, "bad", False, False, gap[:80].decode("utf-8", "replace")))

    def end(self) -> None:
        if self.text is not None:
            self.give(False, False)


def _cut(pieces: DataFrame, starts: dict[int, Start], of: int, key: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, read = None, 0
        names = [x.split()[0] for x in PARTS.split(", ")]
        kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()])))

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(names))], schema=kinds)

        for block, buffer in _buffers(batches):
            if cutter is None or cutter.block != block:
                if cutter is not None:
                    cutter.end()
                    yield batch(cutter.out)
                cutter, read = _Cutter(block, starts[block], of, key), 0
            read += len(buffer)
            cutter.add(buffer[:-1] if read == starts[block].cut else buffer)
            yield batch(cutter.out)
            cutter.out = []
        if cutter is not None:
            cutter.end()
            yield batch(cutter.out)

    return pieces.mapInArrow(run, PARTS)


def _unclosed(blocks: list, size: int) -> bool:
    """The document does not end with a brace: all pieces had one but for the last. A byte order mark is not read."""
    return size - sum(b.bytes for b in blocks) in (-1, 2)


def _placed(blocks: list, size: int, path: str) -> dict[int, Start]:
    """Where each range stands; the document must end outside strings and brackets."""
    starts, inside, depth = {}, False, 0
    for b in blocks:
        starts[b.block] = Start(inside, depth, False)
        depth += b.d1 if inside else b.d0
        inside ^= b.odd
    if _unclosed(blocks, size):
        starts[blocks[-1].block].cut = blocks[-1].bytes
        depth += not inside
    if inside or depth:
        raise ValueError(f"{path}: no JSON, it ends within a string or brackets")
    return starts


def first_byte(spark: SparkSession, path: str) -> str:
    """The first character of a document that is no blank."""
    return next((b.head for b in _blocks(_pieces(spark, path)) if b.head), "")


def records(spark: SparkSession, path: str, size: int, key: str | None = None) -> DataFrame:
    """pos and value, the text of each record, of a document of size bytes."""
    pieces = _pieces(spark, path)
    blocks = _blocks(pieces)
    head = next((b.head for b in blocks if b.head), "")
    none = spark.createDataFrame([], "pos long, value string")
    if head not in ("[", "{"):
        # a blank document has no brace but that put behind its only piece
        blank = head == "}" and _unclosed(blocks, size) and sum(b.d0 for b in blocks) == -1
        if head and not blank:
            raise ValueError(f"{path}: no JSON list or object")
        return none
    starts = _placed(blocks, size, path)
    under = key if head == "{" else None
    if head == "{":
        if key is None:
            return none
        last, listed = _listed(pieces, starts, key), False
        for b in blocks:
            starts[b.block].listed = listed
            listed = last.get(b.block, listed)
    parts = materialize(_cut(pieces, starts, 1 if under is None else 2, under))
    if bad := parts.where("kind = 'bad'").first():
        raise ValueError(f"{path}: no JSON, {bad.value!r} beside the list")
    if under is None and parts.where("opens").count() > 1:
        raise ValueError(f"{path}: no JSON, more than one list")
    # of a range, what begins in it, and what goes on in it, has no end or no beginning
    owner, heads = [], {}
    ends = sorted((r.block, r.kind != "head", r.kind == "tail", r.nth) for r in parts.where("kind != 'whole'").select("block", "kind", "nth").collect())
    current = None
    for block, goes_on, _, nth in sorted(ends, key=lambda e: (e[0], not e[1])):
        if goes_on:
            owner.append((block, *current))
        else:
            current = (block, nth)
            heads[block] = nth
    owners = F.broadcast(spark.createDataFrame(owner, "block long, own long, own_nth long"))  # two rows a range at most
    whole = parts.where("kind = 'whole'").select("block", "nth", "value")
    begun = parts.where("kind = 'head'").select(F.col("block").alias("own"), F.col("nth").alias("own_nth"), "block", "opens", "closes", "value")
    later = parts.where("kind in ('tail', 'middle')").join(owners, "block").select("own", "own_nth", "block", "opens", "closes", "value")
    joined = begun.unionByName(later).groupBy("own", "own_nth").agg(
        F.sort_array(F.collect_list(F.struct("block", "value"))).alias("v"), F.max("opens").alias("opens"), F.max("closes").alias("closes")
    )  # the parts of one record
    joined = joined.select(F.col("own").alias("block"), F.col("own_nth").alias("nth"), F.array_join(F.col("v.value"), "").alias("value"), "opens", "closes")
    joined = joined.where("not (opens and closes) or value rlike '\\\\S'").select("block", "nth", "value")
    every = materialize(whole.unionByName(joined))
    offsets, total = [], 0
    for r in sorted(every.groupBy("block").count().collect()):  # a number a range
        offsets.append((r.block, total))
        total += r["count"]
    placed = every.join(F.broadcast(spark.createDataFrame(offsets, "block long, offset long")), "block")
    return placed.select((F.col("offset") + F.col("nth")).alias("pos"), "value")
