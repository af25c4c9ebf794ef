"""Vector code compression: each part of a vector becomes the number of the nearest entry of the part's codebook.

Components become whole numbers, floor(scale * x), and all that follows is exact. The codebooks start as the parts of
the first vectors. A round assigns every part to its nearest entry, by the squared distance |x|^2 - 2 x.c + |c|^2 with
int64 matrix products, ties to the lower entry, and moves each entry to the floor of the mean of its parts; an entry
without parts stays. The codebooks (entries x components numbers) are broadcast; a task sends one sum for each entry
that it used, so the shuffle of a round grows with the tasks, not with the vectors.

Rows whose vector is null, or holds a null or a component that is not finite, go. The width is that of the first
vector with an id whose width is a positive multiple of the number of parts; vectors of another width stay with
a null code and a null error, and take no part in the codebooks. Rows without id are coded but start no codebook.
Repeated rows are coded each; equal ids are ordered by their numbers. Fewer rows than entries make smaller codebooks.
An empty table gives an empty result. A component beyond REACH in size is an error, as sums would leave 64 bits.
Other columns are not read, but for the label where one is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest whole number that a component may become: squared distances of 65,536 components stay below 2^63.
REACH = (1 << 22) - 1
#: Vectors whose distances a task holds at a time.
BLOCK = 4096
#: Labels with more than one of MANY rows, fewer than MANY, have their sums broadcast to their rows.
MANY = 1000


@dataclass(frozen=True)
class Codebooks:
    """entries: int64 of (part, entry, component of the part)."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_numbers(vectors: DataFrame, keep: list[Column], vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The columns kept, and v, the whole numbers of the vector, of the rows that have one; written."""
    given = vectors.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def number(x: Column) -> Column:
        n = F.floor(x.cast("double") * scale)
        fits = F.abs(x.cast("double") * scale) <= REACH
        return F.when(fits, n.cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond {REACH / scale}")).cast("int"))

    return materialize(given.select(*keep, F.transform(vector, number).alias("v")))


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; the driver reads these few. None where no vector fits."""
    fits = rows.where(f"vec_id IS NOT NULL AND size(v) > 0 AND size(v) % {parts} = 0")
    first = fits.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if first is None:
        return None
    some = fits.where(F.size("v") == first.n).orderBy("vec_id", "v").limit(entries).collect()
    v = np.array([r.v for r in some], dtype=np.int64)
    return Codebooks(v.reshape(len(v), parts, -1).transpose(1, 0, 2).copy())


def nearest(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors v (n, width): the nearest entry of each part (n, parts), and the squared distances to it."""
    parts, _, width = books.shape
    norms = (books * books).sum(axis=2)
    entry, distance = (np.empty((len(v), parts), dtype=np.int64) for _ in range(2))
    for p in range(parts):
        x = v[:, p * width : (p + 1) * width]
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ books[p].T) + norms[p]
        entry[:, p] = d.argmin(axis=1)
        distance[:, p] = np.take_along_axis(d, entry[:, p, None], axis=1)[:, 0]
    return entry, distance


def _matrix(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have vectors of the width, and these vectors."""
    fits = column.value_lengths().to_numpy(zero_copy_only=False) == width
    flat = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, flat.astype(np.int64).reshape(-1, width)


def next_codebooks(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round over all rows."""
    shared, shape = rows.sparkSession.sparkContext.broadcast(books.entries), books.entries.shape
    parts, entries, width = shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, dtype=np.int64), np.zeros(shape[:2], dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                _, v = _matrix(b.column(0).slice(at, BLOCK), parts * width)
                entry, _ = nearest(v, shared.value)
                for p in range(parts):
                    np.add.at(total[p], entry[:, p], v[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(entry[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        used = total[part, entry]
        component = np.tile(np.arange(width), len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(x, width).astype(np.int32)) for x in (part, entry)]
            + [pa.array(component.astype(np.int32)), pa.array(used.ravel()), pa.array(np.repeat(count[part, entry], width))],
            ["part", "entry", "component", "s", "n"],
        )

    partial = rows.select("v").mapInArrow(sums, "part int, entry int, component int, s long, n long")
    new = books.entries.copy()
    for r in partial.groupBy("part", "entry", "component").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        new[r.part, r.entry, r.component] = r.s // r.n
    return Codebooks(new)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = next_codebooks(rows, books)
    return books


def coder(rows: DataFrame, books: Codebooks) -> Column:
    """struct<code: binary, error: long> of v: an entry number a byte (two for more than 256 entries, the high one
    first), and the squared distances to the entries, summed."""
    shared = rows.sparkSession.sparkContext.broadcast(books.entries)
    width, kind = books.width, ">u1" if books.entries.shape[1] <= 256 else ">u2"

    @F.arrow_udf("struct<code: binary, error: long>")
    def code(column: pa.Array) -> pa.Array:
        codes, errors = [], []
        for at in range(0, len(column), BLOCK):
            fits, v = _matrix(column.slice(at, BLOCK), width)
            entry, distance = nearest(v, shared.value)
            spot = iter(zip(entry.astype(kind), distance.sum(axis=1).tolist()))
            for fit in fits.tolist():
                e, d = next(spot) if fit else (None, None)
                codes.append(e.tobytes() if fit else None)
                errors.append(d)
        return pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], ["code", "error"])

    return code("v")


def decoder(books: Codebooks) -> Column:
    """The whole numbers that the bytes of a column code stand for, as array<long>; null for null."""
    flat, kind = books.entries, ">u1" if books.entries.shape[1] <= 256 else ">u2"
    parts = flat.shape[0]

    @F.arrow_udf("array<long>")
    def decode(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            out.append(None if x is None else flat[np.arange(parts), np.frombuffer(x, dtype=kind).astype(np.int64)].ravel().tolist())
        return pa.array(out, pa.list_(pa.int64()))

    return decode("code")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded (label, error, written) with label_error, the errors of all rows of the label, nulls together. The sums
    of labels with very many rows are broadcast, those of the rest joined."""
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    limit = sums.agg(F.sum("n") / MANY).scalar()
    hot = F.broadcast(sums.where(F.col("n") > limit).drop("n").withColumnRenamed("label", "of"))
    rest = sums.where(F.col("n") <= limit).drop("n").withColumnRenamed("label", "of")
    same = F.col("label").eqNullSafe(F.col("of"))
    many = coded.join(hot, same).drop("of")
    return many.unionByName(coded.join(hot, same, "left_anti").join(rest, same).drop("of"))


def compress(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, **sizes: int) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code, error of vectors (vec_id, label and the vector), and the codebooks."""
    rows = whole_numbers(vectors, [F.col("vec_id"), F.col("label")], vector, scale)
    books = train(rows, **sizes)
    if books is None:
        return rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    return materialize(rows.select("vec_id", "label", coder(rows, books).alias("c")).select("vec_id", "label", "c.*")), books
