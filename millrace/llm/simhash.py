"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints at most max_bits apart agree in one segment but
for max_bits // 2 bits (pigeonhole). So there is a table for each segment, from its value to the fingerprints
that have it; each fingerprint enumerates the Hamming ball of that radius round each of its segments, fetches
the fingerprints found there, and the distance over all bits decides. Of two values a bit apart only the one
without the bit looks for the other, which halves the balls.

A value that more than MOST different fingerprints share (of a large group of near copies, say) is not paired
with all of them. Who meets such a value is entered in a further table instead, under each whole fingerprint
at most one bit off: there all that meet are at most two bits apart, so a chain links them, not pairs. Both
ways are exact; the work grows with the number of different fingerprints, and no key is hot.

A null or blank text has fingerprint zero. Copies and repeated rows share a fingerprint and a component.
A null doc_id gets its fingerprint and the smallest id it is linked to, or null. Texts are read whole, however
long; a bit set in just half of the hashes (a tie) is 0. An empty table gives an empty result. Only doc_id and
text are read; keep_one() gives back all columns of its input, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, components, materialize, spare

BITS, SEGMENT = 64, 32
#: Bits that links() reaches at most, as the chains do.
REACH = 2
#: Fingerprints of one segment value that are compared one by one.
MOST = 64
#: Hashes turned into bits at a time: 64 bytes each.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, n: int, seed: int) -> np.ndarray:
    """XXH64 of each run of n words (white space between them becomes one space), A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(n))) if len(words) >= n else [words]
    return np.fromiter((digest(b" ".join(x), seed) for x in runs), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed long."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        octets = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (long) of each row of docs (doc_id, text)."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingle_hashes(t.as_py() or b"", n, seed)) for t in texts], pa.int64())

    return docs.select("doc_id", prints(F.col("text").cast("binary")).alias("fp"))


def segments(fp: Column) -> Column:
    """The table keys of a fingerprint: each segment's value, with the number of the segment above it."""
    mask = F.lit((1 << SEGMENT) - 1).cast("long")
    keys = [F.shiftrightunsigned(fp, SEGMENT * s).bitwiseAND(mask).bitwiseOR(F.lit(s << SEGMENT).cast("long")) for s in range(BITS // SEGMENT)]
    return F.array(*keys)


def ball(key: Column, radius: int) -> Column:
    """The keys to look up for one key: itself and, for radius 1, those with one bit more (null for each bit it has)."""
    bits = [F.shiftleft(F.lit(1).cast("long"), i) for i in range(SEGMENT * radius)]
    return F.array(key, *[F.when(key.bitwiseAND(bit) == 0, key.bitwiseOR(bit)) for bit in bits])


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, max_bits: int = 2, most: int = MOST) -> DataFrame:
    """(a, b): edges between different fingerprints (fp); what they connect is what all pairs at most max_bits
    apart connect."""
    if not 0 <= max_bits <= REACH:
        raise ValueError(f"max_bits must be 0 to {REACH}: the tables do not reach further")
    # Spark sizes what is exploded as the fingerprints it came from: the hints keep all that is below from being broadcast
    table = fps.select("fp", F.explode(segments(F.col("fp"))).alias("key"))
    sizes = table.groupBy("key").agg(F.count("*").alias("n"))
    # of a crowded value only that it is one
    found = table.join(sizes.hint("shuffle_hash"), "key").select("key", F.when(F.col("n") <= most, F.col("fp")).alias("other")).distinct()
    probes = table.select("fp", F.explode(ball(F.col("key"), max_bits // 2)).alias("key")).where("key is not null")
    near = F.col("other").isNull() | ((F.col("fp") != F.col("other")) & (distance("fp", "other") <= max_bits))
    met = materialize(probes.join(found.hint("shuffle_hash"), "key").where(near).select("fp", "other"))
    pairs = met.where("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return pairs.unionByName(chains(met.where("other is null").select("fp").distinct(), max_bits)).distinct()


def chains(fps: DataFrame, max_bits: int) -> DataFrame:
    """As links(), by whole values: a fingerprint is entered under itself and each value one bit off, so that an
    entry has 65 of them at most, two bits apart at most. For two bits each is linked to the one before it in an
    entry, for one bit to the fingerprint that the entry is."""
    off = [F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(BITS)]
    table = fps.select(F.col("fp").alias("a"), F.explode(F.array("fp", *off)).alias("entry"))
    if max_bits < 2:
        met = table.hint("merge").join(fps.select(F.col("fp").alias("b")), F.col("entry") == F.col("b"))
    else:
        met = table.select("a", F.lag("a").over(Window.partitionBy("entry").orderBy("a")).alias("b")).where("b is not null")
    return met.where((F.col("a") != F.col("b")) & (distance("a", "b") <= max_bits)).select("a", "b")


def parts(fps: DataFrame) -> DataFrame:
    """(fp, component) of the fingerprints (fp) that are linked to another; component is the smallest of them."""
    return components(links(fps)).select(F.col("node").alias("fp"), "component")


def link(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (long) and component_id, the smallest doc_id reachable over links, of each row of docs."""
    prints = materialize(fingerprints(docs, n, seed))
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = materialize(parts(fps).join(fps, "fp"))
    least = found.groupBy("component").agg(F.min("rep").alias("least"))
    named = fps.join(found.join(least, "component").select("fp", "least"), "fp", "left").select(
        "fp", F.coalesce("least", "rep").alias("component_id")
    )
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """One row of docs, with all columns, of each component of linked fingerprints: that of its smallest doc_id,
    and of its rows that share this id the one of the smallest hash; an id that unrelated texts share stays with
    each of them. Rows without id have no group and stay.

    Texts are written once with a row number, and no more shuffled than the join with the rows that go needs:
    these are numbers, broadcast while they are below Spark's threshold."""
    row, columns = spare(docs, "__row")[0], columns_of(docs)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    place = F.struct(F.col("doc_id"), F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(7), *columns).alias("h2"), F.col(row).alias("row"))
    numbered = rows.select(F.when(F.col("doc_id").isNotNull(), place).alias("doc_id"), "text")
    prints = materialize(fingerprints(numbered, n, seed).select(F.col("doc_id").alias("place"), "fp"))
    fps = materialize(prints.groupBy("fp").agg(F.min("place").alias("first")))
    linked = materialize(parts(fps.select("fp")).join(fps, "fp"))
    least = linked.groupBy("component").agg(F.min("first").alias("kept"))
    named = linked.join(least, "component").select("fp", "kept")
    kept = fps.join(named, "fp", "left").select("fp", F.coalesce("kept", "first").getField("row").alias("kept"))
    gone = materialize(prints.join(kept, "fp").where(F.col("place.row") != F.col("kept")).select(F.col("place.row").alias(row)))
    return rows.join(gone, row, "left_anti").select(*columns)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
