"""Near copies of a similarity by SimHash and multi-index hashing: the dedup that a corpus wants.

The 64 bits and two differing bits of simhash.py find little but copies: texts of which a fifth of the five-word
shingles differ are about 10 of 64 bits apart. Here a fingerprint has BITS bits, of the different shingles of a
text, and the distance over all of them estimates the Jaccard similarity of the sets: bits differ with a chance of
acos(2 s / (1 + s)) / pi at similarity s, 0.15 at 0.8. Pairs at most that far apart, and one standard deviation,
are near copies.

SEGMENTS segments of WIDTH bits have a table each. A fingerprint enumerates the Hamming ball of radius 1 round each
of its segments (of two values a bit apart only the one without the bit looks), fetches who has such a value, and
the distance over all bits decides. Two texts share a segment but for one bit with a chance of 0.12 at similarity
0.8, so that 16 segments miss one pair in eight there, one in 30 at 0.85, one in 1000 at 0.9; groups are found by
any of their pairs. WIDTH is to be some 4 to 6 bits more than the logarithm of the number of different texts, so
that few values are shared by chance: 24 is for some ten millions, 32 for billions.

A value shared by many is no group in which all are paired: who fetches it is compared with its first
fingerprint alone, linear work that connects the copies of a text; afterwards those that this has not connected are
compared with the others, within the join that fetches them, which gives the near ones alone. No candidate is left
out.

A null or blank text has no shingles and fingerprint zero; texts of fewer words have one shingle. Texts are read
whole, however long. Equal texts, and repeated rows, share a fingerprint. Rows without doc_id connect others, and
stay. An empty table gives an empty result. Only doc_id and text are read; keep_one() gives back all columns of its
input, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import columns_of, components, materialize, settled, spare
from millrace.llm.simhash import shingle_hashes

N_WORDS, SIMILARITY = 5, 0.8
BITS, SEGMENTS, WIDTH = 512, 16, 24
LONGS = [f"w{i}" for i in range(BITS // 64)]
#: Hashes turned into bits at a time: BITS bytes each.
CHUNK = 1 << 13


def max_distance(similarity: float, bits: int = BITS) -> int:
    """Bits that texts of the similarity differ in, and one standard deviation."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + math.sqrt(bits * p * (1 - p)))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """BITS bits as longs: of each, whether it is set in over half of the different hashes, each made BITS bits long."""
    hashes = np.unique(hashes)
    ones = np.zeros(BITS, dtype=np.int64)
    steps = np.arange(1, len(LONGS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), CHUNK):
        z = hashes[at : at + CHUNK, None] + steps  # splitmix64
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(31))).astype("<u8")
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")


def wide_prints(docs: DataFrame, n: int = N_WORDS, seed: int = 42) -> DataFrame:
    """The columns of docs without text, and the longs of each row's fingerprint."""

    @F.arrow_udf("struct<" + ",".join(f"{w}:long" for w in LONGS) + ">")
    def prints(texts: pa.Array) -> pa.Array:
        rows = np.array([wide_print(shingle_hashes(t.as_py() or b"", n, seed)) for t in texts], dtype=np.int64).reshape(-1, len(LONGS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(len(LONGS))], names=LONGS)

    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, prints(F.col("text").cast("binary")).alias("print")).select(*rest, "print.*")


def segment_keys() -> Column:
    """The table keys of a fingerprint: each segment's value, with the number of the segment above it."""
    keys = []
    for s in range(SEGMENTS):
        word, at = divmod(s * WIDTH, 64)
        value = F.shiftrightunsigned(LONGS[word], at)
        if at + WIDTH > 64:
            value = value.bitwiseOR(F.shiftleft(LONGS[word + 1], 64 - at))
        keys.append(value.bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")).bitwiseOR(F.lit(s << WIDTH).cast("long")))
    return F.array(*keys)


def ball(key: Column) -> Column:
    """The keys to look up for one: itself and those with one bit more (null for each bit it has)."""
    bits = [F.lit(1 << i).cast("long") for i in range(WIDTH)]
    return F.array(key, *[F.when(key.bitwiseAND(bit) == 0, key.bitwiseOR(bit)) for bit in bits])


def apart(a: str, b: str) -> Column:
    """Differing bits of two structs of the longs."""
    return sum(F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in LONGS)


def near(pairs: DataFrame, fps: DataFrame, max_bits: int) -> DataFrame:
    """The pairs (a, b) of ids of fps (id and longs) that are at most max_bits apart, written."""
    side = lambda name: fps.select(F.col("id").alias(name), F.struct(*LONGS).alias(f"{name}_print"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return materialize(both.where(apart("a_print", "b_print") <= max_bits).select("a", "b"))


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): edges between fingerprints (id and longs, each different) that connect what all fetched pairs at most
    max_bits apart connect."""
    # those that share a value are compared with its first; what is exploded is sized as before, hence the hints
    table = fps.select("id", F.explode(segment_keys()).alias("key"))
    sizes = table.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    crowded = materialize(table.join(sizes.hint("shuffle_hash"), "key").where("id != first").select("key", "id", "first"))
    shared = near(crowded.select(F.col("id").alias("a"), F.col("first").alias("b")), fps, max_bits)
    # all are compared with the first of each value that they fetch, unless they are connected already
    known = materialize(_named(fps, components(shared), "id", "mine"))
    table = known.select("id", "mine", F.explode(segment_keys()).alias("key"))
    sizes = materialize(table.groupBy("key").agg(F.min(F.struct("id", "mine")).alias("first"), (F.count("*") > 1).alias("many")))
    probes = table.select("id", "mine", F.explode(ball(F.col("key"))).alias("key")).where("key is not null")
    met = materialize(probes.join(sizes.hint("shuffle_hash"), "key").where("many or mine != first.mine").select("key", "id", "many", F.when(F.col("mine") != F.col("first.mine"), F.col("first.id")).alias("first")))
    beside = met.where("first is not null").select(F.col("id").alias("a"), F.col("first").alias("b"))
    firsts = shared.unionByName(near(beside, fps, max_bits))
    # the others of a value, by their component; each asks the components it is not in
    part = components(firsts)
    prints = fps.select("id", F.struct(*LONGS).alias("print"))
    others = materialize(_named(crowded.drop("first"), part, "id", "theirs").join(prints, "id").select("key", "theirs", F.col("id").alias("b"), F.col("print").alias("b_print")))
    asks = _named(met.where("many").select("key", "id").distinct(), part, "id", "mine")
    open_ = asks.join(others.select("key", "theirs").distinct(), "key").where("mine != theirs").join(prints, "id")
    open_ = open_.select("key", "theirs", F.col("id").alias("a"), F.col("print").alias("a_print"))
    fits = (open_.key == others.key) & (open_.theirs == others.theirs) & (apart("a_print", "b_print") <= max_bits)
    return firsts.unionByName(open_.join(others, fits).select("a", "b").distinct())


def _named(df: DataFrame, part: DataFrame, of: str, name: str) -> DataFrame:
    """df with the component of a column of ids: that of part (node, component), or the id itself."""
    known = part.select(F.col("node").alias(of), F.col("component").alias("__component"))
    return df.join(known, of, "left").withColumn(name, F.coalesce("__component", of)).drop("__component")


def gone(rows: DataFrame, row: str, columns: list[Column], n: int, similarity: float, seed: int) -> DataFrame:
    """The numbers (row) of the rows that go."""
    place = F.struct(F.col("doc_id"), F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(7), *columns).alias("h2"), F.col(row).alias("row"))
    prints = materialize(wide_prints(rows.select(F.when(F.col("doc_id").isNotNull(), place).alias("place"), "text"), n, seed))
    fps = materialize(prints.groupBy(*LONGS).agg(F.min("place").alias("first")).withColumn("id", F.monotonically_increasing_id()))
    part = components(links(fps.select("id", *LONGS), max_distance(similarity)))
    linked = materialize(fps.join(part, fps.id == part.node, "left").select(*LONGS, "first", F.coalesce("component", "id").alias("component")))
    kept = linked.groupBy("component").agg(F.min("first").alias("kept"))
    named = linked.join(kept, "component").select(*LONGS, F.col("kept.row").alias("kept"))
    return prints.join(named, LONGS).where(F.col("place.row") != F.col("kept")).select(F.col("place.row").alias(row))


def keep_one(docs: DataFrame, n: int = N_WORDS, similarity: float = SIMILARITY, seed: int = 42) -> DataFrame:
    """One row of docs, with all columns, of each group of near copies: that of its smallest doc_id, and of its rows
    that share this id the one of the smallest hash; an id that unrelated texts share stays with each of them.

    Texts are written once with a row number, and no more shuffled than the join with the rows that go needs: these
    are numbers, broadcast while they are below Spark's threshold."""
    row, columns = spare(docs, "__row")[0], columns_of(docs)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    dropped = settled(docs.sparkSession, lambda: gone(rows, row, columns, n, similarity, seed))
    return rows.join(dropped, row, "left_anti").select(*columns)
