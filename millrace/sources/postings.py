"""The full-text index as segments: what changes is written as a new segment, and what it replaces is marked as removed.

A segment has the postings of some documents (key, field, pos, stem), dealt in ranges of stem and key, so that a word
that is in every document is in many files, each small; a table of the files with their first and last stem says
which ones a word or a prefix is in, and no other is read. A version is a table of the segments' files and one of the
removed keys, each with the generation that removed it: postings of a segment that is older don't count. When there are
more than MOST segments, the smaller ones are merged into one, without what was removed. A version is written
whole or not at all, and the one before it stays for those who read it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.search import TEXT_FIELDS, full_text, postings
from millrace.operators.tables import delete, latest, materialize, names_in, next_version

#: Segments that may stand side by side.
MOST = 8
FILES = "segment string, born long, file string, first string, last string, n long"


def _version(spark: SparkSession, path: str, number: int | None = None) -> tuple[str, int] | None:
    folder = latest(spark, path) if number is None else f"{path}/version={number:010d}"
    return (folder, int(folder.rpartition("=")[2])) if folder else None


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{folder}/files")


def _dealt(flat: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Postings in ranges of stem and key, sorted by stem. Where there is one field, its name is left behind and put back."""
    rows = flat.drop("field") if len(fields) == 1 else flat
    rows = rows.repartitionByRange("stem", key).sortWithinPartitions("stem")
    field = F.lit(fields[0]).alias("field") if len(fields) == 1 else F.col("field")
    return rows.select(key, field, "pos", "stem")


def _write_segment(flat: DataFrame, key: str, path: str, born: int, fields: tuple[str, ...]) -> DataFrame:
    """Writes postings as a segment; its FILES rows."""
    name = uuid.uuid4().hex
    folder = f"{path}/segments/{name}"
    _dealt(flat, key, fields).write.parquet(folder)
    rows = flat.sparkSession.read.schema(flat.schema).parquet(folder)
    ends = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("stem").alias("first"), F.max("stem").alias("last"), F.count("*").alias("n"))
    return ends.select(F.lit(name).alias("segment"), F.lit(born).cast("long").alias("born"), F.concat(F.lit(f"{folder}/"), "file").alias("file"), "first", "last", "n")


def build(docs: DataFrame, key: str, path: str, fields: tuple[str, ...] = TEXT_FIELDS, stemmed: bool = True) -> int:
    """Writes the index of docs as a new version under path, of one segment; the version's number."""
    spark = docs.sparkSession
    with next_version(spark, path) as folder:
        number = int(folder.rpartition("=")[2])
        _write_segment(postings(docs, key, fields, stemmed), key, path, number, fields).write.parquet(f"{folder}/files")
        docs.select(key).limit(0).withColumn("at", F.lit(number).cast("long")).write.parquet(f"{folder}/removed")
    _sweep(spark, path)
    return number


def update(changed: DataFrame, removed: DataFrame, key: str, path: str, fields: tuple[str, ...] = TEXT_FIELDS, stemmed: bool = True, base: int | None = None) -> int:
    """The index after documents were added or changed (whole rows) and others removed (their keys), from the latest
    version or that of a number, as a new one, whose number it gives. What is written grows with these documents, but for
    the small tables of files and removed keys, and where segments are merged."""
    spark = changed.sparkSession
    old, _ = _version(spark, path, base)
    with next_version(spark, path) as folder:
        number = int(folder.rpartition("=")[2])
        gone = changed.select(key).unionByName(removed.select(key)).distinct().withColumn("at", F.lit(number).cast("long"))
        oldest = _files(spark, old).agg(F.coalesce(F.min("born"), F.lit(number))).first()[0]
        before = spark.read.parquet(f"{old}/removed").where(F.col("at") > oldest)  # others concern no segment any more
        before.unionByName(gone).groupBy(key).agg(F.max("at").alias("at")).write.parquet(f"{folder}/removed")
        new = _write_segment(postings(changed, key, fields, stemmed), key, path, number, fields)
        files = materialize(_files(spark, old).unionByName(new))
        _merged(spark, folder, files, key, path, MOST, fields).coalesce(1).write.parquet(f"{folder}/files")
    _sweep(spark, path)
    return number


def _live(spark: SparkSession, folder: str, files: list[tuple[str, int]], key: str, wanted: Column | None = None) -> DataFrame:
    """The postings of files (name, generation) that were not removed since."""
    removed = spark.read.parquet(f"{folder}/removed")
    kind = removed.select(key).schema.fields[0].dataType.simpleString()
    schema = f"{key} {kind}, field string, pos int, stem string"
    out = None
    for born in sorted({b for _, b in files}):
        rows = spark.read.schema(schema).parquet(*[f for f, b in files if b == born])
        rows = rows if wanted is None else rows.where(wanted)
        rows = rows.join(removed.where(F.col("at") > born).select(key), key, "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def _merged(spark: SparkSession, folder: str, files: DataFrame, key: str, path: str, most: int, fields: tuple[str, ...]) -> DataFrame:
    """FILES rows of the segments, the smaller ones merged so that half of most are left if there are more."""
    sizes = files.groupBy("segment").agg(F.sum("n").alias("n"), F.max("born").alias("born")).orderBy(F.desc("n"), "segment").collect()
    if len(sizes) <= most:
        return files
    small = sizes[max(0, most // 2 - 1) :]
    among = F.col("segment").isin([r.segment for r in small])
    parts = [(r.file, r.born) for r in files.where(among).select("file", "born").collect()]
    # what was removed up to the youngest of them is left out, and what is removed later is younger
    new = _write_segment(_live(spark, folder, parts, key), key, path, max(r.born for r in small), fields)
    return files.where(~among).unionByName(new)


def _sweep(spark: SparkSession, path: str) -> None:
    """Deletes the segments that no version left has."""
    used = {r.segment for n in names_in(spark, path) if n.startswith("version=") and "_complete" in names_in(spark, f"{path}/{n}") for r in _files(spark, f"{path}/{n}").select("segment").distinct().collect()}
    for name in names_in(spark, f"{path}/segments"):
        if name not in used:
            delete(spark, f"{path}/segments/{name}")


class Index:
    """The postings of a version, looked up by word; search.full_text() and matching() take it as an index."""

    def __init__(self, spark: SparkSession, path: str, key: str, version: int | None = None):
        self.spark, self.key = spark, key
        self.folder, self.version = _version(spark, path, version)

    def word(self, word: str, prefix: bool) -> DataFrame:
        """The postings of a stem, or of all that begin so, from the files that can have them."""
        low, high = F.lit(word), F.lit(word + "\U0010ffff" if prefix else word)
        hit = _files(self.spark, self.folder).where((F.col("last") >= low) & (F.col("first") <= high))
        fits = F.startswith("stem", low) if prefix else F.col("stem") == low
        return _live(self.spark, self.folder, [(r.file, r.born) for r in hit.select("file", "born").collect()], self.key, fits)

    def keys(self, phrases: list[list[str]]) -> DataFrame:
        return full_text(self, self.key, phrases)


__all__ = ["Index", "build", "update"]
