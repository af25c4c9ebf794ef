"""Reading and writing the catalog: JSON in two shapes, Parquet tables, dated snapshots, URL state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.functions.urls import Skips
from millrace.operators.crawl import Limits
from millrace.operators.memory import STATE
from millrace.operators.tables import delete, latest, materialize, names_in, next_version, scratch
from millrace.schema import CATALOG
from millrace.sources import arrays, postings

#: A table of another version is built anew.
SCHEMA_VERSION = 2
META = "schema_version int, buckets int, index_version int"
#: Records that a bucket of the table is to have when it is built.
BUCKET_ROWS = 200_000
#: A path with such an end has a record a line and is read in parallel, in a file or a folder of parts.
LINES = (".jsonl", ".ndjson")
#: A longer document is cut into its records by many tasks (sources.arrays); a shorter one is one value of one task.
SPLIT_BYTES = 32 << 20


def _value(text: Column) -> Column:
    """The one JSON value of a text; null if it is none, or if anything stands beside it, which the parser alone would
    leave out without a word."""
    listed = F.try_parse_json(F.concat(F.lit("["), F.regexp_replace(text, r"^\x{FEFF}", ""), F.lit("]")))
    at = lambda i: F.try_variant_get(listed, f"$[{i}]", "variant")
    return F.when(at(1).isNull(), at(0))


def _parsed(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """v, the value of each line, or of the whole document; text that is no JSON, or too long for one value
    (a line beyond 128 MB), is an error, not an empty catalog. Blank text has no value."""
    text = spark.read.text(path, wholetext=whole).where(r"value rlike '[^\\x{FEFF}\\s]'")
    v = _value(F.col("value"))
    why = F.lit(f"{path}: no JSON, or a value beyond 128 MB")
    return text.select(F.when(v.isNull(), F.raise_error(why).cast("variant")).otherwise(v).alias("v"))


def _size(spark: SparkSession, path: str) -> int:
    """The bytes of a file; of a folder none."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen()


def _records(spark: SparkSession, path: str, wrapper: str | None) -> DataFrame:
    """pos and record of a JSON document, a list or a list under the key wrapper, or of lines; pos rises with the place."""
    if path.rstrip("/").endswith(LINES):
        return _parsed(spark, path, False).select(F.monotonically_increasing_id().alias("pos"), F.col("v").alias("record"))
    if (size := _size(spark, path)) > SPLIT_BYTES:
        record = _value(F.col("value"))
        why = F.concat(F.lit(f"{path}: no JSON, record "), F.col("pos"))
        return arrays.records(spark, path, size, wrapper).select("pos", F.when(record.isNull(), F.raise_error(why).cast("variant")).otherwise(record).alias("record"))
    listed = F.try_variant_get("v", "$", "array<variant>")
    if wrapper is not None:
        key = "$['" + wrapper.replace("\\", "\\\\").replace("'", "\\'") + "']"
        listed = F.coalesce(F.try_variant_get("v", key, "array<variant>"), listed)
    return _parsed(spark, path, True).select(F.posexplode(listed).alias("pos", "record"))


def read_json(spark: SparkSession, path: str, schema: StructType = CATALOG, wrapper: str | None = None) -> DataFrame:
    """Records of a JSON document, a list or an object with the list under the key wrapper, or of lines, with pos, their place in it (of lines
    it rises, with gaps)."""
    fields = [F.try_variant_get("record", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema]
    return _records(spark, path, wrapper).select("pos", *fields)


def read_raw(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """pos and value, the JSON text of each record, as validation.untyped() takes them; a document that is no
    list gives no rows and is an issue of its own (is_list)."""
    return _records(spark, path, wrapper).select("pos", F.to_json("record").alias("value"))


def is_list(spark: SparkSession, path: str) -> bool:
    if path.rstrip("/").endswith(LINES):
        return True
    if _size(spark, path) > SPLIT_BYTES:
        return arrays.first_byte(spark, path) == "["
    kind = _parsed(spark, path, True).select(F.schema_of_variant("v")).first()
    return kind is not None and (kind[0] or "").startswith("ARRAY")


def _bucket(records: DataFrame, buckets: int) -> Column:
    """The bucket of a record, by its id; records without one are dealt by what they are."""
    name = F.coalesce("id", F.to_json(F.struct(*[c for c in records.columns if c != "id"])), F.lit(""))
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def _write_buckets(records: DataFrame, path: str, buckets: int) -> DataFrame:
    """Writes records by bucket in a new folder under path; the rows of the table of buckets: bucket, part, n."""
    part = f"{path}/parts/{uuid.uuid4().hex}"
    dealt = records.withColumn("bucket", _bucket(records, buckets))
    # tasks of like size, whatever the buckets' sizes
    dealt.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(part)
    schema = StructType([*records.schema.fields, StructField("bucket", IntegerType())])
    counts = records.sparkSession.read.schema(schema).parquet(part).groupBy("bucket").agg(F.count("*").alias("n"))
    return counts.select("bucket", F.lit(part).alias("part"), "n")


def _read_buckets(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    paths = [f"{r.part}/bucket={r.bucket}" for r in rows]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _sweep(spark: SparkSession, path: str) -> None:
    """Deletes the folders of records that no version left has."""
    versions = [n for n in names_in(spark, path) if n.startswith("version=") and "_complete" in names_in(spark, f"{path}/{n}")]
    used = {r.part.rpartition("/")[2] for n in versions for r in spark.read.parquet(f"{path}/{n}/buckets").select("part").distinct().collect()}
    for name in names_in(spark, f"{path}/parts"):
        if name not in used:
            delete(spark, f"{path}/parts/{name}")


def _close(spark: SparkSession, folder: str, table: DataFrame, buckets: int, index: int) -> int:
    table.coalesce(1).write.parquet(f"{folder}/buckets")
    spark.createDataFrame([(SCHEMA_VERSION, buckets, index)], META).coalesce(1).write.parquet(f"{folder}/meta")
    return spark.read.parquet(f"{folder}/buckets").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def rebuild(records: DataFrame, path: str) -> int:
    """Writes the query table, in buckets by id, and its index as a new version under path; a failed write leaves the
    old one. Returns the rows."""
    spark = records.sparkSession
    with next_version(spark, path) as folder, scratch(spark):
        rows = materialize(records)
        buckets = max(1, -(-rows.count() // BUCKET_ROWS))
        written = _write_buckets(rows, path, buckets)
        total = _close(spark, folder, written, buckets, postings.build(rows, "id", f"{path}/index"))
    _sweep(spark, path)
    return total


def merge(changed: DataFrame, removed: DataFrame, path: str) -> int:
    """The table with changed records (whole ones, each in place of all records of its id) and without those whose id
    is in removed (id), as a new version: only their buckets are written anew, and only their postings. Returns
    the rows. Records without id can't be named and stay; changed ones without id are added."""
    spark = changed.sparkSession
    old = latest(spark, path)
    meta = spark.read.parquet(f"{old}/meta").first()
    table = spark.read.parquet(f"{old}/buckets")
    with next_version(spark, path) as folder, scratch(spark):
        new = materialize(changed)
        ids = materialize(new.select("id").unionByName(removed.select("id")).where("id is not null").distinct())
        touched = new.select(_bucket(new, meta.buckets).alias("bucket")).unionByName(ids.select(F.pmod(F.xxhash64("id"), F.lit(meta.buckets)).cast("int").alias("bucket"))).distinct()
        hit = table.join(touched, "bucket", "left_semi").collect()  # rows of the table of buckets
        kept = _read_buckets(spark, hit, new.schema).join(ids, "id", "left_anti").select(*new.columns)
        written = _write_buckets(kept.unionByName(new), path, meta.buckets)
        both = table.join(touched, "bucket", "left_anti").unionByName(written)
        total = _close(spark, folder, both, meta.buckets, postings.update(new, removed, "id", f"{path}/index", base=meta.index_version))
    _sweep(spark, path)
    return total


def open_catalog(spark: SparkSession, path: str, seed: str, wrapper: str | None = None) -> DataFrame:
    """The query table under path; where there is none, or one of another schema, it is built from the JSON document
    or lines of seed."""
    folder = latest(spark, path)
    if folder is None or spark.read.parquet(f"{folder}/meta").first().schema_version != SCHEMA_VERSION:
        rebuild(read_json(spark, seed, wrapper=wrapper).drop("pos"), path)
        folder = latest(spark, path)
    return _read_buckets(spark, spark.read.parquet(f"{folder}/buckets").collect(), CATALOG)


def open_index(spark: SparkSession, path: str) -> postings.Index:
    """The full-text index of the latest version under path."""
    meta = spark.read.parquet(f"{latest(spark, path)}/meta").first()
    return postings.Index(spark, f"{path}/index", "id", meta.index_version)


def rebuild_from(spark: SparkSession, seed: str, path: str, wrapper: str | None = None) -> str:
    """Rebuilds from a catalog document and says how many records it has read and the table now has."""
    inserted = rebuild(read_json(spark, seed, wrapper=wrapper).drop("pos"), path)
    total = open_catalog(spark, path, seed, wrapper).count()
    return f"Base reconstruida: {inserted} registros indexados ({total} en total)."


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The URL state under path, empty if there is none."""
    folder = latest(spark, path)
    return spark.read.schema(STATE).parquet(f"{folder}/state") if folder else spark.createDataFrame([], STATE)


def write_state(state: DataFrame, path: str, day: str) -> None:
    """The state as the latest version under path, with the day of the update."""
    spark = state.sparkSession
    with next_version(spark, path) as folder:
        state.write.parquet(f"{folder}/state")
        spark.createDataFrame([(day, state.count())], "updated_at string, urls long").coalesce(1).write.parquet(f"{folder}/stamp")


def state_stamp(spark: SparkSession, path: str) -> str | None:
    """The day of the last update of the state, None before the first."""
    folder = latest(spark, path)
    return spark.read.parquet(f"{folder}/stamp").first().updated_at if folder else None


def write_snapshot(records: DataFrame, path: str, day: str) -> None:
    """One folder a day; a later one of the same day replaces it."""
    records.write.mode("overwrite").parquet(f"{path}/snapshot_date={day}")


def last_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of the latest snapshot, or None. The folder's names tell which; only that one is read."""
    days = [n for n in names_in(spark, path) if n.startswith("snapshot_date=")]
    return spark.read.parquet(f"{path}/{days[-1]}") if days else None


def first_snapshot(records: DataFrame, path: str, day: str) -> bool:
    """Writes a snapshot if there is none yet, and says so: then there is nothing to compare with."""
    if last_snapshot(records.sparkSession, path) is not None:
        return False
    write_snapshot(records, path, day)
    return True


def read_skips(spark: SparkSession, path: str) -> Skips:
    """What the crawl leaves out, of a JSON document (skipExtensions, skipPatterns, lists of texts); what it does not say
    is as built in."""
    row = spark.read.schema("skipExtensions array<string>, skipPatterns array<string>").option("multiLine", True).json(path).first()
    given = {"suffixes": row.skipExtensions, "parts": row.skipPatterns}
    return Skips(**{k: tuple(x.lower() for x in v) for k, v in given.items() if v is not None})


def read_limits(spark: SparkSession, path: str) -> Limits:
    """The crawl's limits of a JSON document (max_depth, max_pages_per_source, revisit_days); what it does not say is
    as built in."""
    row = spark.read.schema("max_depth int, max_pages_per_source int, revisit_days int").option("multiLine", True).json(path).first()
    given = {"max_depth": row.max_depth, "max_pages": row.max_pages_per_source, "revisit_days": row.revisit_days}
    return Limits(**{k: v for k, v in given.items() if v is not None})


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    kind = "id string, institution string, country string, domains array<string>, seed_urls array<string>, max_depth int, enabled boolean, adapter string, notes string"
    return spark.read.schema(kind).option("multiLine", True).json(path)
