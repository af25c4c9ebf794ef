"""The URL state as a stream, and reloading the catalog when its file changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators import memory
from millrace.operators.tables import latest, next_version, scratch
from millrace.sources.catalog import read_state


def track(visits: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the URL state under path (read_state) up to date with a stream of visits. A batch is folded by
    aggregates, so an address costs a row a batch however often it was visited, and merged with the latest
    version, which the new one replaces when it is whole. A batch that is run again after a failure is folded
    once: its number is in the version. Visits of an address are in the order of seq within a batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = latest(spark, path)
        if folder and spark.read.parquet(f"{folder}/stamp").first().batch >= number:
            return
        with next_version(spark, path) as new, scratch(spark):
            memory.fold(batch, read_state(spark, path)).write.parquet(f"{new}/state")
            spark.range(1).select(F.lit(number).cast("long").alias("batch"), F.lit(None).cast("string").alias("updated_at")).write.parquet(f"{new}/stamp")

    return visits.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def watch_catalog(spark: SparkSession, folder: str, rebuild: Callable[[SparkSession, list[str]], None], checkpoint: str, every: str = "250 milliseconds") -> StreamingQuery:
    """Calls rebuild with the paths of catalog files that came or changed."""

    def batch(files: DataFrame, _: int) -> None:
        names = [r.path for r in files.select("path").distinct().collect()]
        if names:
            rebuild(spark, names)

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.drop("content").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
