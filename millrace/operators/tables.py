"""Written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one on a single machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder, sorted; none if there is no such folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []


def latest(spark: SparkSession, path: str) -> str | None:
    """The folder of the last version under path that was written to its end."""
    whole = [n for n in names_in(spark, path) if n.startswith("version=") and "_complete" in names_in(spark, f"{path}/{n}")]
    return f"{path}/{whole[-1]}" if whole else None


@contextmanager
def next_version(spark: SparkSession, path: str) -> Iterator[str]:
    """A new folder under path, which is the latest once all is written; the one before it is kept for those who
    read it, older ones go. A write that fails leaves the latest as it was."""
    before = latest(spark, path)
    number = int(before.rpartition("=")[2]) + 1 if before else 1
    folder = f"{path}/version={number:010d}"
    delete(spark, folder)  # what a failed write may have left
    yield folder
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_complete")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark).close()
    for name in names_in(spark, path):
        if name.startswith("version=") and int(name.partition("=")[2]) < number - 1:
            delete(spark, f"{path}/{name}")


def fingerprint(df: DataFrame) -> str:
    """What a table holds, in whatever order its rows are, as a short text: their number and the sum of their hashes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}:{row.h}"


class Trail:
    """Finished steps of a long job under a folder, so that it goes on behind them after it was broken off. A step is a
    folder of tables and a mark that it is whole; of is what the job works on, and another of is an error."""

    def __init__(self, spark: SparkSession, path: str, of: str):
        self.spark, self.path = spark, path
        if not self.has("job"):
            with self.step("job") as folder:
                spark.createDataFrame([(of,)], "of string").coalesce(1).write.parquet(f"{folder}/of")
        elif (found := spark.read.parquet(f"{path}/job/of").first().of) != of:
            raise ValueError(f"{path} is of another job: {found}, not {of}")

    def has(self, step: str) -> bool:
        return "_complete" in names_in(self.spark, f"{self.path}/{step}")

    @contextmanager
    def step(self, step: str) -> Iterator[str]:
        """A folder for the tables of a step, which is whole when the block ends without an error."""
        folder = f"{self.path}/{step}"
        delete(self.spark, folder)
        yield folder
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_complete")
        mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark).close()

    def read(self, step: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{step}/{name}")

    def table(self, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The only table of a step, made if the step is not there yet."""
        if not self.has(step):
            with self.step(step) as folder:
                make().write.parquet(f"{folder}/rows")
        return self.read(step, "rows")


#: The tables written since the innermost scratch() began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def materialize(df: DataFrame, level: int = 3) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, outlives lost executors, and
    its size is known to the planner, so that only a table below the threshold is broadcast."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": level}).parquet(path)
    if (written := _written.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialize() writes within is deleted at the end, but for what settled() gives."""
    mine: list[str] = []
    token = _written.set(mine)
    try:
        yield
    finally:
        _written.reset(token)
        for path in mine:
            delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], instead_of: list[str] | None = None) -> DataFrame:
    """make() as a written table, without the tables that were written to make it. With instead_of, the folders it
    lists are deleted too and the new one takes their place in the list: for loops that read the last result only."""
    with scratch(spark):
        df = materialize(make())
        path = _written.get().pop()
    if instead_of is not None:
        while instead_of:
            delete(spark, instead_of.pop())
        instead_of.append(path)
    if (outer := _written.get()) is not None:
        outer.append(path)
    return df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: a round joins each edge with the least neighbour of
    one end, so that the centre of a star is a hot join key, which the adaptive skew join splits, and
    never a group that one task collects. Each round is written to the shared folder.
    """
    spark, last = edges.sparkSession, []
    first = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = settled(spark, lambda: first, last)
    before = None
    for _ in range(max_rounds):
        for large in (True, False):
            edges = settled(spark, partial(_star, edges, large), last)
        # a star forest, where no node is both a child of two roots nor a root with a parent, is final
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """The edges after a round: large, each larger neighbour of a goes to the least neighbour of a; else a and each
    smaller neighbour go to the least of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    joined = both.join(least, "a")
    if large:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a != b").distinct()
