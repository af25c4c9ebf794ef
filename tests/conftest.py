import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def values(spark):
    """The value of an expression for each of some inputs: values(f, [x, ...], kind) or, for several columns,
    values(f, [(x, y), ...], kinds)."""

    def run(f, inputs, kinds="string"):
        names = [k for k in kinds.split(", ")]
        rows = [x if isinstance(x, tuple) else (x,) for x in inputs]
        schema = ", ".join(["i int", *[f"c{i} {k}" for i, k in enumerate(names)]])
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = df.select("i", f(*[df[f"c{i}"] for i in range(len(names))]).alias("v"))
        return [r.v for r in sorted(out.collect())]

    return run
