import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__
from millrace.plans import catalog_queries, jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(__spark_entry__.queries()))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is not None:
        found = duck.sql(sql)
        places = [found.columns.index(c) for c in columns]
        assert sorted(found.columns) == columns
        assert rows == sorted((tuple(plain(r[i]) for i in places) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_jobs(spark):
    with pytest.raises(ValueError):
        jobs.run(spark, ["x"], {})
    marked = catalog_queries.marked_parts(spark, SF).limit(12)
    from pyspark.sql import functions as F

    from millrace.schema import CATALOG

    pages = marked.select("url", F.lit(True).alias("ok"), "body", F.lit(None).cast("string").alias("reason"), F.lit(False).alias("manual_review"))
    seeds = [r.url for r in pages.collect()]
    sources = spark.createDataFrame([("s", "Store", ["example.org"], seeds, 1, True, None)], "id string, institution string, domains array<string>, seed_urls array<string>, max_depth int, enabled boolean, adapter string")
    empty = spark.createDataFrame([], CATALOG).withColumn("pos", F.lit(0).cast("long"))
    done = jobs.update(sources, pages, empty, "2026-08-09")
    ids = [r.id for r in done.catalog.collect()]
    assert ids and len(ids) == len(set(ids)) and done.changes.where("change = 'added'").count() == len(ids)
    again = jobs.update(sources, pages, done.catalog.withColumn("pos", F.monotonically_increasing_id()), "2026-08-10", state=done.state)
    assert again.catalog.count() == len(ids)


@pytest.mark.parametrize("name", ["extract_records", "normalised_records"])
def test_rows_of_one_row_group_are_dealt(spark, name):
    """The tables are files of one row group, which alone would be one task's."""
    assert catalog_queries.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4


def test_issues_are_sorted_as_written(spark):
    """A sort reads its input twice, so that the rules are not worked out in it."""
    df = catalog_queries.QUERIES["validate_untyped"](spark, SF)
    assert "parse_json" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["curated_pages", "page_title"])
def test_titles_with_digits_in_their_parts(spark, tmp_path, name):
    """Parts of titles that begin or end with the number of their place, as the SQL gives them; of equal addresses the first page."""
    titles = ["ab | 1x1", "1 | 11 | 222", "Zu, 20 | 10 und 1 | 2. die 2", "0a0 | b", "x | 1&amp;1", " | ".join("abcdefghij") + " | 10"]
    rows = [(i, f"https://example.org/en/{i // 2}", f"<html><title>{t}</title><p>{t}</p></html>") for i, t in enumerate(titles * 2)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.sql(__spark_entry__.oracle_sql()[name])
    got = catalog_queries.QUERIES[name](spark, str(tmp_path)).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
