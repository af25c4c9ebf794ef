"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token shards.

Each stage takes rows of documents (doc_id, text, lang, source, n_chars, and more), also empty tables, null and
empty values, texts of any length, repeated rows and equal texts; what becomes of them is said below. All but the
last give back the columns that they got. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, mixing, near_copies, quality, token_shards
from millrace.llm.common import settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go, null and empty texts among them, and all of a rejected host; a null
    source is a host of its own. Repeated rows count each, and stay or go alike."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles, estimated by SimHash) stays, that of the
    smallest doc_id, and one of rows that repeat it; rows without doc_id stay. Texts without a word are copies of
    each other."""
    return near_copies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and empty texts have none. Repeated rows go alike."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target share wants it, in a global shuffle. A null source is one of its
    own; rows that agree in doc_id, source and text are drawn alike."""
    return mixing.mix(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards in training order; the rows are their manifest, none for an empty table. Null and empty
    texts give no tokens. Sequences are packed in the order of the files that docs is read from and then permuted:
    the order that the mixing dealt is not that of the training."""
    return token_shards.materialize_order(docs)[0]


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

#: Fingerprints, components and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and reread; a stage's own tables, and its input, are deleted once it is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), last)
    return STAGES[-1][1](spark, docs, sf_dir)
