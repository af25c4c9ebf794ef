"""Ranks and orders of catalog records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.tables import materialize
from millrace.schema import CREDENTIAL_RANKS

UNKNOWN_RANK, NONE_RANK = 5, 6


def credential_rank(c: Column) -> Column:
    rank = F.when(c.isNull(), NONE_RANK)
    for name, n in CREDENTIAL_RANKS.items():
        rank = rank.when(c == name, n)
    return rank.otherwise(UNKNOWN_RANK)


def verified_rank(c: Column) -> Column:
    return F.when(c == "VERIFICADO", 0).otherwise(1)


def with_ranks(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "credential_rank": credential_rank(F.col("credential_type")),
            "verified_rank": verified_rank(F.col("verification_status")),
        }
    )


def _spanish(name: str) -> list[Column]:
    c = F.nullif(F.col(name), F.lit(""))
    return [F.collate(c, "es").asc_nulls_last()]


def catalog_order() -> list[Column]:
    """Credential, verified, relevance, then institution, title and id as Spanish sorts them, blanks last."""
    return [
        credential_rank(F.col("credential_type")).asc(),
        verified_rank(F.col("verification_status")).asc(),
        F.col("relevance_ppp_infra").desc_nulls_last(),
        *_spanish("institution"),
        *_spanish("title"),
        *_spanish("id"),
    ]


#: The named orders of a search; text sorts by bytes, nulls first unless said otherwise.
ORDERS: dict[str, list[tuple[str, str]]] = {
    "recomendado": [
        ("credential_rank", "asc"),
        ("verified_rank", "asc"),
        ("relevance_ppp_infra", "desc"),
        ("institution", "asc"),
        ("title", "asc"),
        ("id", "asc"),
    ],
    "acreditabilidad": [("credential_rank", "asc"), ("verified_rank", "asc"), ("title", "asc")],
    "relevancia": [("relevance_ppp_infra", "desc"), ("credential_rank", "asc"), ("title", "asc")],
    "institucion": [("institution", "asc"), ("title", "asc")],
    "duracion": [("duration_weeks", "asc_nulls_last"), ("title", "asc")],
    "verificacion": [("last_verified", "desc"), ("title", "asc")],
}


def named_order(name: str | None) -> list[Column]:
    return [getattr(F.col(c), how)() for c, how in ORDERS.get(name or "", ORDERS["recomendado"])]


def top_k(df: DataFrame, order: list[Column], k: int, position: str = "position") -> DataFrame:
    """The first k rows with their position: each task keeps k, so the numbering sees at most k rows."""
    return df.orderBy(*order).limit(k).withColumn(position, F.row_number().over(Window.orderBy(*order)))


def numbered(df: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """All rows with their position (1, 2, ...) in the order. Rows are sorted over the cluster and written; the number
    of rows before a range is summed up over ranges, of which there are as many as tasks."""
    sorted_ = materialize(df.orderBy(*order).withColumn(position, F.monotonically_increasing_id()))
    part, at = F.shiftright(position, 33), F.col(position).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    placed = sorted_.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(position, (at + F.col("__before") + 1).cast("long")).drop("__part", "__before")


def top_per_group(counts: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return counts.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(
        F.col("position") <= k
    )
