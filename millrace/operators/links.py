"""Link checks: the addresses of records, and what an answer means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("url_official", "url_credential_info", "url_syllabus", "source_of_truth")


def targets(catalog: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """id, field, url of all addresses that are not blank."""
    return catalog.select("id", *fields).unpivot("id", list(fields), "field", "url").where("url != ''")


def outcome(probes: DataFrame) -> DataFrame:
    """Adds status, ok, redirect to rows with head_status, get_status, final_url and error: the answer to GET
    counts where HEAD got 403, 405 or an error of the server."""
    again = F.col("head_status").isin(403, 405) | (F.col("head_status") >= 500)
    status = F.when(again, F.col("get_status")).otherwise(F.col("head_status"))
    ok = F.coalesce(status.between(200, 399), F.lit(False)) & F.col("error").isNull()
    redirect = F.when(F.col("final_url").isNotNull() & (F.col("final_url") != F.col("url")), F.col("final_url"))
    return probes.withColumns({"status": status, "ok": ok, "redirect": redirect})


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("checked"),
        F.count_if(~F.col("ok")).alias("broken"),
        F.count_if(F.col("ok") & F.col("redirect").isNotNull()).alias("redirected"),
    )


def fetch_outcome(status: Column, error: Column) -> Column:
    """ok, reason, manual_review of an answer that is not tried again."""
    blocked = status.isin(401, 403, 429)
    ok = F.coalesce(status.between(200, 299), F.lit(False)) & error.isNull()
    reason = (
        F.when(error.isNotNull(), error)
        .when(blocked, F.concat(F.lit("El sitio impide el acceso automatizado (HTTP "), status.cast("string"), F.lit(")")))
        .when(~ok, F.concat(F.lit("HTTP "), status.cast("string")))
    )
    return F.struct(ok.alias("ok"), reason.alias("reason"), (F.coalesce(blocked, F.lit(False)) & error.isNull()).alias("manual_review"))
