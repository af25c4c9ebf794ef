"""State of visited addresses: a fold over visits as a batch, revisits, retired addresses, summary.

visits: url, day (ISO text), seq (order of the visits of a url), ok, source, is_course, content_hash,
reason. A success resets the count of misses; three misses in a row retire an address. The fold is by
aggregates, neither a loop nor a window over one address's visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.dates import days_since
from millrace.operators.tables import materialize

RETIRE_AFTER, REVISIT_DAYS = 3, 14
STATE = """url string, source string, first_seen string, last_seen string, is_course boolean, content_hash string,
changed_at string, missing_count int, status string, last_missing string, last_reason string"""


def status_of(misses: Column) -> Column:
    return F.when(misses == 0, "activo").when(misses < RETIRE_AFTER, "inestable").otherwise("retirado")


def fold(visits: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after visits, from an earlier state if there is one. Everything is a minimum, a maximum or a count
    by url, combined before the shuffle, so an address with very many visits is no group of one task. What counts
    only after a certain visit is aggregated in a second and a third pass, joined with what the passes before gave:
    misses after the last success; and the last change of the hash, which is the first success with the last hash
    after the last success with another."""
    ok, hashed = F.col("ok"), F.col("ok") & F.col("content_hash").isNotNull()
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    first_pass = visits.groupBy("url").agg(
        F.min_by("day", "seq").alias("first_seen"),
        last(F.col("source"), ok & F.col("source").isNotNull()).alias("source"),
        last(F.col("day"), ok).alias("last_seen"),
        F.coalesce(F.max(ok & F.col("is_course")), F.lit(False)).alias("is_course"),
        last(F.col("content_hash"), hashed).alias("content_hash"),
        F.max(F.when(ok, F.col("seq"))).alias("last_ok"),
        F.max_by(F.struct("day", "reason", "seq"), F.when(~ok, F.col("seq"))).alias("miss"),
    )
    new = materialize(first_pass)
    known = visits.join(new.select("url", "last_ok", F.col("content_hash").alias("last_hash")), "url")
    other = F.col("ok") & (F.col("content_hash") != F.col("last_hash"))
    second = materialize(
        known.groupBy("url").agg(
            F.count_if(~ok & (F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok")))).cast("int").alias("since"),
            F.max(F.when(other, F.col("seq"))).alias("other"),
        )
    )
    after = known.join(second.select("url", "other"), "url").where(hashed & (F.col("other").isNull() | (F.col("seq") > F.col("other"))))
    third = after.groupBy("url").agg(F.min_by("day", "seq").alias("settled"))
    done = new.join(second, "url").join(third, "url", "left")
    if state is None:
        done = done.withColumn("old", F.lit(None).cast(StructType.fromDDL(STATE)))
    else:
        done = done.join(state.select("url", F.struct(*state.columns).alias("old")), "url", "left")
    o = lambda name: F.col(f"old.{name}")
    # without another hash among the visits the old one may be another
    changed = F.when(F.col("other").isNotNull() | (o("content_hash") != F.col("content_hash")), F.col("settled"))
    misses = F.col("since") + F.when(F.col("last_ok").isNull(), F.coalesce(o("missing_count"), F.lit(0))).otherwise(0).cast("int")
    open_miss = F.col("last_ok").isNull() | (F.col("miss.seq") > F.col("last_ok"))
    done = done.select(
        "url",
        F.coalesce("source", o("source")).alias("source"),
        F.coalesce(o("first_seen"), "first_seen").alias("first_seen"),
        F.coalesce("last_seen", o("last_seen")).alias("last_seen"),
        (F.col("is_course") | F.coalesce(o("is_course"), F.lit(False))).alias("is_course"),
        F.coalesce("content_hash", o("content_hash")).alias("content_hash"),
        F.coalesce(changed, o("changed_at")).alias("changed_at"),
        misses.alias("missing_count"),
        status_of(misses).alias("status"),
        F.when(open_miss, F.col("miss.day")).alias("last_missing"),
        F.when(open_miss, F.col("miss.reason")).alias("last_reason"),
    )
    if state is None:
        return done
    return done.unionByName(state.join(done.select("url"), "url", "left_anti").select(*done.columns))


def should_revisit(as_of: str, revisit_days: int = REVISIT_DAYS) -> Column:
    """For rows of the state (null status: never seen): retired no, unstable yes, others by age, pages that
    are no course seven times as often."""
    short = max(1, int(revisit_days / 7 + 0.5))
    age = days_since(F.col("last_seen"), as_of)
    due = F.coalesce(age >= F.when(F.coalesce("is_course", F.lit(False)), revisit_days).otherwise(short), F.lit(True))
    return F.when(F.col("status") == "retirado", False).when(F.col("status") == "inestable", True).when(F.col("status").isNull(), True).otherwise(due)


def retired(state: DataFrame) -> DataFrame:
    return state.where("status = 'retirado'").select("url", "last_seen", F.coalesce("missing_count", F.lit(0)).alias("missing_count"), F.col("last_reason").alias("reason"))


def summary(state: DataFrame) -> DataFrame:
    n = lambda name: F.count_if(F.col("status") == name)
    return state.agg(F.count("*").alias("total"), n("activo").alias("active"), n("inestable").alias("unstable"), n("retirado").alias("retired"), F.count_if(F.col("is_course")).alias("course_pages"))
