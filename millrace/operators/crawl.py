"""Breadth-first crawl over a table of pages, level by level.

The frontier, the visited addresses and the candidates are DataFrames; a level is a join with the pages,
the explosion of their links and an anti-join with what was seen, written to the shared folder. With a trail the levels
are kept, and a crawl that was broken off, or ran out of time, goes on behind its last whole level."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.html import links
from millrace.functions.robots import allows
from millrace.functions.urls import Skips, canonical_or_raw, is_allowed_host, is_course_like, is_relevant, path
from millrace.operators.memory import REVISIT_DAYS, should_revisit
from millrace.operators.tables import Trail, fingerprint, materialize, names_in


@dataclass(frozen=True)
class Limits:
    max_depth: int = 3
    max_pages: int = 150
    revisit_days: int = REVISIT_DAYS
    #: After so many seconds no further level is begun; sources are crawled side by side, so that it is the same time for all.
    max_seconds: float | None = None
    skips: Skips = Skips()


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("not (enabled <=> false)")


def crawl(sources: DataFrame, pages: DataFrame | Callable[[DataFrame], DataFrame], as_of: str, state: DataFrame | None = None, limits: Limits = Limits(), trail: str | None = None) -> tuple[DataFrame, DataFrame]:
    """visits (source_id, url, raw_url, depth, ok, reason, is_course, content_hash, manual_review, from_memory) and
    candidates (url, source_id, institution, adapter, depth, discovered_at, from_memory).

    sources: id, institution, domains, seed_urls, max_depth, enabled, adapter. pages: url, ok, body, reason,
    manual_review, and optionally rules (of robots); or what gives such a table for addresses (url), such as
    http.live_pages(), which is asked once a level. A source visits max_pages addresses at most, those nearer to its
    seeds first, then by order of links.

    trail: a folder for what each level visited, found and was answered. A call with the folder of a crawl that did not
    end goes on with it, that of one that ended gives its result again; the sources and limits must be the same."""
    on = enabled(sources)
    steps = open_trail(on, limits, trail) if trail else None
    began = time.monotonic()
    level = len(levels(steps)) if steps else 0
    seeds = (
        on.select("id", "domains", F.coalesce("max_depth", F.lit(limits.max_depth)).alias("most"), F.posexplode("seed_urls").alias("at", "raw"))
        .withColumns({"key": canonical_or_raw(F.col("raw")), "order": F.format_string("%09d", "at")})
        .drop("at")
    )
    if level:
        done = reduce(DataFrame.unionByName, [_thin(steps.read(f"level={k}", "visited")) for k in range(level)])
        frontier = steps.read(f"level={level - 1}", "frontier")
    else:
        frontier, done = materialize(seeds), None
    while level == 0 or not frontier.isEmpty():
        if level and limits.max_seconds is not None and time.monotonic() - began > limits.max_seconds:
            break
        here = frontier.where(is_allowed_host(F.col("raw"), F.col("domains")))
        # the first way to an address counts
        here = here.groupBy("id", "key").agg(F.min_by(F.struct("raw", "domains", "most", "order"), "order").alias("r")).select("id", "key", "r.*")
        if done is not None:
            here = here.join(done.select("id", "key"), ["id", "key"], "left_anti")
        known = F.lit(False)
        if state is not None and level > 0:
            here = materialize(here)
            here = here.join(_among(state.select(F.col("url").alias("key"), "status", "is_course", "first_seen", "last_seen"), here.select("key")), "key", "left")
            known = ~should_revisit(as_of, limits.revisit_days)
        else:
            here = here.withColumns({"is_course": F.lit(None).cast("boolean"), "first_seen": F.lit(None).cast("string")})
        here = here.select("id", "key", "raw", "domains", "most", "order", F.col("is_course").alias("was_course"), "first_seen", known.alias("from_memory"))
        here = materialize(_within_budget(here, done, limits.max_pages))
        wanted = here.where("not from_memory").select(F.col("raw").alias("url")).distinct()
        if callable(pages):
            answers = materialize(pages(wanted)) if steps is None else steps.table(f"answers={level}", lambda: pages(wanted))
        else:
            answers = _among(pages, wanted)
        store = answers.select(F.col("url").alias("page_url"), *[c for c in answers.columns if c != "url"])
        fetched = here.join(store, here.raw == F.col("page_url"), "left")
        permitted = allows(F.col("rules"), path(F.col("raw"))) if "rules" in answers.columns else F.lit(True)
        permitted = F.coalesce(permitted, F.lit(True))
        ok = ~F.col("from_memory") & permitted & F.coalesce("ok", F.lit(False))
        seen = fetched.select(
            "id", "key", "raw", "domains", "most", "order", "was_course", "first_seen", "from_memory",
            F.lit(level).alias("depth"),
            ok.alias("ok"),
            F.when(ok | F.col("from_memory"), F.lit(None)).when(~permitted, "Prohibido por robots.txt").otherwise(F.coalesce("reason", F.lit("sin respuesta"))).alias("reason"),
            F.when(ok, is_course_like(F.col("raw"))).otherwise(False).alias("is_course"),
            F.when(ok, F.left(F.sha2(F.coalesce("body", F.lit("")), 256), F.lit(16))).alias("content_hash"),
            (~ok & F.coalesce("manual_review", F.lit(False))).alias("manual_review"),
            F.when(ok & (level < F.col("most")), links(F.col("body"), F.col("raw"))).alias("links"),
        )
        if steps is None:
            visited = materialize(seen)
            frontier = materialize(_further(visited, limits.skips))
        else:
            with steps.step(f"level={level}") as folder:
                seen.write.parquet(f"{folder}/visited")
                visited = sources.sparkSession.read.schema(seen.schema).parquet(f"{folder}/visited")
                _further(visited, limits.skips).write.parquet(f"{folder}/frontier")
            frontier = steps.read(f"level={level}", "frontier")
        done = _thin(visited) if done is None else done.unionByName(_thin(visited))
        level += 1
    return _results(on, done, as_of)


def _thin(visited: DataFrame) -> DataFrame:
    return visited.drop("links", "domains", "most")


def _among(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a table whose key is in keys, a column of that name. The planner doesn't know the size of what is
    computed, such as bodies, and would send all of it to each task; what is found here is joined by sorting."""
    return table.join(keys, keys.columns, "left_semi").hint("merge")


def _further(visited: DataFrame, skips: Skips) -> DataFrame:
    """The frontier behind a level."""
    found = visited.select("id", "domains", "most", "order", F.posexplode("links").alias("at", "raw")).where(
        is_allowed_host(F.col("raw"), F.col("domains")) & is_relevant(F.col("raw"), skips)
    )
    return found.select("id", "domains", "most", "raw", canonical_or_raw(F.col("raw")).alias("key"), F.concat("order", F.format_string("%09d", "at")).alias("order"))


def open_trail(sources: DataFrame, limits: Limits, path: str) -> Trail:
    of = f"crawl of {fingerprint(sources)}, depth {limits.max_depth}, {limits.max_pages} pages, {limits.revisit_days} days, {limits.skips}"
    return Trail(sources.sparkSession, path, of)


def levels(steps: Trail) -> list[int]:
    """The whole levels of a crawl."""
    out: list[int] = []
    while steps.has(f"level={len(out)}"):
        out.append(len(out))
    return out


def answered(spark: SparkSession, trail: str) -> DataFrame | None:
    """The pages that a crawl with a trail was answered, where it asked for them."""
    found = [n for n in names_in(spark, trail) if n.startswith("answers=") and "_complete" in names_in(spark, f"{trail}/{n}")]
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{trail}/{n}/rows") for n in found]) if found else None


def ended(spark: SparkSession, trail: str) -> bool:
    """A crawl with this trail has nothing left to visit."""
    last = [n for n in names_in(spark, trail) if n.startswith("level=") and "_complete" in names_in(spark, f"{trail}/{n}")]
    return bool(last) and spark.read.parquet(f"{trail}/level={len(last) - 1}/frontier").isEmpty()


def _within_budget(here: DataFrame, done: DataFrame | None, most: int) -> DataFrame:
    """What a source's page budget allows of a level, in the order of the frontier; what is known from memory costs
    nothing, but ends where the budget does. Each task keeps most + 1 addresses a source before they are numbered."""
    order = [F.col("order"), F.col("key")]
    costly = here.where("not from_memory").select("id", "order", "key")
    first = costly.withColumn("turn", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("turn") <= most + 1)
    used = done.where("not from_memory").groupBy("id").agg(F.count("*").alias("used")) if done is not None else None
    first = first.join(used, "id", "left").na.fill(0, ["used"]) if used is not None else first.withColumn("used", F.lit(0))
    # the first address of a source that there is no budget for
    ends = first.where(F.col("turn") + F.col("used") > most).groupBy("id").agg(F.min(F.struct("order", "key")).alias("end"))
    return here.join(ends, "id", "left").where(F.col("end").isNull() | (F.struct(*order) < F.col("end"))).drop("end")


def _results(sources: DataFrame, done: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    visits = done.where("not from_memory").select(
        F.col("id").alias("source_id"), F.col("key").alias("url"), F.col("raw").alias("raw_url"), "depth", "ok", "reason", "is_course", "content_hash", "manual_review"
    )
    found = done.where("is_course or (from_memory and was_course)")
    named = sources.select("id", "institution", F.coalesce("adapter", F.lit("generic")).alias("adapter"))
    candidates = found.join(named, "id").select(
        F.col("key").alias("url"), F.col("id").alias("source_id"), "institution", "adapter", "depth",
        F.when(F.col("from_memory"), F.coalesce("first_seen", F.lit(as_of))).otherwise(as_of).alias("discovered_at"), "from_memory",
    )
    return visits, candidates


def totals(visits: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, visited, blocked, candidates, from_memory: counts of a crawl by source."""
    v = visits.groupBy("source_id").agg(F.count("*").alias("visited"), F.count_if(F.col("manual_review")).alias("blocked"))
    c = candidates.groupBy("source_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("from_memory")).alias("from_memory"))
    return v.join(c, "source_id", "full_outer").na.fill(0)


def depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: the fewest steps over edges (src, dst) from seeds (node), up to max_depth."""
    seen = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        next_ = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(next_.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
