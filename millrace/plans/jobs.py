"""The incremental update as stages, each a function of tables, written between stages."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import lifecycle, memory, resolve, validation
from millrace.operators.crawl import Limits, answered, crawl
from millrace.operators.tables import Trail, fingerprint, materialize

STEPS = ("update", "validate")
log = logging.getLogger("millrace")
_running = threading.Lock()


@dataclass
class Update:
    """What an update leaves: tables, all written."""

    catalog: DataFrame
    state: DataFrame
    verified: DataFrame
    changes: DataFrame | None
    discovered: DataFrame


def verify(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates (with pos) with match, by, existing and the bucket they go to."""
    found = resolve.classify(candidates, catalog)
    return candidates.join(found, "pos").withColumn("bucket", lifecycle.verification_bucket(F.col("match")))


def update(sources: DataFrame, pages: DataFrame | Callable[[DataFrame], DataFrame], catalog: DataFrame, as_of: str, state: DataFrame | None = None, before_urls: DataFrame | None = None, limits: Limits = Limits(), work: str | None = None) -> Update:
    """Crawl, extract, verify, discover, mark what is gone, incorporate, diff. catalog has pos. pages is a table, or
    what fetches them (http.live_pages()). A page is read once: its body serves the crawl and the extraction. A
    report of changes that fails leaves changes None, and the catalog as it is updated.

    work: a folder for what the stages and the levels of the crawl give. A run with the folder of one that broke off
    goes on behind the last whole stage; the day, the sources, the catalog, the state and the limits must be the same."""
    steps = None
    if work:
        given = [f"{n} {fingerprint(t)}" for n, t in (("sources", sources), ("catalog", catalog), ("state", state), ("urls", before_urls)) if t is not None]
        steps = Trail(sources.sparkSession, work, f"update of {as_of}, {limits}, {', '.join(given)}")

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return steps.table(name, make) if steps else materialize(make())

    if callable(pages) and not steps:
        live, fetched = pages, []

        def pages(urls: DataFrame) -> DataFrame:
            fetched.append(materialize(live(urls)))
            return fetched[-1]

    visits, found = crawl(sources, pages, as_of, state, limits, f"{work}/crawl" if work else None)
    visits, found = stage("visits", lambda: visits), stage("candidates", lambda: found)
    seen = visits.select("url", F.lit(as_of).alias("day"), F.lit(1).alias("seq"), "ok", F.col("source_id").alias("source"), "is_course", "content_hash", "reason")
    folded = stage("state", lambda: memory.fold(seen.dropDuplicates(["url"]), state))
    every = (reduce(DataFrame.unionByName, fetched) if not steps else answered(sources.sparkSession, f"{work}/crawl")).dropDuplicates(["url"]) if callable(pages) else pages
    bodies = every.select(F.col("url").alias("raw"), "ok", "body", "reason")
    taken = found.withColumnRenamed("institution", "source_institution").join(visits.select("url", "source_id", "raw_url"), ["url", "source_id"], "left").join(bodies, F.coalesce("raw_url", "url") == F.col("raw"), "left")
    extracted = stage("extracted", lambda: lifecycle.extract(taken, as_of))
    ready = stage("ready", lambda: extracted.where("outcome = 'extracted'").withColumn("platform", F.lit(None).cast("string")).withColumn("pos", F.monotonically_increasing_id()))
    verified = stage("verified", lambda: verify(ready, catalog))
    retired = memory.retired(folded).withColumn("pos", F.lit(0))
    marked = stage("marked", lambda: lifecycle.apply_retired(catalog, retired, as_of))
    accepted = lifecycle.pending_record(verified.where("bucket = 'accepted'"), as_of)
    names = [c for c in catalog.columns if c != "pos"]
    after = stage("catalog", lambda: lifecycle.incorporate(marked.select(*names), accepted.select(*names)))
    try:
        changes = stage("changes", lambda: lifecycle.diff(catalog, after))
    except PySparkException as error:
        log.error("the report of changes failed, the catalog is updated: %s", error)
        changes = None
    now = found.select("url")
    discovered = lifecycle.discover(now, before_urls) if before_urls is not None else now.distinct().withColumn("change", F.lit("new"))
    return Update(after, folded, verified, changes, stage("discovered", lambda: discovered))


class _Relay(logging.Handler):
    """Hands what the library logs during a step on."""

    def __init__(self, step: str, tell: Callable[[str, str, str], None]):
        super().__init__()
        self.step, self.tell = step, tell

    def emit(self, record: logging.LogRecord) -> None:
        for line in record.getMessage().splitlines():
            if line.strip():
                self.tell(self.step, record.levelname.lower(), line)


def run(
    spark: SparkSession,
    steps: list[str],
    actions: dict[str, Callable[[SparkSession], bool | None]],
    tell: Callable[[str, str, str], None] = lambda step, level, message: None,
    step_timeout_s: float = 20 * 60,
    tries: int = 1,
) -> bool:
    """Runs named steps one after the other; one run at a time. A step that gives False or raises is run again, up to
    tries times in all, then the run stops. A step that takes longer than step_timeout_s has its Spark jobs
    cancelled, and fails. tell gets step, level and message of starts, ends, faults and of what the library logs."""
    unknown = [s for s in steps if s not in actions]
    if unknown or not steps:
        raise ValueError(f"unknown steps: {unknown}" if unknown else "no steps")
    if not _running.acquire(blocking=False):
        raise RuntimeError("a run is going on")
    try:
        return all(any(_step(spark, step, actions[step], tell, step_timeout_s) for _ in range(tries)) for step in steps)
    finally:
        _running.release()


def _step(spark: SparkSession, step: str, action: Callable[[SparkSession], bool | None], tell: Callable[[str, str, str], None], timeout_s: float) -> bool:
    tag, late = f"millrace-{step}-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    tell(step, "info", "start")
    relay, timer = _Relay(step, tell), threading.Timer(timeout_s, cancel)
    log.addHandler(relay)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        good = action(spark) is not False and not late.is_set()
    except Exception as error:  # noqa: BLE001  a step that fails stops the run, not the caller
        tell(step, "error", str(error))
        good = False
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
        log.removeHandler(relay)
    tell(step, "info" if good else "error", "done" if good else "timed out" if late.is_set() else "failed")
    return good


def validate(records: DataFrame, as_of: str) -> tuple[DataFrame, bool]:
    """The issues, and whether none is an error."""
    issues = materialize(validation.validate(records, as_of))
    return issues, issues.where("level = 'error'").isEmpty()
