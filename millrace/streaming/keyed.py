"""The URL state as keyed state of a stream: a batch costs what it brings, not what is known.

Each address has its folded state in the state store, its newest visits, not folded yet, and a timer for the
day on which it is to be visited again (days are those of the visits, not the clock's). Visits of an address may come in any order, and again, within keep_days of its
newest one: until then they are held by their number, and the state that a batch gives is the fold of all of
them. A visit that comes later than that, or again, changes nothing and is given as a row of kind "late".

What a batch changed is written as a folder of its own, and again if the batch is run again; current() reads the last
row of each address, compact() writes them as a base. An address is one task's, with its visits of keep_days; where
single addresses have very many visits a batch, streaming.state.track() folds them by aggregates instead."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from millrace.operators.memory import RETIRE_AFTER, REVISIT_DAYS, STATE
from millrace.operators.tables import delete, latest, names_in, next_version

VISIT = "day string, ok boolean, source string, is_course boolean, content_hash string, reason string"
#: kind: state (what is known of an address now), due (it is to be visited), late (a visit that came too late).
CHANGE = f"kind string, {STATE}, seq long"
FIELDS = [x.split()[0] for x in STATE.split(",")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def visited(state: dict | None, url: str, seq: int, visit: dict) -> dict:
    """The state after one more visit."""
    s = dict(state) if state else dict.fromkeys(FIELDS) | {"url": url, "first_seen": visit["day"], "is_course": False, "missing_count": 0}
    if visit["ok"]:
        hashed = visit["content_hash"]
        if hashed is not None and s["content_hash"] is not None and hashed != s["content_hash"]:
            s["changed_at"] = visit["day"]
        s |= {
            "source": visit["source"] if visit["source"] is not None else s["source"],
            "last_seen": visit["day"],
            "is_course": bool(s["is_course"] or visit["is_course"]),
            "content_hash": hashed if hashed is not None else s["content_hash"],
            "missing_count": 0,
            "last_missing": None,
            "last_reason": None,
        }
    else:
        s |= {"missing_count": s["missing_count"] + 1, "last_missing": visit["day"], "last_reason": visit["reason"]}
    misses = s["missing_count"]
    return s | {"status": "activo" if misses == 0 else "inestable" if misses < RETIRE_AFTER else "retirado", "seq": seq}


def day_number(day: str | None) -> int | None:
    try:
        return datetime.date.fromisoformat(day).toordinal() if day else None
    except ValueError:
        return None


class Memory(StatefulProcessor):
    """The state of one address: folded (the state up to some visit), open (visits since, by number), due (its timer). All
    visits since are read and written as one: each call of the state store is a message to another process."""

    def __init__(self, keep_days: int, revisit_days: int):
        self.keep_days, self.revisit_days = keep_days, revisit_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", f"{STATE}, seq long")
        self.open = handle.getListState("held", f"seq long, {VISIT}")
        self.due = handle.getValueState("due", "ms long")

    def close(self) -> None:
        pass

    def _row(self, kind: str, state: dict) -> Row:
        return Row(kind=kind, **{n: state.get(n) for n in FIELDS}, seq=state.get("seq"))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        url, names = key[0], VISIT.replace(" string", "").replace(" boolean", "").split(", ")
        known = self.folded.get()
        state = dict(zip([*FIELDS, "seq"], known)) if known else None
        new = {}
        for row in rows:
            if row.seq is None or state and row.seq <= state["seq"]:
                yield self._row("late", {"url": url, "last_seen": row.day, "seq": row.seq})
            else:
                new[row.seq] = {n: row[n] for n in names}
        if not new:
            return
        before = {v[0]: dict(zip(names, v[1:])) for v in self.open.get()}
        held = sorted((before | new).items())
        newest = max((d for _, v in held if (d := day_number(v["day"])) is not None), default=None)
        settled, now, left = True, state, []
        for seq, visit in held:
            day = day_number(visit["day"])
            settled = settled and newest is not None and day is not None and day < newest - self.keep_days
            now = visited(now, url, seq, visit)
            if settled:
                state = now
            else:
                left.append((seq, *visit.values()))
        self.open.put(left)  # the newest visit is never settled
        if state is not None and state["seq"] != (known and known[-1]):
            self.folded.update(tuple(state[n] for n in [*FIELDS, "seq"]))
        self._set_timer(now)
        yield self._row("state", now)

    def _set_timer(self, state: dict) -> None:
        """Retired addresses have none; unstable ones are due at once, others when their age is that of a revisit. A timer
        that stays is left alone."""
        before = self.due.get()
        days = self.revisit_days if state["is_course"] else max(1, int(self.revisit_days / 7 + 0.5))
        stable = state["status"] == "activo"
        seen = day_number(state["last_seen"] if stable else state["last_missing"])
        if state["status"] == "retirado" or seen is None:
            if before:
                self.handle.deleteTimer(before[0])
                self.due.clear()
            return
        at = (seen - datetime.date(1970, 1, 1).toordinal() + (days if stable else 0)) * DAY_MS
        if before and before[0] == at:
            return
        if before:
            self.handle.deleteTimer(before[0])
        self.due.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        yield self._row("due", {"url": key[0]})


def changes(visits: DataFrame, keep_days: int = 7, revisit_days: int = REVISIT_DAYS) -> DataFrame:
    """CHANGE rows of a stream of visits: one of kind state for each address a batch has visits of.

    The time of the timers is that of the visits, the newest day so far. The column it is read from ends before the state
    does, as Spark would leave out what is older than the newest day without a word."""
    timed = visits.withColumn("at", F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))).withWatermark("at", "0 seconds")
    typed = timed.select("url", F.col("seq").cast("long").alias("seq"), *[F.col(n).cast(k).alias(n) for n, k in (x.split() for x in VISIT.split(", "))])
    return typed.where("url is not null").groupBy("url").transformWithState(Memory(keep_days, revisit_days), CHANGE, "Update", "EventTime")


def track(visits: DataFrame, path: str, checkpoint: str, keep_days: int = 7, revisit_days: int = REVISIT_DAYS, **trigger) -> StreamingQuery:
    """Keeps the state under path (current()) up to date with a stream of visits. The state store is RocksDB with a log of
    changes, so that a batch writes what it changed."""
    spark = visits.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return changes(visits, keep_days, revisit_days).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:  # a query has the settings it was started with
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _batches(spark: SparkSession, path: str, after: int = -1) -> list[int]:
    """The numbers of the batches written to their end, beyond one."""
    found = [n for n in names_in(spark, path) if n.startswith("batch=") and "_SUCCESS" in names_in(spark, f"{path}/{n}")]
    return [k for k in (int(n.partition("=")[2]) for n in found) if k > after]


def written(spark: SparkSession, path: str, kind: str, after: int = -1) -> DataFrame:
    """The changes of a kind with the number of their batch, beyond one."""
    parts = [spark.read.schema(CHANGE).parquet(f"{path}/batch={k:010d}").withColumn("batch", F.lit(k)) for k in _batches(spark, path, after)]
    none = spark.createDataFrame([], f"{CHANGE}, batch int")
    return reduce(DataFrame.unionByName, parts, none).where(F.col("kind") == kind)


def _base(spark: SparkSession, path: str) -> tuple[str | None, int]:
    folder = latest(spark, f"{path}/base")
    return folder, spark.read.parquet(f"{folder}/upto").first().batch if folder else -1


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state of all addresses: the base, and of each address the last of what batches since then changed."""
    folder, upto = _base(spark, path)
    last = F.max_by(F.struct(*FIELDS), "batch").alias("s")
    new = written(spark, path, "state", upto).groupBy("url").agg(last).select("s.*")
    if folder is None:
        return new
    base = spark.read.schema(STATE).parquet(f"{folder}/state")
    return base.join(new.select("url"), "url", "left_anti").select(*FIELDS).unionByName(new.select(*FIELDS))


def compact(spark: SparkSession, path: str) -> int:
    """Writes the state as a base, and deletes the batches that the base before it held; how many batches there
    were since then."""
    _, upto = _base(spark, path)
    new = _batches(spark, path, upto)
    if new:
        with next_version(spark, f"{path}/base") as folder:
            current(spark, path).write.parquet(f"{folder}/state")
            spark.range(1).select(F.lit(max(new)).alias("batch")).write.parquet(f"{folder}/upto")
        for name in names_in(spark, path):
            if name.startswith("batch=") and int(name.partition("=")[2]) <= upto:
                delete(spark, f"{path}/{name}")
    return len(new)
