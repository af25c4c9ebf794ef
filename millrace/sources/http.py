"""Pages over HTTP: a host belongs to one task, which keeps its pauses, and tasks have about equally many addresses."""

from __future__ import annotations

import heapq
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.robots import allows, policy_of_answer
from millrace.functions.urls import host, origin, path
from millrace.operators.links import fetch_outcome
from millrace.operators.tables import materialize

#: (status, headers, body, final url) of an address, or an exception.
Fetch = Callable[[str, str], tuple[int, dict[str, str], str, str]]
# Reasons of addresses that are not asked.
DENIED, LATE = "Prohibido por robots.txt", "Tiempo agotado para la fuente"
PAGE = "url string, status int, body string, content_type string, final_url string, error string, attempts int"
NO_ANSWER = {"status": None, "body": None, "content_type": None, "final_url": None, "error": None, "attempts": 0}
PAGE_SCHEMA = pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in (x.split() for x in PAGE.split(", "))])
#: Hosts, those with the most addresses, that are dealt one by one; more, each with fewer, fill up what is left.
PACKED = 10_000


@dataclass(frozen=True)
class Politeness:
    agent: str = "CatalogBot/0.1"
    timeout_s: float = 15.0
    delay_s: float = 1.2
    retries: int = 2
    backoff_s: float = 2.0
    factor: float = 2.0
    #: Tasks that ask at a time; requests of a task, and to a host, under way at a time; the pause holds between these too.
    tasks: int = 4
    at_once: int = 4
    host_at_once: int = 2
    #: Bytes of a body; a longer one is a failure.
    most_bytes: int = 32 << 20
    #: After so many seconds on one host the rest of its addresses in a call are not asked any more; None: no end.
    host_s: float | None = 240.0


def url_fetch(agent: str, timeout_s: float, most_bytes: int) -> Fetch:
    def fetch(url: str, method: str) -> tuple[int, dict[str, str], str, str]:
        request = urllib.request.Request(url, method=method, headers={"User-Agent": agent})
        try:
            with urllib.request.urlopen(request, timeout=timeout_s) as answer:
                raw = b"" if method == "HEAD" else answer.read(most_bytes + 1)
                if len(raw) > most_bytes:
                    raise ValueError(f"a body beyond {most_bytes} bytes")
                body = raw.decode(answer.headers.get_content_charset() or "utf-8", "replace")
                return answer.status, dict(answer.headers), body, answer.url
        except urllib.error.HTTPError as error:
            return error.code, dict(error.headers), "", url

    return fetch


def attempt(url: str, method: str, fetch: Fetch, polite: Politeness, sleep: Callable[[float], None] = time.sleep) -> dict:
    """An answer after retries: of faults in the connection, of 429 and of errors of the server, the latter two
    after what Retry-After says."""
    pause, row = polite.backoff_s, {"url": url} | NO_ANSWER
    for n in range(polite.retries + 1):
        rest = pause
        try:
            status, headers, body, final = fetch(url, method)
            low = {k.lower(): v for k, v in headers.items()}
            row |= {"status": status, "body": body, "content_type": low.get("content-type", ""), "final_url": final if final != url else None, "error": None, "attempts": n + 1}
            if status != 429 and status < 500:
                break
            if low.get("retry-after", "").strip().isdigit():
                rest = float(low["retry-after"])
        except Exception as error:  # noqa: BLE001  a page that fails is a row, not the end of the job
            row |= {"error": str(error), "attempts": n + 1}
        if n < polite.retries:
            sleep(rest)
            pause *= polite.factor
    return row


def _task_of(urls: DataFrame, tasks: int) -> DataFrame:
    """urls (host, ...) with the task that each host goes to. The hosts with the most addresses are dealt one by one, the
    largest first to the task that has the least; the others are dealt by their hash to what room is left below the
    largest task, or alike where none is."""
    counts = materialize(urls.groupBy("host").agg(F.count("*").alias("n")))
    large = counts.orderBy(F.desc("n"), "host").limit(PACKED).collect()
    loads = [(0, t) for t in range(tasks)]
    dealt = []
    for r in large:
        load, task = heapq.heappop(loads)
        dealt.append((r.host, task))
        heapq.heappush(loads, (load + r.n, task))
    named = urls.join(F.broadcast(urls.sparkSession.createDataFrame(dealt, "host string, task int")), "host", "left")
    rest = (counts.agg(F.sum("n")).first()[0] or 0) - sum(r.n for r in large)
    by_task = dict((t, n) for n, t in loads)
    level = max((rest + sum(by_task.values())) / tasks, 1)
    room = [max(0.0, level - by_task[t]) + 1e-9 for t in range(tasks)]
    share = (F.xxhash64("host") / float(1 << 64)) + 0.5
    task, edge = F.lit(tasks - 1), 1.0
    for t in range(tasks - 1, 0, -1):
        edge -= room[t] / sum(room)
        task = F.when(share < edge, F.lit(t - 1)).otherwise(task)
    return named.withColumn("task", F.coalesce("task", task))


class _Asker:
    """Asks for the addresses of a task: several at a time, at most host_at_once of a host, its pause between any two."""

    def __init__(self, method: str, call: Fetch, polite: Politeness, sleep: Callable[[float], None]):
        self.method, self.call, self.polite, self.sleep = method, call, polite, sleep
        self.lock, self.next_at, self.began = threading.Lock(), {}, {}

    def ask(self, url: str, host: str, delay_s: float) -> dict:
        with self.lock:
            now = time.monotonic()
            if self.polite.host_s is not None and now - self.began.setdefault(host, now) > self.polite.host_s:
                return {"url": url} | NO_ANSWER | {"error": LATE}
            at = max(now, self.next_at.get(host, now))
            self.next_at[host] = at + delay_s
        if at > now:
            self.sleep(at - now)
        return attempt(url, self.method, self.call, self.polite, self.sleep)

    def all(self, rows: Iterator[tuple[str, str, float]]) -> Iterator[dict]:
        """The answers as they come. Addresses wait by host; a host that has its requests under way lets others go first."""
        waiting: dict[str, deque] = {}
        busy: dict[str, int] = {}
        under_way: dict[Future, str] = {}
        held, ended = 0, False
        with ThreadPoolExecutor(self.polite.at_once) as pool:
            while True:
                while not ended and held < 64 * self.polite.at_once:
                    row = next(rows, None)
                    if row is None:
                        ended = True
                        break
                    waiting.setdefault(row[1], deque()).append(row)
                    held += 1
                for host in sorted(waiting, key=lambda h: -len(waiting[h])):
                    while waiting[host] and busy.get(host, 0) < self.polite.host_at_once and len(under_way) < self.polite.at_once:
                        under_way[pool.submit(self.ask, *waiting[host].popleft())] = host
                        busy[host] = busy.get(host, 0) + 1
                        held -= 1
                waiting = {h: q for h, q in waiting.items() if q}
                if not under_way:
                    return
                done, _ = wait(under_way, return_when=FIRST_COMPLETED)
                for future in done:
                    busy[under_way.pop(future)] -= 1
                    yield future.result()


def fetch_pages(urls: DataFrame, method: str = "GET", polite: Politeness = Politeness(), fetch: Fetch | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """PAGE rows of urls (url, and optionally delay_ms from robots)."""
    call = fetch or url_fetch(polite.agent, polite.timeout_s, polite.most_bytes)
    wanted = F.coalesce(F.col("delay_ms"), F.lit(0)) if "delay_ms" in urls.columns else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((u, h, max(polite.delay_s, d / 1000)) for b in batches for u, h, d in zip(*(c.to_pylist() for c in b.columns)))
        answers, size = [], 0
        for row in _Asker(method, call, polite, sleep).all(rows):
            answers.append(row)
            size += len(row["body"] or "")
            if len(answers) == 1000 or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(answers, PAGE_SCHEMA)
                answers, size = [], 0
        yield pa.RecordBatch.from_pylist(answers, PAGE_SCHEMA)

    named = materialize(urls.select("url", F.coalesce(host(F.col("url")), F.lit("")).alias("host"), wanted.cast("double").alias("delay_ms")))
    dealt = _task_of(named, polite.tasks).repartitionById(polite.tasks, F.col("task"))
    return dealt.select("url", "host", "delay_ms").mapInArrow(run, PAGE)


def live_pages(polite: Politeness = Politeness(), fetch: Fetch | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """What gives pages (url, ok, body, reason, manual_review) for addresses (url), for crawl.crawl(). The robots file
    of an origin is asked once for all calls; where it can't be had nothing is fetched. An address that robots do
    not allow is not asked, and the delay they want is kept."""
    known: list[DataFrame] = []

    def robots(origins: DataFrame) -> DataFrame:
        new = origins
        for table in known:
            new = new.join(table.select("origin"), "origin", "left_anti")
        asked = fetch_pages(new.select(F.concat("origin", F.lit("/robots.txt")).alias("url")), "GET", polite, fetch, sleep)
        found = policy_of_answer(F.col("status"), F.col("body"), polite.agent)
        known.append(materialize(asked.select(F.regexp_replace("url", r"/robots\.txt$", "").alias("origin"), found.alias("policy"), (F.col("status").isNull() | (~F.col("status").between(200, 299) & (F.col("status") != 404))).alias("shut"))))
        return reduce(DataFrame.unionByName, known)

    def pages(urls: DataFrame) -> DataFrame:
        named = materialize(urls.select("url", origin(F.col("url")).alias("origin")).distinct())
        ruled = named.join(robots(named.select("origin").where("origin is not null").distinct()), "origin", "left")
        allowed = F.coalesce(allows(F.col("policy.rules"), path(F.col("url"))), F.lit(False))
        ruled = materialize(ruled.select("url", "shut", allowed.alias("allowed"), F.col("policy.delay_ms").alias("delay_ms")))
        got = fetch_pages(ruled.where("allowed").select("url", "delay_ms"), "GET", polite, fetch, sleep)
        answers = got.select("url", "body", F.inline(F.array(fetch_outcome(F.col("status"), F.col("error")))))
        answers = answers.select("url", "ok", F.when(F.col("ok"), F.col("body")).alias("body"), "reason", "manual_review")
        denied = ruled.where("not allowed").select("url", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("body"), F.lit(DENIED).alias("reason"), F.coalesce("shut", F.lit(False)).alias("manual_review"))
        return answers.unionByName(denied)

    return pages


def probe_links(targets: DataFrame, polite: Politeness = Politeness(), fetch: Fetch | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds head_status, get_status, final_url, error to targets (url, ...); each address is asked once."""
    urls = targets.select("url").distinct()
    head = fetch_pages(urls, "HEAD", polite, fetch, sleep).select("url", F.col("status").alias("head_status"), F.col("final_url").alias("head_final"), F.col("error").alias("head_error"))
    again = head.where("head_status in (403, 405) or head_status >= 500").select("url")
    get = fetch_pages(again, "GET", polite, fetch, sleep).select("url", F.col("status").alias("get_status"), F.col("final_url").alias("get_final"), F.col("error").alias("get_error"))
    both = head.join(get, "url", "left").select("url", "head_status", "get_status", F.coalesce("get_final", "head_final").alias("final_url"), F.coalesce("get_error", "head_error").alias("error"))
    return targets.join(both, "url", "left")
