"""Pages over HTTP with robots by origin, link probes, reports, stored state and versions, streams, and the runner."""

import json
import logging
import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators import crawl, labels, lifecycle, links, memory, tables, validation
from millrace.plans import jobs
from millrace.schema import CATALOG
from millrace.sources import catalog as store
from millrace.sources import exports, http
from millrace.streaming import keyed, state

FAST = http.Politeness(delay_s=0, retries=0)
SITE = {
    "https://x.org/robots.txt": (200, "User-agent: *\nDisallow: /private\nCrawl-delay: 3"),
    "https://x.org/": (200, '<a href="/course/a">a</a> <a href="/private/course/b">b</a> <a href="https://y.org/course/c">c</a> <a href="https://z.org/course/d">d</a>'),
    "https://x.org/course/a": (200, "<title>Machine learning basics</title><p>free</p>"),
    "https://y.org/robots.txt": (404, ""),
    "https://y.org/course/c": (403, ""),
    "https://z.org/robots.txt": (503, ""),
    "https://z.org/course/d": (200, "never asked"),
}
SOURCES = "id string, institution string, domains array<string>, seed_urls array<string>, max_depth int, enabled boolean, adapter string"


def site(log):
    """A fetch of SITE that writes its calls to a file, as tasks run elsewhere."""

    def fetch(url, method):
        with open(log, "a") as file:
            file.write(f"{method} {url}\n")
        if url not in SITE:
            raise OSError("unreachable")
        status, body = SITE[url]
        return status, {}, body, url

    return fetch


def test_live_pages_keep_to_robots(spark, tmp_path):
    log, waits = tmp_path / "calls", tmp_path / "waits"
    pages = http.live_pages(FAST, site(str(log)), lambda s: open(waits, "a").write(f"{s:.0f}\n"))
    sources = spark.createDataFrame([("s", "X", ["x.org", "y.org", "z.org"], ["https://x.org/"], 3, True, None)], SOURCES)
    visits, found = crawl.crawl(sources, pages, "2026-08-09")
    got = {r.url: (r.depth, r.ok, r.reason, r.manual_review) for r in visits.collect()}
    assert got == {
        "https://x.org/": (0, True, None, False),
        "https://x.org/course/a": (1, True, None, False),
        "https://x.org/private/course/b": (1, False, http.DENIED, False),
        "https://y.org/course/c": (1, False, "El sitio impide el acceso automatizado (HTTP 403)", True),
        "https://z.org/course/d": (1, False, http.DENIED, True),
    }
    assert [r.url for r in found.collect()] == ["https://x.org/course/a"]
    calls = log.read_text().split("\n")
    assert len(calls) - 1 == len(set(calls)) - 1 and "GET https://z.org/course/d" not in calls and "GET https://x.org/private/course/b" not in calls


def test_update_from_live_pages(spark, tmp_path):
    sources = spark.createDataFrame([("s", "X", ["x.org"], ["https://x.org/"], 3, True, None)], SOURCES)
    empty = spark.createDataFrame([], CATALOG).withColumn("pos", F.lit(0).cast("long"))
    done = jobs.update(sources, http.live_pages(FAST, site(str(tmp_path / "calls"))), empty, "2026-08-09")
    assert [r.title for r in done.catalog.collect()] == ["Machine learning basics"]
    assert {r.url: r.status for r in done.state.collect()}["https://x.org/private/course/b"] == "inestable"


def test_a_host_that_takes_too_long(spark):
    urls = spark.createDataFrame([(f"https://x.org/{i}",) for i in range(6)], "url string").coalesce(1)

    def slow(url, method):
        time.sleep(0.2)
        return 200, {}, "", url

    rows = http.fetch_pages(urls, polite=http.Politeness(delay_s=0, host_s=0.3, host_at_once=1), fetch=slow).collect()
    assert len(rows) == 6 and sum(r.error == http.LATE for r in rows) >= 3 and any(r.status == 200 for r in rows)


def test_probe_links_and_report(spark):
    answers = {"a": 200, "b": 405, "c": 404, "d": 503}
    again = {"b": 200, "d": 500}

    def fetch(url, method):
        if url.endswith("e"):
            raise OSError("refused")
        final = "https://x.org/new" if url.endswith("a") else url
        return (answers if method == "HEAD" else again)[url[-1]], {}, "", final

    targets = spark.createDataFrame([(x, "url_official", f"https://x.org/{x}") for x in "abcdea"], "id string, field string, url string")
    found = links.outcome(http.probe_links(targets, FAST, fetch))
    got = {(r.id, r.status, r.ok, r.redirect) for r in found.collect()}
    assert got == {("a", 200, True, "https://x.org/new"), ("b", 200, True, None), ("c", 404, False, None), ("d", 500, False, None), ("e", None, False, None)}
    assert tuple(links.summary(found).first()) == (6, 3, 2)
    lines = [r.line for r in exports.link_report(found.dropDuplicates(["id"]), "2026-08-09").collect()]
    assert lines == [
        "# Reporte de enlaces", "", "Fecha: 2026-08-09", "", "- Enlaces verificados: 5", "- Con problemas: 3", "- Con redirección: 1", "",
        "## Enlaces con problemas", "", "| ID | Curso | Campo | Estado | URL |", "|---|---|---|---|---|",
        "| c | c | url_official | 404 | https://x.org/c |", "| d | d | url_official | 500 | https://x.org/d |", "| e | e | url_official | refused | https://x.org/e |", "",
        "## Redirecciones detectadas", "", "| ID | Campo | URL original | Destino |", "|---|---|---|---|", "| a | url_official | https://x.org/a | https://x.org/new |", "",
    ]
    none = exports.link_report(found.where("id = 'b'"), "2026-08-09").collect()
    assert none[-1].line == "Todos los enlaces respondieron correctamente y sin redirecciones."


def test_reports_of_issues_and_changes(spark):
    rows = [{"id": "b", "title": "", "institution": "I"}, {"id": "a", "title": "T", "institution": "I", "domain": "datos", "url_official": "https://x.org", "verification_status": "PENDIENTE", "source_of_truth": "x", "relevance_ppp_infra": 1}]
    df = spark.createDataFrame([tuple(r.get(n) for n in CATALOG.names) for r in rows], CATALOG).coalesce(1).withColumn("pos", F.monotonically_increasing_id())
    lines = [r.line for r in exports.issue_report(validation.validate(df, "2026-08-09"), 2).collect()]
    assert lines[0] == "b" and lines[1] == "  ERROR [title]: Campo obligatorio ausente." and "a" in lines
    assert "  aviso [notes]: Relevancia mayor que 0 sin justificación en notes." in lines and lines[-1].startswith("Validación: 2 cursos · ")
    assert [r.line for r in exports.issue_report(validation.validate(df.limit(0), "2026-08-09"), 0).collect()] == ["Validación: 0 cursos · 0 errores · 0 avisos"]
    same = lifecycle.diff(df, df)
    assert exports.diff_report(same, "d", 2, "x").collect()[-1].line.startswith("Sin cambios")
    now = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    assert tuple(exports.discovery_report(now, now.where("url = 'a'").union(spark.sql("select 'z'")), "d").first()) == ("d", 2, 2, 1, 1)


def test_labels(spark):
    df = spark.createDataFrame([("domain", "pmo"), ("domain", "other"), ("institution", "OpenAI"), ("institution", "Harvard University"), ("country", "DE"), ("platform", "edX")], "facet string, value string")
    got = {(r.facet, r.value): (r.label, r.group_label) for r in labels.labelled(df).collect()}
    assert got == {
        ("domain", "pmo"): ("PMO y proyectos", "Gestión y negocio"), ("domain", "other"): ("other", None), ("institution", "OpenAI"): ("OpenAI", "Proveedores de IA"),
        ("institution", "Harvard University"): ("Harvard", "Universidades y organismos"), ("country", "DE"): ("Alemania", None), ("platform", "edX"): ("edX", None),
    }


def test_versions_survive_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "table")
    one = spark.createDataFrame([("a",)], "id string").select(*[F.col("id") if n == "id" else F.lit(None).cast(k).alias(n) for n, k in ((f.name, f.dataType) for f in CATALOG)])
    assert store.rebuild(one, path) == 1
    with pytest.raises(Exception, match="broken"):
        store.rebuild(one.withColumn("title", F.raise_error(F.lit("broken")).cast("string")), path)
    assert tables.latest(spark, path).endswith("version=0000000001")
    assert store.open_catalog(spark, path, "no such file").count() == 1
    assert store.rebuild(one.union(one), path) == 2 and store.rebuild(one, path) == 1
    assert [n for n in tables.names_in(spark, path) if n.startswith("version=")] == ["version=0000000002", "version=0000000003"]
    assert len(tables.names_in(spark, f"{path}/parts")) == 2
    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps({"the list": [{"id": "a"}, {"id": "b"}]}))
    assert store.rebuild_from(spark, str(seed), path, "the list") == "Base reconstruida: 2 registros indexados (2 en total)."


def test_state_with_stamp_and_first_snapshot(spark, tmp_path):
    path, snaps = str(tmp_path / "state"), str(tmp_path / "snaps")
    assert store.state_stamp(spark, path) is None
    visits = spark.createDataFrame([("u", "2026-08-01", 1, True, "s", True, "h", None)], "url string, day string, seq int, ok boolean, source string, is_course boolean, content_hash string, reason string")
    store.write_state(memory.fold(visits), path, "2026-08-09")
    assert store.state_stamp(spark, path) == "2026-08-09" and store.read_state(spark, path).first().url == "u"
    df = spark.createDataFrame([("a",)], "id string")
    assert store.first_snapshot(df, snaps, "2026-08-09") and not store.first_snapshot(df.limit(0), snaps, "2026-08-10")
    assert store.last_snapshot(spark, snaps).count() == 1


def test_sources_and_limits_from_files(spark, tmp_path):
    (tmp_path / "sources.json").write_text('[{"id": "a", "domains": ["x.org"], "seed_urls": ["https://x.org"], "enabled": false}, {"id": "b", "max_depth": 2}]')
    rows = {r.id: r for r in store.read_sources(spark, str(tmp_path / "sources.json")).collect()}
    assert rows["a"].domains == ["x.org"] and rows["a"].enabled is False and rows["b"].max_depth == 2 and rows["b"].enabled is None
    assert [r.id for r in crawl.enabled(store.read_sources(spark, str(tmp_path / "sources.json"))).collect()] == ["b"]
    (tmp_path / "crawler.json").write_text('{"max_depth": 1, "max_pages_per_source": 7, "other": {}, "skipPatterns": ["/Login"]}')
    skips = store.read_skips(spark, str(tmp_path / "crawler.json"))
    assert skips.parts == ("/login",) and ".pdf" in skips.suffixes
    said = spark.sql("select 'https://x.org/LOGIN/a' a, 'https://x.org/cart' b").select(*[urls.is_relevant(F.col(c), skips) for c in "ab"]).first()
    assert tuple(said) == (False, True)
    assert store.read_limits(spark, str(tmp_path / "crawler.json")) == crawl.Limits(max_depth=1, max_pages=7)


def test_stream_of_visits(spark, tmp_path):
    kind = "url string, day string, seq int, ok boolean, source string, is_course boolean, content_hash string, reason string"
    rows = [("u", f"2026-08-{i:02d}", i, i % 4 != 0, "s", False, f"h{i // 3}", "e") for i in range(1, 20)] + [("v", "2026-08-01", 1, False, None, None, None, "gone")]
    base = tmp_path / "visits"
    for k in range(3):
        part = spark.createDataFrame([r for r in rows if 7 * k <= r[2] < 7 * k + 7], kind)
        part.repartition(3).write.mode("append").json(str(base))
        state.track(spark.readStream.schema(kind).json(str(base)), str(tmp_path / "state"), str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    got = sorted(store.read_state(spark, str(tmp_path / "state")).collect())
    assert got == sorted(memory.fold(spark.createDataFrame(rows, kind)).collect()) and len(got) == 2


def test_keyed_state_of_a_stream(spark, tmp_path):
    """Visits out of order and again, in batches, are the fold of all; a batch writes what it changed."""
    kind = "url string, day string, seq int, ok boolean, source string, is_course boolean, content_hash string, reason string"
    r = random.Random(5)
    rows = [(f"u{u}", f"2026-08-{1 + i // 2:02d}", i, r.random() < 0.6, r.choice(["s", None]), r.random() < 0.1, r.choice(["h1", "h2", None]), "e") for u in range(4) for i in range(20)]
    rows += [("gone", f"2026-08-0{i}", i, False, "s", False, None, "HTTP 404") for i in (1, 2, 3)] + [("odd", None, 1, True, None, None, None, None)]
    mixed = sorted(rows, key=lambda x: int((x[1] or "2026-08-01")[-2:]) + r.random() * 4)
    path, base = str(tmp_path / "state"), str(tmp_path / "in")

    def bring(visits):
        spark.createDataFrame(visits, kind).repartition(2).write.mode("append").json(base)
        stream = spark.readStream.schema(kind).json(base)
        keyed.track(stream, path, str(tmp_path / "checkpoint"), keep_days=5, availableNow=True).awaitTermination()

    bring(mixed[:40])
    assert keyed.compact(spark, path) > 0
    bring(mixed[40:] + mixed[30:50])
    want = sorted(memory.fold(spark.createDataFrame(rows, kind)).select(*keyed.FIELDS).collect(), key=str)
    assert sorted(keyed.current(spark, path).select(*keyed.FIELDS).collect(), key=str) == want
    before = keyed._batches(spark, path)[-1]
    bring([("new", "2026-08-20", 1, True, "s", True, "h", None), rows[0]])
    new = {(x.kind, x.url) for k in ("state", "due", "late") for x in keyed.written(spark, path, k, before).collect()}
    assert {("state", "new"), ("late", "u0")} <= new and all(k == "due" for k, u in new - {("state", "new"), ("late", "u0")})
    due = {x.url for x in keyed.written(spark, path, "due").collect()}
    assert due and "gone" not in due  # retired addresses are not visited again
    assert sorted(keyed.current(spark, path).where("url != 'new'").select(*keyed.FIELDS).collect(), key=str) == want
    assert keyed.compact(spark, path) > 0 and keyed.compact(spark, path) == 0
    assert keyed.current(spark, path).count() == len(want) + 1


def test_watch_catalog(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("[]")
    query = state.watch_catalog(spark, str(tmp_path / "in"), lambda s, names: seen.extend(n.rpartition("/")[2] for n in names), str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
        (tmp_path / "in" / "b.json").write_text("[1]")
        end = time.time() + 60
        while "b.json" not in seen and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen == ["a.json", "b.json"]


def test_page_budget(spark):
    pages = [("https://x.org/", True, "".join(f'<a href="/course/{i}">x</a>' for i in range(30)), None, False)] + [(f"https://x.org/course/{i}", True, "", None, False) for i in range(30)]
    table = spark.createDataFrame(pages, "url string, ok boolean, body string, reason string, manual_review boolean")
    sources = spark.createDataFrame([("s", "X", ["x.org"], ["https://x.org/"], 3, True, None)], SOURCES)
    visits = crawl.crawl(sources, table, "2026-08-09", limits=crawl.Limits(max_pages=11))[0]
    assert sorted(r.url for r in visits.collect()) == sorted(["https://x.org/", *[f"https://x.org/course/{i}" for i in range(10)]])
    known = spark.createDataFrame([(f"https://x.org/course/{i}", "activo", True, "2026-01-01", "2026-08-08") for i in (0, 3, 25)], "url string, status string, is_course boolean, first_seen string, last_seen string")
    visits, found = crawl.crawl(sources, table, "2026-08-09", known, crawl.Limits(max_pages=11))
    # what memory knows costs nothing as long as there is budget
    assert visits.count() == 11 and {r.url for r in found.where("from_memory").collect()} == {"https://x.org/course/0", "https://x.org/course/3"}


def test_runner(spark):
    said = []
    tell = lambda step, level, message: said.append((step, level, message))

    def noisy(s):
        logging.getLogger("millrace").warning("one\n\ntwo")

    tries = []

    def second_time(s):
        tries.append(1)
        return len(tries) > 1

    def slow(s):
        return s.range(0, 8, 1, 8).mapInPandas(lambda it: (time.sleep(60) or b for b in it), "id long").count() >= 0

    assert jobs.run(spark, ["a", "b"], {"a": noisy, "b": second_time}, tell, tries=2)
    assert ("a", "warning", "one") in said and ("a", "warning", "two") in said and ("b", "error", "failed") in said and said[-1] == ("b", "info", "done")
    said.clear()
    began = time.time()
    assert not jobs.run(spark, ["slow", "after"], {"slow": slow, "after": lambda s: True}, tell, step_timeout_s=3)
    assert time.time() - began < 50 and said[-1] == ("slow", "error", "timed out")
    assert not jobs.run(spark, ["x"], {"x": lambda s: 1 / 0}, tell) and ("x", "error", "division by zero") in said
    with pytest.raises(ValueError, match="no steps"):
        jobs.run(spark, [], {})


def test_scratch_tables_go(spark):
    with tables.scratch(spark):
        df = tables.materialize(spark.range(3))
        path = df.inputFiles()[0].rpartition("/")[0]
        assert tables.names_in(spark, path)
    assert tables.names_in(spark, path) == []
    made = []
    last = []

    def make():
        made.append(tables.materialize(spark.range(5)))
        return made[-1].where("id > 1")

    assert tables.settled(spark, make, last).count() == 3
    assert tables.names_in(spark, last[0])
    before = last[0]
    assert tables.settled(spark, make, last).count() == 3 and tables.names_in(spark, before) == [] and len(last) == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())


def test_commands(spark, tmp_path, capsys):
    from millrace import __main__ as command

    good, bad, other = (tmp_path / f"{n}.json" for n in ("good", "bad", "other"))
    good.write_text('[{"id": "a-1", "title": "T", "institution": "I", "domain": "datos", "url_official": "https://x.org/1", "verification_status": "PENDIENTE", "source_of_truth": "https://x.org"}]')
    bad.write_text('[{"id": "A", "topics": "x"}, 7]')
    other.write_text('{"id": "a"}')
    assert command.main(["validate", str(good), "2026-08-09"]) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "Validación: 1 cursos · 0 errores · 0 avisos"
    assert command.main(["validate", str(bad)]) == 1 and "  ERROR [topics]: Debe ser un arreglo o null." in capsys.readouterr().out
    assert command.main(["validate", str(other)]) == 1 and command.main([]) == 2
    assert command.main(["rebuild", str(good), str(tmp_path / "table")]) == 0 and "1 registros" in capsys.readouterr().out
