import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import norm_title
from millrace.operators import crawl, lifecycle, memory, ranking, resolve, search, validation
from millrace.schema import CATALOG
from millrace.sources import catalog as store
from millrace.sources import exports, http

AS_OF = "2026-08-09"
GOOD = {"id": "mit-1", "title": "T", "institution": "MIT", "domain": "datos", "url_official": "https://x.org/1", "verification_status": "VERIFICADO", "source_of_truth": "https://x.org/1", "last_verified": "2026-08-01"}


def records(spark, *rows):
    df = spark.createDataFrame([tuple(r.get(n) for n in CATALOG.names) for r in rows], CATALOG)
    return df.coalesce(1).withColumn("pos", F.monotonically_increasing_id())


def issues(spark, **change):
    found = validation.validate(records(spark, GOOD | change), AS_OF).collect()
    return {(i.level, i.field) for i in found}


def test_rules(spark):
    assert issues(spark) == set()
    assert issues(spark, domain=None) == {("error", "domain")}
    assert issues(spark, title="") == {("error", "title")}
    assert issues(spark, id="Mit_1") == {("error", "id")}
    assert issues(spark, level="x") == {("error", "level")}
    assert issues(spark, url_syllabus="ftp://x") == {("error", "url_syllabus")}
    assert issues(spark, start_date="2026-02-31") == {("error", "start_date")}
    assert issues(spark, relevance_ppp_infra=4) == {("error", "relevance_ppp_infra")}
    assert issues(spark, relevance_ppp_infra=2) == {("warn", "notes")}
    assert issues(spark, credential_price_usd=-1.0) == {("error", "credential_price_usd")}
    assert issues(spark, credential_free=True, credential_price_usd=5.0) == {("error", "credential_price_usd")}
    assert issues(spark, credential_type="certificado gratuito", credential_free=False) == {("error", "credential_free")}
    assert issues(spark, credential_type="certificado pagado", credential_free=True) == {("error", "credential_free")}
    assert issues(spark, cost_access="audit gratuito", credential_free=True) == {("warn", "cost_access")}
    assert issues(spark, last_verified="2026-01-01") == {("warn", "last_verified")}
    assert issues(spark, last_verified=None, verification_status="PENDIENTE", credential_price_usd=3.0) == {("warn", "credential_price_usd")}
    assert issues(spark, topics=[]) == {("error", "topics")}


def test_untyped_rules_and_duplicates(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text('[{"id": "a", "topics": "x", "credential_price_usd": "149", "url_official": "https://x.org"}, 7, {"id": "a", "url_official": "https://x.org"}, null]')
    raw = validation.untyped(store.read_raw(spark, str(path)))
    found = validation.validate(raw, AS_OF)
    got = {(i.pos, i.field, i.message) for i in found.collect()}
    assert {(0, "topics", "Debe ser un arreglo o null."), (0, "credential_price_usd", "Precio inválido."), (1, None, "El registro no es un objeto."), (2, "id", "ID duplicado en el catálogo."), (3, None, "El registro no es un objeto.")} <= got
    assert (2, "url_official", "URL repetida: ya usada por a. Revisar posible duplicado.") in got
    assert store.is_list(spark, str(path))
    s = validation.summary(found).first()
    assert s.total == s.errors + s.warnings == found.count()
    assert validation.grouped(found).first().id == "a"
    opened = [store.open_catalog(spark, str(tmp_path / "table"), str(path)).count() for _ in range(2)]
    assert opened == [4, 4]
    typed = store.read_json(spark, str(path)).orderBy("pos").collect()
    assert typed[0].id == "a" and typed[0].credential_price_usd == 149.0


def test_catalog_order_is_independent_of_input_order(spark):
    rows = [
        dict(id=f"r{i}", credential_type=c, verification_status=v, relevance_ppp_infra=r, institution=n, title=t)
        for i, (c, v, r, n, t) in enumerate(itertools.product(["badge gratuito", None, "otro"], ["VERIFICADO", None], [3, None], ["Zeta", "Árbol", "Ñandú", "nube", None], ["b"]))
    ]
    first = [r.id for r in records(spark, *rows).orderBy(*ranking.catalog_order()).collect()]
    random.Random(1).shuffle(rows)
    assert [r.id for r in records(spark, *rows).orderBy(*ranking.catalog_order()).collect()] == first
    names = spark.createDataFrame([("Zeta",), ("Árbol",), ("Ñandú",), ("nube",), ("oso",), (None,)], "institution string").withColumns({c: F.lit(None).cast("string") for c in ("credential_type", "verification_status", "title", "id")} | {"relevance_ppp_infra": F.lit(1)})
    assert [r.institution for r in names.orderBy(*ranking.catalog_order()).collect()] == ["Árbol", "nube", "Ñandú", "oso", "Zeta", None]


def test_search(spark):
    rows = [
        GOOD | {"id": "a", "title": "Machines and learners", "language": ["ES"], "credential_free": True},
        GOOD | {"id": "b", "title": "Máquinas", "course_code": "6.006", "topics": ["learning", "c++"]},
        GOOD | {"id": "c", "title": "Other", "institution": "Machine Institute", "domain": "salud"},
    ]
    df = records(spark, *rows)
    ask = lambda **k: {r.id for r in search.matching(df, search.Request(**k)).collect()}
    assert ask(search="mach learn") == {"a"} and ask(search="mach") == {"a", "c"} and ask(search="maquina") == {"b"} and ask(search="máq") == {"b"}
    assert ask(search="learning") == {"a", "b"} and ask(search="learnin") == set() and ask(search="6.006") == {"b"} and ask(search="c++") == {"b"}
    assert ask(search="mach +") == set() and ask(search='"*()') == {"a", "b", "c"}
    assert ask(domain="salud") == {"c"} and ask(domain="nope") == set() and ask(language="es") == {"a"} and ask(credential_free=True) == {"a"}
    assert ask(country="x" * 9, min_relevance=7, level="  ") == {"a", "b", "c"}
    top, total = search.query(df, search.Request(limit=2, sort="institucion"))
    assert [r.id for r in top.collect()] and top.count() == 2 and total.first().total == 3
    assert search.stats(df, AS_OF).first().total == 3


def reference_fold(candidates, catalog):
    """The sequential rule: exact by the strongest key, in order, before similar titles, in order."""
    def keys(r):
        n = lambda x: r["n"][x]
        out = [("url", r["url"])] if r["url"] else []
        if n("institution") and r["course_code"]:
            out.append(("institution+code", (n("institution"), n("course_code"))))
        if n("institution") and r["title"]:
            out.append(("institution+title", (n("institution"), n("title"))))
        return out

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return new

    def score(a, b):
        return 0 if not a or not b else 1 - edits(a, b) / max(len(a), len(b))

    seen, out = list(catalog), {}
    for c in candidates:
        hit = next(((k[0], e) for k in keys(c) for e in seen if k in keys(e)), None)
        if hit:
            out[c["pos"]] = ("exact", hit[0], hit[1]["tag"])
            continue
        inst = c["n"]["institution"]
        near = next((e for e in seen if (not inst or e["n"]["institution"] == inst) and score(c["n"]["title"], e["n"]["title"]) >= 0.88), None)
        if near:
            out[c["pos"]] = ("ambiguous", "similitud de título", near["tag"])
        else:
            out[c["pos"]] = ("none", None, None)
            seen.append(c | {"tag": ("candidate", c["pos"])})
    return out


def test_classify_against_the_sequential_rule(spark):
    r = random.Random(4)
    bases = ["introduction to machine learning", "applied data science", "public health economics", "short"]

    def make(pos, tag):
        t = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("abc ")
        return {"pos": pos, "tag": (tag, pos), "title": "".join(t) if r.random() < 0.95 else None, "institution": r.choice(["MIT", "Universidad Á", None]), "course_code": r.choice([None, None, f"C{r.randint(1, 12)}"]), "platform": None, "url": r.choice([None, f"https://x.org/{r.randint(1, 60)}"])}

    catalog = [make(i, "catalog") for i in range(12)]
    candidates = [make(i, "candidate") for i in range(60)]
    columns = "pos long, title string, institution string, course_code string, platform string, url_official string"
    frame = lambda rows: spark.createDataFrame([(x["pos"], x["title"], x["institution"], x["course_code"], x["platform"], x["url"]) for x in rows], columns)
    for rows in (catalog, candidates):
        normal = {n.pos: n for n in frame(rows).select("pos", *[norm_title(F.col(c)).alias(c) for c in ("title", "institution", "course_code")]).collect()}
        for x in rows:
            x["n"] = normal[x["pos"]].asDict()
    got = {g.pos: (g.match, g.by, (g.existing_kind, g.existing) if g.existing is not None else None) for g in resolve.classify(frame(candidates), frame(catalog)).collect()}
    assert got == reference_fold(candidates, catalog)


def test_lifecycle(spark):
    catalog = records(spark, GOOD | {"notes": "Nota."}, GOOD | {"id": "b", "url_official": "https://x.org/2", "verification_status": "NO_DISPONIBLE", "notes": "[DEPRECADO 2026-01-01] Motivo: X. Y. Z. Propia."}, GOOD | {"id": "c", "url_official": "https://x.org/3"})
    gone = spark.createDataFrame([("http://www.x.org/1/?utm_source=a", "HTTP 404", 3, 0), ("http://x.org/1", "HTTP 410", 4, 1)], "url string, reason string, missing_count int, pos int")
    after = {r.id: r for r in lifecycle.apply_retired(catalog, gone, AS_OF).collect()}
    assert after["mit-1"].verification_status == "NO_DISPONIBLE" and after["mit-1"].notes.startswith(f"[DEPRECADO {AS_OF}] Motivo: HTTP 410. Confirmado tras 4 ") and after["mit-1"].notes.endswith("vez. Nota.")
    assert after["b"].action == "restored" and after["b"].notes == f"[RESTAURADO {AS_OF}] El curso volvio a responder. Propia." and after["b"].enrollment_open is None
    assert after["c"].action is None and len(after) == 3


def test_memory_thresholds_and_reset(spark):
    day = lambda i: f"2026-08-{i:02d}"
    rows = [("u", day(i), i, ok, "s", False, h, "r") for i, (ok, h) in enumerate([(True, "a"), (False, None), (False, None), (True, "b"), (False, None), (False, None), (False, None)], 1)]
    rows += [("v", day(1), 1, False, "s", False, None, "x")]
    df = spark.createDataFrame(rows, "url string, day string, seq int, ok boolean, source string, is_course boolean, content_hash string, reason string")
    got = {r.url: r for r in memory.fold(df).collect()}
    u, v = got["u"], got["v"]
    assert (u.missing_count, u.status, u.changed_at, u.first_seen, u.last_seen, u.last_missing) == (3, "retirado", day(4), day(1), day(4), day(7))
    assert (v.missing_count, v.status, v.last_seen, v.last_reason) == (1, "inestable", None, "x")
    step = memory.fold(df.where("seq > 3"), memory.fold(df.where("seq <= 3")))
    assert {r.url: r for r in step.select(*memory.fold(df).columns).collect()} == got
    due = step.withColumn("due", memory.should_revisit(AS_OF)).collect()
    assert {r.url: r.due for r in due} == {"u": False, "v": True}


def test_crawl(spark):
    pages = [
        ("https://x.org/", True, '<a href="/course/a">a</a><a href="/list">l</a><a href="https://evil.com/course/">e</a><a href="/x.pdf">p</a>', None, False),
        ("https://x.org/list", True, '<a href="/course/b/">b</a><a href="/">home</a>', None, False),
        ("https://x.org/course/a", True, "a", None, False),
        ("https://x.org/course/b/", False, None, "HTTP 403", True),
    ]
    store_ = spark.createDataFrame(pages, "url string, ok boolean, body string, reason string, manual_review boolean")
    sources = spark.createDataFrame(
        [("s", "MIT", ["x.org"], ["https://x.org/"], 3, None, None), ("off", "Off", ["x.org"], ["https://x.org/"], 3, False, None)], "id string, institution string, domains array<string>, seed_urls array<string>, max_depth int, enabled boolean, adapter string"
    )
    visits, found = crawl.crawl(sources, store_, AS_OF)
    got = {(r.url, r.depth, r.ok) for r in visits.collect()}
    assert got == {("https://x.org/", 0, True), ("https://x.org/course/a", 1, True), ("https://x.org/list", 1, True), ("https://x.org/course/b", 2, False)}
    assert [(r.url, r.institution) for r in found.collect()] == [("https://x.org/course/a", "MIT")]
    assert [tuple(r) for r in crawl.totals(visits, found).collect()] == [("s", 4, 1, 1, 0)]
    few, _ = crawl.crawl(sources, store_, AS_OF, limits=crawl.Limits(max_pages=2))
    assert few.count() == 2


def test_http(spark):
    calls = []

    def fetch(url, method):
        calls.append(url)
        return {"a": (200, {"Content-Type": "text/html"}, "body", url), "b": (503, {"Retry-After": "7"}, "", url), "c": (403, {}, "", url)}[url[-1]]

    waits = []
    polite = http.Politeness()
    assert http.attempt("http://x/a", "GET", fetch, polite, waits.append)["status"] == 200 and waits == []
    assert http.attempt("http://x/b", "GET", fetch, polite, waits.append)["attempts"] == 3 and waits == [7.0, 7.0]

    def broken(url, method):
        raise OSError("refused")

    waits.clear()
    assert http.attempt("http://x/a", "GET", broken, polite, waits.append)["error"] == "refused" and waits == [2.0, 4.0]
    urls = spark.createDataFrame([("http://x.org/a",), ("http://x.org/c",)], "url string")
    fixed = lambda url, method: (200 if url.endswith("a") else 404, {}, method, url)
    rows = {r.url: r.status for r in http.fetch_pages(urls, polite=http.Politeness(delay_s=0), fetch=fixed).collect()}
    assert rows == {"http://x.org/a": 200, "http://x.org/c": 404}


def test_exports(spark, tmp_path):
    row = GOOD | {"title": '=1+"x"', "language": ["es"], "credential_free": True, "duration_weeks": 4.0, "credential_price_usd": 9.5, "institution": "a|b\nc"}
    df = records(spark, row)
    text = exports.document(df, "csv")
    assert text.startswith('﻿"ID";"Título"') and text.endswith("\r\n") and '"\'=1+""x"""' in text and '"sí"' in text and '"4"' in text
    assert exports.document(df.limit(0), "csv").count("\r\n") == 1
    assert exports.document(df, "md").splitlines()[2] == '| mit-1 | =1+"x" | a\\|b c | sin credencial | 9.5 | VERIFICADO | [abrir](https://x.org/1) |'
    assert '"language": [' in exports.document(df.select("id", "language"), "json")
    exports.write_csv(df, str(tmp_path / "csv"))
    assert store.rebuild(df, str(tmp_path / "table")) == 1
    store.write_snapshot(df, str(tmp_path / "snap"), "2026-08-08")
    store.write_snapshot(df.withColumn("title", F.lit("new")), str(tmp_path / "snap"), "2026-08-09")
    assert store.last_snapshot(spark, str(tmp_path / "snap")).first().title == "new"
    assert store.last_snapshot(spark, str(tmp_path / "none")) is None and store.read_state(spark, str(tmp_path / "none")).count() == 0
    changes = lifecycle.diff(df, df.withColumn("title", F.lit("new")))
    lines = [r.line for r in exports.diff_report(changes, AS_OF, 1, "x").collect()]
    assert '| mit-1 | title | "=1+"x"" | "new" |' in lines and lines[0].startswith("# Reporte")


def test_catalog_that_does_not_parse_is_an_error(spark, tmp_path):
    """Cut JSON gives null, as a document does that is beyond one value: neither is an empty catalog, and no table
    is left of it."""
    cut, blank = (tmp_path / f"{n}.json" for n in ("cut", "blank"))
    cut.write_text('[{"id": "a"}, {"id":')
    blank.write_text(" \n")
    table = str(tmp_path / "table")
    for read in (store.read_json, store.read_raw, lambda s, p: store.open_catalog(s, table, p)):
        with pytest.raises(Exception, match="beyond 128 MB"):
            read(spark, str(cut)).collect()
    with pytest.raises(Exception, match="beyond 128 MB"):
        store.is_list(spark, str(cut))
    good = tmp_path / "good.json"
    good.write_text('[{"id": "a"}]')
    assert store.open_catalog(spark, table, str(good)).count() == 1
    assert store.read_json(spark, str(blank)).count() == 0 and not store.is_list(spark, str(blank))


def test_catalog_lines_and_bounded_documents(spark, tmp_path, monkeypatch):
    df = records(spark, *[{**GOOD, "id": f"mit-{i}", "language": ["en", None], "title": None if i % 3 else "é\n"} for i in range(40)]).drop("pos")
    path = str(tmp_path / "catalog.jsonl")
    exports.write_json(df.repartition(3), path)
    back = store.read_json(spark, path)
    assert back.select("pos").distinct().count() == 40 and sorted(back.drop("pos").collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)
    assert store.is_list(spark, path) and store.read_raw(spark, path).count() == 40
    assert store.open_catalog(spark, str(tmp_path / "table"), path).count() == 40
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n\n{"id":\n')
    with pytest.raises(Exception, match="no JSON"):
        store.read_json(spark, str(tmp_path / "bad.jsonl")).collect()
    monkeypatch.setattr(exports, "DOCUMENT_ROWS", 39)
    for kind in ("csv", "md", "json"):
        with pytest.raises(ValueError, match="39 rows"):
            exports.document(df, kind)
        assert exports.document(df.limit(39), kind).count("mit-") >= 39
