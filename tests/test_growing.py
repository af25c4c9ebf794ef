"""What grows by what changed: index segments, buckets of the catalog, chains of candidates, resumed crawls and updates."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from millrace.functions.stemming import kept_of, stem
from millrace.operators import crawl, resolve, search, tables
from millrace.plans import jobs
from millrace.schema import CATALOG
from millrace.sources import catalog as store
from millrace.sources import http, postings
from millrace.streaming import keyed

WORDS = "learn learning learner machine machines the de data datum deep depth course zeta".split()
SOURCES = "id string, institution string, domains array<string>, seed_urls array<string>, max_depth int, enabled boolean, adapter string"


def records(spark, texts):
    """Catalog records with these titles by id."""
    rows = [tuple({"id": i, "title": t}.get(n) for n in CATALOG.names) for i, t in texts.items()]
    return spark.createDataFrame(rows, CATALOG)


def by_hand(texts, phrases):
    """The ids in which each phrase is a run of stems, the last one a prefix."""
    out = set()
    for i, text in texts.items():
        stems = [stem(w) for w in (text or "").split()]
        found = [any(stems[k : k + len(p) - 1] == p[:-1] and k + len(p) <= len(stems) and stems[k + len(p) - 1].startswith(p[-1]) for k in range(len(stems))) for p in phrases]
        if all(found):
            out.add(i)
    return out


QUERIES = ["learn", "the-machin", "de data", "d", "deep-learning mach", "zzz"]


def test_index_after_changes_is_that_of_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "MOST", 3)
    r, path = random.Random(1), str(tmp_path / "index")
    text = lambda: " ".join(r.choices(WORDS, k=r.randint(0, 7)))
    texts = {f"r{i}": text() for i in range(40)}
    postings.build(records(spark, texts), "id", path)
    for step in range(4):
        changed = {i: text() for i in [*r.sample(sorted(texts), 4), f"new{step}"]}
        gone = r.sample(sorted(set(texts) - set(changed)), 3)
        postings.update(records(spark, changed), spark.createDataFrame([(g,) for g in gone], "id string"), "id", path)
        texts = {i: t for i, t in (texts | changed).items() if i not in gone}
    index = postings.Index(spark, path, "id")
    files = postings._files(spark, index.folder).collect()
    assert len({f.segment for f in files}) <= 3 and {f.segment for f in files} <= set(tables.names_in(spark, f"{path}/segments"))
    for q in QUERIES:
        phrases = search.query_phrases(q)
        assert {k.id for k in index.keys(phrases).collect()} == by_hand(texts, phrases), q


def test_words_are_read_from_their_files_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        postings.build(records(spark, {f"r{i}": "the " + WORDS[i % len(WORDS)] for i in range(400)}), "id", path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    index = postings.Index(spark, path, "id")
    every = {r.file for r in postings._files(spark, index.folder).collect()}
    rare, common = ({f.removeprefix("file://") for f in index.word(w, False).inputFiles() if "/segments/" in f} for w in ("zeta", "the"))
    assert len(every) > 2 and len(rare) == 1 and rare < {f.removeprefix("file://") for f in every}
    assert len(common) > 1  # a word that all have is in no single file
    assert index.word("zeta", False).count() == 400 // len(WORDS) and index.word("nope", True).count() == 0
    found = search.matching(records(spark, {"r12": "the zeta"}), search.Request(search="zet"), index)
    assert [x.id for x in found.collect()] == ["r12"]


def test_merge_rewrites_the_buckets_of_what_changed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 5)
    path = str(tmp_path / "table")
    texts = {f"r{i}": f"title {i}" for i in range(60)} | {None: "nameless"}
    assert store.rebuild(records(spark, texts), path) == 61
    buckets = lambda: {r.bucket: r.part for r in spark.read.parquet(f"{tables.latest(spark, path)}/buckets").collect()}
    before = buckets()
    changed = {"r3": "machine three", "r77": "machine new"}
    assert store.merge(records(spark, changed), spark.createDataFrame([("r5",), ("nope",)], "id string"), path) == 61
    want = {i: t for i, t in (texts | changed).items() if i != "r5"}
    assert {r.id: r.title for r in store.open_catalog(spark, path, "").collect()} == want
    assert sum(before[b] != p for b, p in buckets().items() if b in before) <= 4 < len(before)
    assert {r.id for r in store.open_index(spark, path).keys([["machin"]]).collect()} == {"r3", "r77"}
    assert store.open_index(spark, path).keys([["titl"], ["5"]]).count() == 10  # 50 to 59, without 5
    # a merge that fails leaves table and index as they were, and the next one does not see it
    with pytest.raises(Exception, match="broken"):
        store.merge(records(spark, {"r1": "x"}).withColumn("level", F.raise_error(F.lit("broken")).cast("string")), spark.createDataFrame([], "id string"), path)
    assert store.merge(records(spark, {}), spark.createDataFrame([("r77",)], "id string"), path) == 60
    assert {r.id: r.title for r in store.open_catalog(spark, path, "").collect()} == {i: t for i, t in want.items() if i != "r77"}
    assert {r.id for r in store.open_index(spark, path).keys([["machin"]]).collect()} == {"r3"}


def fold(rows):
    """The sequential rule over (pos, block, leads)."""
    led, kept = set(), []
    for pos in sorted({p for p, _, _ in rows}):
        own = [(b, leads) for p, b, leads in rows if p == pos]
        if not any(b in led for b, _ in own):
            kept.append(pos)
            led |= {b for b, leads in own if leads}
    return kept


@pytest.mark.parametrize("most", [7, 100_000])
def test_chains_are_folded(spark, most):
    """A chain in which each meets the two before it, a long one of pairs, and random blocks."""
    r = random.Random(3)
    rows = [(i, f"c{k}", k == i) for i in range(400) for k in (i, i - 1, i - 2) if k >= 0]
    rows += [(1000 + i, f"p{k}", k == i) for i in range(400) for k in (i, i - 1) if k >= 0]
    rows += [(2000 + i, f"r{r.randint(0, 60)}", r.random() < 0.6) for i in range(120) for _ in range(3)]
    rows = list({(p, b): (p, b, leads) for p, b, leads in rows}.values())
    if most == 7:  # chains longer than what is folded at a time
        rows = [x for x in rows if x[0] % 1000 < 14]
    keys = spark.createDataFrame(rows, "pos long, block string, leads boolean")
    got = resolve.first_come(keys, keys.select("pos").distinct(), most)
    assert sorted(x.pos for x in got.collect()) == fold(rows)


def test_a_chain_of_5000_similar_titles(spark):
    """Each title is similar to the ones around it: of a run the first is kept, up to where they are no longer alike."""
    from millrace.functions.text import norm_title

    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [letters[i % 26] * 2 for i in range(13)]
    titles = []
    for i in range(5000):  # one more place changed each time, so that neighbours differ by one edit
        base[i % 13] = letters[(i * 7 + i // 13) % 26] + base[i % 13][1]
        titles.append("".join(base))
    kind = "pos long, title string, institution string, course_code string, platform string, url_official string"
    df = spark.createDataFrame([(i, t, "I", None, None, None) for i, t in enumerate(titles)], kind)
    none = df.limit(0)
    got = {x.pos: (x.match, x.existing) for x in resolve.classify(df, none).collect()}
    near = lambda a, b: edits(a, b) <= int(max(len(a), len(b)) * 0.12 + 1e-9)
    kept, want = [], {}
    for i, t in enumerate(titles):
        if t in {titles[k] for k in kept}:
            want[i] = ("exact", next(k for k in kept if titles[k] == t))
        elif (hit := next((k for k in kept if near(titles[k], t)), None)) is not None:
            want[i] = ("ambiguous", hit)
        else:
            kept.append(i)
            want[i] = ("none", None)
    assert got == want and len(kept) > 40
    assert df.limit(1).select(norm_title(F.col("title"))).first()[0] == titles[0]


def edits(a, b, most=4):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j in range(1, len(b) + 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != b[j - 1]))
        if min(row) > most:
            return 99
    return row[-1]


def test_catalog_places_beyond_any_number_of_partitions(spark):
    kind = "pos long, title string, institution string, course_code string, platform string, url_official string"
    far = [(1 << 40) + 5, (1 << 50) + 1]
    catalog = spark.createDataFrame([(p, f"machine learning {p}", "I", None, None, f"https://x.org/{p}") for p in far], kind)
    candidates = spark.createDataFrame([(0, "other", "J", None, None, f"https://x.org/{far[1]}"), (7, "same", "K", None, None, "https://x.org/9"), (1 << 45, "machine learning 9", "K", None, None, "https://x.org/9")], kind)
    got = {x.pos: (x.match, x.existing_kind, x.existing) for x in resolve.classify(candidates, catalog).collect()}
    assert got == {0: ("exact", "catalog", far[1]), 7: ("none", None, None), 1 << 45: ("exact", "candidate", 7)}


def test_hosts_are_packed_and_paused(spark, tmp_path):
    r = random.Random(2)
    for packed, sizes in ((10_000, [60, 45, 44, 30] + [r.randint(1, 9) for _ in range(60)]), (6, [200, 60, 45, 44, 30] + [1] * 1500)):
        urls = spark.createDataFrame([(f"https://h{h}.org/{i}", f"h{h}.org") for h, n in enumerate(sizes) for i in range(n)], "url string, host string")
        http.PACKED, before = packed, http.PACKED
        dealt = http._task_of(urls, 8).groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("host")).collect()
        http.PACKED = before
        assert max(x.n for x in dealt) <= 1.3 * max(sum(sizes) / 8, max(sizes)) and sum(x.n for x in dealt) == sum(sizes)
    log = str(tmp_path / "log")

    def fetch(url, method):
        import time

        began = time.time()
        time.sleep(0.3)
        with open(log, "a") as file:
            file.write(f"{url} {began} {time.time()}\n")
        return 200, {}, "x", url

    some = spark.createDataFrame([(f"https://h{h}.org/{i}",) for h in range(3) for i in range(4)], "url string")
    rows = http.fetch_pages(some, polite=http.Politeness(delay_s=0.1, tasks=2, at_once=4), fetch=fetch).collect()
    assert len(rows) == 12 and all(x.status == 200 and x.body == "x" for x in rows)
    calls = [(u, float(a), float(b)) for u, a, b in (line.split() for line in open(log))]
    for h in range(3):
        own = sorted((a, b) for u, a, b in calls if u.startswith(f"https://h{h}.org"))
        assert all(b[0] - a[0] >= 0.09 for a, b in zip(own, own[1:]))  # the pause
        assert all(sum(x[0] < a[1] and a[0] < x[1] for x in own) <= 3 for a in own)  # two at a time: one more may touch either
        assert any(b[0] < a[1] for a, b in zip(own, own[1:]))  # and not one after the other


TITLES = {1: "Machine learning", 2: "Public health economics", 3: "Roman history"}
PAGES = {
    "https://x.org/": '<a href="/a">a</a> <a href="/course/1">1</a>',
    "https://x.org/a": '<a href="/course/2">2</a> <a href="/b">b</a>',
    "https://x.org/b": '<title>B</title><a href="/course/3">3</a>',
    **{f"https://x.org/course/{i}": f"<title>{TITLES[i]}</title><p>free</p>" for i in (1, 2, 3)},
}


class Broken(Exception):
    pass


def live(spark, asked, breaks_at=None):
    def pages(urls):
        wanted = sorted(r.url for r in urls.collect())
        if len(asked) == breaks_at:
            raise Broken
        asked.append(wanted)
        return spark.createDataFrame([(u, True, PAGES[u], None, False) for u in wanted], "url string, ok boolean, body string, reason string, manual_review boolean")

    return pages


def test_a_crawl_goes_on_behind_its_last_level(spark, tmp_path):
    sources = spark.createDataFrame([("s", "X", ["x.org"], ["https://x.org/"], 5, True, None)], SOURCES)
    both = lambda pages, **k: [sorted(map(str, df.collect())) for df in crawl.crawl(sources, pages, "2026-08-09", **k)]
    whole = both(live(spark, []))
    trail, asked = str(tmp_path / "trail"), []
    for level in (1, 2):
        with pytest.raises(Broken):
            both(live(spark, asked, breaks_at=level), trail=trail)
        assert not crawl.ended(spark, trail)
    # out of time: what is there so far, and the rest in the next call
    limits = crawl.Limits(max_seconds=0)
    assert len(both(live(spark, asked), trail=trail, limits=limits)[0]) < len(whole[0])
    assert both(live(spark, asked), trail=trail) == whole and crawl.ended(spark, trail)
    assert both(live(spark, asked), trail=trail) == whole and sum(asked, []) == sorted(set(sum(asked, [])), key=sum(asked, []).index)
    with pytest.raises(ValueError, match="another job"):
        both(live(spark, []), trail=trail, limits=crawl.Limits(max_depth=9))


def test_an_update_goes_on_behind_its_last_stage(spark, tmp_path, monkeypatch):
    sources = spark.createDataFrame([("s", "X", ["x.org"], ["https://x.org/"], 5, True, None)], SOURCES)
    empty = spark.createDataFrame([], CATALOG).withColumn("pos", F.lit(0).cast("long"))
    work, asked, calls = str(tmp_path / "work"), [], []
    extract, verify = jobs.lifecycle.extract, jobs.verify

    def counted(*args):
        calls.append("extract")
        return extract(*args)

    def breaks(*args):
        raise Broken

    monkeypatch.setattr(jobs.lifecycle, "extract", counted)
    monkeypatch.setattr(jobs, "verify", breaks)
    with pytest.raises(Broken):
        jobs.update(sources, live(spark, asked), empty, "2026-08-09", work=work)
    monkeypatch.setattr(jobs, "verify", verify)
    done = jobs.update(sources, live(spark, asked), empty, "2026-08-09", work=work)
    assert calls == ["extract"] and sum(asked, []) == sorted(set(sum(asked, [])), key=sum(asked, []).index)
    assert sorted(r.title for r in done.catalog.collect()) == sorted(TITLES.values())
    with pytest.raises(ValueError, match="another job"):
        jobs.update(sources, live(spark, asked), empty, "2026-08-10", work=work)


def test_pages_of_a_crawl_are_not_broadcast(spark, tmp_path):
    """Computed bodies and states, which the planner takes for small, go to no task as a whole."""
    spark.range(4000).write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    url = F.concat(F.lit("https://x.org/course/"), "id")
    body = F.concat(F.lit('<a href="/course/'), F.col("id") + 1, F.lit('">n</a>'), F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(60)))
    pages = keys.select(url.alias("url"), F.lit(True).alias("ok"), body.alias("body"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("manual_review"))
    state = keys.where("id = 2 or id > 9").select(url.alias("url"), F.lit("activo").alias("status"), F.lit(True).alias("is_course"), F.repeat(F.lit("2000-06-01"), F.lit(300)).alias("first_seen"), F.lit("2000-12-31").alias("last_seen"))
    sources = spark.createDataFrame([("s", "x", ["x.org"], ["https://x.org/course/0"], 9, True, None)], SOURCES)
    most = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "6m")
    try:
        visits, found = crawl.crawl(sources, pages, "2001-01-01", state)
        assert sorted((r.url, r.depth, r.ok) for r in visits.collect()) == [("https://x.org/course/0", 0, True), ("https://x.org/course/1", 1, True)]
        assert sorted((r.url, r.from_memory) for r in found.collect()) == [(f"https://x.org/course/{k}", k == 2) for k in range(3)]
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)


def test_a_search_cuts_and_stems_the_texts_once(spark):
    """However many words it looks up, and of the words only those that can have such a stem."""
    r = random.Random(5)
    texts = {f"r{i}": " ".join(r.choices(WORDS, k=r.randint(0, 9))) for i in range(60)} | {"same": "the the data data the"}
    docs = records(spark, texts)
    for phrases in [*map(search.query_phrases, QUERIES), [["the", "data", "th"]], [["learn", "machin"], ["d"], ["d"]], [["the"], []]]:
        index = search.postings(docs, "id", ("title",), phrases=phrases)
        found = search.full_text(index, "id", phrases)
        want = by_hand(texts, phrases) if all(phrases) else set()
        assert {x.id for x in found.collect()} == want, phrases
        assert all(phrases) is False or found._jdf.queryExecution().optimizedPlan().toString().count("_stems(") == 1
    stems = {r.stem for r in search.postings(docs, "id", ("title",), phrases=[["data"], ["mach"]]).collect()}
    assert stems and all(x == "data" or x.startswith("mach") for x in stems)


def test_a_stem_begins_as_its_word():
    r = random.Random(6)
    ends = "ational iviti biliti ization fulness icate ical ement ion ed ing eed sses ies s y e ll".split()
    for _ in range(20_000):
        word = "".join(r.choices("aeiouybclstr", k=r.randint(1, 5))) + "".join(r.choices(ends, k=r.randint(0, 3)))
        for n in range(1, len(stem(word)) + 1):
            assert word.startswith(stem(word)[: kept_of(n)])


class Counted:
    """A state store's handle, of one address, that counts the calls of its states."""

    def __init__(self):
        self.calls = 0

    def _state(self, empty):
        def call(f):
            self.calls += 1
            return f()

        held = {"v": empty}
        put = lambda v: held.update(v=v)
        return type("State", (), {"get": lambda _: call(lambda: iter(held["v"]) if isinstance(held["v"], list) else held["v"]), "put": lambda _, v: call(lambda: put(v)), "update": lambda _, v: call(lambda: put(v)), "clear": lambda _: call(lambda: put(empty))})()

    def getValueState(self, *_):
        return self._state(None)

    def getListState(self, *_):
        return self._state([])

    def registerTimer(self, _):
        self.calls += 1

    deleteTimer = registerTimer


def test_visits_of_an_address_do_not_call_the_state_store_each():
    def calls(n):
        handle, memory = Counted(), keyed.Memory(5, 14)
        memory.init(handle)
        out = []
        for part in (range(0, n, 2), range(1, n, 2)):
            rows = [Row(seq=k, day=f"2024-01-{1 + k * 28 // n:02d}", ok=True, source="s", is_course=False, content_hash="h", reason=None) for k in part]
            out = list(memory.handleInputRows(("u",), iter(rows), None))
        assert out[-1].kind == "state" and out[-1].seq == n - 1
        return handle.calls

    assert calls(400) <= 16 and calls(40) <= 16


def test_titles_are_compared_where_no_key_decides(spark, monkeypatch):
    """Similar titles equal brute force; titles go to the comparison only where no key has decided."""
    names = [(f"supplier {i * 37:09d}", f"customer {i * 41:09d}") for i in range(60)] + [("abc", "abd"), ("x1", "x2"), ("aaaaaaaaaa", "aaaaaaaaab")]
    own = [a for a, _ in names]
    other = [b for _, b in names] + [a[:-1] + "7" for a in own]
    frame = lambda ts: spark.createDataFrame([("=", t) for t in ts], "block string, t string")
    got = {(x.a, x.b) for x in resolve.similar_titles(frame(own), frame(other)).collect()}
    assert got == {(a, b) for a in own for b in other if edits(a, b) <= int(max(len(a), len(b)) * 0.12 + 1e-9)} and len(got) > 60
    asked, whole = [], resolve.ambiguous_matches
    monkeypatch.setattr(resolve, "ambiguous_matches", lambda c, *rest: asked.append({x.pos for x in c.collect()}) or whole(c, *rest))
    kind = "pos long, title string, institution string, course_code string, platform string, url_official string"
    catalog = spark.createDataFrame([(1, "one", "I", "K1", None, None)], kind)
    candidates = spark.createDataFrame([(1, "one more", "I", "K1", None, None), (2, "two", "I", "K2", None, None), (3, "three", "I", "K2", None, None)], kind)
    assert {x.pos: x.match for x in resolve.classify(candidates, catalog).collect()} == {1: "exact", 2: "none", 3: "exact"}
    assert asked == [{2, 3}, set()]


@pytest.mark.parametrize("fields", [("text",), ("text", "title")])
def test_postings_are_dealt_without_the_name_of_an_only_field(spark, fields):
    """What is shuffled and sorted is key, place and stem; the postings are the same."""
    rows = spark.createDataFrame([(i, f, p, w) for i in range(20) for f in fields for p, w in enumerate(WORDS)], "id long, field string, pos int, stem string")
    dealt = postings._dealt(rows, "id", fields)
    assert dealt.columns == rows.columns and sorted(dealt.collect()) == sorted(rows.collect())
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    sort = next(x for x in plan.splitlines() if "Sort" in x)
    assert sort.count("ASC") == 1 and ("text AS field" in plan.partition("Sort")[0]) == (len(fields) == 1)
