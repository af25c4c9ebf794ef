import pytest
from pyspark.sql import functions as F

from millrace.functions import classify, dates, html, robots, text, urls
from millrace.functions.stemming import stem

AS_OF = "2026-08-09"


def test_clean_and_slug(values):
    assert values(text.clean, ["  a\t b \n c ", "", "   ", None, "x"]) == ["a b c", None, None, None, "x"]
    assert values(text.slug, ["Introducción a la IA: ¡Ñandú!", "--", None, "A" * 79 + " b"]) == ["introduccion-a-la-ia-nandu", None, None, "a" * 79]
    assert values(text.norm_title, ["Introducción  a la Programación", "C++ & C#", "¿?", None]) == ["introduccion a la programacion", "c c", None, None]


def test_ids(values):
    cases = {
        ("Massachusetts Institute of Technology", "6.0001", "Python"): "mit-6-0001",
        ("Universidad de Chile", None, "Ética pública"): "universidad-de-chile-etica-publica",
        (None, None, "Solo título"): "solo-titulo",
        ("MIT", None, None): None,
        ("??", "A1", None): "a1",
    }
    assert values(text.make_id, list(cases), "string, string, string") == list(cases.values())


def test_similarity(values):
    got = values(text.similarity, [("Machine Learning", "machine  learning!"), ("abcd", "abce"), (None, "a"), ("kitten", "sitting")], "string, string")
    assert got == [1.0, 0.75, 0.0, pytest.approx(1 - 3 / 7)]


def test_entities(values):
    got = values(text.decode_entities, ["a &lt;b&gt; &quot;c&quot;", "&#233;&#xE9;&#x1F600;", "&amp;lt;", "&nbsp;x&bogus;", "&#1114112;", "plain", None, "&#Xe9;"])
    assert got == ['a <b> "c"', "éé😀", "&lt;", " x&bogus;", "&#1114112;", "plain", None, "é"]


CANONICAL = {
    "http://www.Example.org/a/?b=2&utm_source=x&a=1#frag": "https://example.org/a?a=1&b=2",
    "https://example.org": "https://example.org/",
    "https://example.org/": "https://example.org/",
    "https://example.org:8443/x//": "https://example.org/x/",
    "https://user:pw@example.org/x": "https://user:pw@example.org/x",
    "https://example.org/?REF=1&source=2": "https://example.org/",
    "https://example.org/a/../b/./c": "https://example.org/b/c",
    "https://example.org/?q=a+b%20c&flag": "https://example.org/?flag=&q=a+b+c",
    "ftp://example.org/": None,
    "javascript:alert(1)": None,
    "no url": None,
    "": None,
    None: None,
}


def test_canonical(values):
    assert values(urls.canonical, list(CANONICAL)) == list(CANONICAL.values())
    some = [v for v in CANONICAL.values() if v and not v.endswith("x/")]  # of two final slashes one goes at a time
    assert values(urls.canonical, some) == some


def test_hosts(values):
    cases = {"https://www.mit.edu/x": True, "https://ocw.mit.edu": True, "https://mit.edu.evil.com": False, "https://notmit.edu": False, "x": False}
    allowed = F.array(F.lit("MIT.edu"))
    assert values(lambda c: urls.is_allowed_host(c, allowed), list(cases)) == list(cases.values())
    assert values(lambda c: urls.is_allowed_host(c, F.lit(None).cast("array<string>")), ["https://mit.edu"]) == [False]


def test_page_kinds(values):
    index = {("https://x.org/cursos/", "A"): True, ("https://x.org/a", "Search results"): True, ("https://x.org/a", "Catálogo"): True, ("https://x.org/course/ml", "Machine Learning"): False, ("https://x.org/searching", None): False}
    assert values(urls.is_index_page, list(index), "string, string") == list(index.values())
    material = {"notes.pdf": True, "Week 8 Tool": True, "Slides 1-46": True, "Theory, Part III of IV": True, "Lecture notes": True, "Weekly planning": False, None: False, "Partial equations": False}
    assert values(urls.is_course_material, list(material)) == list(material.values())
    like = {"https://x.org/course/ml": True, "https://x.org/cursos": False, "https://x.org/course-v1:a": True, "https://x.org/learning/a": False}
    assert values(urls.is_course_like, list(like)) == list(like.values())
    relevant = {"https://x.org/a.PDF": False, "https://x.org/login": False, "https://x.org/search?q": False, "https://x.org/a": True}
    assert values(urls.is_relevant, list(relevant)) == list(relevant.values())
    assert values(urls.may_open, [" https://a ", "HTTPS://a", "http://a", None, "https://" + "a" * 2000]) == [True, True, False, False, False]


PRICES = {
    "Price: $4,200": (4200.0, "pagado"),
    "cost US$ 20.50 each": (20.5, "pagado"),
    "Tuition: $1,000. Price $5": (5.0, "pagado"),
    "Price: Free. Certificate $99": (0.0, "gratis"),
    "audit for free, price $50": (50.0, None),
    "acceso gratuito": (None, "gratis"),
    "freedom, prices": (None, None),
    "gratisé": (None, "gratis"),
    "free* online": (None, "gratis"),
    "": (None, None),
    None: (None, None),
}


def test_access(values):
    assert list(zip(values(classify.access_price, list(PRICES)), values(classify.access, list(PRICES)))) == list(PRICES.values())
    assert values(classify.is_paid, ["price $5", "x", None]) == [True, False, False]


def test_price_usd(values):
    cases = {"$1,299.50": 1299.5, "USD 10": 10.0, "us$7": 7.0, "Free": 0.0, "sin costo": 0.0, "€20": None, "20 EUR $5": None, "12": None, "$1.2.3": 1.2, "$.": None, None: None}
    assert values(classify.price_usd, list(cases)) == list(cases.values())


def test_price_or_null(values):
    assert values(classify.price_or_null, [0.0, 3.5, -1.0, float("inf"), float("nan"), None], "double") == [0.0, 3.5, None, None, None, None]


def test_credentials(values):
    cases = {
        ("Free certificate of completion", None): "certificado gratuito",
        ("certificate", 0.0): "certificado gratuito",
        ("certificate", 49.0): "certificado pagado",
        ("Verified certificate", 49.0): "certificado pagado verificable",
        ("digital badge", 0.0): "badge gratuito",
        ("badge", 5.0): None,
        ("Statement of Accomplishment", None): "declaracion de logro",
        ("declaración de logro", 3.0): "declaracion de logro",
        ("certificate", None): None,
        (None, 0.0): None,
    }
    assert values(classify.credential, list(cases), "string, double") == list(cases.values())


def test_levels(values):
    cases = {"An intermediate, then advanced course": "intermedio", "nivel básico": "introductorio", "GRADUATE": "avanzado", "undergraduate": None, None: None}
    assert values(classify.level, list(cases)) == list(cases.values())


def test_dates(values):
    assert values(dates.is_iso_date, ["2026-08-09", "2026-02-31", "2026-8-9", "x"]) == [True, False, False, False]
    assert values(lambda c: dates.days_since(c, AS_OF), ["2026-05-11", "2026-05-10", "bad", None]) == [90, 91, None, None]
    assert values(lambda c: dates.is_stale(c, AS_OF), ["2026-05-11", "2026-05-10", "bad", None]) == [False, True, True, True]
    got = values(lambda s, d: dates.derived_status(s, d, AS_OF), [("VERIFICADO", AS_OF), ("VERIFICADO", None), ("PENDIENTE", None), (None, None)], "string, string")
    assert got == ["VERIFICADO", "REVERIFICAR", "PENDIENTE", "PENDIENTE"]
    assert values(lambda c: dates.needs_reverify(c, AS_OF + " 12:00:00"), ["2026-05-11", "2026-05-12", "bad", None]) == [True, False, False, True]


PAGE = """<html><head><title>Machine Learning | Online | MIT</title><META content='Desc &amp; more' name="description">
<meta property="og:title" content=" Graph "><script type="application/ld+json">{bad</script>
<script type='application/ld+json'>[{"@graph": [{"@type": "Thing"}, {"@type": ["Course"], "name": "ML &lt;1&gt;", "provider": {"name": " MIT "}, "courseCode": "6.86", "inLanguage": "EN"}]}]</script>
</head><body><p>A free intermediate course with certificate.</p><style>p {}</style><a href="/a?b=1">x</a><a href='https://other.org/p#f'>y</a>
<a href="mailto:x@y">m</a><a href="/a?b=1">again</a><a href="b c">s</a></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(PAGE, "https://x.org/dir/page")], "html string, url string")
    h, u = F.col("html"), F.col("url")
    row = df.select(html.title(h).alias("title"), html.meta(h, "description").alias("d"), html.meta(h, "og:title").alias("g"), html.links(h, u).alias("links"), html.page_text(h).alias("text")).first()
    assert row.title == "Machine Learning" and row.d == "Desc & more" and row.g == "Graph"
    assert row.links == ["https://x.org/a?b=1", "https://x.org/dir/b%20c"]
    assert row.text == "Machine Learning | Online | MIT A free intermediate course with certificate. x y m again s"
    parts = df.select("html", "url", *html.course_parts(h))
    r = parts.select(*html.course_record(*[F.col(c) for c in ("html", "url", "blocks", "entity", "text")])).first()
    assert (r.title, r.institution, r.course_code, r.language, r.level) == ("ML <1>", "MIT", "6.86", ["en"], "intermedio")
    assert r.evidence.has_course_entity and r.evidence.mentions_free and not r.evidence.mentions_badge


def test_titles(values):
    cases = {"<title>A · Longest part – b</title>": "Longest part", "<title>one - two</title>": "one - two", "<TITLE lang=x> a\n b </TITLE>": "a b", "<title></title>": None, "none": None, None: None}
    assert values(html.title, list(cases)) == list(cases.values())


def test_parts_of_titles_keep_the_digits_of_their_place(values):
    cases = {"<title>ab | 1st part of 11</title>": "1st part of 11", "<title>007 and 00 | b</title>": "007 and 00", "<title>ab – 1 – 2222</title>": "2222", "<title>abc | 1;x</title>": "abc"}
    assert values(html.title, list(cases)) == list(cases.values())


ROBOTS = """
User-agent: other
Disallow: /

User-agent: catalogbot
User-agent: *  # shared
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Crawl-delay: 2
"""


def test_robots(spark, values):
    group = robots.group_for(ROBOTS, "CatalogBot/0.1")
    assert group["delay_ms"] == 2000 and len(group["rules"]) == 3
    assert robots.group_for("", "x") == {"rules": [], "delay_ms": None}
    assert robots.group_for("User-agent: *\nDisallow:", "x")["rules"] == [{"allow": False, "path": ""}]
    rules = F.array(*[F.struct(F.lit(r["allow"]).alias("allow"), F.lit(r["path"]).alias("path")) for r in group["rules"]])
    cases = {"/private/x": False, "/private/open/x": True, "/a.pdf": False, "/a.pdfx": True, "/": True}
    assert values(lambda p: robots.allows(rules, p), list(cases)) == list(cases.values())
    tie = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit("/a").alias("path")) for a in (False, True)])
    assert values(lambda p: robots.allows(tie, p), ["/a"]) == [True]
    answers = spark.createDataFrame([(200, "User-agent: *\nDisallow: /x"), (404, None), (503, None), (None, None)], "status int, text string")
    policies = answers.select(robots.policy_of_answer(F.col("status"), F.col("text"), "bot").alias("p"))
    got = policies.select(robots.allows(F.col("p.rules"), F.lit("/x")), robots.allows(F.col("p.rules"), F.lit("/y")))
    assert [tuple(r) for r in got.collect()] == [(False, True), (True, True), (False, False), (False, False)]


@pytest.mark.parametrize(
    ("word", "stemmed"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("learning", "learn"), ("machines", "machin"), ("is", "is"), ("año", "año")],
)
def test_stem(word, stemmed):
    assert stem(word) == stemmed
