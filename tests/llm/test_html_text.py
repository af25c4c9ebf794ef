import sys
import time
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import html_samples, html_text

sys.path.insert(0, str(Path(__file__).parent))

from hand_pages import PAGES, UNSEEN  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return html_text.built_in()


def text_of(model, source):
    page = html_text.parse(source)
    return html_text.main_text(page, model.content([page])[0])


def test_sum_product_against_enumeration():
    page = html_text.parse("<body><div><p>a<b>c</b></p><p>d</p></div><ul><li>e</ul></body>")
    f, n = html_text.forest([page]), len(page.tags)
    r = np.random.default_rng(0)
    scores, edges = r.normal(size=n), r.normal(size=(html_text.EDGE_KINDS, 2, 2))
    weights, joint = np.zeros(n), 0.0
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        e = sum(scores[i] * y[i] for i in range(n)) + sum(edges[f.kinds[i], y[f.parents[i]], y[i]] for i in range(1, n))
        weights += np.exp(e) * np.array(y)
        joint += np.exp(e)
    p, both, log_z = html_text.sum_product(f, scores, edges)
    assert np.allclose(p, weights / joint) and np.allclose(log_z, np.log(joint))
    assert np.allclose(both[1:].sum(axis=1)[:, 1], p[1:])


def test_held_out_accuracy(model):
    right = wrong = 0
    pages = [html_text.parse(x) for x in html_samples.labelled_pages(150, seed=77)]
    for page, found in zip(pages, model.content(pages), strict=True):
        for node, s in page.runs:
            if node >= 0:
                hit = bool(found[node]) == bool(page.labels[node])
                right, wrong = right + hit * len(s.split()), wrong + (not hit) * len(s.split())
    assert wrong < 0.01 * (right + wrong)


BODY = "<h1>The Title</h1><p>First &amp; foremost,\n  a <b>para</b>graph.<p>Second one<br>with a break, and more of it."
TEXT = "The Title First & foremost, a paragraph. Second one with a break, and more of it."
AROUND = [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>{}<footer>&copy; us</footer>",
    "<header><a href=/>Logo</a><p>Our motto here</p></header><main>{}</main><aside><h3>Related</h3><p>Some other story that you may like.</p></aside>",
    "<div class='cookie-notice'><p>We use cookies. Please agree.</p><button>OK</button></div>{}<div class='sidebar'><p>Popular posts of this week.</p></div>",
    "<div id='menu'><a href=/1>One</a> | <a href=/2>Two</a></div>{}<section id='comments'><h2>Comments</h2><div class='comment'><p>I liked this, thanks a lot.</p></div><div class='comment'><p>So did I. Great read!</p></div></section>",
    "{}<form action=/s><label>Search</label><input name=q><button>Go</button></form><div class=ad>Buy one, get one. Only today.</div><script>var a = '<p>no</p>';</script><style>p {{}}</style>",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("inside", ["<article>{}</article>", "<div class='post-content'>{}</div>"])
def test_layouts(model, around, inside):
    page = "<!DOCTYPE html><html><head><title>no</title></head><body>" + around.format(inside.format(BODY)) + "</body></html>"
    assert text_of(model, page) == TEXT


@pytest.mark.parametrize("name", [*PAGES, *UNSEEN])
def test_hand_written_pages(model, name):
    source, wanted = (PAGES | UNSEEN)[name]
    assert text_of(model, source) == wanted


HOSTILE = {
    "unclosed tags": "<a" * 500_000,
    "unclosed declarations": "<!-" * 330_000,
    "quotes that hide the end": "<a " * 300_000 + 'x=">"',
    "one tag after another unclosed": "<a x='\"" * 150_000,
    "long name": "<a" * 500_000 + ">",
    "comments": "<!--" * 250_000 + ">",
    "raw text": "<title><" * 120_000,
    "deep": "<div>" * 100_000 + "x" + "</p>" * 100_000,
    "deep in a cell": "<p><table><tr><td>" + "<i>" * 100_000 + "<div></div>" * 60_000,
    "unseen": "<svg>" * 100_000 + "x" + "</svg>" * 100_000,
    "many names": "<div class='menu " + "x y z " * 150_000 + "'>" + "<div>" * 20_000,
    "tables": "<table><td>" * 60_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_markup_takes_time_in_proportion(model, name):
    """A megabyte or so: seconds at most, where time by the square of the length would take hours."""
    began = time.process_time()
    text_of(model, HOSTILE[name])
    assert time.process_time() - began < 10


def test_long_page(model):
    body = "".join(f"<p>Sentence number {i} of a very long story, told once.</p>" for i in range(20_000))
    got = text_of(model, f"<body><nav><a href=/>Home</a></nav><article><h1>Long</h1>{body}</article><footer>&copy; us</footer></body>")
    assert got == "Long " + " ".join(f"Sentence number {i} of a very long story, told once." for i in range(20_000))


def test_parts_inside_the_article_are_left_out(model):
    page = f"<body><article>{BODY}<div class='ad'>Sponsored: buy this now.</div><p>The last words of it.</p><!-- <p>hidden</p> --></article></body>"
    assert text_of(model, page) == TEXT + " The last words of it."


def test_odd_markup(model):
    for source in ("", "<", "<<<>>>", "<p", "<!--", "<!-- x", "<script>", "</p></div>", "<a href=\"x>y", "&#x110000;&#0;&bogus;", "<table><td><table><td></table>x", "\x00<p>\x00"):
        text_of(model, source)
    assert html_text.parse("<p>a<p>b").parents == [0, 0, 0]
    deep = "<div>" * 3000 + "x"
    text_of(model, deep)


def test_operator(spark, model, edge_docs):
    pages = spark.createDataFrame(
        [(1, "u", f"<body><nav><a href=/>Home</a></nav><article>{BODY}</article></body>", "x", 7), (1, "u", None, "x", 7), (None, None, "", None, None)],
        "page_id long, url string, html string, text string, n_chars int",
    )
    rows = sorted(html_text.extract(pages, model).collect(), key=str)
    assert sorted((r.text, r.n_chars) for r in rows) == [("", 0), ("", 0), (TEXT, len(TEXT))]
    assert html_text.extract(pages.limit(0), model).count() == 0
