"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Every element is a node with a hidden label, content or not. Its tag, its names (class, id, role) and its
text give a node potential; a parent-child potential, by kind of the child, couples labels along the tree.
Sum-product messages, upward and then downward, give each node's marginal; text whose node's marginal is
above one half is content. The weights are fitted by maximum likelihood (the same messages give the
expected counts) to labelled pages, in which data-main="1" or "0" marks an element and all below it.

Blocks are parted by block elements and <br>; white space inside one becomes one space; blocks are joined
by a space in page order. Null and empty pages, and pages without content, have an empty text; broken
markup is read as browsers do, near enough: unclosed paragraphs end at the next block, stray end tags
are ignored, a tag or comment that never ends is text or nothing. Pages are read whole; the time grows with
their length, whatever their markup: elements below DEEPEST levels hang there, and names that the model does
not know are no features. Equal marginals (one half) are no content. Repeated rows are read each; an empty
table gives an empty result. Only page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import html_samples

#: Pages whose messages are passed together.
BATCH = 256

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes svg datalist".split())
RAW = frozenset("script style iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADS | frozenset("p li dt dd td th tr tbody thead tfoot caption blockquote pre ul ol dl table figure figcaption".split())
ENDS_P = FLOW - frozenset("li dt dd td th tr tbody thead tfoot caption figcaption".split()) | frozenset(
    "address article aside details div fieldset footer form header hgroup hr main menu nav section".split()
)
#: What a start tag closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
CELLS = frozenset(["td", "th", "table"])
BREAKS_CELLS = frozenset("table tr tbody thead tfoot body html".split())
SCOPE = frozenset(["table", "td", "th", "caption", "button", "object", "template", "html"])

#: What may follow "<" in a tag: its name, then attributes, in which a quoted value may hold ">".
TAG = re.compile(r"(/?+)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
LOOSE_TAG = re.compile(r"(/?+)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAME_START = re.compile(r"/?[a-zA-Z]")
COMMENT_END = re.compile(r"--!?>")
#: Browsers nest no deeper than about this either.
DEEPEST = 256
NAMES = re.compile(r"(?:^|[\s\"'])(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
MARK = re.compile(r"data-main=\"([01])\"")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a claim of rights says.
RIGHTS = re.compile(r"©|&copy;|&#169;|&#xa9;|\bcopyright\b|\(c\)|\brights reserved\b|\brechte vorbehalten\b|\bderechos reservados\b|\bdroits réservés\b", re.I)
EDGE_KINDS = 7
BOUNDS = frozenset("nav header footer aside form menu search dialog".split())


@dataclass
class Page:
    """Nodes in document order; node 0 is the root."""

    tags: list[str] = field(default_factory=lambda: ["#"])
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    depths: list[int] = field(default_factory=lambda: [0])
    labels: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str]] = field(default_factory=list)  # (-1, "") between blocks


def tokens(source: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(slash, name, attributes, start, end) of each tag; name is "" for comments and declarations. Every place is
    looked at a few times at most: what ends nowhere is only searched for once."""
    at, last, tag = source.find("<"), source.rfind(">"), TAG
    while 0 <= at < last:
        m = tag.match(source, at + 1)
        if m is None and tag is TAG and NAME_START.match(source, at + 1):
            tag = LOOSE_TAG  # quotes that hide every ">" from here on are no quotes
            continue
        if m:
            end = m.end()
            yield m[1], m[2].lower(), m[3], at, end
        elif source.startswith("!--", at + 1):
            closed = COMMENT_END.search(source, at + 2)  # <!--> is a comment too
            end = closed.end() if closed else len(source)
            yield "", "", "", at, end
        elif source[at + 1] in "!?" or source.startswith("/", at + 1):
            end = source.index(">", at) + 1
            yield "", "", "", at, end
        else:
            end = at + 1
        raw = m and not m[1] and m[2].lower()
        if raw in RAW or raw in ("textarea", "title"):
            closed = re.compile(f"</{raw}(?=[\\s/>])", re.I).search(source, end)
            end = closed.start() if closed else len(source)
        at = source.find("<", end)


def parse(source: str) -> Page:
    page, stack, unseen, at = Page(), [0], 0, 0
    tags, runs = page.tags, page.runs
    opened, beyond = Counter(), Counter()  # open elements by tag; those that hang too deep to be on the stack

    def pop_to(k: int) -> None:
        nonlocal unseen
        for node in stack[k:]:
            unseen -= tags[node] in UNSEEN
            opened[tags[node]] -= 1
            if tags[node] not in INLINE:
                runs.append((-1, ""))
        del stack[k:]

    def close(names: frozenset[str], limits: frozenset[str]) -> None:
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if tags[stack[k]] in names:
                return pop_to(k)
            if tags[stack[k]] in limits:
                return

    for slash, tag, attributes, start, end in tokens(source):
        if start > at and not unseen:
            runs.append((stack[-1], source[at:start]))
        at = end
        if not tag:
            continue
        if slash:
            if beyond[tag]:
                beyond[tag] -= 1
            elif opened[tag]:
                close(frozenset([tag]), frozenset() if tag in BREAKS_CELLS else CELLS)
            continue
        if tag in ENDS_P:
            close(frozenset(["p"]), SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag not in INLINE:
            runs.append((-1, ""))
        if tag in VOID:
            continue
        node, parent = len(tags), stack[-1]
        tags.append(tag)
        page.names.append(" ".join(a or b or c for a, b, c in NAMES.findall(attributes)) if "=" in attributes else "")
        page.parents.append(parent)
        page.depths.append(page.depths[parent] + 1)
        mark = MARK.search(attributes)
        page.labels.append(int(mark[1]) if mark else page.labels[parent])
        if len(stack) > DEEPEST and (unseen or tag not in UNSEEN):
            beyond[tag] += 1
        else:
            stack.append(node)
            opened[tag] += 1
            unseen += tag in UNSEEN
    if len(source) > at and not unseen:
        runs.append((stack[-1], source[at:]))
    return page


def _bin(x: int, most: int = 12) -> int:
    return min(x.bit_length(), most)


def features(page: Page, known: Container[str] | None = None) -> list[list[str]]:
    """The names of each node's features; of what nodes and those above are called, only known ones (all if None)."""
    n = len(page.tags)
    text, linked, ends, own, rights = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    in_link, heads = [False] * n, [0] * n
    for i in range(1, n):
        in_link[i] = page.tags[i] == "a" or in_link[page.parents[i]]
        heads[i] = page.tags[i] == "h1" and not in_link[page.parents[i]]
    first_head = heads.index(True) if any(heads) else n
    for node, s in page.runs:
        if node >= 0:
            size = len(s) - s.count(" ") - s.count("\n") if len(s) < 200 else len(s)
            text[node] += size
            own[node] += size
            linked[node] += size if in_link[node] else 0
            ends[node] += s.count(". ") + s.count(", ") + (s.rstrip()[-1:] in (".", "!", "?", "…"))
            rights[node] |= bool(RIGHTS.search(s))
    claims = list(rights)
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        text[p] += text[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
        rights[p] |= rights[i]
        heads[p] += heads[i]
    out: list[list[str]] = []
    above: list[list[str]] = []  # what the nodes above are called, and the node itself
    for i in range(n):
        tag, over = page.tags[i], above[page.parents[i]] if i else []
        density = 4 * linked[i] // text[i] if text[i] else -1
        share = 8 * text[i] // text[0] if text[0] else 0
        side = "none" if first_head == n else "with" if heads[i] else "before" if i < first_head else "after"
        size = _bin(text[i])
        f = ["1", f"t {tag}", f"n {size}", f"l {density}", f"e {_bin(ends[i], 6)}", f"o {_bin(own[i])}", f"tl {tag} {density}", f"tn {tag} {size // 3}", f"s {share}", f"h {side}", f"hl {side} {density}", f"hs {side} {share}"]
        if rights[i]:
            f += [f"r {size // 2}", "claim"][: 1 + claims[i]]
        names = [x for x in map(str.lower, PARTS.findall(page.names[i])) if known is None or f"c {x}" in known or f"ac {x}" in known] if page.names[i] else []
        f += [f"c {x}" for x in dict.fromkeys(names)]
        f += over
        new = [x for x in (f"a {tag}", *[f"ac {x}" for x in names]) if x not in over and (known is None or x in known)] if tag not in INLINE else []
        above.append(over + list(dict.fromkeys(new)) if new else over)
        if page.names[i]:
            f.append("named")
        f.append(f"p {tag} {page.tags[page.parents[i]]}")
        out.append(f)
    return out


def edge_kind(tag: str) -> int:
    if tag in INLINE:
        return 0
    if tag in FLOW:
        return 1 if tag == "p" else 2 if tag in HEADS else 3
    return 4 if tag in ("div", "section", "#") else 5 if tag in BOUNDS else 6


@dataclass
class Forest:
    """Nodes of some pages, sorted by depth: parents, kinds of edges, and slices of equal depth."""

    parents: np.ndarray
    kinds: np.ndarray
    levels: list[slice]
    back: np.ndarray  # place of each node in page order
    over: list[tuple[np.ndarray, np.ndarray]]  # of each level: where a parent's children start, and the parents


def forest(pages: list[Page]) -> Forest:
    starts = np.cumsum([0] + [len(p.tags) for p in pages])
    parents = np.concatenate([np.asarray(p.parents) + s for p, s in zip(pages, starts)])
    depths = np.concatenate([np.asarray(p.depths) for p in pages])
    kinds = np.concatenate([np.fromiter(map(edge_kind, p.tags), dtype=np.int64) for p in pages])
    order = np.argsort(depths, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    cuts = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    levels, parents = [slice(a, b) for a, b in zip(cuts, cuts[1:])], back[parents[order]]
    # children of one parent stand together, as both levels are in page order
    starts = [np.flatnonzero(np.diff(parents[x], prepend=-1)) for x in levels]
    return Forest(parents, kinds[order], levels, back, [(s, parents[x][s]) for s, x in zip(starts, levels)])


def sum_product(f: Forest, scores: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of content; of each edge's (parent, child) labels; and the log partition of each root."""
    up = np.zeros((len(scores), 2))
    up[:, 1] = scores
    sent = np.zeros((len(scores), 2))
    pair = edges[f.kinds]  # node, parent's label, own label
    for level, (starts, parents) in reversed(list(zip(f.levels, f.over))[1:]):
        sent[level] = np.logaddexp(*np.moveaxis(up[level][:, None, :] + pair[level], 2, 0))
        up[parents] += np.add.reduceat(sent[level], starts)
    down = np.zeros((len(scores), 2))
    both = np.zeros((len(scores), 2, 2))
    for level in f.levels[1:]:
        over = f.parents[level]
        rest = (down[over] + up[over] - sent[level])[:, :, None] + pair[level]
        down[level] = np.logaddexp(rest[:, 0], rest[:, 1])
        both[level] = rest + up[level][:, None, :]
    belief = down + up
    p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
    both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
    both /= both.sum(axis=(1, 2), keepdims=True)
    roots = up[f.levels[0]]
    return p, both, np.logaddexp(roots[:, 0], roots[:, 1])


@dataclass
class Model:
    weights: dict[str, float]
    edges: np.ndarray

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Which nodes of each page are content."""
        get = self.weights.get
        f = forest(pages)
        scores = np.fromiter((sum(get(x, 0.0) for x in node) for p in pages for node in features(p, self.weights)), dtype=float)
        by_depth = np.empty_like(scores)
        by_depth[f.back] = scores
        p = sum_product(f, by_depth, self.edges)[0][f.back]
        return np.split(p > 0.5, np.cumsum([len(x.tags) for x in pages])[:-1])


def fit(labelled: list[str], steps: int = 300, rate: float = 0.1, l2: float = 0.002) -> Model:
    """Maximum likelihood on pages with data-main marks, by Adam's steps on the exact gradient."""
    pages = [parse(x) for x in labelled]
    f = forest(pages)
    rows = [x for p in pages for x in features(p)]
    seen: dict[str, int] = {}
    for x in rows:
        for name in x:
            seen[name] = seen.get(name, 0) + 1
    index = {name: i for i, name in enumerate(sorted(k for k, c in seen.items() if c >= 3))}
    node = np.concatenate([np.full(len(x), at) for at, x in zip(f.back, rows)])
    column = np.array([index.get(name, -1) for x in rows for name in x])
    node, column = node[column >= 0], column[column >= 0]
    y = np.empty(len(rows), dtype=np.int64)
    y[f.back] = [v for p in pages for v in p.labels]
    child = np.arange(f.levels[0].stop, len(y))
    there = np.zeros((EDGE_KINDS, 2, 2))
    np.add.at(there, (f.kinds[child], y[f.parents[child]], y[child]), 1)
    size = len(index)
    w, m, v = np.zeros(size + 4 * EDGE_KINDS), 0.0, 0.0
    for step in range(1, steps + 1):
        edges = w[size:].reshape(EDGE_KINDS, 2, 2)
        scores = np.bincount(node, w[column], len(y))
        p, both, _ = sum_product(f, scores, edges)
        expected = np.zeros_like(there)
        np.add.at(expected, f.kinds[child], both[child])
        g = np.concatenate([np.bincount(column, (y - p)[node], size), (there - expected).ravel()]) - l2 * len(pages) * w
        g /= len(pages)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = {name: float(w[i]) for name, i in index.items()}
    return Model(weights, w[size:].reshape(EDGE_KINDS, 2, 2))


@cache
def built_in() -> Model:
    """The model of html_samples' pages, fitted once a process."""
    return fit(html_samples.labelled_pages())


def main_text(page: Page, content: np.ndarray) -> str:
    blocks, parts = [], []
    for node, s in [*page.runs, (-1, "")]:
        if node >= 0:
            if content[node]:
                parts.append(html.unescape(s) if "&" in s else s)
        elif parts:
            blocks += "".join(parts).split()
            parts = []
    return " ".join(blocks)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html); model: the built-in one if None."""
    model = model or built_in()

    @F.arrow_udf("string")
    def text_of(sources: pa.Array) -> pa.Array:
        out: list[str] = []
        for at in range(0, len(sources), BATCH):
            parsed = [parse(x.as_py() or "") for x in sources[at : at + BATCH]]
            out += [main_text(p, c) for p, c in zip(parsed, model.content(parsed), strict=True)]
        return pa.array(out, pa.string())

    return pages.select("page_id", "url", text_of("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
