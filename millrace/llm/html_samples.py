"""Labelled pages for the HTML model: made up from layouts, with data-main marks.

The words are random letters, so that the model learns from structure, names and shape of the text, not from
vocabulary. Layouts: elements that say what they are, named containers, containers without names, blocks that
stand in the body itself, and tables. Where nothing but prose would tell a part from the article, no such part
is made."""

from __future__ import annotations

import random
import re

# Usual class and id names of page parts.
MAIN_NAMES = """content main-content post post-content entry entry-content article article-body article-content story
story-body text body-text page-content hentry blog-post post-body single-post main primary content-area rich-text""".split()
PART_NAMES = {
    "menu": "menu nav navbar navigation main-menu top-nav nav-links site-nav mega-menu menu-list breadcrumb breadcrumbs toc pagination pager".split(),
    "header": "header site-header masthead top topbar page-header branding logo banner-top".split(),
    "footer": "footer site-footer bottom page-footer colophon copyright legal foot".split(),
    "sidebar": "sidebar side aside widget widget-area secondary right-column left-col rail related related-posts recommended popular trending".split(),
    "notice": "notice cookie cookie-banner cookie-notice consent gdpr alert popup modal overlay announcement message-bar disclaimer subscribe-box paywall".split(),
    "ad": "ad ads advert advertisement adsense ad-slot ad-container sponsored sponsor promo promotion banner adbox advertorial".split(),
    "form": "form search search-form newsletter signup login contact-form subscribe".split(),
    "comments": "comments comment comment-list comments-area discussion responses replies disqus reader-comments user-comments".split(),
    "share": "share social sharing share-buttons social-links follow tags tag-list".split(),
}
BYLINES = "byline author date dateline published post-meta entry-date".split()
TAGS = {"menu": ["nav"], "header": ["header"], "footer": ["footer"], "sidebar": ["aside"], "notice": ["section", "div"], "ad": ["aside", "ins", "div", "section"], "form": ["form"], "comments": ["section", "div"], "share": ["div", "ul", "section"]}
#: What claims of rights say.
RIGHTS = ["&copy;", "©", "Copyright", "(c)", "Copyright ©", "All rights reserved.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Tous droits réservés."]
STYLES = ["semantic"] * 7 + ["named"] * 5 + ["plain"] * 4 + ["bare"] * 3 + ["table"] * 3
MARK = ' data-main="1"'


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = self.r.choice(["etaoinshrdlu", "enisratdhul", "aeosrnidlc", "esaitnrulo", "оеаинтсрвл", "αοιετσνηρ", "的一是不了人在有我他"])

    def word(self) -> str:
        return "".join(self.r.choice(self.letters) for _ in range(self.r.choice([1, 2, 3, 4, 5, 6, 8, 11])))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        r = self.r
        return " ".join(self.words(3, 16).capitalize() + (", " + self.words(2, 9) if r.random() < 0.5 else "") + r.choice("....!?") for _ in range(r.randint(a, b)))

    def rich(self, text: str) -> str:
        r, out = self.r, []
        for w in text.split(" "):
            x = r.random()
            out.append(f"<a href='/x'>{w}</a>" if x < 0.03 else f"<{t}>{w}</{t}>" if x < 0.06 and (t := r.choice(["b", "i", "em", "strong", "span", "code"])) else w)
        return " ".join(out)

    def links(self, a: int, b: int) -> str:
        r = self.r
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(r.randint(a, b))]
        if r.random() < 0.5:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([" | ", " ", " &middot; ", "<br>", " - "]).join(items)

    def rights(self) -> str:
        r = self.r
        who = r.choice([self.words(1, 4), f"{r.randint(1996, 2030)} {self.words(1, 4)}", f"{r.randint(1996, 2009)}-{r.randint(2010, 2030)} {self.words(1, 3)}"])
        claim, reserved = r.choice(RIGHTS[:5]), r.choice(RIGHTS[5:])
        return r.choice([f"{claim} {who}", f"{claim} {who}. {reserved}", f"{who}. {reserved}", f"{claim} {who} &middot; {self.sentences(1, 2)}"])

    def wrap(self, kind: str, inner: str, marked: str, style: str) -> str:
        r = self.r
        tag = r.choice(TAGS[kind]) if r.random() < (0.75 if style == "semantic" else 0.4) else "div"
        if kind == "form":
            tag = "form"
        name = ""
        if tag in ("div", "section", "ul", "ins") or r.random() < 0.4:
            name = f' {r.choice(["class", "class", "id"])}="{r.choice(PART_NAMES[kind])}{r.choice(["", "", f" c{r.randint(1, 9)}", "-1"])}"'
        return f"<{tag}{name}{marked}>{inner}</{tag}>"

    def part(self, kind: str, style: str = "semantic", marked: str = "") -> str:
        r = self.r
        if style in ("plain", "bare", "table") and kind in ("menu", "header", "footer", "share") and r.random() < 0.7:
            return self.unnamed(kind, marked)
        if kind == "menu":
            inner = self.links(3, 10)
        elif kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<a href='/'>{self.words(1, 2)}</a>", f"<div>{self.words(1, 4)}</div>"]) + (self.links(2, 6) if r.random() < 0.5 else f"<p>{self.words(2, 7)}</p>" if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice([self.rights(), f"<p>{self.rights()}</p>", self.links(2, 8) + f"<p>{self.sentences(1, 3)}</p>", f"<p>{self.sentences(1, 4)}</p>"])
        elif kind == "sidebar":
            inner = r.choice([f"<h3>{self.words(1, 4)}</h3>", ""]) + r.choice([self.links(3, 8), f"<p>{self.sentences(1, 4)}</p>", f"<div><p>{self.sentences(1, 3)}</p>{self.links(2, 5)}</div>", self.sentences(1, 3)])
        elif kind == "notice":
            inner = r.choice([f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 3)]) + r.choice(["", f"<button>{self.word()}</button>", f"<a href='/p'>{self.word()}</a>"])
        elif kind == "ad":
            inner = r.choice([self.sentences(1, 4), f"<p>{self.sentences(1, 4)}</p>", f"<a href='/b'>{self.words(3, 12)}</a>", f"<h4>{self.words(2, 5)}</h4><p>{self.sentences(1, 2)}</p>", f"<span>{self.words(1, 9)}</span>"])
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=q>" + r.choice([f"<button>{self.word()}</button>", f"<p>{self.sentences(1, 2)}</p><input type=submit>", f"<select><option>{self.word()}<option>{self.word()}</select>", f"<textarea>{self.words(1, 6)}</textarea>"])
        elif kind == "comments":
            each = lambda: r.choice([f"<p>{self.sentences(1, 5)}</p>", f"<b>{self.word()}</b>: {self.sentences(1, 4)}", f"<div class='author'>{self.words(1, 2)}</div><p>{self.sentences(1, 6)}</p>"])
            box = r.choice(["<div class='comment'>{}</div>", "<li>{}</li>", "<article class='comment'>{}</article>", "{}", "<div>{}</div>"])
            inner = r.choice([f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 3)}</h2>", ""]) + "".join(box.format(each()) for _ in range(r.choice([1, 1, 2, 3, 5, 8, 20])))
        else:
            inner = r.choice([self.links(2, 6), self.words(1, 6), f"<span>{self.words(1, 5)}</span>"])
        return self.wrap(kind, inner, marked, style)

    def unnamed(self, kind: str, marked: str) -> str:
        """A part that only its shape tells: links, a linked name, a claim of rights."""
        r = self.r
        if kind in ("menu", "share"):
            inner = self.links(2, 12)
        elif kind == "header":
            inner = r.choice([f"<a href='/'>{self.words(1, 3)}</a>", f"<a href='/'><img src=l.png alt=x></a> <a href='/'>{self.words(1, 3)}</a> {self.links(2, 5)}"])
        else:
            inner = self.rights() + r.choice(["", "", f" <a href='/p'>{self.words(1, 3)}</a> <a href='/q'>{self.words(1, 3)}</a>"])
        tag = r.choice(["div", "div", "p", "p", "center", "small", "table"]) if "<ul" not in inner else "div"
        if tag == "table":
            return f"<table{marked}><tr><td>{inner}</td></tr></table>"
        return f"<{tag}{marked}>{inner}</{tag}>"

    def block(self, linked: bool = True) -> str:
        r, x = self.r, self.r.random()
        if x < 0.60:
            return f"<p>{self.rich(self.sentences(1, 7))}" + ("</p>" if r.random() < 0.85 else "")
        if x < 0.69:
            return f"<h{(k := r.randint(2, 4))}>{self.words(1, 8)}</h{k}>"
        if x < 0.76:
            t = r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{self.rich(self.words(1, 20))}" + r.choice(["</li>", ""]) for _ in range(r.randint(1, 6))) + f"</{t}>"
        if x < 0.80:
            return f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(self.sentences(1, 3))}</blockquote>"
        if x < 0.84:
            return r.choice(["<pre>{}</pre>", "<pre><code>{}</code></pre>"]).format(r.choice([" ", "\n", " = ", "(); "]).join(self.words(1, 6) for _ in range(r.randint(1, 12))))
        if x < 0.88:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 6))) + "</table>"
        if x < 0.92:
            return f"<div>{self.sentences(1, 5)}</div>"
        if x < 0.95:
            return f"<figure><img src=a.png><figcaption>{self.words(2, 12)}</figcaption></figure>"
        if x < 0.98 and linked:
            t = r.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li><a href='/{self.word()}'>{self.words(1, 9)}</a>{r.choice(['', ' ' + self.words(1, 12)])}</li>" for _ in range(r.randint(2, 12))) + f"</{t}>"
        return f"<p><{(t := r.choice(['b', 'i', 'em', 'strong', 'span']))}>{self.sentences(1, 2)}" + r.choice(["</p>", "<br>", ""])

    def byline(self) -> str:
        said = f"{self.words(1, 4)}{self.r.choice([', ', ' - ', ' | '])}{self.r.randint(1, 28)} {self.word()} {self.r.randint(1996, 2030)}"
        return self.r.choice([f"<p>{said}</p>", f"<time>{said}</time>", f"<address>{said}</address>", f'<div class="{self.r.choice(BYLINES)}">{said}</div>', f'<p class="{self.r.choice(BYLINES)}">{said}</p>'])

    def blocks(self, linked: bool = True) -> list[str]:
        r = self.r
        title = f"<h1>{self.words(1, 12)}{r.choice(['', '.'])}</h1>"
        n = r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14, 25, 45])
        out = ([title] if r.random() < 0.85 or n == 0 else []) + ([self.byline()] if r.random() < 0.2 else [])
        if linked and r.random() < 0.04:  # an article that is a list of links
            return [title, self.block()] + [f"<ul>{''.join(f'<li><a href=/x>{self.words(1, 9)}</a></li>' for _ in range(r.randint(2, 25)))}</ul>"]
        return out + [self.block(linked) for _ in range(n)]

    def main(self, style: str) -> str:
        r = self.r
        blocks = self.blocks(style in ("semantic", "named"))
        if blocks and blocks[0].startswith("<h1") and r.random() < 0.2:
            blocks[0] = f"<header>{blocks[0]}</header>"
        for _ in range(r.choice([0, 0, 1, 1, 2]) if style in ("semantic", "named") else 0):
            kind = r.choice(["ad", "ad", "ad", "share", "sidebar", "notice", "form", "menu", "comments"])
            at = len(blocks) if kind == "comments" else r.randint(1, len(blocks))
            blocks.insert(at, self.part(kind, style, ' data-main="0"'))
        if r.random() < 0.15:
            blocks = [f"<section>{''.join(blocks)}</section>"]
        if r.random() < 0.1:
            blocks = [f"<div>{''.join(blocks)}</div>"]
        inner = "".join(blocks)
        name = f' {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}"'
        if style == "semantic":
            x = r.random()
            if x < 0.65:
                return f'<article{r.choice(["", name])}{MARK}>{inner}</article>'
            return f'<main{r.choice(["", name])}{MARK}>{inner}</main>' if x < 0.85 else f"<main><article{MARK}>{inner}</article></main>"
        tag = r.choice(["div", "div", "div", "section"])
        return f"<{tag}{name if style == 'named' else ''}{MARK}>{inner}</{tag}>"

    def body(self, style: str) -> str:
        r = self.r
        few = style in ("plain", "bare", "table")
        before = [k for k, c in (("notice", 0.1 if few else 0.2), ("header", 0.45), ("menu", 0.75), ("form", 0.15), ("ad", 0.1 if few else 0.35), ("share", 0.1), ("sidebar", 0 if few else 0.2)) if r.random() < c]
        after = [k for k, c in (("share", 0.15), ("ad", 0.1 if few else 0.2), ("sidebar", 0.1 if few else 0.35), ("comments", 0.15 if few else 0.35), ("form", 0.15), ("menu", 0.2), ("notice", 0.05 if few else 0.15), ("footer", 0.8)) if r.random() < c]
        first, last = [self.part(k, style) for k in before], [self.part(k, style) for k in after]
        if style == "bare":  # the body is the article's container, the parts in it are not of the article
            first, last = ([re.sub(r"^<\w+", lambda m: m[0] + ' data-main="0"', x, count=1) for x in side] for side in (first, last))
            blocks = self.blocks(False)
            if r.random() < 0.2:
                blocks = [f"<h1>{self.words(1, 9)}</h1>", *[self.sentences(1, 5) + r.choice(["<br><br>", "<br>", "<hr>", "<p>"]) for _ in range(r.randint(1, 9))]]
            if r.random() < 0.15:
                first.insert(0, " | ".join(f'<a data-main="0" href="/">{self.words(1, 3)}</a>' for _ in range(r.choice([1, 1, 2, 4]))))
            return "".join([*first, *blocks, *last])
        if style == "table":
            inner = "".join(self.blocks(False) or [f"<p>{self.sentences(2, 5)}</p>"])
            side = self.links(3, 12)
            cells = [f"<td width=150>{side}</td>", f"<td valign=top{MARK}>{inner}</td>"]
            if r.random() < 0.3:
                cells = cells[::-1]
            if r.random() < 0.3:
                cells = cells[:1] if MARK in cells[0] else cells[1:]
            top = f"<tr><td colspan=2>{''.join(first)}</td></tr>" if first else ""
            bottom = f"<tr><td colspan=2>{''.join(last)}</td></tr>" if last else ""
            return f"<table>{top}<tr>{''.join(cells)}</tr>{bottom}</table>"
        parts = [*first, self.main(style), *last]
        return "".join([f'<div{r.choice(["", " id=wrapper", " class=container", " class=page"])}>', *parts, "</div>"] if r.random() < 0.3 else parts)

    def page(self) -> str:
        style = self.r.choice(STYLES)
        body = self.body(style)
        mark = MARK if style == "bare" else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{}}</style></head><body{mark}>{body}<script>x()</script></body></html>"


def labelled_pages(n: int = 1000, seed: int = 1) -> list[str]:
    """n pages; n bounds what the fit reads."""
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]
