"""Made pages with known main text, to train the page extractor on.

Pages vary in what carries the article (semantic elements, classes, bare paragraphs), in
what surrounds it, and in how carelessly they are written. Words are random syllables, so
the trees can lean on structure only. Pieces of main text start with ``MARK``.
"""

from __future__ import annotations

import random

from farebox.llm.html_nodes import MARK

_SYLLABLES = "an ber ci da el fo ga hi in ka le mo na or pa qu re sa ti un ver wo xi za the of".split()
_NOISE = ["", "", "", "", "!!", "***", "%%%", "|"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.noise = self.r.choice(_NOISE)

    def words(self, low: int, high: int) -> str:
        out = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 3))) for _ in range(self.r.randint(low, high))]
        if self.noise:
            out = [w + self.noise for w in out]
        return " ".join(out)

    def sentences(self, low: int, high: int) -> str:
        one = lambda: self.words(1, 16).capitalize() + self.r.choice([".", ".", ".", "?", "!"])
        out = " ".join(one() for _ in range(self.r.randint(low, high)))
        return out.upper() if self.noise == "!!" else out

    def attributes(self, *names: str) -> str:
        if self.r.random() < 0.2:
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'

    def link_list(self, tag: str = "li") -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(3, 9))]
        return "<ul>" + "".join(f"<{tag}>{x}</{tag}>" for x in items) + "</ul>"

    def paragraph(self) -> str:
        text = MARK + self.sentences(1, 9)
        kind = self.r.random()
        if kind < 0.1:
            text = f"<b>{text}"
        elif kind < 0.2:
            text += f' <a href="/x">{self.words(1, 3)}</a> <em>{self.words(1, 3)}</em> {self.words(2, 9)}.'
        text += self.r.choice(["", "", "", "<br>"])
        return f"<p>{text}" + self.r.choice(["</p>", "</p>", "</p>", ""])

    def article(self) -> str:
        r = self.r
        parts = [self.paragraph() for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14]))]
        extras = [
            lambda: f"<h2>{MARK}{self.words(2, 8)}</h2>",
            lambda: "<ul>" + "".join(f"<li>{MARK}{self.words(3, 15)}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
            lambda: f"<blockquote><p>{MARK}{self.sentences(1, 3)}</p></blockquote>",
            lambda: f"<pre>{MARK}{self.words(4, 20)}</pre>",
            lambda: "<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>",
            self.advert, self.share, self.related,
        ]
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(0, len(parts)), r.choice(extras)())
        title = f"<h1>{MARK}{self.words(3, 14)}</h1>" if r.random() < 0.9 else ""
        if r.random() < 0.1:
            title = f"<header>{title}</header>" if title else ""
        inner = title + "".join(parts)
        kind = r.random()
        if kind < 0.5:
            inner = f"<article{self.attributes('post', 'entry', 'story') if r.random() < 0.4 else ''}>{inner}</article>"
        elif kind < 0.85:
            name = self.attributes("content", "article-body", "post-content", "entry", "main-text", "story")
            inner = f"<div{name}>{inner}</div>"
        if r.random() < 0.3:
            inner = f"<main>{inner}</main>"
        if r.random() < 0.2:
            inner = f"<div{self.attributes('container', 'wrapper', 'row', 'page')}>{inner}</div>"
        return inner

    def advert(self) -> str:
        text = self.sentences(1, 6)
        tag = self.r.choice(["div", "div", "div", "aside", "section"])
        if self.r.random() < 0.3:
            text = f"<p>{text}</p>"
        return f'<{tag} {self.r.choice(["class", "id"])}="{self.r.choice(["ad", "ads", "advert", "banner", "sponsored", "ad-slot", "promo"])}">{text}</{tag}>'

    def share(self) -> str:
        links = " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(self.r.randint(2, 5)))
        return f'<div class="{self.r.choice(["share", "social", "share-bar", "follow"])}">{links}</div>'

    def related(self) -> str:
        return f'<div class="{self.r.choice(["related", "recommended", "popular", "more"])}"><h3>{self.words(1, 4)}</h3>{self.link_list()}</div>'

    def comments(self) -> str:
        r = self.r
        one = lambda: f"<div{self.attributes('comment', 'reply', 'comment-body')}><p>{self.sentences(1, 5)}</p></div>"
        if r.random() < 0.3:
            items = "".join(f"<li>{self.sentences(1, 4)}</li>" for _ in range(r.randint(1, 6)))
            inner = f"<ol>{items}</ol>"
        else:
            inner = "".join(one() for _ in range(r.randint(1, 6)))
        name = r.choice(["comments", "comment-list", "discussion", "reader-comments", "respond", "disqus_thread"])
        return f'<{(t := r.choice(["div", "section"]))} {r.choice(["class", "id"])}="{name}"><h3>{self.words(1, 3)}</h3>{inner}</{t}>'

    def nav(self) -> str:
        if self.r.random() < 0.7:
            return f"<nav{self.attributes('menu', 'main-nav') if self.r.random() < 0.4 else ''}>{self.link_list()}</nav>"
        return f'<div class="{self.r.choice(["nav", "menu", "breadcrumb", "navbar"])}">{self.link_list()}</div>'

    def header(self) -> str:
        inner = f"<h1>{self.words(1, 4)}</h1><p>{self.words(3, 10)}</p>" if self.r.random() < 0.5 else self.words(1, 6)
        tag = self.r.choice(["header", "header", 'div class="header"', 'div id="masthead"'])
        return f"<{tag}>{inner}{self.nav() if self.r.random() < 0.4 else ''}</{tag.split()[0]}>"

    def footer(self) -> str:
        inner = "&copy; " + self.words(1, 3) + " &middot; " + self.sentences(1, 4)
        if self.r.random() < 0.4:
            inner = f"<p>{inner}</p>" + (self.link_list() if self.r.random() < 0.5 else "")
        tag = self.r.choice(["footer", "footer", "footer", 'div class="footer"', 'div id="colophon"'])
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def aside(self) -> str:
        inner = self.link_list() if self.r.random() < 0.5 else f"<h3>{self.words(1, 3)}</h3><p>{self.sentences(1, 5)}</p>"
        tag = self.r.choice(["aside", 'aside class="sidebar"', 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"'])
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    def notice(self) -> str:
        name = self.r.choice(["cookie-notice", "cookie-banner", "consent", "notice", "alert", "newsletter-popup", "gdpr"])
        text = self.sentences(1, 4)
        return f'<div {self.r.choice(["class", "id"])}="{name}">{f"<p>{text}</p>" if self.r.random() < 0.6 else text}<button>{self.words(1, 2)}</button></div>'

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=x>" for _ in range(self.r.randint(1, 4)))
        return f"<form>{fields}{f'<p>{self.sentences(1, 2)}</p>' if self.r.random() < 0.4 else ''}<button>{self.words(1, 2)}</button></form>"

    def page(self) -> str:
        r = self.r
        maybe = lambda chance, make: make() if r.random() < chance else ""
        before = [maybe(0.4, self.header), maybe(0.7, self.nav), maybe(0.4, self.advert), maybe(0.25, self.notice), maybe(0.15, self.aside), maybe(0.1, self.form)]
        after = [maybe(0.35, self.comments), maybe(0.35, self.aside), maybe(0.25, self.related), maybe(0.2, self.advert), maybe(0.2, self.form), maybe(0.2, self.share), maybe(0.8, self.footer), maybe(0.1, self.notice)]
        comment = "<!-- ad 3 -->" if r.random() < 0.5 else ""
        body = "".join(before) + comment + self.article() + "".join(after)
        if r.random() < 0.15:
            body = f'<div id="wrapper">{body}</div>'
        end = "</body></html>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body>{body}{end}"


def training_pages(count: int, seed: int = 11) -> list[str]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(count)]
