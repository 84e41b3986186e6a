"""Block elements of a web page, with the features that tell content from the rest.

Inline elements melt into the block that holds them. Text that lies beside blocks in the
same parent becomes a node of its own. End tags may be missing or stray; a page that breaks
off in the middle of a tag ends before that tag. An element whose text is left out and that
has no end tag of its own never takes the rest of the page with it. Work is linear in the
length of the page.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

# Elements of HTML by their role.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend "
    "li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
NEVER_TEXT = "script style template noscript textarea title iframe noembed noframes svg math object select".split()
FOREIGN, FALLBACK = {"svg", "math"}, {"noscript", "object", "template"}
# Fixed values of HTML: start tags that end an unclosed svg or math, but for places in them
# that hold HTML; and what may stand in a select.
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
    "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var "
    "article aside footer form header main nav section".split()
)
HOLDS_HTML = "foreignobject desc title annotation-xml mi mn mo ms mtext".split()
IN_SELECT = {"option", "optgroup", "hr", "button", "legend", "div"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
CLOSED_BY_SAME = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"},
}
TAG_GROUPS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"},
    {"article", "main"}, {"nav", "menu"}, {"aside", "dialog", "search"}, {"footer"}, {"header", "hgroup"},
    {"form", "fieldset", "label", "button", "legend", "option"}, {"table", "tbody", "tr", "td", "th"},
    {"blockquote", "pre", "figure", "figcaption"}, {"section", "div"}, {"#text"},
]
# Words in class, id and role attributes.
TOKEN_GROUPS = [
    r"article|content|post|entry|story|text|body|main|prose|page",
    r"nav|menu|breadcrumb|pagination|pager|toc|tabs|skip",
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|dfp|outbrain|taboola",
    r"comments?|reply|replies|discussion|disqus|respond|reader\w*",
    r"side|sidebar|aside|widget|related|recommend\w*|popular|trending|more|teaser",
    r"foot|footer|copyright|legal|colophon",
    r"head|header|masthead|logo|brand|top|site",
    r"share|social|follow|subscribe|newsletter|signup|login|search|form",
    r"cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|message|hidden",
]
_TOKENS = [re.compile(rf"(?:^|[^a-z])(?:{g})(?:$|[^a-z])") for g in TOKEN_GROUPS]
# A value in quotation marks may hold ">"; a mark that is never closed is a stray one.
_TAG = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*+)(>?)"""
    r"""|!--|[!?][^>]*>?)"""
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PUNCTUATION = re.compile(r"[.,;:?!]")
MARK = "\ue000"  # a private code point: never in a page to extract from
FEATURES = 24 + 2 * len(TAG_GROUPS) + 2 * len(TOKEN_GROUPS)


@dataclass
class Node:
    tag: str
    parent: int
    tokens: str = ""
    hidden: bool = False
    pieces: list[tuple[str, bool]] = field(default_factory=list)  # text, in a link
    children: list[int] = field(default_factory=list)


class Page:
    """``nodes`` in page order (parents first) and ``order``: (node, text) in page order."""

    def __init__(self, source: str | None):
        self.nodes: list[Node] = [Node("body", -1)]
        self.order: list[tuple[int, str]] = []
        self._open = [0]
        self._count: dict[str, int] = {"body": 1}
        self._link = False
        self._head = False
        self._parse(source or "")
        self._separate_text()

    def _parse(self, source: str) -> None:
        at, n, skip = 0, len(source), ""
        began, opened, inside = 0, "", {}  # of the skipped element: where, attributes, open tags
        plain: dict[str, int] = {}  # tags that are not skipped before a place
        while True:
            m = _TAG.search(source, at)
            self._text(source[at : m.start() if m else n], skip)
            if not m or (m.group(2) and not m.group(4)):
                # the page ends, or breaks off inside a tag
                if not skip:
                    return
                at, plain[skip] = began, n
                self._start(skip, opened)
                skip = ""
                continue
            if m.group() == "<!--":
                end = source.find("-->", m.end())
                at = n if end < 0 else end + 3
                continue
            at = m.end()
            if not m.group(2):
                continue
            tag, closing, inner = m.group(2).lower(), bool(m.group(1)), m.group(3)
            empty = inner.rstrip().endswith("/")
            if skip and closing:
                if inside.get(tag):
                    inside[tag] -= 1
                    if tag == skip and not inside[tag]:
                        skip = ""
                    continue
                if not self._encloses(tag):
                    continue
                if skip in FALLBACK:
                    at, plain[skip] = began, m.start()
                    self._start(skip, opened)
                    skip = ""
                    continue
                skip = ""
            elif skip and self._ends(skip, tag, inside):
                skip = ""
            if tag in RAW and not closing and skip not in FOREIGN:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                if not stop and not skip:
                    return
                at = stop.end() if stop else n
            elif skip:
                if not empty:
                    inside[tag] = inside.get(tag, 0) + 1
            elif tag in NEVER_TEXT and not closing and not empty and m.start() >= plain.get(tag, 0):
                skip, began, opened, inside = tag, at, inner, {tag: 1}
            elif closing:
                self._close(tag)
            else:
                self._start(tag, inner)

    def _encloses(self, tag: str) -> bool:
        """Whether an end tag closes something that is open around a skipped element."""
        if tag in ("head", "body", "html"):
            return self._head or tag != "head"
        return tag in BLOCKS and self._count.get(tag, 0) > 0

    def _ends(self, skip: str, tag: str, inside: dict[str, int]) -> bool:
        """Whether a start tag ends a skipped element that has not been closed."""
        if tag == "body" and self._head and not inside.get("html"):
            return True
        if skip in FOREIGN:
            return tag in BREAKOUT and not any(inside.get(x) for x in HOLDS_HTML)
        if skip == "select":
            return tag in ("input", "textarea") or (tag in BLOCKS and tag not in IN_SELECT)
        return False

    def _text(self, raw: str, skip: str) -> None:
        if raw and not skip:
            text = html.unescape(raw) if "&" in raw else raw
            self.order.append((self._open[-1], text))
            self.nodes[self._open[-1]].pieces.append((text, self._link))

    def _break(self) -> None:
        self.order.append((self._open[-1], " "))

    def _start(self, tag: str, inner: str) -> None:
        if tag in ("head", "body"):
            self._head = tag == "head"
        if tag in ("body", "html"):
            return
        if tag not in BLOCKS:
            if tag == "a":
                self._link = True
            elif tag == "br":
                self._break()
            return
        closes = CLOSED_BY_SAME.get(tag, set())
        while len(self._open) > 1:
            top = self.nodes[self._open[-1]].tag
            if top == "p" or top in closes:
                self._pop()
            else:
                break
        if tag == "hr":
            self._break()
            return
        attributes = _ATTRIBUTE.findall(inner) if inner else []
        tokens = " ".join(v.strip("\"'") for _, v in attributes).lower()
        self._link = False
        self._break()
        self.nodes.append(Node(tag, self._open[-1], tokens, bool(inner and _HIDDEN.search(inner))))
        self._open.append(len(self.nodes) - 1)
        self._count[tag] = self._count.get(tag, 0) + 1
        self._break()

    def _pop(self) -> None:
        self._break()
        node = self.nodes[self._open.pop()]
        self._count[node.tag] -= 1
        self._break()

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._link = False
        elif tag == "head":
            self._head = False
        if tag in BLOCKS and tag not in ("body", "html") and self._count.get(tag):
            while self.nodes[self._open[-1]].tag != tag:
                self._pop()
            self._pop()
            self._link = False

    def _separate_text(self) -> None:
        """Give text beside blocks a node of its own: one for each run between blocks."""
        for i, node in enumerate(self.nodes[1:], 1):
            self.nodes[node.parent].children.append(i)
        mixed = {i for i, node in enumerate(self.nodes) if node.children}
        last, holder, order = -1, -1, []
        for node, text in self.order:
            if node in mixed and text.strip():
                if last != node:
                    self.nodes.append(Node("#text", node))
                    holder = len(self.nodes) - 1
                    self.nodes[node].children.append(holder)
                self.nodes[holder].pieces.append((text, False))
                last = node
                order.append((holder, text))
                continue
            if text != " " and node != last:
                last = -1
            order.append((node, text))
        for i in mixed:
            self.nodes[i].pieces = []
        self.order = order

    def text(self, kept: list[bool]) -> str:
        """White space becomes one space; blocks are joined by one space."""
        return " ".join("".join(t if kept[i] else " " for i, t in self.order).split())

    def features(self) -> list[list[float]]:
        """One line for each node: subtree, tag, attributes, depth, siblings and ancestors."""
        nodes, n = self.nodes, len(self.nodes)
        size, links, words, points, under = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n, [1.0] * n
        for i, node in enumerate(nodes):
            for text, link in node.pieces:
                text = text.replace(MARK, "")
                length = len(text.strip())
                size[i] += length
                links[i] += length * link
                words[i] += text.count(" ") + 1 if length else 0
                points[i] += len(_PUNCTUATION.findall(text))
        for i in self.bottom_up():
            p = nodes[i].parent
            if p >= 0:
                for x in (size, links, words, points, under):
                    x[p] += x[i]
        total = max(size[0], 1.0)
        out: list[list[float]] = [[]] * n
        depth, above = [0] * n, [[0.0] * (len(TAG_GROUPS) + len(TOKEN_GROUPS))] * n
        place = [(0, 1, 1)] * n
        for i in self.top_down():
            node, p = nodes[i], nodes[i].parent
            depth[i] = depth[p] + 1 if p >= 0 else 0
            tags = [float(node.tag in g) for g in TAG_GROUPS]
            tokens = [float(bool(t.search(node.tokens))) if node.tokens else 0.0 for t in _TOKENS]
            own = tags + tokens
            inherited = above[p] if p >= 0 else above[i]
            same = [nodes[c].tag for c in node.children]
            kinds: dict[str, int] = {}
            for tag in same:
                kinds[tag] = kinds.get(tag, 0) + 1
            for k, c in enumerate(node.children):
                place[c] = (k, len(same), kinds[same[k]])
            k, siblings, alike = place[i]
            parent_size = max(size[p], 1.0) if p >= 0 else total
            s, w = size[i], max(words[i], 1.0)
            out[i] = [
                math.log1p(s), links[i] / max(s, 1.0), s / under[i], math.log1p(under[i]), math.log1p(words[i]),
                s / w, points[i] / w, s / total, s / parent_size, depth[i], len(same), k, siblings,
                k / siblings, alike / siblings, siblings - 1 - k, float(node.hidden), float(bool(node.pieces)),
                math.log1p(total), depth[p] if p >= 0 else -1, links[p] / parent_size if p >= 0 else 0.0,
                math.log1p(parent_size), float(bool(node.tokens)), kinds.get("p", 0) / max(len(same), 1),
                *own, *inherited,
            ]
            above[i] = [max(a, b) for a, b in zip(own, inherited)]
        return out

    def top_down(self) -> list[int]:
        """Parents before children. Text nodes come last and have no children."""
        return list(range(len(self.nodes)))

    def bottom_up(self) -> range:
        return range(len(self.nodes) - 1, -1, -1)

    def marked(self) -> list[bool]:
        """Which nodes hold a text piece with the training mark, in themselves or below."""
        found = [any(MARK in t for t, _ in node.pieces) for node in self.nodes]
        for i in self.bottom_up():
            if found[i] and self.nodes[i].parent >= 0:
                found[self.nodes[i].parent] = True
        return found

    def decode(self, log_odds: list[float]) -> list[bool]:
        """Which nodes are kept: the best choice in which no kept node lies in a dropped one.

        From the leaves up, a subtree is worth its own log-odds and the worth of those
        children that are worth keeping; from the root down, subtrees without worth go whole.
        """
        worth = list(log_odds)
        for i in self.bottom_up():
            p = self.nodes[i].parent
            if p >= 0 and worth[i] > 0:
                worth[p] += worth[i]
        kept = [True] * len(worth)
        for i in self.top_down()[1:]:
            kept[i] = kept[self.nodes[i].parent] and worth[i] > 0
        return kept
