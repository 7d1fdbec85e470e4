"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements, and inline ones whose names tell of an advert, a notice and the like, are nodes with
two states, content or not. A node's figures (tag, names in class, id and role, text and link share,
what encloses it) give its own potential; a potential couples each node with its parent. Sum-product
messages go up and down the tree once and give exact marginals. The weights are trained by the same
messages, as a conditional random field, on labelled pages that `labelled_pages` lays out: articles
with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and among
them. Text of nodes with a content marginal above 0.5 is kept, in page order; character references
are decoded and white space becomes one space.

Null and empty html, and pages without content, have the empty text. Unclosed and stray tags are
taken as browsers do, roughly: scripts, styles, templates, titles, text areas and frames are skipped
up to their end tag, buttons and selects too; one that has none ends where a block begins or its
parent ends. Elements nested over DEEPEST deep stay siblings at that depth, as browsers do; their text
is kept. Very long pages are read whole, in time linear in their length. Repeated rows are each read.
A marginal of just 0.5 drops. Columns besides page_id, url and html are not read, those of the result
may clash with them. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import made_in_task, read_table, small_slices

# How tags behave.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr label math mi mn mo ms mtext mrow mfrac msup msub msqrt semantics annotation svg g path text tspan".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped up to their end tag; and those that markup may stand in, whose text is dropped all the same.
RAW = frozenset("script style template textarea title iframe noembed".split())
MUTE = RAW | {"button", "select"}
DEEPEST = 512
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead div section article main nav aside header footer body html form blockquote".split())
TAGS = "html body div section article main p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th nav header footer aside form fieldset blockquote pre figure figcaption address details summary".split()
# Words in class, id and role, by what they say of a block.
NAMES = {
    "menu": "nav navigation navbar menu menus breadcrumb breadcrumbs pagination pager toc topbar",
    "header": "header masthead banner logo hero",
    "footer": "footer copyright colophon legal",
    "sidebar": "sidebar side aside rail widget widgets related recommended trending popular complementary",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner",
    "notice": "cookie cookies consent notice notices alert alerts gdpr popup modal overlay disclaimer warning announcement",
    "form": "form newsletter subscribe subscription signup login search register contact",
    "social": "social share sharing follow tags meta byline",
    "comment": "comment comments reply replies discussion respond disqus responses",
    "content": "article content post entry story main body text maincontent",
}
_NAME = {w: k for k, words in enumerate(NAMES.values()) for w in words.split()}
_TAG = {t: i for i, t in enumerate(TAGS)}
_ATTR = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
#: Marks content in laid-out pages.
_MARK = "data-y"
N_FIGURES = len(TAGS) + 1 + 2 * len(NAMES) + 13


#: Names that make an inline element a node of its own.
_APART = frozenset(k for k, group in enumerate(NAMES) if group in ("menu", "advert", "notice", "form", "social", "comment"))
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EDGE = re.compile(r"""[>"']""")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}


def tags(html: str):
    """(start, end, name, closing, attributes) of each tag; the name is empty for comments and the like.

    A raw element with an end tag is one tag up to that, with closing None. Every search goes on where
    the last one ended, or is known to fail from there on.
    """
    at, none = 0, set()
    while True:
        i = html.find("<", at)
        if i < 0:
            return
        sign = html[i + 1 : i + 2]
        name, attributes, closing = "", "", False
        if html.startswith("<!--", i):
            j = html.find("-->", i + 2)
            end = len(html) if j < 0 else j + 3
        elif sign and sign in "!?/":
            m = _TAG_NAME.match(html, i + 2) if sign == "/" else None
            j = html.find(">", i + 2)
            if j < 0:
                return  # no tag can end any more
            end = j + 1
            if m:
                name, closing = m[0].lower(), True
        elif m := _TAG_NAME.match(html, i + 1):
            name, end = m[0].lower(), m.end()
            while True:
                q = _EDGE.search(html, end)
                if not q:
                    return
                end = q.end()
                if q[0] == ">":
                    break
                k = q.start() - 1
                while html[k].isspace():
                    k -= 1
                if html[k] == "=" and q[0] not in none:  # a quoted value
                    j = html.find(q[0], end)
                    if j < 0:
                        none.add(q[0])
                    else:
                        end = j + 1
            attributes = html[m.end() : end - 1]
            if name in RAW and name not in none:
                close = _ENDS[name].search(html, end)
                if close:
                    end, closing = close.end(), None
                else:
                    none.add(name)
        else:
            at = i + 1
            continue
        yield i, end, name, closing, attributes
        at = end


class Page:
    """Nodes of a page in order: tag, parent, depth, names, mark; and its text in pieces (node, text, in a link)."""

    __slots__ = ("tags", "parents", "depths", "names", "marks", "pieces")

    def __init__(self, html: str):
        self.tags, self.parents, self.depths, self.names, self.marks = ["html"], [-1], [0], [()], [0]
        self.pieces: list[tuple[int, str, bool]] = []
        blocks, opened = [("html", 0)], {}  # open blocks, and how many there are of each tag
        inner: list[list[tuple[str, int]]] = [[]]  # open inline elements of each block, with the node each is in
        node, links, mute, at = 0, False, None, 0

        def add(tag: str, attributes: str) -> int:
            self.tags.append(tag)
            self.parents.append(node)
            self.depths.append(self.depths[node] + 1)
            self.names.append(names_in(attributes))
            self.marks.append(int(_MARK in attributes))
            return len(self.tags) - 1

        def close(to: int) -> None:
            for tag, _ in blocks[to:]:
                opened[tag] -= 1
            del blocks[to:], inner[to:]

        for start, end, tag, closing, attributes in tags(html):
            if start > at and mute is None:
                self.pieces.append((node, html[at:start], links))
            at = end
            if not tag:
                continue
            if closing is None:  # a raw element as a whole
                if mute is None and tag not in ("script", "style", "template"):
                    self.pieces.append((node, " ", False))
                continue
            if mute is not None:
                if closing and tag == mute:
                    mute = None
                    continue
                if tag in INLINE or tag in VOID or tag in MUTE or tag in ("option", "optgroup") or (closing and not opened.get(tag)):
                    continue
                mute = None  # a block begins, or its parent ends
            if tag in MUTE:
                if not closing:
                    mute = tag
                    self.pieces.append((node, " ", False))
                continue
            if tag in INLINE and tag not in VOID:
                own = inner[-1]
                if closing:
                    if any(t == tag for t, _ in own[-DEEPEST:]):
                        while own:
                            t, node = own.pop()
                            if t == tag:
                                break
                elif not attributes.endswith("/"):
                    own.append((tag, node))
                    if _APART & set(names_in(attributes)) and self.depths[node] < DEEPEST:
                        node = add(tag, attributes)
                if tag == "a":
                    links = not closing
                continue
            self.pieces.append((node, " ", False))  # a block's edge, or a break
            if tag in VOID or tag in ("html", "head"):
                continue
            if closing:
                if opened.get(tag):
                    k = len(blocks) - 1
                    while blocks[k][0] != tag:
                        k -= 1
                    close(k)
                    node, links = blocks[-1][1], False
                continue
            if tag != "p" or blocks[-1][0] == "p":  # a paragraph ends where a block begins
                while blocks[-1][0] == "p":
                    close(len(blocks) - 1)
            if any(opened.get(t) for t in CLOSES.get(tag, ())):
                for k in range(len(blocks) - 1, 0, -1):
                    if blocks[k][0] in CLOSES[tag]:
                        close(k)
                        break
                    if blocks[k][0] in SCOPES:
                        break
            node, links = blocks[-1][1], False
            new = add(tag, attributes)
            if attributes.endswith("/"):
                continue
            if self.depths[new] < DEEPEST:
                blocks.append((tag, new))
                inner.append([])
                opened[tag] = opened.get(tag, 0) + 1
                node = new
            else:
                node = new  # its text is its own; what follows is its sibling
        if at < len(html) and mute is None:
            self.pieces.append((node, html[at:], links))


def names_in(attributes: str) -> tuple[int, ...]:
    """The known words in class, id and role."""
    found = []
    if attributes:
        for a in _ATTR.finditer(attributes):
            for w in _PARTS.findall(a[1] or a[2] or a[3] or ""):
                k = _NAME.get(w.lower())
                if k is not None:
                    found.append(k)
    return tuple(found)


class Forest:
    """The trees of some pages as arrays, parents before children."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tags) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(self.first[-1])
        shift = np.repeat(self.first[:-1], sizes)
        self.parent = np.array([x for p in pages for x in p.parents], np.int64)
        self.parent = np.where(self.parent >= 0, self.parent + shift, -1)
        self.depth = np.array([x for p in pages for x in p.depths], np.int64)
        tag = np.array([_TAG.get(t, len(TAGS)) for p in pages for t in p.tags], np.int64)
        names = np.zeros((n, len(NAMES)))
        own, link, dots, commas, count = (np.zeros(n) for _ in range(5))
        for p, a in zip(pages, self.first):
            for i, ks in enumerate(p.names):
                for k in ks:
                    names[a + i, k] = 1
            for b, text, linked in p.pieces:
                size = len(text.strip())
                if size:
                    own[a + b] += size
                    count[a + b] += text.count(" ") + 1
                    dots[a + b] += text.count(".")
                    commas[a + b] += text.count(",")
                    if linked:
                        link[a + b] += size
        order = np.argsort(self.depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if n else []
        self.levels = levels
        below, below_link, kids, p_text = own.copy(), link.copy(), np.zeros(n), np.where(tag == _TAG["p"], own, 0.0)
        for at in levels[:0:-1]:
            for a in (below, below_link, p_text):
                np.add.at(a, self.parent[at], a[at])
            np.add.at(kids, self.parent[at], 1)
        over, over_tag = np.zeros_like(names), np.zeros((n, 3))
        is_tag = [np.isin(tag, [_TAG[t] for t in ts]) for ts in (("article", "main"), ("nav", "header", "footer", "aside"), ("form",))]
        for at in levels[1:]:
            up = self.parent[at]
            over[at] = np.maximum(over[up], names[up])
            for k, flag in enumerate(is_tag):
                over_tag[at, k] = np.maximum(over_tag[up, k], flag[up])
        page = np.repeat(np.arange(len(pages)), sizes)
        has_article = np.zeros(len(pages))
        np.maximum.at(has_article, page, is_tag[0].astype(float))
        total = np.maximum(1, below[self.first[:-1]][page]) if n else np.zeros(0)
        outside = has_article[page] * (1 - np.maximum(over_tag[:, 0], is_tag[0]))
        figures = [np.log1p(own) / 6, np.log1p(below) / 8, (own > 0) * link / np.maximum(1, own), (below > 0) * below_link / np.maximum(1, below), dots / np.maximum(1, count), commas / np.maximum(1, count), np.log1p(kids) / 3, below / total, p_text / total, outside]
        self.x = np.concatenate([np.eye(len(TAGS) + 1)[tag], names, over, over_tag, np.stack(figures, 1)], 1) if n else np.zeros((0, N_FIGURES))


def sum_product(f: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(content marginal of each node, joint of (parent, child) states for each node with a parent).

    unary: log-potential of content against not; pair: 2 x 2 log-potentials of (parent, child).
    """
    n = len(f.parent)
    own = np.stack([np.zeros(n), unary], 1)
    inside = own.copy()  # own potential and what has come up from children
    up = np.zeros((n, 2))
    for at in f.levels[:0:-1]:
        t = inside[at][:, None, :] + pair[None]
        top = t.max(2, keepdims=True)
        up[at] = (top + np.log(np.exp(t - top).sum(2, keepdims=True)))[:, :, 0]
        np.add.at(inside, f.parent[at], up[at])
    outside = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for at in f.levels[1:]:
        p = f.parent[at]
        rest = outside[p] + inside[p] - up[at]  # what the parent knows without this child
        t = rest[:, :, None] + pair[None]
        top = t.max(1, keepdims=True)
        outside[at] = (top + np.log(np.exp(t - top).sum(1, keepdims=True)))[:, 0, :]
        both = t + inside[at][:, None, :]
        both -= both.max((1, 2), keepdims=True)
        e = np.exp(both)
        joint[at] = e / e.sum((1, 2), keepdims=True)
    belief = inside + outside
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), joint


# ---------------------------------------------------------------- labelled pages

_SYLLABLES = "ar en ti on la de ver sch eau ción mo ra li st und the or es ne ka".split()


def labelled_pages(n: int = 240, seed: int = 5, marked: bool = False) -> list[tuple[str, list[int]]]:
    """Pages laid out at random, with the label of each node; content blocks carry a mark, cut off unless `marked`."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    some = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda: (some(4, 14).capitalize() + pick([".", ".", ", " + some(2, 6) + ".", "?"]))
    text = lambda a, b: " ".join(sentence() for _ in range(int(rng.integers(a, b))))
    links = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(int(rng.integers(a, b)))) + "</ul>"
    name = lambda group: pick([w for w in NAMES[group].split()])

    def block(tag: str, group: str | None, inner: str) -> str:
        key = pick(["class", "class", "id"])
        label = f' {key}="{name(group)}{pick(["", "-box", " wide", "_1"])}"' if group else ""
        return f"<{tag}{label}>{inner}</{tag}>"

    def noise(kind: str) -> str:
        if kind == "menu":
            return pick([f"<nav>{links(2, 8)}</nav>", block("div", "menu", links(2, 8)), block("ul", "menu", "".join(f'<li><a href="/">{word()}</a></li>' for _ in range(4)))])
        if kind == "header":
            return pick([f"<header><div>{some(1, 4)}</div></header>", block("div", "header", f"<p>{some(1, 6)}</p>"), f"<header><h1><a href='/'>{some(1, 3)}</a></h1>{links(2, 5)}</header>"])
        if kind == "footer":
            return pick([f"<footer>&copy; {word()}.example &middot; {text(1, 3)}</footer>", block("div", "footer", f"<p>{text(1, 3)}</p>"), f"<footer><p>{text(1, 2)}</p>{links(1, 5)}</footer>"])
        if kind == "sidebar":
            return pick([f"<aside><h3>{some(1, 3)}</h3><p>{text(1, 3)}</p></aside>", block("div", "sidebar", f"<h2>{some(1, 3)}</h2>{links(2, 6)}"), block("section", "sidebar", f"<p>{text(1, 4)}</p>"), f"<aside>{links(2, 6)}</aside>"])
        if kind == "form":
            return pick([f"<form><p>{sentence()}</p><input><button>{word()}</button></form>", block("div", "form", f"<form><label>{some(1, 4)}</label><input></form>")])
        if kind == "comment":
            many = "".join(pick([f"<li><p>{text(1, 4)}</p></li>", f"<div class='comment'><b>{word()}</b><p>{text(1, 4)}</p></div>", block("article", "comment", f"<p>{text(1, 3)}</p>")]) for _ in range(int(rng.integers(1, 5))))
            return block(pick(["div", "section", "ol"]), "comment", f"<h3>{some(1, 3)}</h3>{many}")
        return block(pick(["div", "div", "section", "aside", "p"]), kind, pick([text(1, 3), some(2, 8)]) if rng.random() < 0.5 else f"<p>{text(1, 3)}</p>")

    y = f' {_MARK}="1"'
    kinds = ["menu", "header", "footer", "sidebar", "advert", "notice", "form", "social", "comment"]
    out = []
    for _ in range(n):
        body = []
        for i in range(int(rng.integers(0, 9))):
            body.append(pick([f"<p{y}>{text(1, 7)}</p>", f"<p{y}>{text(1, 7)}</p>", f"<p{y}><b>{sentence()}</b><br>{text(1, 3)}</p>", f"<p{y}><b>{sentence()}<br>", f"<h2{y}>{some(2, 7)}</h2>", f"<ul{y}>" + "".join(f"<li{y}>{sentence()}</li>" for _ in range(3)) + "</ul>", f"<blockquote{y}><p{y}>{text(1, 3)}</p></blockquote>", f"<div{y}>{text(2, 5)}</div>", f"<p{y}>{sentence()} <a href='/x'>{some(1, 4)}</a> {text(1, 3)}</p>", f"<p{y}>{sentence()} <span class='{name(pick(['advert', 'advert', 'notice', 'social', 'menu', 'form', 'comment']))}'>{some(1, 6)}</span> {text(1, 3)}</p>", f"<table{y}><tr{y}><td{y}>{some(1, 3)}</td><td{y}>{some(1, 5)}</td></tr></table>", f"<pre{y}>{some(3, 12)}</pre>", f"<figure{y}><img src='x'><figcaption{y}>{sentence()}</figcaption></figure>"]))
            if rng.random() < 0.15:
                body.append(noise(pick(["advert", "social", "notice", "form", "sidebar", "menu"])))
        head = pick([f"<h1{y}>{some(2, 9)}</h1>"] * 4 + [""])
        core = head + "".join(body)
        if rng.random() < 0.25:
            core += noise("comment")
        shell = rng.random()
        if shell < 0.55:
            core = f"<article{y}>{core}</article>"
        elif shell < 0.7:
            core = f"<main{y}>{core}</main>"
        elif shell < 0.95:
            core = f'<{pick(["div", "section"])}{y} {pick(["class", "id"])}="{name("content")}{pick(["", "-body", " wide"])}">{core}</div>'
        if rng.random() < 0.3:
            core = f'<div class="{pick(["wrap", "container", "page", "row"])}">{core}{noise("sidebar") if rng.random() < 0.5 else ""}</div>'
        before = [noise(k) for k in rng.permutation(kinds[:7])[: int(rng.integers(0, 4))]]
        after = [noise(k) for k in rng.permutation(kinds[2:])[: int(rng.integers(0, 4))]]
        if rng.random() < 0.6:
            after.append(noise("footer"))
        html = f"<html><head><title>{some(2, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"
        labels = Page(html).marks
        out.append((html if marked else html.replace(y, ""), labels))
    return out


@lru_cache
def train(rounds: int = 250, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and pair potentials of greatest conditional likelihood, by Adam."""
    data = labelled_pages()
    f = Forest([Page(h) for h, _ in data])
    y = np.array([v for _, ls in data for v in ls])
    assert len(y) == len(f.parent)
    child = np.flatnonzero(f.parent >= 0)
    truth = np.zeros((2, 2))
    np.add.at(truth, (y[f.parent[child]], y[child]), 1)
    theta = np.zeros(f.x.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, b, pair = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        p, joint = sum_product(f, f.x @ w + b, pair)
        g = np.concatenate([f.x.T @ (p - y), [np.sum(p - y)], (joint[child].sum(0) - truth).ravel()]) / len(data) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)


def joined(page: Page, keep: list[bool]) -> str:
    """The text of the nodes that are kept, in page order."""
    text = "".join(t if keep[k] else "" if page.tags[k] in INLINE else " " for k, t, _ in page.pieces)
    return _SPACE.sub(" ", unescape(text)).strip()


def main_texts(htmls: list[str], model) -> list[str]:
    w, b, pair = model
    pages = [Page(h) for h in htmls]
    f = Forest(pages)
    p, _ = sum_product(f, f.x @ w + b, pair)
    return [joined(page, (p[a : a + len(page.tags)] > 0.5).tolist()) for page, a in zip(pages, f.first)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    model = made_in_task(pages.sparkSession, train)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_slices(batch, "html"):
                texts = main_texts([h or "" for h in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
