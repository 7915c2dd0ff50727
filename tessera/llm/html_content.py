"""Main text of web pages by a tree-structured graphical model.

A page becomes a forest of block elements with text runs as leaves. Every node is content or not; a log-linear
potential looks at the node's tag, the words of its class, id and role, its share of linked characters and its
length, and a two-by-two potential links each node with its parent, one table for each kind of parent. The
marginals are exact: messages go up the levels of the trees and down again, for all pages of a batch at once.
Weights are fitted on labelled pages by the gradient of the likelihood, which the same messages give.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of HTML that one pass of messages takes at most, besides a longer single page.
BATCH_CHARS = 4 << 20

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp plaintext svg math".split())
RCDATA = frozenset(("title", "textarea"))
SILENT = RAW | RCDATA | frozenset(("head", "select", "datalist", "object", "audio", "video", "canvas"))
BLOCK = frozenset(
    "html body address article aside blockquote button center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup label legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul head select".split()
)
CLOSES_P = BLOCK - frozenset(("button", "label", "html", "body", "head", "select", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "legend"))
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

_TAG = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: End tags of the elements that are skipped whole, searched in the page as it is: lower-casing may change its length.
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW | RCDATA}
#: Attributes that end in the slash of a self-closed element; one in an unquoted value belongs to the value.
_SELF_CLOSED = re.compile(r"""(?<!=)(?:^|[\s"']|[\s"'][^\s"'=>]+)/\Z""")

OUTER, PLAIN, STRUCTURE, TEXTUAL = range(4)
_KIND = {t: OUTER for t in ("", "html", "body")} | {t: STRUCTURE for t in "article aside nav header footer form main menu dialog figure search ul ol dl table fieldset".split()} | {t: TEXTUAL for t in "p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption summary label button legend caption".split()}


@dataclass
class Page:
    """Nodes in page order: parent, tag, feature names; leaves carry text, other nodes None."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)


def parse(source: str) -> Page:
    """The block tree of a page. Markup errors are mended as browsers do in the common cases; nothing raises."""
    page = Page([-1], [""], [["tag:"]], [None])
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and their nodes (an inline element's node is its block's)
    run: list[str] = []
    linked = [0]

    def leave() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                share, size = linked[0] / max(1, sum(len(x.strip()) for x in run)), len(text)
                page.parent.append(stack[-1][1])
                page.tag.append("#")
                page.names.append(["text", f"links:{0 if share < 0.2 else 1 if share < 0.7 else 2}", f"size:{0 if size < 25 else 1 if size < 100 else 2}"])
                page.text.append(text)
            run.clear()
        linked[0] = 0

    where: dict[str, list[int]] = {}  # places in the stack of each open element's name
    silent = [0]

    def push(name: str, node: int) -> None:
        where.setdefault(name, []).append(len(stack))
        silent[0] += name in SILENT
        stack.append((name, node))

    where: dict[str, list[int]] = {}  # places in the stack of each open element's name
    silent = [0]

    def push(name: str, node: int) -> None:
        where.setdefault(name, []).append(len(stack))
        silent[0] += name in SILENT
        stack.append((name, node))

    def close(name: str, stop: frozenset | set = frozenset()) -> None:
        if not where.get(name):
            return
        i = where[name][-1]
        if any(where.get(t) and where[t][-1] > i for t in stop):
            return
        gone = [t for t, _ in stack[i:]]
        if not BLOCK.isdisjoint(gone):
            leave()
        for t in gone:
            where[t].pop()
            silent[0] -= t in SILENT
        del stack[i:]

    def add(raw: str) -> None:
        if raw and not silent[0]:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if where.get("a"):
                linked[0] += len(text.strip())

    at = 0
    while True:
        m = _TAG.search(source, at)
        if m is None:
            break
        add(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, attrs = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if name == "br":
                run.append(" ")
            elif name not in ("html", "body"):
                close(name, {"table"} if name == "p" else frozenset())
            continue
        if name == "br" or name == "hr":
            if name == "hr":
                leave()
            else:
                run.append(" ")
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            close("p", {"button", "table", "td", "th", "li", "object"})
        if name in ENDS:
            gone, stop = ENDS[name]
            for other in gone:
                close(other, stop)
        if name == "body":
            close("head")
        if name in ("html", "body") and where.get(name):
            continue
        if name in RAW or name in RCDATA:
            if name in ("svg", "math") and _SELF_CLOSED.search(attrs):
                continue
            end = _END[name].search(source, at)
            at = end.start() if end else len(source)
            push(name, stack[-1][1])
            continue
        if name in BLOCK:
            leave()
            names = [f"tag:{name}"]
            for a in _ATTR.finditer(attrs):
                value = a[2] or a[3] or a[4] or ""
                names += [f"word:{w.lower()}" for w in _WORD.findall(value)]
            page.parent.append(stack[-1][1])
            page.tag.append(name)
            page.names.append(list(dict.fromkeys(names)))
            page.text.append(None)
            push(name, len(page.parent) - 1)
        elif not attrs.rstrip().endswith("/"):
            push(name, stack[-1][1])
    add(source[at:])
    leave()
    return page


@dataclass(frozen=True)
class Forest:
    parent: np.ndarray  # -1 for roots
    kind: np.ndarray  # of the parent
    levels: list[np.ndarray]  # nodes by depth
    row: np.ndarray  # node of each feature
    feature: np.ndarray


def forest(pages: list[Page], index: dict[str, int], grow: bool = False) -> Forest:
    parent, kind, depth, row, feature = [], [], [], [], []
    for page in pages:
        base = len(parent)
        for i, up in enumerate(page.parent):
            parent.append(base + up if up >= 0 else -1)
            kind.append(_KIND.get(page.tag[up], PLAIN) if up >= 0 else OUTER)
            depth.append(depth[base + up] + 1 if up >= 0 else 0)
            for name in page.names[i]:
                if grow:
                    index.setdefault(name, len(index))
                if name in index:
                    row.append(base + i)
                    feature.append(index[name])
    depth_of = np.array(depth, np.int64)
    order = np.argsort(depth_of, kind="stable")
    cuts = np.searchsorted(depth_of[order], np.arange(1, depth_of.max() + 1)) if len(order) else []
    return Forest(np.array(parent, np.int64), np.array(kind, np.int64), np.split(order, cuts), np.array(row, np.int64), np.array(feature, np.int64))


@dataclass(frozen=True)
class Model:
    index: dict[str, int]
    weight: np.ndarray  # of each feature, for content
    pair: np.ndarray  # kind of parent x parent's label x label


def marginals(f: Forest, weight: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node, and P(parent's label, label) of each node with its parent, by sum-product."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(f.row, weight[f.feature], n)
    table = pair[f.kind]  # n x 2 x 2
    up = np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        x = table[level] + own[level][:, None, :]
        up[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
        np.add.at(own, f.parent[level], up[level])
    down, both = np.zeros((n, 2)), np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        rest = (own + down)[f.parent[level]] - up[level]
        x = table[level] + rest[:, :, None]
        down[level] = np.logaddexp(x[:, 0], x[:, 1])
        joint = x + own[level][:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        both[level] = joint / joint.sum((1, 2), keepdims=True)
    belief = own + down
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), both


def fit(pages: list[Page], labels: list[list[int]], steps: int = 250, decay: float = 0.002) -> Model:
    """Weights that maximise the labels' likelihood (Adam on the exact gradient, small weights preferred)."""
    index: dict[str, int] = {}
    f = forest(pages, index, grow=True)
    y = np.array([v for page in labels for v in page])
    child = np.flatnonzero(f.parent >= 0)
    seen = np.bincount(f.feature, y[f.row], len(index))
    pairs = np.zeros((4, 2, 2))
    np.add.at(pairs, (f.kind[child], y[f.parent[child]], y[child]), 1)
    theta = np.zeros(len(index) + 16)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        p, both = marginals(f, theta[:-16], theta[-16:].reshape(4, 2, 2))
        expected = np.zeros((4, 2, 2))
        np.add.at(expected, f.kind[child], both[child])
        g = np.concatenate([seen - np.bincount(f.feature, p[f.row], len(index)), (pairs - expected).ravel()]) / len(pages) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(index, theta[:-16], theta[-16:].reshape(4, 2, 2))


# --- labelled pages ---------------------------------------------------------------------------------------

_CONTENT = ["article", "post", "entry", "content", "story", "body", "text", "main", "page"]
_OTHER = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "toc", "pagination", "pager", "skip"],
    "header": ["header", "masthead", "top", "logo", "brand", "site"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon"],
    "aside": ["sidebar", "aside", "side", "widget", "rail", "related", "recommended", "popular", "trending", "archive", "tags", "tagcloud"],
    "notice": ["cookie", "cookies", "consent", "notice", "gdpr", "banner", "popup", "modal", "alert", "overlay", "privacy"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "adbox"],
    "form": ["form", "search", "login", "signup", "newsletter", "subscribe", "subscription", "contact"],
    "comments": ["comments", "comment", "reply", "replies", "discussion", "disqus", "respond", "commentlist", "reader", "readers"],
    "share": ["share", "social", "sharing", "follow", "author", "byline", "meta"],
}


def labelled_page(seed: int) -> tuple[str, list[str]]:
    """A page of our own making and its content blocks, for training and tests: varied frames around an article."""
    r = random.Random(seed)
    serial = iter(range(10**6))

    def sentence(low: int, high: int) -> str:
        return f"{r.choice(['Lorem', 'Ipsum', 'Dolor'])} w{seed}x{next(serial)} " + " ".join(r.choice("ta ro mi ken sul var".split()) + r.choice("na le dor st".split()) for _ in range(r.randint(low, high))) + "."

    def named(words: list[str], tag: str = "div") -> str:
        w = r.choice(words)
        w = r.choice([w, w, f"{w}-{r.choice(['box', 'wrap', 'area', 'inner', 'x', 'left'])}", f"{r.choice(['site', 'page', 'the', 'main'])}-{w}"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{w}">'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{sentence(0, 2)}</a>' + r.choice(["</li>", "</li>", ""]) for i in range(n)) + "</ul>"

    def other(kind: str) -> str:
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6 else "div"
        head = f"<{tag}>" if tag != "div" and r.random() < 0.5 else named(_OTHER[kind], tag)
        if kind in ("nav", "aside") and r.random() < 0.7:
            inner = (f"<h3>{sentence(0, 2)}</h3>" if r.random() < 0.4 else "") + links(r.randint(1, 7))
        elif kind == "form":
            inner = f'<label>{sentence(0, 2)}</label><input type="text"><button>{sentence(0, 1)}</button>' + r.choice(["", f"<p>{sentence(2, 9)}</p>"])
        elif kind == "comments":
            inner = f"<h3>{sentence(0, 2)}</h3>" + "".join(f'{named(_OTHER["comments"], r.choice(["div", "li", "article"] if r.random() < 0.3 else ["div"]))}<p>{sentence(3, 30)}</p></div>' for _ in range(r.randint(1, 4)))
        else:
            inner = r.choice([sentence(2, 20), f"<p>{sentence(2, 25)}</p>", f'<p>{sentence(2, 8)} <a href="#">{sentence(0, 2)}</a></p>', f'<a href="/">{sentence(0, 3)}</a>'])
        return f"{head}{inner}</{tag}>"

    blocks: list[str] = []

    def content(tag: str, low: int, high: int) -> str:
        text = sentence(low, high)
        blocks.append(text)
        if r.random() < 0.15:
            text = text.replace(" ", ' <a href="/x">', 1) + "</a>"
        return f"<{tag}>{text}" + (f"</{tag}>" if tag != "p" or r.random() < 0.7 else "")

    def article() -> str:
        out = [content("h1", 0, 5)] if r.random() < 0.8 else []
        if r.random() < 0.15:
            out.append(other("share"))
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.75:
                out.append(content("p", 0, r.choice([1, 10, 60])))
            elif x < 0.85:
                out.append(content(r.choice(["h2", "h3", "blockquote", "pre"]), 0, 8))
            elif x < 0.93:
                out.append("<ul>" + "".join(content("li", 0, 9) for _ in range(r.randint(1, 4))) + "</ul>")
            else:
                out.append(other(r.choice(["ad", "ad", "share", "form", "aside"])))
        head = r.choice(["<article>", "<article>", named(_CONTENT, "article"), named(_CONTENT), named(_CONTENT, "section"), "<main>"])
        return f"{head}{''.join(out)}</{re.match('<([a-z]+)', head)[1]}>"

    before = [other(k) for k in ("header", "nav", "notice", "ad", "aside") if r.random() < 0.5]
    after = [other(k) for k in ("aside", "comments", "ad", "form", "share", "footer", "notice") if r.random() < 0.5]
    r.shuffle(after)
    middle = article()
    if r.random() < 0.3:
        side = other("aside")
        middle = f'<div class="{r.choice(["wrapper", "container", "row", "layout"])}">{middle}{side}</div>'
    if r.random() < 0.3:
        middle = f"<main>{middle}</main>"
    body = "".join(before) + middle + "".join(after)
    if r.random() < 0.3:
        body = f'<div id="{r.choice(["wrapper", "container", "page", "root", "app"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{sentence(0, 4)}</title><style>p{{}}</style></head><body>{body}<script>var x='</p>';</script></body></html>", blocks


def label_nodes(page: Page, blocks: list[str]) -> list[int]:
    """A leaf is content if its text is a labelled block, another node if it holds content."""
    known = set(blocks)
    out = [int(t is not None and t in known) for t in page.text]
    for i in range(len(out) - 1, 0, -1):
        if out[i] and page.parent[i] >= 0:
            out[page.parent[i]] = 1
    return out


@lru_cache(1)
def default_model() -> Model:
    """Fitted on 300 labelled pages; a bounded, fixed sample."""
    made = [labelled_page(i) for i in range(300)]
    pages = [parse(source) for source, _ in made]
    return fit(pages, [label_nodes(p, blocks) for p, (_, blocks) in zip(pages, made, strict=True)])


def extract(sources: list[str], model: Model) -> list[str]:
    """Main text of each page: its content blocks in page order, one on a line."""
    pages = [parse(s) for s in sources]
    f = forest(pages, model.index)
    p, _ = marginals(f, model.weight, model.pair) if len(f.parent) else (np.zeros(0), None)
    out, base = [], 0
    for page in pages:
        out.append("\n".join(t for i, t in enumerate(page.text) if t is not None and p[base + i] > 0.5))
        base += len(page.text)
    return out


def main_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, ``text`` (main text, empty if none) and ``n_chars`` (its code points) of every page.

    Null or empty HTML has an empty text; broken markup is mended; repeated rows and null ids are each answered; an
    empty table gives none; other columns are not read. A page is handled whole, however long.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = [s or "" for s in batch.column(2).to_pylist()]
            at = 0
            while at < len(sources):
                to, size = at + 1, len(sources[at])
                while to < len(sources) and size + len(sources[to]) <= BATCH_CHARS and to - at < 400:
                    size += len(sources[to])
                    to += 1
                texts = extract(sources[at:to], model)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = to

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})
