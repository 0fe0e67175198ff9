"""Main text of web pages by gradient-boosted trees over the nodes of the DOM.

A page becomes a tree (elements left open and closed out of order are put right much as browsers do).
Each element has features: density of its subtree, tokens of its tag and attributes and of those of its
ancestors, depth, and statistics of its siblings. Boosted trees give each the log-odds of being part
of the article. Decoding then chooses for the whole tree at once, so that nothing is kept below what
is dropped: a subtree goes if that is likelier than the best choice with its top kept.

The trees are trained here on pages that are made up by rule from kinds of parts that pages have.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm.common import slices

TAG = re.compile(r"""<!--(?:.*?(?:--!?>)|.*)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[A-Za-z][^>]*$""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
TOKEN = re.compile("[a-z]+")

# Kinds of elements of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: Elements of other markup, in which "/>" closes; what stands apart from the words around it.
FOREIGN = frozenset({"svg", "math"})
APART = frozenset("br select option optgroup button".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
#: Elements that a start tag closes, and those beyond which it doesn't look.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist", "optgroup"})}


@dataclass
class Tree:
    """A page's block elements in order; texts: (node, text) in order, the root being 0."""

    tags: list[str] = field(default_factory=list)
    tokens: list[list[str]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters in links
    inner: list[int] = field(default_factory=list)  # tags right inside, blocks or not
    marks: list[str] = field(default_factory=list)  # data-y, in training pages

    def add(self, tag: str, parent: int, tokens: list[str], mark: str = "") -> int:
        for column, value in ((self.tags, tag), (self.tokens, tokens), (self.parents, parent), (self.links, 0), (self.inner, 0), (self.marks, mark)):
            column.append(value)
        return len(self.tags) - 1


def parse(page: str) -> Tree:
    tree = Tree()
    stack: list[tuple[str, int]] = [("#root", tree.add("#root", -1, []))]
    pending: list[str] = []
    standing = Counter()  # how many of each tag are open: what isn't needs no search
    link = foreign = 0
    skip_to = 0

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                tree.texts.append((stack[-1][1], text))

    def pop(k: int) -> None:
        nonlocal link, foreign
        if any(t in BLOCK for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            standing[t] -= 1
            link -= t == "a"
            foreign -= t in FOREIGN
            if t in APART:
                pending.append(" ")
        del stack[k:]

    def text(raw: str) -> None:
        if raw:
            decoded = html.unescape(raw) if "&" in raw else raw
            pending.append(decoded)
            if link:
                tree.links[stack[-1][1]] += len(decoded)

    at = 0
    for m in TAG.finditer(page):
        if m.start() < skip_to:
            continue
        text(page[max(at, skip_to) : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if standing[tag]:
                pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            elif tag in BLOCK:
                flush()
            continue
        rest = m[3] if m[2] else m[6]
        if tag in RAW and not (foreign and rest.endswith("/")):
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, m.end())
            if end or not foreign:
                skip_to = at = end.end() if end else len(page)
                pending.append(" ")
                continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, 0, -1) if standing["p"] else ():
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in ("td", "th", "table", "button", "blockquote", "article", "section", "div", "li", "foreignobject"):
                    break
        if tag in CLOSES:
            which, until = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1) if any(standing[t] for t in which) else ():
                if stack[k][0] in which:
                    pop(k)
                    break
                if stack[k][0] in until:
                    break
        node = stack[-1][1]
        tree.inner[node] += 1
        if tag in APART:
            pending.append(" ")
        # Whatever can be displayed ends the head, closed or not: nothing needs to be inside it.
        if tag == "head" or tag in VOID or rest.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK:
            tokens, mark = [tag], ""
            for a in ATTRIBUTE.finditer(rest):
                name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if name in ("class", "id", "role"):
                    tokens += TOKEN.findall(value)
                elif name == "data-y":
                    mark = value
            node = tree.add(tag, node, tokens, mark)
        link += tag == "a"
        foreign += tag in FOREIGN
        standing[tag] += 1
        stack.append((tag, node))
    text(page[max(at, skip_to) :])
    flush()
    return tree


#: Tokens of tags and attributes that are features of a node, a kind in each line; the kinds are features of a node and of
#: those above it. Fixed values.
KINDS = """section div p h1 h2 h3 ul ol li table td blockquote pre figure
wrap wrapper container row column col page inner outer layout block box grid site root
article main content post entry story text body copy
nav menu navigation navbar breadcrumb breadcrumbs toc skip links pagination pager
header masthead banner top logo brand title
footer copyright colophon bottom legal
aside sidebar side widget rail related recent popular tags categories archive trending more
cookie cookies notice consent alert gdpr popup modal privacy overlay warning message
ad ads advert adverts advertisement sponsor sponsored promo promotion dfp sky
form search newsletter subscribe signup login register contact
comments comment reply respond discussion disqus thread feedback
share social follow author byline meta date""".splitlines()
TOKENS = [t for kind in KINDS for t in kind.split()]
NUMBER = {t: k for k, t in enumerate(TOKENS)}
KIND = {t: k for k, kind in enumerate(KINDS) for t in kind.split()}
NUMERIC = 17


def features(tree: Tree) -> np.ndarray:
    """A row for each node."""
    n = len(tree.tags)
    own, words, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    first, last = np.full(n, np.inf), np.zeros(n)
    total = 0
    for node, text in tree.texts:
        own[node] += len(text)
        words[node] += text.count(" ") + 1
        stops[node] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
        first[node] = min(first[node], total)
        total += len(text)
        last[node] = total
    parents = tree.parents
    sub, link, tags, paragraphs = own.copy(), np.array(tree.links, float), np.array(tree.inner, float), np.array([t == "p" for t in tree.tags], float)
    words_, stops_ = words.copy(), stops.copy()
    children = np.zeros(n)
    depth = np.zeros(n)
    for k in range(1, n):
        depth[k] = depth[parents[k]] + 1
        children[parents[k]] += 1
    for k in range(n - 1, 0, -1):
        p = parents[k]
        for column in (sub, link, tags, paragraphs, words_, stops_):
            column[p] += column[k]
        first[p], last[p] = min(first[p], first[k]), max(last[p], last[k])
    first[np.isinf(first)] = 0
    kinds, above = NUMERIC + len(TOKENS), NUMERIC + len(TOKENS) + len(KINDS)
    out = np.zeros((n, above + len(KINDS)), np.float32)
    place, alike, seen = np.zeros(n), np.zeros(n), {}
    for k in range(1, n):
        place[k] = seen.get(parents[k], 0)
        seen[parents[k]] = place[k] + 1
    same: dict[tuple[int, str], int] = {}
    for k in range(1, n):
        same[parents[k], tree.tags[k]] = same.get((parents[k], tree.tags[k]), 0) + 1
    for k in range(1, n):
        alike[k] = same[parents[k], tree.tags[k]]
    up = np.maximum(np.array(parents), 0)
    page = max(total, 1)
    out[:, :NUMERIC] = np.column_stack([
        np.log1p(sub), np.log1p(own), sub / np.maximum(tags, 1), link / np.maximum(sub, 1), np.log1p(paragraphs), stops_ / np.maximum(words_, 1), sub / np.maximum(words_, 1), depth, first / page, last / page,
        place, children[up], alike / np.maximum(children[up], 1), sub / np.maximum(sub[up], 1), sub / page, link[up] / np.maximum(sub[up], 1), np.log1p(children),
    ])
    for k in range(n):
        for t in tree.tokens[k]:
            if (number := NUMBER.get(t)) is not None:
                out[k, NUMERIC + number] = 1
                out[k, kinds + KIND[t]] = 1
        if k:
            over = out[parents[k]]
            out[k, above:] = np.maximum(over[kinds:above], over[above:])
    return out


@dataclass
class Boosted:
    """Trees of a fixed depth; each level's question is answered for all nodes at once."""

    base: float
    columns: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for column, cut, leaf in zip(self.columns, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, column[at]] > cut[at])
            out += leaf[at - len(column)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Boosted:
    """Newton steps on the logistic loss; splits by histograms of quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    edges = [e if len(e) else np.zeros(1) for e in edges]
    coded = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    base = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    z = np.full(len(y), base)
    columns, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p) + 1e-6
        column, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows) < 20:
                    continue
                code = coded[rows] + np.arange(x.shape[1]) * bins
                sums = [np.bincount(code.ravel(), np.repeat(v[rows], x.shape[1]), minlength=x.shape[1] * bins).reshape(-1, bins).cumsum(1) for v in (g, h)]
                gl, hl = sums[0][:, :-1], sums[1][:, :-1]
                ga, ha = sums[0][:, -1:], sums[1][:, -1:]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(hl < 1) | (ha - hl < 1)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-3 and b < len(edges[j]):
                    column[node], cut[node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), column[at]] > cut[at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, minlength=2**depth) / (np.bincount(leaf, h, minlength=2**depth) + 1)
        z += value[leaf]
        columns.append(column)
        cuts.append(cut)
        leaves.append(value)
    return Boosted(base, np.array(columns), np.array(cuts), np.array(leaves))


def decode(parents: list[int], logits: np.ndarray) -> np.ndarray:
    """The likeliest choice of nodes to keep in which whatever is kept has its parent kept. The root,
    which is no element, is kept."""
    n = len(parents)
    gone = -np.logaddexp(0, logits)  # log of the chance that a node is not part
    kept = gone + logits
    gone = gone.copy()
    best = kept.copy()
    for k in range(n - 1, 0, -1):
        gone[parents[k]] += gone[k]
        best[parents[k]] += max(best[k], gone[k])
    out = np.zeros(n, bool)
    out[0] = True
    for k in range(1, n):
        out[k] = out[parents[k]] and best[k] > gone[k]
    return out


# Training pages. What kinds of parts are called, and the tags that they use.
PARTS = {
    "menu": ("nav div ul header", "nav menu navbar navigation breadcrumb breadcrumbs toc main-menu top-links pagination"),
    "header": ("header div", "header masthead site-header banner top logo brand page-top"),
    "footer": ("footer div", "footer site-footer copyright colophon bottom legal page-bottom"),
    "side": ("aside div section", "sidebar side widget rail related recent popular tags categories archive trending read-more"),
    "notice": ("div section aside", "cookie-notice cookies consent alert gdpr popup modal privacy-overlay notice warning message"),
    "advert": ("div aside section p", "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp sky ad-box"),
    "form": ("form div", "search newsletter subscribe signup login register form contact"),
    "comments": ("section div ol", "comments comment-list reply respond discussion disqus thread feedback comment"),
    "share": ("div ul", "share social follow share-links"),
}
MAIN = ("article main div section", "content article post entry story main body post-body entry-content article-text text page-content")
NEUTRAL = "wrap container row column page inner outer layout block box grid col site root wrapper"


class Maker:
    """Pages of random parts, with data-y on every block: 1 in the article, 0 elsewhere, - where both are inside."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.words = ["".join(self.rng.choice("abcdeilmnoprstuv") for _ in range(self.rng.randint(1, 11))) for _ in range(800)]

    def sentence(self, low: int, high: int) -> str:
        words = [self.rng.choice(self.words) + self.rng.choice(["", "", "", "", "", ",", "&amp;", "$$$", " |"]) for _ in range(self.rng.randint(low, high))]
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def text(self, sentences: int) -> str:
        return " ".join(self.sentence(1, 25) for _ in range(self.rng.randint(1, sentences)))

    def named(self, tags: str, names: str, y: str, inner: str, bare: float = 0.2) -> str:
        tag = self.rng.choice(tags.split())
        name = self.rng.choice(names.split()) if names else ""
        # Only what a tag says by itself, or what holds the article, goes without a name.
        plain = tag in ("nav", "header", "footer", "aside", "form") or names == MAIN[1]
        kind = "" if plain and self.rng.random() < bare else f' {self.rng.choice(["class", "id", "class"])}="{name}"' if name else ""
        return f'<{tag}{kind} data-y="{y}">{inner}</{tag}>'

    def links(self, low: int, high: int) -> str:
        items = "".join(f'<li data-y="0"><a href="/x">{self.sentence(1, 4)}</a></li>' for _ in range(self.rng.randint(low, high)))
        return f'<ul data-y="0">{items}</ul>' if self.rng.random() < 0.8 else re.sub("</?li[^>]*>", " ", items)

    def part(self, kind: str) -> str:
        r = self.rng
        tags, names = PARTS[kind]
        line = lambda: f'<p data-y="0">{self.text(2)}</p>'
        if kind in ("menu", "share"):
            inner = self.links(2, 9)
        elif kind == "header":
            inner = r.choice([f'<h1 data-y="0">{self.sentence(1, 4)}</h1>', f'<div class="logo" data-y="0">{self.sentence(1, 3)}</div>', self.links(2, 6), self.sentence(1, 8)])
        elif kind == "footer":
            inner = r.choice([f"&copy; {self.sentence(1, 4)} &middot; {self.text(2)}", line(), self.links(2, 6) + line()])
        elif kind == "side":
            inner = f'<h3 data-y="0">{self.sentence(1, 4)}</h3>' + r.choice([self.links(2, 8), line(), line() + line()])
        elif kind == "form":
            inner = line() * r.randint(0, 1) + f'<label>{self.sentence(1, 3)}</label><input name="q"><button>{self.sentence(1, 2)}</button>'
        elif kind == "comments":
            inner = f'<h2 data-y="0">{self.sentence(1, 2)}</h2>' * r.randint(0, 1) + "".join(f'<{t} class="{r.choice(["comment", "reply", "item", "comment-body"])}" data-y="0">{line() if r.random() < 0.7 else self.text(3)}</{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))
        else:
            inner = r.choice([self.text(3), line(), line() + self.links(1, 2), f'<span>{self.sentence(1, 5)}</span>'])
        return self.named(tags, names, "0", inner)

    def article(self) -> str:
        r = self.rng
        out = [f'<h1 data-y="1">{self.sentence(2, 12)}</h1>'] * (r.random() < 0.8)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15])):
            p = r.random()
            if p < 0.7:
                out.append(f'<p data-y="1">{self.text(r.choice([1, 2, 6, 12]))}</p>')
            elif p < 0.78:
                out.append(f'<p data-y="1"><b>{self.text(3)}<br><p data-y="1">{self.text(6)}</p>')
            elif p < 0.84:
                out.append(f'<h2 data-y="1">{self.sentence(1, 8)}</h2>')
            elif p < 0.9:
                out.append('<ul data-y="1">' + "".join(f'<li data-y="1">{self.sentence(1, 12)}</li>' for _ in range(r.randint(1, 5))) + "</ul>")
            elif p < 0.94:
                out.append(f'<blockquote data-y="1"><p data-y="1">{self.text(3)}</p></blockquote>')
            elif p < 0.96:
                out.append(f'<table data-y="1"><tr data-y="1"><td data-y="1">{self.sentence(1, 4)}</td><td data-y="1">{self.sentence(1, 4)}</td></tr></table>')
            else:
                out.append(f'<p data-y="1">{self.text(3)} <a href="/y">{self.sentence(1, 5)}</a> {self.text(2)}</p>')
            if r.random() < 0.06:
                out.append(self.part(r.choice(["advert", "side", "share", "notice", "form", "menu"])))
        if r.random() < 0.2:
            out.append(self.part(r.choice(["share", "comments", "side", "form"])))
        body = "".join(out)
        if r.random() < 0.1:
            body = self.named("div", NEUTRAL, "1", body)
        return self.named(*MAIN, "1", body, 0.5) if r.random() < 0.95 else body

    def page(self) -> str:
        r = self.rng
        before = [self.part(k) for k in ("header", "menu", "notice", "advert", "menu", "form") if r.random() < 0.45]
        after = [self.part(k) for k in ("side", "share", "comments", "form", "advert", "menu", "notice") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        middle = self.article()
        if r.random() < 0.35:
            k = r.randint(0, len(after))
            middle = self.named("div section", NEUTRAL, "-", middle + "".join(after[:k]))
            after = after[k:]
        if r.random() < 0.7:
            after.append(self.part("footer"))
        body = "".join(before + [middle] + after)
        if r.random() < 0.3:
            body = self.named("div", NEUTRAL, "-", body)
        return f"<!DOCTYPE html><html data-y='-'><head><title>{self.sentence(1, 9)}</title></head><body data-y='-'>{body}</body></html>"


def train(pages: int = 900, seed: int = 1) -> Boosted:
    """Fitted on made-up pages; nodes that hold both kinds count as part, since what is kept is below them."""
    maker, x, y = Maker(seed), [], []
    for _ in range(pages):
        tree = parse(maker.page())
        marks = np.array([{"1": 1, "0": 0, "-": 1}.get(m, -1) for m in tree.marks])
        x.append(features(tree)[marks >= 0])
        y.append(marks[marks >= 0])
    return boost(np.concatenate(x), np.concatenate(y).astype(float))


#: Nodes whose features are held at once (a page that has more stands alone).
NODES_AT_ONCE = 20_000


def main_text(trees: Iterator[Tree], model: Boosted) -> list[str]:
    """The article of each page: blocks in order, an empty line between them."""
    out: list[str] = []
    held: list[Tree] = []

    def judge() -> None:
        rows = [features(t) for t in held]
        logits = model.logits(np.concatenate(rows))
        at = 0
        for tree, own in zip(held, rows):
            kept = decode(tree.parents, logits[at : at + len(own)])
            at += len(own)
            out.append("\n\n".join(text for node, text in tree.texts if kept[node]))
        held.clear()

    for tree in trees:
        if held and sum(len(t.tags) for t in held) + len(tree.tags) > NODES_AT_ONCE:
            judge()
        held.append(tree)
    if held:
        judge()
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html); other columns are not
    looked at. A null or empty page has empty text; nulls in page_id and url stay, and so do repeated rows."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = main_text((parse(h or "") for h in batch.column(2).to_pylist()), shared.value)
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, ", ".join(kinds) + ", text string, n_chars long")
