"""Main-text extraction with a tree-structured graphical model over the DOM.

Every block element and every run of text between block boundaries is a node with a
label, content or not. A node has a unary score from its features, a parent and child
have a potential for each pair of labels, which depends on the child's features where
content starts or stops, and the tree is a conditional random field:

    score(y) = sum_v y_v * w.f(v) + sum_(p,c) T[y_p][y_c](f(c))

Sum-product messages, upward and then downward, give each node's content marginal; the
text runs at 0.5 or more are the main text. The weights are trained on labelled pages by
gradient ascent of the likelihood, whose gradient is the labels less the marginals.

Features never look at words: they are tags, hints in class, id and role, lengths,
link shares, punctuation and whether the page has an article or main element elsewhere, so the model holds in any language.

Defined results: a null or empty page gives the empty text; broken markup (open tags,
cut pages, stray ends) is repaired as browsers do for the common cases; repeated rows
give repeated results; an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_texts, renamed
from .labelled_pages import PAGES

# Element groups of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr audio video picture source track button input output meter progress".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = ("script", "style", "title", "template", "textarea", "select", "svg", "math", "iframe", "noscript", "object", "canvas", "button")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
SCOPES = frozenset("table td th ul ol body html article section div main aside nav form".split())
# Parts of class, id and role names.
AGAINST = "comment disqus discussion reply sidebar side-bar widget related recommend promo advert sponsor banner cookie consent notice popup modal newsletter subscribe share social breadcrumb menu navbar navigation topbar toolbar pagination pager footer header masthead copyright toc login signup complementary contentinfo search tags meta byline".split()
EXACTLY_AGAINST = frozenset("ad ads nav right left foot head form".split())
FOR = "article content entry story post main body text markdown".split()

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(DROPPED)})(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|[\"'])"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MARK = re.compile(r'data-main="([01])"')
_SPACES = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """Nodes of one page in document order: parents before children."""

    def __init__(self):
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [["tag:root"]]
        self.runs: dict[int, str] = {}
        self.labels: list[int] = [0]

    def node(self, parent: int, features: list[str], label: int) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.labels.append(label)
        return len(self.parent) - 1


def _hint_features(attrs: str) -> list[str]:
    found = []
    for m in _HINTS.finditer(attrs):
        value = (m[1] or m[2] or m[3] or "").lower()
        if any(x in value for x in AGAINST) or not EXACTLY_AGAINST.isdisjoint(re.split(r"[\s_-]+", value)):
            found.append("hint:against")
        elif any(x in value for x in FOR):
            found.append("hint:for")
    return found[:2]


def _run_features(text: str, linked: int, tag: str) -> list[str]:
    n = len(text)
    share = linked / n
    return [
        f"run:len{min(n.bit_length(), 7)}",
        "run:links" if share > 0.6 else "run:some_links" if share > 0.2 else "run:plain",
        f"run:punct{min(3, sum(1 for _ in _PUNCTUATION.finditer(text)))}",
        f"run:in_{tag}",
        f"run:linked_in_{tag}" if share > 0.2 else f"run:{'long' if n > 60 else 'short'}_in_{tag}",
        "run:copyright" if "©" in text[:40] else "run:any",
    ]


def _mark_beside(page: Page, mains: list[int]) -> None:
    """A feature for what stands beside the article or main elements of a page that has some: neither in nor around one."""
    inside, around = set(mains), set()
    for v in mains:
        v = page.parent[v]
        while v > 0 and v not in around:
            around.add(v)
            v = page.parent[v]
    for v in range(1, len(page.parent)):
        if v in inside or page.parent[v] in inside:
            inside.add(v)
        elif v not in around:
            page.features[v].append("run:beside" if v in page.runs else "tag:beside")


def parse(source: str) -> Page:
    """The nodes of a page. One pass over the markup; the depth of nesting is not limited."""
    page = Page()
    stack: list[tuple[str, int]] = [("root", 0)]
    buffer: list[str] = []
    linked = 0
    in_link = False
    mains: list[int] = []

    def close_run() -> None:
        nonlocal linked
        if buffer:
            text = _SPACES.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                tag, at = stack[-1]
                run = page.node(at, _run_features(text, min(linked, len(text)), tag), page.labels[at])
                page.runs[run] = text
            buffer.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        buffer.append(piece)
        if in_link:
            linked += len(piece)

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and m["raw"].lower() not in INLINE:
                close_run()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m["end"]
            elif tag in ("br", "img", "input"):
                buffer.append(" ")
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close_run()
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and tag not in SCOPES:
                    break
            else:
                close_run()
            in_link = False
            continue
        close_run()
        if stack[-1][0] == "p" or (len(stack) > 1 and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6") and tag[0] == "h" and tag[1:].isdigit()):
            stack.pop()
        shut = CLOSES.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in shut:
                del stack[i:]
            elif stack[i][0] in SCOPES:
                break
        if tag in VOID:
            continue
        attrs = m["attrs"]
        outer, above = stack[-1]
        mark = _MARK.search(attrs) if "data-main" in attrs else None
        features = [f"tag:{tag}", f"tag:{tag}_in_{outer}"]
        if attrs:
            features += _hint_features(attrs)
        stack.append((tag, page.node(above, features, int(mark[1]) if mark else page.labels[above])))
        if tag in ("article", "main") and "hint:against" not in features:
            mains.append(stack[-1][1])
    if at < len(source):
        text(source[at:])
    close_run()
    if mains:
        _mark_beside(page, mains)
    return page


class Model:
    """``unary``: weight of content by feature; ``start`` and ``stop``: weights, by a child's features, of
    content below no content and of no content below content; ``pairs``: the potential of each pair of
    labels, parent's first."""

    def __init__(self, unary: dict[str, float], start: dict[str, float], stop: dict[str, float], pairs: list[float]):
        self.unary, self.start, self.stop, self.pairs = unary, start, stop, pairs


def _log_sum(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def beliefs(page: Page, model: Model) -> tuple[list[float], list[float], list[float], list[tuple[float, float]]]:
    """Log-odds of content for every node; with the sums below a node, its messages to its parent and
    its two conditional potentials, which training needs. Messages are differences of log values."""
    t00, t01, t10, t11 = model.pairs
    parent, n = page.parent, len(page.parent)
    get, start, stop = model.unary.get, model.start.get, model.stop.get
    below = [sum([get(f, 0.0) for f in fs]) for fs in page.features]
    edges = [(t01, t10) if v in page.runs else (t01 + sum([start(f, 0.0) for f in fs]), t10 + sum([stop(f, 0.0) for f in fs])) for v, fs in enumerate(page.features)]
    up = [0.0] * n
    for v in range(n - 1, 0, -1):
        s = below[v]
        e01, e10 = edges[v]
        up[v] = d = _log_sum(e10, t11 + s) - _log_sum(t00, e01 + s)
        below[parent[v]] += d
    odds = below[:]
    for v in range(1, n):
        e01, e10 = edges[v]
        s = odds[parent[v]] - up[v]  # what the parent knows without this child
        odds[v] += _log_sum(e01, t11 + s) - _log_sum(t00, e10 + s)
    return odds, below, up, edges


def train(pages: list[str] = PAGES, rounds: int = 250, rate: float = 0.5, decay: float = 0.003) -> Model:
    """The likeliest weights, by gradient ascent on the labelled pages; a bounded set by design."""
    parsed = [parse(p) for p in pages]
    names = {f for p in parsed for fs in p.features for f in fs}
    on_edges = {f for f in names if f.startswith(("tag:", "hint:"))}
    model = Model(dict.fromkeys(names, 0.0), dict.fromkeys(on_edges, 0.0), dict.fromkeys(on_edges, 0.0), [0.0, -0.5, 0.0, 0.5])
    for _ in range(rounds):
        grads = [{f: -decay * len(parsed) * w for f, w in d.items()} for d in (model.unary, model.start, model.stop)]
        pairs = [0.0] * 4
        for page in parsed:
            odds, below, up, edges = beliefs(page, model)
            for v, fs in enumerate(page.features):
                y = page.labels[v]
                gap = y - 1 / (1 + exp(-max(-30.0, min(30.0, odds[v]))))
                for f in fs:
                    grads[0][f] += gap
                if not v:
                    continue
                s = odds[page.parent[v]] - up[v]
                scores = [model.pairs[0], edges[v][0] + below[v], edges[v][1] + s, model.pairs[3] + s + below[v]]
                top = max(scores)
                parts = [exp(x - top) for x in scores]
                z = sum(parts)
                gaps = [-x / z for x in parts]
                gaps[2 * page.labels[page.parent[v]] + y] += 1
                for k in range(4):
                    pairs[k] += gaps[k]
                if v not in page.runs:
                    for f in fs:
                        grads[1][f] += gaps[1]
                        grads[2][f] += gaps[2]
        scale = rate / len(parsed)
        for d, grad in zip((model.unary, model.start, model.stop), grads):
            for f in d:
                d[f] += scale * grad[f]
        for k in range(4):
            model.pairs[k] += scale * pairs[k] / 8
    return model


def main_text(source: str, model: Model) -> str:
    """The text runs whose content marginal is at least 0.5, in page order."""
    page = parse(source)
    odds = beliefs(page, model)[0]
    return "\n\n".join(text for v, text in page.runs.items() if odds[v] >= 0)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``."""
    model = model or train()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in as_texts(batch.column(2))]
            columns = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["page_id", "url", "text", "n_chars"])

    rows = renamed(pages, page_id=id_col, url=url_col, html=html_col)
    kind = dict(rows.dtypes)
    return rows.mapInArrow(extracted, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
