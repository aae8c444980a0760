"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of block elements; runs of text between their tags are its leaves.
Every node is content or not. A node's own potential is a logistic regression on its tag, on
words in its class, id and role, and, for leaves, on length, links and punctuation. A potential
between parent and child, for each kind of child, favours like labels. All are trained on
labelled pages: those of html_pages, marked by hand, and a bounded sample (``MAX_PAGES`` of at
most ``MAX_CHARS`` characters, those with the smallest hash of their id) of pages whose article
or main element says what is content. Sum-product messages from the leaves to the root and back
give each node's marginal; leaves above one half are the text, in page order.

White space in a leaf becomes one space; leaves are trimmed and joined by a space. Time and
memory follow the size of a page.

Defined results: null or empty html, or html without text, gives empty text; broken markup is
read as far as it goes; equal pages give equal texts; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.html_pages import LABELLED

MAX_PAGES = 60
MAX_CHARS = 100_000

# Elements without content, without readable text, and within a line.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SILENT = frozenset(
    "script style head title noscript template svg math select option textarea button iframe "
    "object canvas audio video datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var".split()
)
#: A start tag that ends an open element of the same group.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)

TAGS = (
    "nav header footer aside form article main section div p h ul ol li dl table td blockquote pre "
    "figure figcaption body #text other".split()
)
WORDS = {
    "menu": r"nav|menu|breadcrumb|topbar|toolbar|tabs|pagination|pager",
    "advert": r"\bads?\b|advert|sponsor|promo|offer|commercial|banner",
    "comments": r"comment|repl(y|ies)|disqus|discuss|respond",
    "foot": r"foot|copyright|imprint|legal",
    "head": r"\bhead|header|masthead|logo|brand",
    "side": r"side|aside|widget|related|recommend|popular|tags?\b|most-?read|trending|teaser",
    "notice": r"notice|cookie|consent|alert|popup|modal|overlay|gdpr|warning|message",
    "share": r"share|social|follow",
    "form": r"form|newsletter|subscri|login|signup|search",
    "content": r"content|article|post|entry|story|main|body|text|prose",
}
_words = [re.compile(w, re.I) for w in WORDS.values()]
_BOILERPLATE = slice(0, 9)
_marked_section = re.compile(r"<!\[[^>]*>")
_space = re.compile(r"\s+")
_CUES = len(WORDS)
N_FEATURES = 1 + len(TAGS) + _CUES + 6


class _Builder(HTMLParser):
    """Nodes (parent, tag, names, text, linked characters, inside data-main) in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.text = [-1], ["body"], [""], [""]
        self.linked, self.main = [0], [False]
        self.open: list[tuple[str, int]] = []  # element, and its node (-1: inline, -2: silent)
        self.nodes = [0]  # the open ones
        self.counts: Counter[str] = Counter()  # of open elements by tag
        self.silent = self.links = 0
        self.run: list[str] = []
        self.run_linked = 0

    def _push(self, tag: str, node: int) -> None:
        self.open.append((tag, node))
        self.counts[tag] += 1
        if node >= 0:
            self.nodes.append(node)

    def _add(self, tag: str, names: str, text: str, linked: int, main: bool) -> int:
        above = self.nodes[-1]
        self.parent.append(above)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.main.append(main or self.main[above])
        return len(self.parent) - 1

    def flush(self) -> None:
        if self.run:
            text = _space.sub(" ", "".join(self.run)).strip()
            if text:
                self._add("#text", "", text, min(self.run_linked, len(text)), False)
            self.run, self.run_linked = [], 0

    def _close_to(self, at: int) -> None:
        while len(self.open) > at:
            tag, node = self.open.pop()
            self.counts[tag] -= 1
            if node == -2:
                self.silent -= 1
            elif node >= 0:
                self.flush()
                self.nodes.pop()
            if tag == "a":
                self.links -= 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.run.append(" ")
            return
        if tag in VOID or tag in ("html", "body"):
            return
        if tag in INLINE:
            if tag == "a":
                self.links += 1
            self._push(tag, -1)
            return
        ends = CLOSES.get(tag, ()) or (("p",) if tag in ENDS_P else ())
        if any(self.counts[e] for e in ends):
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] in ends:
                    self._close_to(at)
                    break
                if self.open[at][1] >= 0 and self.open[at][0] not in ("td", "th"):
                    break
        self.flush()
        if tag in SILENT:
            self.silent += 1
            self._push(tag, -2)
            return
        own = dict(attrs)
        names = " ".join(str(own.get(k) or "") for k in ("class", "id", "role"))
        kind = "h" if re.fullmatch("h[1-6]", tag) else tag
        self._push(tag, self._add(kind, names, "", 0, "data-main" in own))

    def handle_endtag(self, tag: str) -> None:
        if not self.counts[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close_to(at)
                return
            if tag in INLINE and self.open[at][1] >= 0:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)
            if self.links:
                self.run_linked += len(data.strip())


class Page:
    """The tree of a page; parents come before their children."""

    def __init__(self, html: str | None):
        b = _Builder()
        if html:
            b.feed(_marked_section.sub("", html))
            b.close()
            b._close_to(0)
            b.flush()
        self.parent, self.tag, self.text, self.main = b.parent, b.tag, b.text, b.main
        n = len(self.parent)
        x = np.zeros((n, N_FEATURES))
        x[:, 0] = 1
        at = {t: i + 1 for i, t in enumerate(TAGS)}
        cues = 1 + len(TAGS)
        remembered: dict[str, list[float]] = {}
        for i in range(n):
            x[i, at.get(self.tag[i], at["other"])] = 1
            names = b.names[i]
            if names.strip():
                if names not in remembered:
                    remembered[names] = [float(bool(w.search(names))) for w in _words]
                x[i, cues : cues + _CUES] = remembered[names]
            t = self.text[i]
            if t:
                size = len(t)
                x[i, cues + _CUES :] = (
                    min(math.log1p(size), 7) / 7,
                    b.linked[i] / size,
                    min(1.0, 10 * sum(map(t.count, ".,;:?!")) / size),
                    float(size < 25),
                    float(size > 120),
                    float("©" in t or "|" in t or "·" in t),
                )
        self.x = x
        # Kinds of child, for the potentials between it and its parent.
        marked = x[:, cues : cues + _CUES]
        chrome = marked[:, _BOILERPLATE].any(axis=1) | x[:, [at[t] for t in ("nav", "header", "footer", "aside", "form")]].any(axis=1)
        body = (marked[:, -1] > 0) | x[:, [at["article"], at["main"]]].any(axis=1)
        text = np.array([t == "#text" for t in self.tag])
        self.kind = np.where(text, 3, np.where(chrome, 1, np.where(body, 2, 0)))

    def truth(self, by_markup: bool) -> list[bool]:
        """Content or not: marked by hand, or said by article and main elements."""
        if not by_markup:
            out = list(self.main)
            for i, p in enumerate(self.parent):
                if p >= 0 and self.kind[i] == 1 and self.tag[i] != "header" or (p >= 0 and self.main[p] and not out[p]):
                    out[i] = False
            return out
        out = [False] * len(self.parent)
        for i, p in enumerate(self.parent):
            if p >= 0:
                out[i] = (out[p] or self.tag[i] in ("article", "main")) and self.kind[i] != 1
        return out


class Model:
    """Weights of the nodes' potentials, and one coupling for each kind of child.

    A link adds s/2 to the log potential if both ends are alike and takes s/2 if not. Weights are
    those of greatest likelihood with a ridge, climbed to by gradients: what is seen in labelled
    trees less what the messages expect.
    """

    def __init__(self, weights: np.ndarray, couplings: np.ndarray):
        self.weights, self.couplings = weights, couplings

    @classmethod
    def trained(
        cls, pages: list[tuple[Page, list[bool], float]], steps: int = 150, ridge: float = 0.02
    ) -> Model:
        """From pages with their labels and weights."""
        value = np.zeros(N_FEATURES + 4)
        first, second = np.zeros_like(value), np.zeros_like(value)
        total = sum(w for *_, w in pages)
        for step in range(1, steps + 1):
            model = cls(value[:N_FEATURES], value[N_FEATURES:])
            slope = -ridge * value
            for page, truth, weight in pages:
                p, alike = model.marginals(page)
                y = np.array(truth, float)
                slope[:N_FEATURES] += weight / total * (page.x.T @ (y - p))
                child = np.arange(1, len(y))
                seen = np.where(y[child] == y[np.array(page.parent)[child]], 1.0, -1.0)
                slope[N_FEATURES:] += weight / total / 2 * np.bincount(
                    page.kind[child], seen - alike[child], 4
                )
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            value = value + 0.15 * (first / (1 - 0.9**step)) / (
                np.sqrt(second / (1 - 0.99**step)) + 1e-6
            )
        return cls(value[:N_FEATURES], value[N_FEATURES:])

    def marginals(self, page: Page) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and the mean agreement (1 to -1) of each with its parent."""
        n = len(page.parent)
        own = np.clip(page.x @ self.weights, -30, 30).tolist()
        half = (self.couplings[page.kind] / 2).tolist()
        parent = page.parent
        # Log odds suffice: up[i] is the belief of node i from itself and from below.
        up, sent = own[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            s, u = half[i], up[i]
            sent[i] = _log_sum(-s, s + u) - _log_sum(s, u - s)
            up[parent[i]] += sent[i]
        whole, agree = up[:], [0.0] * n
        for i in range(1, n):
            s, u = half[i], up[i]
            above = whole[parent[i]] - sent[i]
            whole[i] = u + _log_sum(-s, s + above) - _log_sum(s, above - s)
            same, other = s + _log_sum(0.0, above + u), _log_sum(above, u) - s
            agree[i] = math.tanh((same - other) / 2)
        return 1 / (1 + np.exp(-np.clip(np.array(whole), -500, 500))), np.array(agree)

    def extract(self, html: str | None) -> str:
        page = Page(html)
        p, _ = self.marginals(page)
        return " ".join(t for t, v in zip(page.text, p.tolist(), strict=True) if t and v > 0.5)


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def fit(pages: DataFrame, max_pages: int = MAX_PAGES) -> Model:
    """A model of the hand-marked pages and of a bounded sample that labels itself."""
    named = F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.length("html") <= MAX_CHARS)
    chosen = (
        pages.where(named)
        .select("page_id", "html")
        .orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html"))
        .limit(max_pages)
        .collect()
    )
    found = [(p, p.truth(True)) for p in (Page(r["html"]) for r in chosen)]
    ours = [(p, p.truth(False)) for p in map(Page, LABELLED)]
    # Together, the pages marked by hand weigh as much as the sample.
    each = max(1.0, len(found) / len(ours))
    return Model.trained([(p, t, 1.0) for p, t in found] + [(p, t, each) for p, t in ours])


def extract(pages: DataFrame, model: Model, name: str = "text", html: str = "html") -> DataFrame:
    """pages with a column of their main text."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shared.value.extract(h) for h in batch.to_pylist()], pa.string())

    return pages.withColumn(name, text(F.col(html)))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = extract(pages.select("page_id", "url", "html"), fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
