"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at its block tags into text blocks in page order; nothing of its nesting is kept but
what stands on the open containers (their tags, and words of their class, id and role). A block is
described by its own number of words and link density, by those of the blocks before and behind it,
and by these hints. A decision tree, grown on the small labelled table of ``html_examples``, says
which blocks are the article's.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import html_examples
from tessera.llm.common import known, slices, small_batches

DEPTH, LEAF = 12, 3

# Comments and declarations may be unfinished; then they go on to the end, as in browsers.
_MARK = re.compile(r"""<(?:!--(?s:.*?)(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no text of the page.
_RAW = frozenset("script style title noscript template svg iframe textarea object canvas".split())
#: Elements that stay open around others; hints come from them.
_CONTAINERS = frozenset("html body main article section div nav aside header footer form ul ol dl menu table td th fieldset dialog details figure button select "
                        "blockquote address".split())
_BREAKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr thead tbody tfoot caption pre hr figcaption summary option legend center optgroup".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_APART = frozenset("nav aside footer form menu dialog button select fieldset".split())
_MAIN = frozenset("article main".split())
#: Words of class, id and role that stand for parts around an article, for readers' comments, and for the article.
_AROUND = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner topbar toolbar footer bottom colophon contentinfo copyright sidebar side "
                    "aside rail complementary widget related recommended recommendations promo promotion ad ads adv advert adverts advertisement advertising sponsor "
                    "sponsored cookie cookies consent gdpr notice notices notification alert warning disclaimer privacy popup modal overlay dialog newsletter subscribe "
                    "subscription signup login search form share sharing social tags pagination pager legal skip toc outbrain taboola paywall teaser teasers".split())
_COMMENT = frozenset("comment comments commentlist commentary reply replies respond responses discussion disqus feedback reviews guestbook".split())
_ARTICLE = frozenset("article content contents main post entry story body text maincontent hentry".split())

#: Beginnings of class names that tell of other parts, not of their element.
_OF_OTHERS = ("has-", "with-", "no-", "tag-", "category-")
_NO_HINTS = (0, 0, 0, 0, 0, 0, 0)
#: Places of the hints that speak of a part around an article.
_NOT_MAIN = [0, 1, 2, 5]
_FEATURES = 18


class _Page:
    """The blocks of a page: offset, text, words, words in links, hints."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, int, int, tuple[int, ...]]] = []
        self.has_main = False
        self.open: list[tuple[str, tuple[int, ...]]] = []
        self.tag, self.link = "", 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.start = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, lower = 0, None
        while at < len(html):
            lt = html.find("<", at)
            m = _MARK.match(html, lt) if lt >= 0 else None
            if lt >= 0 and m is None:  # a bare "<"
                self._text(html[at:lt + 1], at)
                at = lt + 1
                continue
            self._text(html[at:lt] if lt >= 0 else html[at:], at)
            if lt < 0:
                break
            at, name = m.end(), m[2]
            if name is None:
                continue
            name = name.lower()
            if name in _RAW and not m[1]:
                if lower is None:
                    lower = html.lower() if len(html.lower()) == len(html) else html
                end = lower.find("</" + name, at)
                at = len(html) if end < 0 else end
                if name != "title":
                    continue
            self._tag(bool(m[1]), name, m[3])
        self._close()

    def _text(self, text: str, at: int) -> None:
        if text:
            if not self.parts:
                self.start = at
            text = _html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.link:
                self.linked.append(text)

    def _tag(self, end: bool, name: str, attributes: str) -> None:
        if name == "a":
            self.link = 0 if end else 1
            if self.linked:
                self.linked.append(" ")
        elif name == "br":
            self.parts.append(" ")
        elif name in _BREAKS:
            self._close()
            self.tag = "" if end else name
            if name in _CONTAINERS:
                self._container(end, name, attributes)

    def _container(self, end: bool, name: str, attributes: str) -> None:
        if end:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == name:
                    del self.open[i:]
                    break
            return
        words, hidden = set(), 0
        for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("hidden", "aria-hidden", "style"):
                hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", "")
            else:
                for one in value.split():
                    if not one.startswith(_OF_OTHERS):
                        mine = {w.lower() for w in _HINT.findall(one)}
                        words |= mine - {"header"} if mine & _ARTICLE else mine
        if name in ("html", "body"):
            words, hidden = set(), 0
        apart, around, comment, main, article, hidden_, header = self.open[-1][1] if self.open else _NO_HINTS
        # Whole pages are wrapped in a form at times; an article in one is no part of it.
        form = apart == 2 and name not in _MAIN or name == "form"
        apart = apart == 1 or name in _APART and name != "form"
        hints = (1 if apart else 2 if form else 0, int(around or bool(words & _AROUND)), int(comment or bool(words & _COMMENT)),
                 int(main or name in _MAIN), int(article or bool(words & _ARTICLE)), int(hidden_ or hidden), int(header or name == "header"))
        self.has_main |= (name in _MAIN or bool(words & _ARTICLE)) and not any(hints[i] for i in _NOT_MAIN)
        self.open.append((name, hints))

    def _close(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                n, linked = text.count(" ") + 1, len("".join(self.linked).split())
                hints = self.open[-1][1] if self.open else _NO_HINTS
                kind = (int(self.tag in _HEADINGS), int(self.tag == "p"), int(self.tag == "li"))
                self.blocks.append((self.start, text, n, min(n, linked), hints + kind))
            self.parts, self.linked = [], []

    def features(self) -> np.ndarray:
        """A row per block: words and link density of it, the one before and the one behind; hints;
        whether it stands in a container for an article (2), outside those of its page (0) or in a
        page without (1); whether any hint speaks of a part around an article."""
        n = len(self.blocks)
        out = np.zeros((n, _FEATURES), np.float32)
        if n:
            words = np.array([b[2] for b in self.blocks], np.float32)
            links = np.array([b[3] for b in self.blocks], np.float32) / words
            out[:, 0], out[:, 1] = words, links
            out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
            out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
            out[:, 6:16] = [b[4] for b in self.blocks]
            out[:, 16] = np.where(out[:, 9:11].max(1) > 0, 2, 0 if self.has_main else 1)
            out[:, 17] = out[:, [6 + i for i in _NOT_MAIN]].max(1) > 0
        return out


class Tree:
    """A decision tree by least Gini impurity over thresholds, of at most DEPTH levels and LEAF
    examples in a leaf at least. Ties go to the first feature and the smallest threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.feature, self.threshold, self.down, self.value = [], [], [], []
        self._grow(x, y.astype(np.float64), DEPTH)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.feature)
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.down.append((at, at))
        self.value.append(bool(y.mean() >= 0.5))
        best = self._split(x, y) if depth and 0 < y.sum() < len(y) else None
        if best is not None:
            f, t = best
            left = x[:, f] <= t
            self.feature[at], self.threshold[at] = f, t
            self.down[at] = (self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))
        return at

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        n, best, least = len(y), None, 2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, up = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= LEAF) & (k <= n - LEAF)]
            if len(k):
                a, b = up[k - 1], up[-1] - up[k - 1]
                impurity = 2 * a * (1 - a / k) + 2 * b * (1 - b / (n - k))
                i = int(np.argmin(impurity))
                if impurity[i] < least:
                    least, best = impurity[i], (f, float((v[k[i] - 1] + v[k[i]]) / 2))
        return best

    def __call__(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, down = np.array(self.feature), np.array(self.threshold, np.float32), np.array(self.down)
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[at]
            right = (x[np.arange(len(x)), f] > threshold[at]).astype(np.int64)
            at = down[at, right]  # leaves lead to themselves
        return np.array(self.value)[at]


def examples(n: int = html_examples.PAGES, seed: int = html_examples.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of n labelled pages."""
    x, y = [], []
    for html, marks in html_examples.pages(n, seed):
        page, offsets = _Page(html), [m[0] for m in marks]
        x.append(page.features())
        y += [marks[bisect_right(offsets, b[0]) - 1][1] for b in page.blocks]
    return np.concatenate(x), np.array(y)


@cache
def tree() -> Tree:
    return Tree(*examples())


def main_blocks(html: str | None, by: Tree) -> list[str]:
    """The texts of the article's blocks, in page order."""
    page = _Page(html or "")
    return [b[1] for b, main in zip(page.blocks, by(page.features())) if main]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text (empty if it has none).

    Blocks are joined by one space; inside a block, white space (of any script) is one space. An
    unfinished tag, comment or script goes on to the end of the page. Null and empty pages have no
    text. Repeated rows stay; further columns are ignored; an empty table gives no rows.
    """
    by = tree()

    def run(batches):
        for s in slices(batches, 2):
            text = [" ".join(main_blocks(h, by)) for h in s.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1).cast(pa.string()), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(known(pages, page_id="long", url="string", html="string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long").select("page_id", "url", "text", F.col("n_chars"))
