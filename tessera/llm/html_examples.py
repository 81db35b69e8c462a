"""The labelled table for main-text extraction: small pages put together from labelled parts.

A page has parts that stand around its article, the article in a container of some style, and now and
then other parts inside the article. In a part, ``{w}`` stands for one to four words, ``{l}`` for a
link, ``{s}`` for a sentence, ``{p}`` for a paragraph of any length and ``{P}`` for a long one.
"""

from __future__ import annotations

import random

PAGES, SEED = 300, 13

_LINKS = "<ul><li>{l}</li><li>{l}</li><li>{l}</li><li>{l}</li></ul>"
#: Parts before an article, behind it, and within it, that are not its text.
BEFORE = [
    f"<nav>{_LINKS}</nav>", f"<header><h1>{{w}}</h1><p>{{s}}</p>{_LINKS}</header>", '<div class="ad">{s} {s}</div>', '<div class="ad"><p>{P}</p></div>',
    '<div class="cookie-notice"><p>{P}</p><button>{w}</button></div>', '<div id="header"><a href="/">{w}</a><div class="tagline">{s}</div></div>',
    f'<div id="menu">{_LINKS}</div>', '<div class="breadcrumbs">{l} {l} {w}</div>', "<div>{l} {l} {l} {l}</div>", f"<div>{_LINKS}</div>",
    '<div role="banner">{w} {l}</div>', f'<div role="navigation">{_LINKS}</div>', '<form class="search"><p>{w}</p><input type="text"><button>{w}</button></form>',
    '<div class="alert notice" role="alert"><p>{P}</p></div>', '<aside class="sidebar"><p>{P}</p><p>{s}</p></aside>', "<form><p>{P}</p><label>{w}</label></form>",
    '<div class="banner promo"><p>{s}</p></div>', '<div class="topbar">{l} {l}</div>', '<div class="gdpr consent-popup"><p>{P}</p></div>', '<div hidden><p>{P}</p></div>',
]
AFTER = [
    "<footer>&copy; {w} &middot; {s}</footer>", f"<footer><p>{{P}}</p>{_LINKS}</footer>", '<div id="footer"><p>{s}</p><p>{l} {l}</p></div>',
    '<section id="comments"><h2>{w}</h2><article class="comment"><p>{P}</p></article><div class="comment"><b>{w}</b><p>{s}</p></div></section>',
    '<div class="comments-area"><h3>{w}</h3><div class="comment-body"><p>{P}</p></div><div class="comment-body"><p>{P}</p></div></div>',
    '<div id="respond"><p>{P}</p><div class="reply">{s}</div></div>', '<ol class="commentlist"><li><p>{P}</p></li><li>{s}</li></ol>',
    f'<div class="related-posts"><h4>{{w}}</h4>{_LINKS}</div>', '<div id="sidebar"><h3>{w}</h3><p>{P}</p><div class="widget">{s} {l}</div></div>',
    "<div>{l} {l} {l}</div>", '<div class="newsletter-signup"><p>{s}</p><form><p>{P}</p></form></div>', '<section class="sponsored"><p>{P}</p></section>',
    f'<div role="complementary"><p>{{P}}</p>{_LINKS}</div>', '<div role="contentinfo"><p>{s}</p></div>', '<div class="site-footer"><p>{s} {l}</p></div>',
    f'<aside><h3>{{w}}</h3>{_LINKS}<p>{{s}}</p></aside>', '<div class="notice"><p>{P}</p></div>', '<div class="disqus-thread"><p>{P}</p></div>',
    "<form action='/c'><label>{w}</label><p>{s}</p><textarea>{s}</textarea></form>", '<div class="copyright">{s}</div>',
]
WITHIN = [
    f"<aside><h3>{{w}}</h3>{_LINKS}</aside>", '<div class="advertisement"><p>{P}</p></div>', '<div class="share">{l} {l}</div>', f'<nav class="toc">{_LINKS}</nav>',
    '<div class="newsletter"><p>{s}</p></div>', f'<div class="related">{_LINKS}</div>', "<form><p>{s}</p></form>", '<div class="ad">{s}</div>',
    f"<div>{_LINKS}</div>",
]
#: Parts outside an article that nothing marks; around a container that nothing marks either, short ones only.
UNMARKED, SHORT = ["<div>{w}</div>", "<p>{s}</p>", "<div>{s}</div>", '<div class="x1"><p>{P}</p></div>'], ["<div>{w}</div>", "<p>{w}</p>"]
#: Containers that tell what they hold, and others (whose articles have long paragraphs only).
NAMED = [
    ("<article>", "</article>"), ("<article>", "</article>"), ("<article>", ""), ("<main>", "</main>"), ("<main><article>", "</article></main>"),
    ('<div class="post"><div class="entry">', "</div></div>"), ('<div id="content">', "</div>"), ('<section class="article-body">', "</section>"),
    ('<div role="main">', "</div>"), ('<div class="has-sidebar post-content">', "</div>"), ("<form><main>", "</main></form>"),
]
PLAIN = [("<div>", "</div>"), ("", ""), ("<table><tr><td>", "</td></tr></table>")]
TITLES = ["<h1>{w}</h1>", "<h1>{s}</h1>", "<header><h1>{w}</h1></header>", '<header class="entry-header"><h1>{w}</h1></header>', "<h2>{w}</h2>", ""]
TEXT = [
    *["<p>{p}</p>"] * 4, "<p>{P}</p>", "<p>{P}</p>", "<p>{w}</p>", "<p>{s}</p>", "<p>{p} {l} {p}</p>", "<p>{l} {p}</p>", "<p>{l}</p>", "<p><b>{p}<br><p>{p}",
    "<h2>{w}</h2>", "<ul><li>{s}</li><li>{w}</li></ul>", "<ol><li>{l}</li><li>{s}</li></ol>", "<blockquote>{s}</blockquote>", "<div>{p}</div>", "<div>{s} {l} {s}</div>",
    "<figure><figcaption>{s}</figcaption></figure>", "<pre>{s}</pre>", "<table><tr><th>{w}</th><td>{w}</td></tr></table>", "<section><p>{p}</p></section>",
]
LONG = ["<p>{P}</p>", "<p>{P} {P}</p>", "<p>{P} {l} {P}</p>", "<div>{P}</div>", "{P}<br>{P}<hr>"]
_WORDS = "the of and a report on city water people said that new year river house long after many small work day found under".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join(rng.choice(_WORDS) for _ in range(rng.randint(low, high)))


def _filled(rng: random.Random, part: str) -> str:
    for mark, draw in {"{P}": lambda: _words(rng, 25, rng.choice([60, 120, 400])).capitalize() + ".",
                       "{p}": lambda: _words(rng, 1, rng.choice([8, 80, 400])).capitalize() + ".",
                       "{s}": lambda: _words(rng, 4, 14).capitalize() + ".", "{w}": lambda: _words(rng, 1, 4),
                       "{l}": lambda: f'<a href="/x">{_words(rng, 1, 3)}</a>'}.items():
        while mark in part:
            part = part.replace(mark, draw(), 1)
    return part


def _unmarked(rng: random.Random, named: bool) -> list[tuple[str, bool]]:
    return [(rng.choice(UNMARKED if named else SHORT), False)] if rng.random() < 0.3 else []


def _page(rng: random.Random) -> list[tuple[str, bool]]:
    """Parts of a page, and whether their text is the article's."""
    named = rng.random() < 0.8
    container, end = rng.choice(NAMED if named else PLAIN)
    parts = [("<!DOCTYPE html><html><head><title>x</title></head><body>", False)]
    parts += [(x, False) for x in rng.sample(BEFORE, rng.randint(0, 4))] + _unmarked(rng, named)
    parts.append((container + rng.choice(TITLES if named else TITLES[:2]), True))
    for _ in range(rng.randint(1, 9)):
        parts.append((rng.choice(TEXT if named else LONG), True))
        if named and rng.random() < 0.12:
            parts.append((rng.choice(WITHIN), False))
    parts.append((end, True))
    if end or not named:  # else the page is cut off within the article
        parts += _unmarked(rng, named) + [(x, False) for x in rng.sample(AFTER, rng.randint(0, 4))]
    return [(_filled(rng, x), main) for x, main in parts]


def pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[int, bool]]]]:
    """n pages: the html, and (offset, whether the text from there on is the article's)."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        html, marks = "", []
        for text, main in _page(rng):
            marks.append((len(html), main))
            html += text
        out.append((html, marks))
    return out
