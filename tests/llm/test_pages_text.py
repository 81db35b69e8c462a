"""Main text of pages: the tree on pages it was not grown on, and awkward HTML."""

import pytest

from tessera.llm import html_examples, html_text

PAGES = [
    (1, "http://a/1", """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
      <nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
      <article><h1>A &lt;b&gt; title</h1><p><b>One&nbsp;&nbsp;two.<br><p>Th<i>ree</i>, 3 < 4 &amp;&am</p><p>x</p><aside>See also this and that.</aside><p>End.</p></article>
      <div class="comments"><p>A reader's long comment that goes on and on about the article and its many words and then some more words.</p></div>
      <footer>&copy; me</footer></body></html>""", "A <b> title One two. Three, 3 < 4 &&am x End."),
    (2, None, None, ""), (3, "u", "", ""), (4, "u", "<nav><a href=x>only a menu</a></nav>", ""),
    (5, "u", "<article><p>Cut off in the middle of its text and then in a tag <a href=\"x", "Cut off in the middle of its text and then in a tag"),
    (6, "u", "<article><p>Kept.</p><script>never closed <p>gone", "Kept."),
    (7, "u", "<article><p>" + "long " * 200_000 + "</p></article><footer>f</footer>", ("long " * 200_000).strip()),
    (8, "u", "<form id=aspnet><div role=search><p>find</p></div><main><p>Words of the page.</p></main></form>", "Words of the page."),
    (9, "u", "<div id='header'><h1>Site</h1></div><div class=\"entry-content\"><p>Text.</p><ul><li>a</li></ul></div><div class=cookieNotice><p>We use cookies.</p></div>", "Text. a"),
    (1, "http://a/1", "", ""), (None, "u", "<article>n</article>", "n"),
]


def test_main_text(spark):
    df = spark.createDataFrame([r[:3] for r in PAGES], "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars").repartition(3)
    key = lambda r: (r[0] or 0, r[1] or "", r[2], r[3])
    got = sorted([tuple(r) for r in html_text.extract(df).collect()], key=key)
    assert got == sorted([(i, u, t, len(t)) for i, u, _, t in PAGES], key=key)
    assert html_text.extract(df.where("false")).collect() == []
    assert html_text.extract(df).columns == ["page_id", "url", "text", "n_chars"]


def test_held_out_pages():
    """Blocks of other pages of the same rule; what nothing marks cannot always be told."""
    x, y = html_text.examples(400, seed=77)
    by = html_text.tree()
    assert (by(x) == y).mean() > 0.985
    assert 0.2 < y.mean() < 0.6


def test_tree_splits_by_gini():
    import numpy as np

    x = np.array([[i, i % 2] for i in range(20)], np.float32)
    tree = html_text.Tree(x, x[:, 0] > 12)
    assert (tree.feature[0], tree.threshold[0]) == (0, 12.5)
    assert list(tree(x)) == [i > 12 for i in range(20)]
    assert html_text.Tree(x, np.ones(20, bool))(x).all()


def test_examples_are_labelled_by_offset():
    html, marks = html_examples.pages(1)[0]
    assert marks[0] == (0, False) and any(m for _, m in marks) and max(o for o, _ in marks) <= len(html)


@pytest.mark.parametrize("html", ["<", "<a", "</", "<!--", "<!", "<p title=\"", "<script", "&", "<" * 5000, "<a \"" * 5000])
def test_broken_html_ends(html):
    assert isinstance(html_text.main_blocks(html, html_text.tree()), list)
