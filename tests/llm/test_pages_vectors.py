"""Operators on pages and vectors, components, and the registered queries."""

import hashlib
import random
import sys

import pytest

from tessera.llm import mtree, url_alias, warc
from tessera.llm.common import table
from tessera.llm.components import components
from tessera.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 1)]
    group = {}
    for a, b in links:
        if a is not None and a != b:
            both = group.get(a, {a}) | group.get(b, {b})
            for x in both:
                group[x] = both
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(g) for x, g in group.items() if x != min(g)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGE = "<html>" + "long page " * 150
PAGES = [(1, "http://a.org/x", PAGE), (2, "http://b.org/x", PAGE), (9, None, PAGE), (None, "http://c.org/", PAGE), (3, "http://ü.org/a b\r\n", ""),
         (4, "http://d.org", None), (5, "e", "small"), (6, "e", "small"), (2, "http://b.org/x", PAGE), (8, "http://f.org", "é" * 600), (7, "x", "é" * 600)]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as id", "'x' as digest", "'x' as node")


def test_warc_round_trip(spark):
    got = sorted([tuple(r) for r in warc.round_trip(pages_of(spark, PAGES)).collect()], key=repr)
    want = []
    for page_id, _, html in PAGES:
        body = (html or "").encode()
        same = [i for i, _, h in PAGES if (h or "").encode() == body and i is not None]
        keep = max(same) if len(body) >= 1000 and same else page_id
        want.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if keep == page_id else "revisit", None if keep == page_id else keep))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages_of(spark, PAGES).where("false")).count() == 0


def test_warc_files_and_problems(spark, tmp_path):
    rows = [(i, f"http://h.org/{i}", f"<p>page {i} " + "text of the page " * (i % 50)) for i in range(400)]
    warc.write_archives(pages_of(spark, rows), str(tmp_path / "a"), archive_bytes=20_000)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 5
    back = {r.page_id: r.payload for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert back == {i: h.encode() for i, _, h in rows}
    data = max((f.read_bytes() for f in files), key=len)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")  # the dictionary is in front
    raw = [r for _, r in warc.frames(data)]
    assert all(warc.parse(r)["record_type"] == "response" for r in raw)
    for bad in (raw[0][:-1], raw[0].replace(b"Content-Length", b"Content-Lengt"), raw[0].replace(b"WARC/1.1", b"WARC/9"), raw[0].replace(b"<p>page", b"<p>pgae")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.frames(data[:-30]))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.zst").write_bytes(data[:-30])
    problems = [r.problem for r in warc.read_archives(spark, str(tmp_path / "b"), strict=False).collect()]
    assert problems[:-1] == [None] * (len(problems) - 1) and "cut" in problems[-1]


def test_aliases(spark):
    link = '<html><link href="{}" rel="canonical">'
    rows = [(1, "http://x.net/a", link.format("http://y.net/b")), (2, "http://y.net/b#f", ""), (3, "http://Y.net/b", None),
            (4, "http://z.net/", '<META content="0; URL=http://www.example.org/es/1" http-equiv=Refresh>'), (5, "http://q.net/", link.format("http://z.net/")),
            (6, "http://p.net/", link.format("http://z.net/") + link.format("http://m.com/fr/")), (7, None, link.format("http://z.net/")), (8, "no url", ""),
            (9, "http://example.org/en/1", ""), (10, "http://sub.example.org/en/2?x", ""), (11, "http://notexample.org", ""), (12, "http://m.com/de/x", ""),
            (13, "http://n.com/en/", ""), (14, "ftp://example.org/es/?q#f", ""), (3, "http://Y.net/b", None)]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_alias.judge(pages_of(spark, rows[:5] + rows[6:])).collect()}
    assert got == {
        (1, "x.net", "/a", None, "allow"), (2, "y.net", "/b", None, "allow"), (3, "y.net", "/b", None, "allow"), (4, "z.net", "/", None, "block"),
        (5, "q.net", "/", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "example.org", "/en/1", "example.org/en/1", "block"),
        (10, "sub.example.org", "/en/2", "org/", "allow"), (11, "notexample.org", "", None, "allow"), (12, "m.com", "/de/x", "com/de/", "block"),
        (13, "n.com", "/en/", None, "allow"), (14, "example.org", "/es/", "example.org/es/", "block")}
    # An alias that is explicitly allowed comes first; a redirect table links like a page.
    more = spark.createDataFrame([("http://x.net/a", "http://o.com/de/1"), (None, "http://z.net/")], "from_url string, to_url string")
    verdicts = {r.page_id: r.verdict for r in url_alias.judge(pages_of(spark, rows), more).collect()}
    assert verdicts[4] == verdicts[5] == verdicts[6] == "allow" and verdicts[1] == verdicts[2] == "block"
    assert url_alias.judge(pages_of(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_pages_have_no_aliases(spark, folder):
    """What the SQL of op6 takes for granted."""
    assert url_alias.page_links(table(spark, f"/root/testdata/{folder}", "pages")).count() == 0


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(700)] + [(1000 + i, [0.5] * 6) for i in range(400)]
    rows += [(2000, None), (2050, [float("nan")] * 6), (2100, [1.0, None] * 3), (2150, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2200, [3.0]),
             (2250, []), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as v", "1 as shard", "2 as page")
    import numpy as np

    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            seen[i] = w + [0] * (6 - len(w))
    want = []
    for q in seen:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(seen[q], w)), i) for i, w in seen.items() if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = sorted(tuple(r) for r in mtree.top_k(df, shard_rows=300, block_queries=7).collect())
    assert got == sorted(want)
    assert mtree.top_k(df.where("false")).count() == 0
    assert [tuple(r) for r in mtree.top_k(df.where("vec_id in (50, 51)")).collect()] == [(50, 1, 51, sum(a * b for a, b in zip(seen[50], seen[51])))]
    big = spark.createDataFrame([(0, [3e5] * 6), (1, [2e5] * 6), (2, [1e5 + 0.00390625] * 6)], "vec_id long, embedding array<double>")
    assert [r.score for r in mtree.top_k(big).collect()] == [6 * 76800000 * 51200000, 6 * 76800000 * 25600001]


def test_queries_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)
        assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=repr), name


def test_every_query_returns_every_row(spark):
    for name, rows in (("op2_pii", "documents"), ("op3_quality", "documents"), ("op4_simhash", "documents"), ("op8_bpe", "documents"),
                       ("op10_secrets", "documents")):
        assert QUERIES[name](spark, SF).count() == table(spark, SF, rows).count(), name


def test_pipeline_stages(spark):
    sys.path.insert(0, ".")
    import corpus_pipeline
    from tessera.llm import decontaminate, quality, simhash
    from tessera.llm.common import saved

    docs = table(spark, SF, "documents")
    steps = dict(corpus_pipeline.STAGES)
    good = saved(steps["quality"](spark, docs, SF), "t")
    assert good.columns == docs.columns
    scored = {r.doc_id: r.predicted for r in quality.score(docs, table(spark, SF, "labels")).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in scored.items() if p)
    lines = saved(steps["line_dedup"](spark, good, SF), "t")
    assert lines.columns == docs.columns and lines.count() == good.count()
    one = saved(steps["simhash"](spark, lines, SF), "t")
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(lines).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(near.values()))
    left = saved(steps["decontaminate"](spark, one, SF), "t")
    hit = {r.doc_id for r in decontaminate.contamination(one, table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert hit and {r.doc_id for r in left.collect()} == {r.doc_id for r in one.collect()} - hit
    last = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in left.collect()}
