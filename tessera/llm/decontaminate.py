"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

Items are cut into windows of ``WIDTH`` words. One pass over the documents counts the items'
terms; a window with a term that no document holds cannot occur. A second pass stores the
postings of each remaining window's two rarest terms, (term, document, position), the rarest
with its neighbouring words. A window occurs where the two lists, each shifted by its term's
offset in the window, hold the same start and the other words of the window stand around it.
``near`` finds proximity matches the same way: shifted starts that differ by up to ``slop``.

The passes read every word of every document. Only benchmark terms are broadcast, in blocks of
at most ``MAX_TERMS``; a larger benchmark takes more passes. Postings of rare terms are all that
is shuffled; texts are not.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import broadcastable, known, saved

WIDTH = 10
#: Rows of benchmark terms that are broadcast at a time (some 20 MB).
MAX_TERMS = 200_000
#: Words are runs of these characters, after lower-casing A-Z (fixed pattern).
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lower, _BETWEEN), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(wid, item_id, words): each ``width`` consecutive words of an item; all words of a shorter
    item; none of an item without words."""
    w = known(benchmark, item_id="string", text="string").select("item_id", words("text").alias("w")).where("size(w) > 0")
    cut = f"transform(sequence(0, greatest(size(w) - {width}, 0)), i -> slice(w, i + 1, {width}))"
    return w.selectExpr("item_id", f"explode({cut}) as words") \
        .select(F.xxhash64(F.concat_ws(" ", "words")).alias("wid"), "item_id", "words").distinct()


def _blocks(terms: DataFrame, max_terms: int) -> list[DataFrame]:
    """The saved frame in parts of about ``max_terms`` rows, by a hash of its term."""
    if broadcastable(terms, max_terms):
        return [F.broadcast(terms)]
    n = -(-terms.count() // (max_terms // 2))
    return [F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k)) for k in range(n)]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, d, t, w): rows equal in id and text share (d, t)."""
    return known(docs, doc_id="long", text="string").select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"),
        words("text").alias("w"))


def rarest(docs: DataFrame, wins: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(wid, words, term1, off1, term2, off2): the two rarest terms of each window that may
    occur; term2 is null for a window of one term. Of equally rare ones the first counts."""
    places = wins.select("wid", "words").distinct().select("wid", "words", F.posexplode("words").alias("off", "term"))
    vocabulary = saved(places.select("term").distinct(), "decon-vocabulary")
    tokens = _documents(docs).select(F.explode("w").alias("term"))
    counts = saved(_union([tokens.join(b, "term").groupBy("term").agg(F.count("*").alias("n")) for b in _blocks(vocabulary, max_terms)]),
                   "decon-counts")
    each = places.groupBy("wid", "words", "term").agg(F.min("off").alias("off")).join(counts, "term", "left") \
        .groupBy("wid", "words").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"),
                                     F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("by"))
    return each.where("least > 0").selectExpr("wid", "words", "by[0].term as term1", "by[0].off as off1",
                                              "get(by, 1).term as term2", "get(by, 1).off as off2")


def postings(docs: DataFrame, rare: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, d, t, n_words, head, term, pos, from, around): the stored index. Every row of
    documents has one row with ``head`` in the first block, which need not be a posting."""
    reach = WIDTH - 1
    terms = saved(rare.selectExpr("term1 as term", "true as first").union(rare.selectExpr("term2", "false").where("term2 is not null"))
                  .groupBy("term").agg(F.max("first").alias("first")), "decon-terms")
    tokens = _documents(docs).select("doc_id", "d", "t", "w", F.posexplode_outer("w").alias("pos", "term"))
    out = []
    for k, block in enumerate(_blocks(terms, max_terms)):
        found = tokens.join(block, "term", "left").withColumn("head", F.lit(k == 0) & (F.coalesce("pos", F.lit(0)) == 0)) \
            .where("first is not null or head")
        out.append(found.select(
            "doc_id", "d", "t", F.size("w").cast("long").alias("n_words"), "head", F.expr("if(first is null, null, term)").alias("term"),
            "pos", F.greatest(F.col("pos") - reach, F.lit(0)).alias("from"),
            F.expr(f"if(first, slice(w, greatest(pos - {reach}, 0) + 1, {2 * reach + 1}), null)").alias("around")))
    return saved(_union(out), "decon-postings")


def _starts(index: DataFrame, rare: DataFrame, max_terms: int) -> tuple[DataFrame, DataFrame]:
    """The windows' two lists, shifted to the start of the window."""
    small = broadcastable(rare, max_terms)
    hint = F.broadcast if small else (lambda df: df)
    one = index.join(hint(rare.select("wid", "words", F.col("term1").alias("term"), "off1", "term2")), "term") \
        .withColumn("start", F.expr("pos - off1"))
    two = index.select("d", "t", "term", "pos").join(
        hint(rare.where("term2 is not null").select("wid", F.col("term2").alias("term"), "off2")), "term") \
        .select("wid", "d", "t", F.expr("pos - off2").alias("start"))
    return one, two


def occurrences(index: DataFrame, rare: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(wid, d, t, start, size): every exact occurrence of a window."""
    one, two = _starts(index, rare, max_terms)
    held = one.where("start >= 0 and slice(around, start - `from` + 1, size(words)) = words") \
        .select("wid", "d", "t", "start", F.size("words").alias("size"), "term2").distinct()
    pairs = held.where("term2 is not null").join(two.distinct(), ["wid", "d", "t", "start"], "left_semi")
    return pairs.union(held.where("term2 is null")).drop("term2")


def near(index: DataFrame, rare: DataFrame, slop: int, max_terms: int = MAX_TERMS) -> DataFrame:
    """(wid, d, t, start, away): proximity matches, windows whose two rarest terms stand up to
    ``slop`` words nearer or farther than in the window (0 included). A list of one document is
    met in cells of ``slop`` + 1 starts, never whole."""
    one, two = _starts(index, rare, max_terms)
    cell = slop + 1
    a = one.where("term2 is not null").select("wid", "d", "t", F.col("start").alias("a")).distinct() \
        .withColumn("cell", F.explode(F.expr(f"transform(array(-1, 0, 1), x -> floor(a / {cell}) + x)")))
    b = two.distinct().withColumn("cell", F.expr(f"floor(start / {cell})"))
    return a.join(b, ["wid", "d", "t", "cell"]).where(f"abs(a - start) <= {slop}") \
        .groupBy("wid", "d", "t", F.col("a").alias("start")).agg(F.min(F.expr("abs(a - start)")).alias("away"))


def _found(docs: DataFrame, benchmark: DataFrame, max_terms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    wins = saved(windows(benchmark), "decon-windows")
    rare = saved(rarest(docs, wins, max_terms), "decon-rarest")
    index = postings(docs, rare, max_terms)
    return wins, index, saved(occurrences(index.where("term is not null"), rare, max_terms), "decon-found")


def clean(docs: DataFrame, benchmark: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """The rows of documents in which no window occurs."""
    _, _, found = _found(docs, benchmark, max_terms)
    hit = saved(found.select("d", "t").distinct(), "decon-hit")
    if broadcastable(hit, max_terms):
        hit = F.broadcast(hit)
    d = known(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long")
    return d.withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("t", F.xxhash64(F.coalesce("text", F.lit("")))) \
        .join(hit, ["d", "t"], "left_anti").select(d.columns)


def contamination(docs: DataFrame, benchmark: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words. Items with a null id hit words but are in no list of items; equal
    items count each. Rows with a null id are judged; rows equal in id and text have equal
    results. Further columns are ignored; empty tables give no rows, or rows without hits.
    """
    wins, index, found = _found(docs, benchmark, max_terms)
    in_order = Window.partitionBy("d", "t").orderBy("start", "stop")
    before = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    hits = found.select("d", "t", "start", (F.col("start") + F.col("size")).alias("stop")).distinct() \
        .withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))))) \
        .groupBy("d", "t").agg(F.sum("new").cast("long").alias("n_hit"))
    items = found.select("d", "t", "wid").distinct().join(wins.select("wid", "item_id"), "wid").where("item_id is not null") \
        .groupBy("d", "t").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    return index.where("head").select("doc_id", "d", "t", "n_words").join(hits, ["d", "t"], "left").join(items, ["d", "t"], "left") \
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
                (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
