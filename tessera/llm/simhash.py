"""SimHash near-duplicates: segment popcounts, a grid range join, exact verification.

A fingerprint is cut into 32 segments of two bits; its embedding is the vector of the segments'
bit counts (0 to 2). The Manhattan distance of two embeddings never exceeds the Hamming distance
of the fingerprints. Written in unary (0: 00, 1: 01, 2: 11), an embedding is a 64-bit number
again, and Manhattan distance is the number of differing bits of two such numbers.

Range join: cut the vector into three groups of segments. At distance ``most`` two of the three
groups together differ by at most two thirds of it. So two fingerprints meet in a grid cell if
each enters, for every two groups, all cells within half as many steps (for 4 bits: its own cell
and those one step away). Pairs that meet pass the bound, then the exact test.

Only components are asked for, so no group is expanded into all its pairs. Equal fingerprints
are one node. Cells with one node go. Every other node is tested against the smallest of its
cell; the links found make provisional components. Then, cells that still hold several
components test the members outside the cell's largest component against all of another
component. A cell of one dense group of copies costs one row per member, and no link between two
components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import known, saved, slices
from tessera.llm.components import components

LOW = 0x5555555555555555  # the lower bit of each segment
#: Shingle hashes that are unpacked to bits at a time.
CHUNK = 1 << 14


def fingerprint(text: str, shingle: int = 4) -> int:
    """64 bits: set where over half of the shingles' hashes are. Bytes are lower-cased and split as
    ASCII, which leaves other characters as they are."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist())),
                    np.uint64, len(words) - size + 1)
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), CHUNK):
        count += np.unpackbits(h[k:k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, t, fp): a hash of the text, and its fingerprint as a signed long. Null texts have no
    words: 0."""

    def run(batches):
        for s in slices(batches):
            fp = np.array([fingerprint(t or "", shingle) for t in s.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(2), pa.array(fp.view(np.int64))], ["doc_id", "t", "fp"])

    return known(docs, doc_id="long", text="string").select("doc_id", "text", _text_hash()).mapInArrow(run, "doc_id long, t long, fp long")


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def _unary(fp: str) -> str:
    """The embedding in unary: in each segment the bits, the set ones last."""
    return f"((({fp} | shiftright({fp}, 1)) & {LOW}L) | shiftleft({fp} & shiftright({fp}, 1) & {LOW}L, 1))"


def _cells(nodes: DataFrame, most: int) -> DataFrame:
    """(cell, node): the cells near each node in every two groups. A step flips one bit of the
    unary number, unless that leaves 10, which is no count."""
    groups = [range(0, 22), range(22, 44), range(44, 64)]
    steps = (2 * most // 3 + 1) // 2
    out = None
    for left_out in range(3):
        bits = [_signed(1 << b) for g, r in enumerate(groups) if g != left_out for b in r]
        mask = _signed(sum(1 << b for g, r in enumerate(groups) if g != left_out for b in r))
        cells = nodes.selectExpr("node", f"{_unary('node')} & {mask} as cell")
        count = f"(shiftrightunsigned(y, 1) & ~y & {LOW}L) = 0"
        for step in range(steps):
            flipped = f"filter(transform(array({', '.join(bits)}), x -> cell ^ x), y -> {count})"
            cells = cells.selectExpr("node", f"explode(concat(array(cell), {flipped})) as cell")
            cells = cells.distinct() if step else cells
        out = cells if out is None else out.union(cells)
    return out


def _signed(x: int) -> str:
    return "(-9223372036854775807L - 1L)" if x == 1 << 63 else f"{x - (1 << 64) if x >> 63 else x}L"


def link(nodes: DataFrame, most: int = 4) -> DataFrame:
    """(node, component) of distinct fingerprints that have a link of at most ``most`` bits."""

    def close(a, b):
        return f"(bit_count({_unary(a)} ^ {_unary(b)}) <= {most} and bit_count({a} ^ {b}) <= {most})"

    of_cell = Window.partitionBy("cell")
    shared = saved(_cells(nodes.select("node"), most).select(
        "cell", "node", F.min("node").over(of_cell).alias("head"), F.count("*").over(of_cell).alias("n")).where("n > 1").drop("n"), "simhash-cells")
    star = shared.where(f"node != head and {close('node', 'head')}").select(F.col("node").alias("a"), F.col("head").alias("b"))
    first = components(star, "simhash-star")
    found = saved(shared.join(first, "node", "left").select("cell", "node", F.coalesce("component", "node").alias("part")), "simhash-parts")
    sizes = found.groupBy("cell", "part").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("cell").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")) \
        .where("parts > 1").select("cell", "main")
    found = saved(found.join(mixed, "cell"), "simhash-mixed")
    more = found.where("part != main").alias("a").join(
        found.alias("b"), F.expr(f"a.cell = b.cell and a.part != b.part and (b.part = b.main or a.node < b.node) and {close('a.node', 'b.node')}")) \
        .select(F.col("a.part").alias("a"), F.col("b.part").alias("b"))
    second = components(more, "simhash-more").withColumnRenamed("node", "part").withColumnRenamed("component", "whole")
    parts = first.withColumnRenamed("component", "part")
    heads = parts.select(F.col("part").alias("node"), "part").distinct()  # a component's head has no row of its own
    alone = second.select(F.col("part").alias("node"), "part").union(second.select(F.col("whole").alias("node"), F.col("whole").alias("part")))
    every = parts.union(heads).union(alone).distinct()
    return every.join(second, "part", "left").select("node", F.coalesce("whole", "part").alias("component")).distinct()


def _components(docs: DataFrame, shingle: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, fp) of every row, and (fp, low, component): the fingerprints, their smallest id and
    the fingerprint that names their component."""
    fps = saved(fingerprints(docs, shingle), "simhash-fp")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    linked = saved(link(nodes.select(F.col("fp").alias("node")), most), "simhash-linked")
    return fps, nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id: the smallest id
    that can be reached over links of at most ``most`` differing bits.

    Null and empty texts have fingerprint 0 and link like others. A row with a null id takes
    part in links and gets its component's smallest id (null if no row there has one). Repeated
    rows each have a row. Further columns are ignored; an empty table gives no rows.
    """
    fps, of = _components(docs, shingle, most)
    lows = of.groupBy("component").agg(F.min("low").alias("component_id"))
    to = of.join(lows, "component").select("fp", "component_id")
    return fps.join(to, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """The rows of documents, one of each component: that with the smallest id, of texts under this
    id that with the smallest hash, of rows equal in both any one. Texts that are not linked both
    stay, also under one id. Rows without an id cannot be named and stay. Null and empty texts are
    one text; further columns are ignored; an empty table gives no rows."""
    d = known(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long")
    fps, of = _components(docs, shingle, most)
    heads = fps.where("doc_id is not null").join(of, "fp").groupBy("component").agg(F.min(F.struct("doc_id", "t")).alias("head"))
    return d.withColumn("t", _text_hash()).where("doc_id is not null").join(heads.select("head.*"), ["doc_id", "t"], "left_semi") \
        .dropDuplicates(["doc_id", "t"]).select(d.columns).union(d.where("doc_id is null"))
