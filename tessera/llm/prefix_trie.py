"""Conversation prefix trie: every distinct sequence of first turns is a node.

Nodes get their name from their turns: a polynomial over a prime field, folded turn by turn. Turns
are sorted by range over the whole table, so a long conversation may lie in several tasks; each
folds its own part, and since f(a b) = f(a) base^|b| + f(b), what a task lacks of the conversation
that it begins in is added afterwards, from a row or two per task.

Sums over subtrees are rolled up in bands of ``BAND`` levels. Every node is exploded to its ancestors
within its band only. That completes a band except for the bands below it; the roots of the bands,
one level in ``BAND``, then form a smaller tree, along which totals jump over 1, 2, 4, ... bands. At
last each band root's total goes to its ancestors within the band above. A node is exploded to
``BAND`` rows at most, and a trie of n levels takes log2(n / BAND) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import known, saved

BAND = 8
#: Conversations that share a rebuilt beginning, and its most turns.
FAMILY, LENT = 100, 5
_PRIME, _BASE = (1 << 127) - 1, 0x5A827999_6ED9EBA1_8F1BBCDC_CA62C1D7
_MASK = (1 << 64) - 1
_ROOT = bytes(16)
#: Conversation ids in one string of a digest.
_IDS = 1 << 16

_FOLDED = "conv_id long, depth int, xa long, xb long, size long, node binary, above array<binary>, last boolean"
_LOCAL = _FOLDED + ", part int, first boolean, edge boolean, final boolean"


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while out := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_pylist(out, schema)


def _code(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _on(before: int, n: int, part: bytes) -> int:
    """The name of a sequence from those of its beginning and of the n turns after it."""
    return (before * pow(_BASE, n, _PRIME) + int.from_bytes(part, "big")) % _PRIME


def _kept(depth: int) -> int:
    """How many ancestors a node keeps: those in its band, for a band's root those in the band above."""
    return depth % BAND or BAND


def _fold_locally(turns: DataFrame) -> DataFrame:
    """Each task folds what it has of every conversation. ``first``: a turn of the task's first
    conversation (``edge``: its last one); ``final``: the task's last turn. These keep all of the up
    to BAND nodes before them."""
    schema = _schema(_LOCAL)

    def rows(batches, part):
        conv, first, held, full = None, True, None, None
        for b in batches:
            for c, xa, xb, size in zip(*[x.to_pylist() for x in b.columns]):
                if held is not None:
                    if c != conv:
                        held["last"], held["edge"], first = True, first, False
                    yield held
                if held is None or c != conv:
                    conv, state, depth, above = c, 0, 0, [_ROOT]
                depth += 1
                state = (state * _BASE + ((xa & _MASK) << 64 | xb & _MASK)) % _PRIME
                full = above
                held = {"conv_id": c, "depth": depth, "xa": xa, "xb": xb, "size": size, "node": _code(state), "last": False, "part": part,
                        "above": full if first else full[-_kept(depth):], "first": first, "edge": False, "final": False}
                above = [*above[1 - BAND:], held["node"]]
        if held is not None:
            yield held | {"last": True, "edge": first, "final": True, "above": full}

    def run(batches):
        from pyspark import TaskContext

        return _batches(rows(batches, TaskContext.get().partitionId()), schema)

    return turns.select("conv_id", "xa", "xb", "size").mapInArrow(run, _LOCAL)


def _moved(row: dict, before: tuple[int, int, list[bytes]]) -> dict:
    """A local turn behind ``before``: so many turns, their name, the last nodes (its own at the end)."""
    n, state, tail = before
    low = row["depth"] - len(row["above"])
    above = [_code(_on(state, low + i, x)) for i, x in enumerate(row["above"])]
    return row | {"depth": n + row["depth"], "node": _code(_on(state, row["depth"], row["node"])),
                  "above": above if low else [*tail[:-1], *above][-BAND:]}  # the local beginning is the tail's end


def _carried(edges: list[dict]) -> tuple[dict, set]:
    """What comes before each task's first conversation, and the tasks whose final conversation goes
    on in the next one."""
    before, goes_on, open_ = {}, set(), None
    for e in sorted(edges, key=lambda e: (e["part"], not e["first"])):
        if open_ and e["first"] and e["conv_id"] == open_["conv_id"]:
            before[e["part"]] = (open_["depth"], int.from_bytes(open_["node"], "big"), [*open_["above"], open_["node"]][-BAND:])
            goes_on.add(open_["part"])
            e = _moved(e, before[e["part"]])
        open_ = e
    return before, goes_on


def _corrected(rows: DataFrame, before: dict, goes_on: set) -> DataFrame:
    schema = _schema(_FOLDED)

    def corrected(batches):
        for b in batches:
            for r in b.to_pylist():
                if r["first"] and r["part"] in before:
                    r = _moved(r, before[r["part"]])
                yield {k: r[k] for k in schema.names} | {"above": r["above"][-_kept(r["depth"]):],
                                                         "last": r["last"] and not (r["final"] and r["part"] in goes_on)}

    return rows.mapInArrow(lambda batches: _batches(corrected(batches), schema), _FOLDED)


def folded(turns: DataFrame, *order: str) -> DataFrame:
    """(conv_id, depth, xa, xb, size, node, above, last): each turn of a frame (conv_id, xa, xb, size,
    the order) with the node that it leads to. ``above``: the node's nearest ancestors, parent last
    (``_kept`` of them)."""
    local = saved(_fold_locally(turns.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)), "trie-local")
    # Two rows a task at most.
    edges = [r.asDict() for r in local.where("edge or final").select("conv_id", "depth", "node", "above", "part", "first").collect()]
    open_ = "first or final"
    fixed = _corrected(local.where(open_), *_carried([e | {"node": bytes(e["node"]), "above": [bytes(x) for x in e["above"]]} for e in edges]))
    return local.where(f"not ({open_})").select(fixed.columns).unionByName(fixed)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, xa, xb, size): what the trie needs to know of each turn. Null role or text
    is empty; turns without a conversation go."""
    c = known(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    c = c.select("conv_id", "turn", *[F.coalesce(k, F.lit("")).alias(k) for k in ("role", "text")])
    return c.select("conv_id", "turn", "role", F.xxhash64("role", "text").alias("xa"), F.xxhash64(F.lit("x"), "text", "role").alias("xb"),
                    F.length("text").cast("long").alias("size"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of every conversation, and (conv_id, own, at, xa, xb, size) of the turns of each c
    rebuilt: the first h of conversation c - c mod 100, then its own after its first h, with h =
    crc32(c) mod 6. Turns of one number are ordered by role, then by a hash."""
    numbered = saved(folded(turns(conversations), "turn", "role", "xa", "xb").select("conv_id", "depth", "xa", "xb", "size"), "trie-turns")
    h = F.crc32(F.col("conv_id").cast("string")) % (LENT + 1)
    convs = numbered.where("depth = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("base"))
    heads = numbered.where(f"depth <= {LENT} and pmod(conv_id, {FAMILY}) = 0").withColumnRenamed("conv_id", "base")
    lent = convs.where("h > 0").join(heads, "base").where("depth <= h").select("conv_id", F.lit(False).alias("own"), F.col("depth").alias("at"), "xa", "xb", "size")
    own = numbered.where(F.col("depth") > h).select("conv_id", F.lit(True).alias("own"), F.col("depth").alias("at"), "xa", "xb", "size")
    return convs.select("conv_id"), lent.union(own)


def rolled_up(nodes: DataFrame, *values: str) -> DataFrame:
    """(node, *values, n_children): the sums of ``values`` over each node's subtree, itself included.
    ``nodes``: (node, depth, above, *values)."""
    sums = [F.sum(v).alias(v) for v in (*values, "n_children")]
    apart = (F.col("depth") > 0) & (F.col("depth") % BAND == 0)

    def exploded(rows, up):
        return rows.select(F.posexplode(up), F.size("above").alias("n"), *values)             .select(F.col("col").alias("node"), *values, (F.col("pos") == F.col("n") - 1).cast("long").alias("n_children"))

    own = nodes.select("node", *values, F.lit(0).cast("long").alias("n_children"))
    in_band = own.union(exploded(nodes.where(~apart), "above"))
    in_band = saved(in_band.groupBy("node").agg(*sums), "trie-bands")
    # Band roots below the first, their band's totals, and the band root above, if it is not the trie's.
    roots = saved(nodes.where(apart).select("node", "depth", "above").join(in_band.drop("n_children"), "node"), "trie-roots")
    deepest = roots.agg(F.max("depth")).first()[0]
    if deepest is None:
        return in_band
    whole = saved(roots.select("node", *values, F.when(F.col("depth") > BAND, F.col("above")[0]).alias("up")), "trie-jumps")
    step = 1
    while step < deepest // BAND:
        given = whole.where("up is not null").groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        jump = whole.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        whole = saved(whole.join(given, "node", "left").join(jump, "up", "left")
                      .select("node", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values], F.col("upper").alias("up")), "trie-jumps")
        step *= 2
    below = exploded(roots.select("node", "above").join(whole, "node"), "above")
    return in_band.union(below).groupBy("node").agg(*sums)


def listed(rows: DataFrame, most: int = _IDS) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the digest of each node's ids, ascending, in decimal,
    comma-joined. A node that lies within a task (and has up to ``most`` ids) has it at once; of
    others the tasks give strings of ids, which pass in order through a running digest."""
    ddl = "node binary, part int, seq long, ids string, ends_sha256 string"
    schema = _schema(ddl)

    def strings(batches, part):
        node, first, seq, held = None, True, 0, []
        for b in batches:
            for x, c in zip(*[x.to_pylist() for x in b.columns]):
                if x != node and node is not None or len(held) == most:
                    whole = x != node and not first and not seq
                    text = ",".join(held)
                    yield {"node": node, "part": part, "seq": seq, "ids": None if whole else text,
                           "ends_sha256": hashlib.sha256(text.encode()).hexdigest() if whole else None}
                    first, seq, held = first and x == node, seq + 1 if x == node else 0, []
                node = x
                held.append(str(c))
        if held:
            yield {"node": node, "part": part, "seq": seq, "ids": ",".join(held), "ends_sha256": None}

    def run(batches):
        from pyspark import TaskContext

        return _batches(strings(batches, TaskContext.get().partitionId()), schema)

    got = saved(rows.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(run, ddl), "trie-ends")
    short = "node binary, ends_sha256 string"
    end = _schema(short)

    def digests(batches):
        node = None
        for b in batches:
            for x, ids in zip(*[x.to_pylist() for x in b.columns]):
                if x == node:
                    digest.update(b",")
                elif node is not None:
                    yield {"node": node, "ends_sha256": digest.hexdigest()}
                if x != node:
                    node, digest = x, hashlib.sha256()
                digest.update(ids.encode())
        if node is not None:
            yield {"node": node, "ends_sha256": digest.hexdigest()}

    split = got.where("ids is not null").repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ids")         .mapInArrow(lambda batches: _batches(digests(batches), end), short)
    return got.where("ids is null").select("node", "ends_sha256").union(split)


def trie(conversations: DataFrame, turns: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """The nodes, and (node, conv_id) for each conversation and the node that it ends in.

    ``conversations``: (conv_id), distinct. ``turns``: (conv_id, xa, xb, size, the order). A node has
    node (its name), parent (null for the root), depth, conv_id (its smallest member), n_convs
    (members), n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its subtree,
    n_convs - 1 times the size of the last turn). Conversations without turns are members of the
    root only. No conversations: no nodes.
    """
    chain = saved(folded(turns, *order).select("conv_id", "depth", "size", "node", "above", "last"), "trie-chain")
    begun = chain.where("depth = 1").select("conv_id", F.lit(True).alias("begun"))
    root = conversations.join(begun, "conv_id", "left").select(
        "conv_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("size"), F.lit(_ROOT).alias("node"),
        F.array().cast("array<binary>").alias("above"), F.col("begun").isNull().alias("last"))
    chain = chain.unionByName(root)
    nodes = chain.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
                                      F.min("size").alias("size"), F.min("above").alias("above"), F.min("last").alias("leaf"))
    nodes = saved(nodes.select("node", "n_convs", "conv_id", "depth", "above", F.expr("try_element_at(above, -1)").alias("parent"),
                               F.col("leaf").cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), "trie-nodes")
    sums = rolled_up(nodes.select("node", "depth", "above", "n_leaves", "saved_tokens"), "n_leaves", "saved_tokens")
    return nodes.select("node", "parent", "depth", "conv_id", "n_convs").join(sums, "node"), chain.where("last").select("node", "conv_id")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of the ids of the members that end
    there).

    Turns are ordered by number (null first), those of one number by role, then by a hash. Null role
    or text is empty; turns with a null conv_id take no part; repeated rows are turns of their own.
    An empty table gives no rows; further columns are ignored. A size is a number of code points.
    """
    convs, rows = rebuilt(conversations)
    nodes, ends = trie(convs, rows, "own", "at")
    nodes = saved(nodes, "trie-done")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256().hexdigest()
    return nodes.join(parents, "parent", "left").join(listed(ends), "node", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
