"""Conversation structure repair: weighted CYK parsing of turns.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. The repair grammar is in
Chomsky normal form. Its nonterminals X[p,q] are pairs of states of that pattern (nothing yet, after
a system turn, after a user turn, after an assistant turn):

    X[p,r] -> X[p,q] X[q,r]        two neighbouring spans
    X[p,q] -> turn                 kept, given another role or deleted
    X[p,q] -> (nothing)            inserted turns

The cell of a span holds, per nonterminal, the cheapest (cost, audit); the audit is the edits'
initials in order, ties go to the least string. A cell is closed under insertion: turns inserted
before or behind it count as part of it. Cells are combined bottom-up by span length. Of two
different audits of equal cost and equal span neither begins with the other (each more insertion
costs more), so a cheapest whole has cheapest parts; and since nonterminals name the states at both
ends, every split of a span gives the same cell. One split of each span (its halves) is enough, and a
conversation of n turns takes n - 1 combinations.

The same property lets a long conversation be parsed in pieces. Turns are sorted by range over the
whole table, so a conversation may lie in several tasks. One that lies within a task and is short
enough is one piece and is repaired there. Of others each piece gives its cell; the cells of a
conversation are chained to choose each piece's end states, and the pieces are repaired by them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import known, saved, slices, small_batches

#: Most turns, and characters, of a piece.
PIECE_TURNS, PIECE_CHARS = 4096, 1 << 22
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = 1, 2, 3
_ROLES = {"u": "user", "a": "assistant"}
#: state, initial -> state: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
_WHITE = "[\\x20\\x09-\\x0D]"
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

_TURNS = "array<struct<turn:long,role:string,text:string,fault:int>>"
_STATS = ("first_turn long, last_turn long, n_turns long, first_role string, last_role string, "
          "blank long, duplicate long, truncated long, illegal long")
_PIECE = f"conv_id long, part int, seq long, whole boolean, given {_TURNS}, {_STATS}, cost long, audit string, repaired array<struct<role:string,text:string>>"

Cell = dict[tuple[int, int], tuple[int, str]]


def _put(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combine(left: Cell, right: Cell) -> Cell:
    """X[p,r] -> X[p,q] X[q,r]."""
    out: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for r in range(4):
            other = right.get((q, r))
            if other is not None:
                _put(out, (p, r), (cost + other[0], audit + other[1]))
    return out


@cache
def inserted() -> Cell:
    """The cell of an empty span: nothing, or the fewest inserted turns."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    step = cell | {(p, q): (COST[INSERT], INSERT) for (p, c), q in _STEP.items() if c in _ROLES}
    while (more := combine(cell, step)) != cell:
        cell = more
    return cell


@cache
def unit(initial: str, fault: int) -> Cell:
    """The cell of one turn, closed under insertion."""
    cell: Cell = {(p, p): (COST[DELETE], DELETE) for p in range(4)}
    if fault not in (BLANK_FAULT, DUPLICATE_FAULT):
        more = TRUNCATED if fault == TRUNCATED_FAULT else 0
        for (p, c), q in _STEP.items():
            if c == initial:
                _put(cell, (p, q), (COST[KEEP] + more, KEEP))
            if c in _ROLES:
                _put(cell, (p, q), (COST[REROLE] + more, REROLE))
    return combine(combine(inserted(), cell), inserted())


def parse(turns: list[dict]) -> Cell:
    """The cell of the whole span, from spans of 1, 2, 4, ... turns."""
    row = [unit(t["role"][:1] if t["role"][:1] in ("s", "u", "a") else "", t["fault"]) for t in turns] or [inserted()]
    while len(row) > 1:
        row = [combine(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0]


def best_end(cell: Cell) -> tuple[int, str, int]:
    """(cost, audit, end state) of the cheapest repair from the first state."""
    return min((*cell[0, q], q) for q in _ENDS if (0, q) in cell)


def apply(turns: list[dict], audit: str, state: int = 0) -> list[dict]:
    """The turns that an audit leaves. The state says which role an edit gives."""
    out, at = [], 0
    for edit in audit:
        turn = None
        if edit != INSERT:
            turn, at = turns[at], at + 1
        if edit == DELETE:
            continue
        if edit == KEEP:
            role = turn["role"]
        else:
            role = _ROLES["a" if state == 2 else "u"]
        out.append({"role": role, "text": turn["text"] if turn else ""})
        state = _STEP[state, role[0]]
    return out


def _illegal(before: str | None, after: str | None) -> bool:
    return before is not None and after is not None and before[:1] + after[:1] not in ("su", "ua", "au")


def _stats(turns: list[dict]) -> dict:
    numbers = [t["turn"] for t in turns if t["turn"] is not None]
    faults = [t["fault"] for t in turns]
    return {"first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None,
            "n_turns": len(set(numbers)), "first_role": turns[0]["role"] if turns else None, "last_role": turns[-1]["role"] if turns else None,
            "blank": faults.count(BLANK_FAULT), "duplicate": faults.count(DUPLICATE_FAULT), "truncated": faults.count(TRUNCATED_FAULT),
            "illegal": sum(_illegal(a["role"], b["role"]) for a, b in zip(turns, turns[1:]))}


def _joined(a: dict, b: dict) -> dict:
    """The statistics of two neighbouring pieces, taken together."""
    out = {k: a[k] + b[k] for k in ("n_turns", "blank", "duplicate", "truncated", "illegal")}
    out["n_turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["illegal"] += _illegal(a["last_role"], b["first_role"])
    for k, (x, y) in {"first_turn": (a, b), "first_role": (a, b), "last_turn": (b, a), "last_role": (b, a)}.items():
        out[k] = x[k] if x[k] is not None else y[k]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage by crc32 of ``conv_id:turn``. copies is
    0 for a dropped row, which stays as a marker of its conversation, and 2 for a repeated one. Nulls
    count as one space, but in conv_id and turn for the key only."""
    c = known(conversations, conv_id="long", turn="long", role="string", text="string")
    key = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit(" ")) for k in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    c = c.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    return c.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in order over the whole table: by conversation, turn (null first), role and text. Each
    that is like others of its conversation comes with the first turn of those (``first``; ``many``:
    whether there are others)."""
    rows = rows.withColumn("h", F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b")))
    many = rows.where("copies > 0").groupBy("conv_id", "h").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")) \
        .where("n > 1").select(F.col("conv_id").alias("c"), F.col("h").alias("g"), "first")
    rows = rows.join(many, F.expr("conv_id <=> c and h = g"), "left") \
        .select("conv_id", "turn", "role", "text", "copies", F.col("first.turn").alias("first"), F.col("first").isNotNull().alias("many"))
    return rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")


def _fault(text: str, repeated: bool) -> int:
    last = _LAST.search(text)
    if last is None:
        return BLANK_FAULT
    return DUPLICATE_FAULT if repeated else 0 if last[1] in ".!?" else TRUNCATED_FAULT


def _piece(conv: int | None, part: int, seq: int, whole: bool, turns: list[dict]) -> dict:
    out = {"conv_id": conv, "part": part, "seq": seq, "whole": whole} | _stats(turns)
    if not whole:
        return out | {"given": turns, "cost": None, "audit": None, "repaired": None}
    cost, audit, _ = best_end(parse(turns))
    return out | {"given": None, "cost": cost, "audit": audit, "repaired": apply(turns, audit)}


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many, or of some megabytes of text."""
    out, chars = [], 0
    for r in rows:
        out.append(r)
        chars += sum(len(t["text"]) for k in ("given", "repaired") for t in r.get(k) or ())
        if len(out) == size or chars > PIECE_CHARS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _pieces(rows: DataFrame, most: int) -> DataFrame:
    schema = _arrow(_PIECE)

    def pieces(batches, part):
        conv, seq, held, chars, first, last = None, -1, [], 0, True, None
        started = False
        for s in slices(batches, 3):
            for c, turn, role, text, copies, since, many in zip(*[x.to_pylist() for x in s.columns]):
                if not started or c != conv:
                    if started:
                        # The first conversation of a task may have begun in another one.
                        yield _piece(conv, part, seq, not first and not seq, held)
                        first = False
                    started, conv, seq, held, chars, last = True, c, 0, [], 0, None
                for _ in range(copies):
                    this = (turn, role, text)
                    # Like an earlier turn's, or like the row before of the same turn.
                    held.append({"turn": turn, "role": role, "text": text, "fault": _fault(text, many and since != turn or this == last)})
                    last = this
                    chars += len(text)
                if len(held) >= most or chars >= PIECE_CHARS:
                    yield _piece(conv, part, seq, False, held)
                    seq, held, chars = seq + 1, [], 0
        if started:
            yield _piece(conv, part, seq, False, held)

    def run(batches):
        from pyspark import TaskContext

        return _batches(pieces(batches, TaskContext.get().partitionId()), schema)

    return small_batches(rows).mapInArrow(run, _PIECE)


def _chosen(cells: DataFrame) -> DataFrame:
    """(conv_id, part, seq, p, q): the states between the pieces of each conversation."""
    ddl = "conv_id long, part int, seq long, p int, q int"
    schema = _arrow(ddl)

    def ways(conv, back, now):
        q = best_end({(0, k): v for k, v in now.items()})[2]
        for part, seq, by in reversed(back):
            yield {"conv_id": conv, "part": part, "seq": seq, "p": by[q], "q": q}
            q = by[q]

    def choose(batches):
        conv, started, now, back = None, False, {}, []
        for b in batches:
            for r in b.to_pylist():
                if not started or r["conv_id"] != conv:
                    if started:
                        yield from ways(conv, back, now)
                    started, conv, now, back = True, r["conv_id"], {0: (0, "")}, []
                new, by = {}, {}
                for x in r["cell"]:
                    if x["p"] in now:
                        v = (now[x["p"]][0] + x["cost"], now[x["p"]][1] + x["audit"])
                        if x["q"] not in new or v < new[x["q"]]:
                            new[x["q"]], by[x["q"]] = v, x["p"]
                now = new
                back.append((r["part"], r["seq"], by))
        if started:
            yield from ways(conv, back, now)

    def run(batches):
        return _batches(choose(batches), schema)

    return _by_conversation(cells).mapInArrow(run, ddl)


def _by_conversation(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def _cells(pieces: DataFrame) -> DataFrame:
    ddl = "conv_id long, part int, seq long, cell array<struct<p:int,q:int,cost:long,audit:string>>"
    schema = _arrow(ddl)

    def run(batches):
        for b in batches:
            rows = zip(*[b.column(k).to_pylist() for k in ("conv_id", "part", "seq", "given")])
            yield pa.RecordBatch.from_pylist([{"conv_id": c, "part": part, "seq": seq, "cell": [
                {"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in parse(turns).items()]} for c, part, seq, turns in rows], schema)

    return pieces.select("conv_id", "part", "seq", "given").mapInArrow(run, ddl)


def _repaired(pieces: DataFrame) -> DataFrame:
    schema = _arrow(_PIECE)

    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                cost, audit = parse(r["given"])[r["p"], r["q"]]
                yield r | {"given": None, "cost": cost, "audit": audit, "repaired": apply(r["given"], audit, r["p"])}

    def run(batches):
        return _batches(rows(batches), schema)

    return pieces.mapInArrow(run, _PIECE)


def repair(conversations: DataFrame, most: int = PIECE_TURNS) -> DataFrame:
    """The repaired conversations, in pieces: conv_id, (part, seq): their order in a conversation,
    whole: whether it is the only one, statistics of the given turns, cost and audit of the edits,
    repaired: the turns (role, text) that are left.

    conversations: (conv_id, turn, role, text, copies), a row per turn or ``copies`` equal ones; none
    for 0, but the conversation stays. Turns are ordered by turn (null first), those of one turn by
    role and text. A null conv_id is one conversation. Role and text are not null. An empty table
    gives no rows; further columns are ignored.
    """
    pieces = saved(_pieces(_sorted(conversations), most), "repair-pieces")
    open_ = pieces.where("not whole")
    chosen = saved(_chosen(saved(_cells(open_), "repair-cells")), "repair-chosen")
    with_states = open_.alias("o").join(chosen.alias("s"), F.expr("o.conv_id <=> s.conv_id and o.part = s.part and o.seq = s.seq")) \
        .select("o.*", "s.p", "s.q")
    return pieces.where("whole").unionByName(_repaired(with_states)).drop("given")


_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def digests(pieces: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of ``role:text``, newline-joined). A conversation of one piece has its row at
    once; the pieces of others pass in order through a running digest, one at a time."""
    zero = F.lit(0).cast("long")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    # In Python: last_turn - first_turn might overflow.
    gaps = F.coalesce(F.expr("cast(cast(last_turn as decimal(20,0)) - first_turn + 1 - n_turns as long)"), zero)
    one = pieces.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                       F.sha2(lines, 256).alias("repaired_sha256"))
    schema = _arrow(_RESULT)

    def row(conv, sums, cost, audit, digest):
        gap = 0 if sums["first_turn"] is None else sums["last_turn"] - sums["first_turn"] + 1 - sums["n_turns"]
        return {"conv_id": conv, "gaps": gap, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} \
            | {k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}

    def rows(batches):
        conv, sums = None, None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if sums is None or r["conv_id"] != conv:
                    if sums is not None:
                        yield row(conv, sums, cost, audit, digest)
                    conv, sums, cost, audit, digest, empty = r["conv_id"], _stats([]), 0, [], hashlib.sha256(), True
                sums = _joined(sums, r)
                cost += r["cost"]
                audit.append(r["audit"])
                for t in r["repaired"]:
                    digest.update((("" if empty else "\n") + t["role"] + ":" + t["text"]).encode())
                    empty = False
        if sums is not None:
            yield row(conv, sums, cost, audit, digest)

    def run(batches):
        return _batches(rows(batches), schema)

    return one.unionByName(_by_conversation(pieces.where("not whole")).mapInArrow(run, _RESULT))
