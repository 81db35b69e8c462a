"""Operators on conversations against brute force, on a small table with every awkward row."""

import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair as cr, prefix_trie as pt

rng = random.Random(3)
SAYS = ["Yes.", "No", "Why?", "", " \t", "été !", "Stop!\n", "a. b", "中文。", "x" * 3000 + "."]
ROWS = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]) if t else rng.choice(["system", "user", "assistant"]), rng.choice(SAYS) + str(t) * (t % 2))
        for c in range(0, 230) if c not in (100, 117) for t in range(rng.randint(1, 9))]
ROWS += [(c, t, *x) for c in (300, 301, 302, 7000) for t, x in enumerate([("user", "Hello."), ("assistant", "Hi."), ("user", "Bye."), ("assistant", "Bye."), ("user", "?"), ("assistant", "!")])]
# A long one, gaps, null turns, roles and texts, rows that are equal, other initials; a conversation without id.
ROWS += [(500, t, "user" if t % 2 else "assistant", f"Say {t % 90}.") for t in range(700)]
ROWS += [(501, None, "system", "Be kind."), (501, 3, "user", None), (501, 9, None, "Hm."), (501, 9, "User", "Hm."), (501, 12, "assistant", "Ok."), (501, -4, "", "Ok.")]
ROWS += [(502, 1, "user", "Same."), (502, 1, "user", "Same."), (502, 2, "assistant", "Same."), (-5, 0, "user", "Minus."), (503, None, "user", "A."), (503, None, "user", "A.")]
NAMELESS = [(None, 1, "user", "Nobody."), (None, 2, "assistant", "Nobody")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS + NAMELESS, "conv_id long, turn long, role string, text string") \
        .selectExpr("*", "1 as depth", "'x' as node", "2 as h", "3 as kind", "4 as part", "5 as first").repartition(5)


@pytest.fixture()
def split(spark):
    """Many tasks, so that conversations lie in several."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


# --- repair ---

def cheapest(turns):
    """Least (cost, audit) by search over edits one at a time."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(turns) and state in ("", "a"):
            return cost, audit, out[1:]
        for i, s in step[state].items():
            if i != "s":
                role = {"u": "user", "a": "assistant"}[i]
                heapq.heappush(heap, (cost + 5, audit + "I", at, s, f"{out}\n{role}:"))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, out))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                for i, s in step[state].items():
                    if role[:1] == i:
                        heapq.heappush(heap, (cost + more, audit + "K", at + 1, s, f"{out}\n{role}:{text}"))
                    if i != "s":
                        to = {"u": "user", "a": "assistant"}[i]
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, s, f"{out}\n{to}:{text}"))


def brute_repair(rows):
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for c, t, role, text in rows:
            if c == conv:
                role, text = " " if role is None else role, " " if text is None else text
                kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                kept += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, turns = set(), []
        for _, role, text in kept:
            solid = text.strip(" \t\n\v\f\r")
            turns.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        n = [t for t, *_ in kept if t is not None]
        faults = [f for *_, f in turns]
        cost, audit, repaired = cheapest(turns)
        out.append((conv, max(n) - min(n) + 1 - len(set(n)) if n else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit, sha(repaired)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("most", [3, 4096])
def test_repair(table, split, most):
    got = found(cr.digests(cr.repair(cr.damaged(table), most)))
    assert got == brute_repair(ROWS + NAMELESS)
    assert sum(r[5] for r in got) and {"K", "R", "D"} == set("".join(r[7] for r in got)) and any(r[7] == "" for r in got)


def test_repair_of_nothing(table):
    assert cr.digests(cr.repair(cr.damaged(table.where("false")))).collect() == []


def test_every_split_gives_the_same_cell():
    for _ in range(60):
        turns = [{"role": rng.choice("suax"), "text": "t", "fault": rng.choice([0, 0, 0, 1, 2, 3])} for _ in range(rng.randint(2, 7))]
        whole = cr.parse(turns)
        for k in range(1, len(turns)):
            assert cr.combine(cr.parse(turns[:k]), cr.parse(turns[k:])) == whole
        cost, audit, out = cheapest([(t["role"], "t", {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}[t["fault"]]) for t in turns])
        assert cr.best_end(whole)[:2] == (cost, audit)
        assert "\n".join(f"{t['role']}:{t['text']}" for t in cr.apply(turns, audit)) == out


def test_repaired_turns_come_back(table):
    r = cr.repair(cr.damaged(table)).where("conv_id = 300").first()
    assert r.repaired and {t.role for t in r.repaired} <= {"system", "user", "assistant"}


# --- trie ---

def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    for v in convs.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    turns = {c: [r[1:] for r in v] for c, v in convs.items()}
    whole = {}
    for c in turns:
        h = crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, sums = {}, {k: [0, 0] for k in members}
    for k in members:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            sums[k[:d]][0] += k not in children
            sums[k[:d]][1] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children.get(k, 0), *sums[k],
                   sha(",".join(map(str, sorted(c for c in m if whole[c] == k))))) for k, m in members.items())


#: Turns of one number and role are ordered by a hash; those here are equal or alone.
TRIE_ROWS = [r for r in ROWS if r[:2] != (501, 9)]


def test_trie(spark, split):
    df = spark.createDataFrame(TRIE_ROWS + NAMELESS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'x' as node", "2 as h").repartition(5)
    got = sorted(tuple(r) for r in pt.prefix_trie(df).collect())
    want = brute_trie(TRIE_ROWS)
    assert got == want
    assert max(r[1] for r in got) > 600 and max(r[3] for r in got) > 200


def test_trie_of_nothing(table):
    assert pt.prefix_trie(table.where("false")).collect() == []
    assert pt.prefix_trie(table.where("conv_id is null")).collect() == []


def test_conversations_in_several_tasks(spark, split):
    turns = spark.range(1000).select(F.expr("if(id < 30, 1, if(id < 950, 2, 3))").cast("long").alias("conv_id"), F.col("id").alias("at"),
                                     F.xxhash64(F.col("id") % 7).alias("xa"), F.lit(0).cast("long").alias("xb"), F.lit(1).cast("long").alias("size"))
    rows = sorted(pt.folded(turns, "at").collect(), key=lambda r: (r.conv_id, r.depth))
    assert [r.depth for r in rows] == [*range(1, 31), *range(1, 921), *range(1, 51)]
    names = {}
    for r in rows:
        path = names.setdefault(r.conv_id, [bytes(16)])
        keep = r.depth % pt.BAND or pt.BAND
        assert [bytes(x) for x in r.above] == path[-keep:]
        path.append(bytes(r.node))
    assert len({x for p in names.values() for x in p[1:]}) == 1000 and [r.depth for r in rows if r.last] == [30, 920, 50]


def test_digests_of_ids(spark, split):
    rows = [(bytes([k]), c) for k, n in ((1, 1), (2, 40), (3, 3), (4, 4), (5, 0), (6, 300)) for c in range(-2, n - 2)]
    df = spark.createDataFrame(rows, "node binary, conv_id long").repartition(3)
    want = {k: sha(",".join(str(c) for x, c in rows if x == k)) for k, _ in rows}
    for most in (3, 1 << 16):
        assert {bytes(r.node): r.ends_sha256 for r in pt.listed(df, most).collect()} == want
