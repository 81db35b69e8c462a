"""Personal data: base patterns, and terms that give a protected entity away.

A protected entity is a value that the base patterns find (an address, a number), and each kind
of value as a whole. The method is information-theoretic: over the whole corpus it counts in how
many different texts an entity ``c`` occurs, in how many a term ``t`` stands within ``window``
words of it, and in how many of the N texts ``t`` occurs at all (copies of a text are one text
in all four). The term discloses the entity if the
pointwise mutual information reaches a share of the entity's information content,

    log(p(c|t) / p(c)) >= alpha log(1 / p(c)),  p(c) = n(c) / N,
    p(c|t) = (n(c,t) + prior p(c)) / (n(t) + prior).

The prior, in texts, stands for what is expected without evidence, so that a term seen once or
twice has to disclose more than one seen often; no pair is left out for being rare (unless by
``min_texts``). Such terms are marked wherever they occur; ``sanitise`` generalises or removes
them.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import broadcastable, known, row_key, saved, slices

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Terms that are sent to every task at most (some 20 MB); beyond, they are joined instead.
MAX_SENT = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
# A match can only begin where a run of digits begins; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words of a UTF-8 text in lower case (A-Z only), and the same words in a string.
_WORD_BYTES = re.compile(rb"[a-z0-9\x80-\xff]+")
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Every match holds one @: the characters before it as far as they go, a domain after."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text)
                if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _entity(text: str, span: tuple[int, int, int]) -> str:
    raw = text[span[0]:span[2]]
    return KINDS[span[1]] + ":" + (raw.lower() if span[1] == 0 else raw if span[1] == 1 else _digits(raw))


def _lower(word: str) -> str:
    return word.encode().lower().decode()


def words(text: str) -> list[bytes]:
    return _WORD_BYTES.findall(text.encode().lower())


def near_entities(text: str, window: int) -> set[tuple[str, str]]:
    """(entity, term) pairs of a text: the ``window`` words on either side of each entity, for
    the value (``kind:value``) and for its kind (``kind``)."""
    out = set()
    spans = base_spans(text)
    if not spans:
        return out
    found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    i = 0
    for span in spans:
        while i < len(found) and found[i][1] <= span[0]:
            i += 1
        j = i
        while j < len(found) and found[j][0] < span[2]:
            j += 1
        near = [_lower(text[a:b]) for a, b in chain(found[max(0, i - window):i], found[j:j + window])]
        for e in (_entity(text, span), KINDS[span[1]]):
            out.update((e, t) for t in near)
            out.add((e, ""))  # the entity itself
    return out


def _pairs(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for s in slices(batches):
            got = [(p, h) for h, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist()) for p in near_entities(t or "", window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p, _ in got], pa.string()), pa.array([p[1] for p, _ in got], pa.string()),
                 pa.array([h for _, h in got], pa.int64())], ["entity", "term", "h"])

    return docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "entity string, term string, h long")


def _copies(docs: DataFrame) -> DataFrame:
    """(h, m): texts by hash that m rows hold, for m from 2 on."""
    return saved(docs.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("m")).where("m > 1"), "pii-copies")


def _term_counts(docs: DataFrame, copies: DataFrame, only: set[bytes] | None, max_sent: int = MAX_SENT) -> DataFrame:
    """(term, n): different texts that hold the term. Tasks add up what they see before the
    shuffle, a bounded number of terms at a time, apart for each number m of copies: rows that
    hold a text of m copies come m times, so their number is divided by m."""

    def flush(n):
        return pa.RecordBatch.from_arrays([pa.array([t.decode() for t, _ in n], pa.string()), pa.array([m for _, m in n], pa.int64()),
                                           pa.array(list(n.values()), pa.int64())], ["term", "m", "n"])

    def run(batches):
        n = Counter()
        for s in slices(batches, 0):
            for t, m in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                seen = set(words(t or ""))
                n.update((x, m) for x in (seen if only is None else seen & only))
            if len(n) > MAX_SENT:
                yield flush(n)
                n.clear()
        yield flush(n)

    if broadcastable(copies, max_sent):
        copies = F.broadcast(copies)
    each = docs.withColumn("h", F.xxhash64("text")).join(copies, "h", "left").select("text", F.coalesce("m", F.lit(1)).alias("m"))
    return each.mapInArrow(run, "term string, m long, n long").groupBy("term", "m").agg(F.sum("n").alias("n")) \
        .groupBy("term").agg(F.sum(F.expr("n div m")).alias("n"))


def _sent(terms: DataFrame, max_sent: int) -> set[bytes] | None:
    """The terms, if there are at most so many, else None."""
    if not broadcastable(terms, max_sent):
        return None
    return {r[0].encode() for r in terms.select("term").distinct().toLocalIterator()}


def disclosing_terms(docs: DataFrame, window: int = 8, min_texts: int = 1, alpha: float = 0.9,
                     max_sent: int = MAX_SENT, prior: float = 1.0) -> DataFrame:
    """(term, entity, share): the terms that disclose an entity (``kind:value``, or ``kind`` for
    all of its values); share is PMI / IC."""
    d = known(docs, text="string")
    pairs = saved(_pairs(d, window).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
                  .where(F.col("n_ct") >= min_texts), "pii-pairs")
    d = d.where("text != ''")
    copies = _copies(d)
    total = d.count() - (copies.agg(F.sum(F.col("m") - 1)).first()[0] or 0)
    joint, own = pairs.where("term != ''"), pairs.where("term = ''").select("entity", F.col("n_ct").alias("n_c")).where(F.col("n_c") < total)
    kind = F.col("entity").isin(*KINDS)  # few and hot: sent, not dealt by entity
    joint = joint.where(~kind).join(own.where(~kind), "entity").union(joint.where(kind).join(F.broadcast(own.where(kind)), "entity"))
    p, weight = F.col("n_c") / F.lit(float(total)), F.lit(float(prior))
    joint = saved(joint.withColumn("most", (F.col("n_ct") + weight * p) / F.pow(p, F.lit(1.0 - alpha)) - weight), "pii-joint")
    # Terms in more documents than any of their entities allows go before the join, so no common word is a hot key.
    allowed = saved(joint.groupBy("term").agg(F.max("most").alias("allowed")).where(f"allowed >= {1 - 1e-9}"), "pii-terms")
    counts = saved(_term_counts(d, copies, _sent(allowed, max_sent), max_sent).join(allowed, "term").where("n <= allowed * (1 + 1e-9)").select("term", "n"), "pii-counts")
    if broadcastable(counts, max_sent):
        counts = F.broadcast(counts)
    share = F.log((F.col("n_ct") + weight * p) / ((F.col("n") + weight) * p)) / F.log(1 / p)
    found = joint.join(counts, "term").withColumn("share", share)
    return saved(found.where(F.col("share") >= alpha).select("term", "entity", "share"), "pii-disclosing")


def _free(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Those of the spans, by start, that meet no base span."""
    out, i = [], 0
    ends = sorted((s, e) for s, _, e in base)
    for s, e in found:
        while i < len(ends) and ends[i][1] <= s:
            i += 1
        if not any(a < e and s < b for a, b in ends[i:i + len(KINDS)]):
            out.append((s, e))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def find(docs: DataFrame, terms: DataFrame | None = None, max_sent: int = MAX_SENT) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all
    spans as kind:start:end, by start) and n_term.

    terms: from ``disclosing_terms``. Null texts are empty, null ids stay null, repeated rows
    are judged each, further columns are ignored, an empty table gives no rows.
    """
    d = known(docs, doc_id="long", text="string")
    sent = set() if terms is None else _sent(terms, max_sent)

    def run(batches):
        for s in slices(batches):
            cols = [[] for _ in range(7)]
            for text in s.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                named = [(a, k, b, KINDS[k]) for a, k, b in base]
                more = []
                if sent and not sent.isdisjoint(words(text)):
                    more = _free([(m.start(), m.end()) for m in _WORD.finditer(text) if m[0].encode().lower() in sent], base)
                n = Counter(k for _, k, _ in base)
                listed = _joined(named)
                for c, v in zip(cols, (n[0], n[1], n[2], n[3], hashlib.sha256(listed.encode()).hexdigest(),
                                       _joined(named + [(a, 9, b, TERM) for a, b in more]), len(more))):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([s.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long"
    if sent is not None:
        return d.mapInArrow(run, schema)
    sent = set()
    more = (d.select(row_key().alias("key"), "text").mapInArrow(_positions, "d long, t long, term string, a int, b int")
            .distinct().join(terms.select("term").distinct(), "term")
            .groupBy("d", "t").agg(F.collect_list(F.struct("a", "b")).alias("more")))  # no more than the text has words
    both = d.withColumn("k", row_key()).join(more, (F.col("k.d") == more.d) & (F.col("k.t") == more.t), "left")

    def merge(batches):
        for s in slices(batches):
            out = next(run(iter([s.select([0, 1])]))).to_pydict()
            for i, (text, extra) in enumerate(zip(s.column(1).to_pylist(), s.column(2).to_pylist())):
                base_ = base_spans(text or "")
                free = _free(sorted((x["a"], x["b"]) for x in extra or ()), base_)
                out["n_term"][i] = len(free)
                out["spans"][i] = _joined([(a, k, b, KINDS[k]) for a, k, b in base_] + [(a, 9, b, TERM) for a, b in free])
            yield pa.RecordBatch.from_pydict(out, pa.schema([(n, pa.int64() if n not in ("base_sha256", "spans") else pa.string()) for n in out]))

    return both.select("doc_id", "text", "more").mapInArrow(merge, schema)


def _positions(batches):
    """Every word of every text with its place: the way for more terms than can be sent."""
    for s in slices(batches):
        rows = [(k["d"], k["t"], _lower(m[0]), m.start(), m.end())
                for k, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist()) for m in _WORD.finditer(t or "")]
        yield pa.RecordBatch.from_pylist([dict(zip(("d", "t", "term", "a", "b"), r)) for r in rows],
                                         pa.schema([("d", pa.int64()), ("t", pa.int64()), ("term", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))


def sanitise(docs: DataFrame, found: DataFrame, remove: bool = False) -> DataFrame:
    """(doc_id, text): base spans become ``[KIND]``; disclosing terms go (``remove``) or are
    generalised to ``[NUMBER]`` or ``[WORD]``. ``found``: from ``find``; ids must be unique."""
    both = known(docs, doc_id="long", text="string").join(found.select("doc_id", "spans"), "doc_id")

    def run(batches):
        for s in slices(batches):
            out = []
            for text, spans in zip(s.column(1).to_pylist(), s.column(2).to_pylist()):
                text, parts, at = text or "", [], 0
                for span in spans.split(",") if spans else ():
                    kind, a, b = span.split(":")
                    if int(a) >= at:
                        word = text[int(a):int(b)]
                        parts += [text[at:int(a)], f"[{kind.upper()}]" if kind != TERM else "" if remove
                                  else "[NUMBER]" if word.isdigit() else "[WORD]"]
                        at = int(b)
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return both.mapInArrow(run, "doc_id long, text string")
