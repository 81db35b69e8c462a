"""Secrets: base patterns, and a linear-chain conditional random field over tokens.

The field tags each token as the begin of a secret, inside one, or outside. Its features are
the token's shape, length and characters, the two words before it and the one after, and
coarse features of the whole file. It learns from a bounded, documented sample: per kind
``sample`` excerpts around a base match (whose values are the labels), and twice as many from
texts without one, each of the texts with the smallest hashes; in a text, hashes decide which match
and which place. In half of them keywords and prefixes are overwritten with random letters, while
the labels stay: what base patterns go by is then no clue, and the field learns how a secret itself
and its surroundings look. Every whole text is then decoded by Viterbi.

Decoding is exact but skips what is certain: where a token's score for "outside" exceeds the
others by more than transitions can ever make up, every best path passes "outside" there. Only
the runs of tokens between such points need the dynamic programme.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.llm.common import known, slices

KINDS = ("assign", "access", "hex")
CRF = "crf"
#: Keywords, patterns and least lengths of the base kinds (fixed values).
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*b"0123456789abcdef"]] = True

_TOKEN = re.compile(r"[\w+/.-]+|[^\w\s+/.-]")
O, B, I = 0, 1, 2
BUCKETS = 1 << 13
_SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"},
                        **{c: "9" for c in "0123456789"}})
_AGAIN = re.compile(r"(.)\1+")
#: Tokens whose features a worker keeps; more are worked out again.
CACHE = 300_000


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base matches, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) >= 24:
        other = np.flatnonzero(~_HEX_BYTE[raw])
        if len(raw) - 1 - (other[-1] if len(other) else -1) >= 24 or (len(other) and (other[0] >= 24 or (np.diff(other) > 24).any())):
            out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _form(t: str) -> tuple[str, int, int, int]:
    """What a token looks like: its shape without repeats, length class, and for tokens over
    15 characters the eighths that are digits and that are different characters. Long mixtures of
    letters and digits look alike, whatever their alphabet: what is learnt of one holds for others."""
    n = len(t)
    if t.isalpha() and n < 16:
        return ("a" if t.islower() else "A" if t.isupper() else "Aa" if t[1:].islower() else "aA"), n.bit_length(), 0, 0
    digits = sum(map(str.isdigit, t)) if n >= 16 else 0
    if n <= 8 * digits <= 7 * n and t.isalnum():
        return "*", max(6, min(n.bit_length(), 8)), 1, min(2, 1 + len(set(t)) // 8)
    shape = _AGAIN.sub(r"\1", t.translate(_SHAPE))[:12]
    if n < 16:
        return shape, n.bit_length(), 0, 0
    return shape, min(n.bit_length(), 8), 1 + 8 * digits // n, 1 + min(7, 8 * len(set(t)) // n)


def _own(form: tuple[str, int, int, int]) -> list[int]:
    shape, size, digits, unlike = form
    return [_hash(f"s={shape}"), _hash(f"l={size}"), _hash(f"k={len(set(shape))}{len(shape)}"), _hash(f"d={digits}"),
            _hash(f"u={unlike}")]


def _seen(form: tuple[str, int, int, int], t: str) -> list[int]:
    """Buckets of what a neighbour sees of a token: its word, if short, and its form."""
    return [_hash("w=" + t.lower() if len(t) < 16 else "w="), _hash(f"r={form[0][:3]}{form[2] > 0}")]


def _file_feature(text: str) -> int:
    n = len(text) + 1
    return min(7, 400 * (text.count("=") + text.count(":") + text.count('"')) // n)


class Field:
    """The model: ``weights[slot]`` is (BUCKETS, 3); slots: own, two before, one before, after."""

    def __init__(self, weights: np.ndarray, files: np.ndarray, moves: np.ndarray):
        self.weights, self.files, self.moves = weights, files, moves
        self.margin = 2 * float(moves.max() - moves.min())
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.forms: dict[tuple, int] = {}
        self.form_rows = np.zeros((256, 4, 3), np.float32)
        self.rows = np.zeros((1 << 14, 4, 3), np.float32)

    def _new_form(self, form: tuple) -> int:
        i = self.forms[form] = len(self.forms)
        if i == len(self.form_rows):
            self.form_rows = np.concatenate([self.form_rows, np.zeros_like(self.form_rows)])
        seen = _seen(form, "")[1]
        self.form_rows[i] = np.stack([self.weights[0][_own(form)].sum(0), *(self.weights[k][seen] for k in (1, 2, 3))])
        return i

    def _add(self, tokens: list[str]) -> None:
        """Scores of new tokens: of their form, and of their word as a neighbour."""
        at, end = len(self.index), len(self.index) + len(tokens)
        while end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.index.update(zip(tokens, range(at, end)))
        kinds = np.fromiter((self.forms[f] if f in self.forms else self._new_form(f) for f in map(_form, tokens)), np.int64, len(tokens))
        words = np.fromiter((zlib.crc32(b"w=" + t.lower().encode()) if len(t) < 16 else zlib.crc32(b"w=") for t in tokens),
                            np.int64, len(tokens)) % BUCKETS
        self.rows[at:end] = self.form_rows[kinds]
        self.rows[at:end, 1:] += self.weights[1:, words].transpose(1, 0, 2)

    def scores(self, text: str, tokens: list[str]) -> np.ndarray:
        if len(self.index) > CACHE:
            self._forget()
        index = self.index
        if new := [t for t in set(tokens) if t not in index]:
            self._add(new)
        ids = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        e = self.rows[ids, 0] + self.files[_file_feature(text)]
        e[2:] += self.rows[ids[:-2], 1]
        e[1:] += self.rows[ids[:-1], 2]
        e[:-1] += self.rows[ids[1:], 3]
        return e

    def tags(self, e: np.ndarray) -> np.ndarray:
        """The best path (Viterbi), over the runs that are not certainly outside."""
        out = np.zeros(len(e), np.int8)
        doubt = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.margin)
        if len(doubt):
            for run in np.split(doubt, np.flatnonzero(np.diff(doubt) > 1) + 1):
                a, b = run[0], run[-1] + 1
                best = e[a] + (self.moves[O] if a else 0)
                back = np.zeros((b - a, 3), np.int8)
                for k in range(a + 1, b):
                    step = best[:, None] + self.moves
                    back[k - a] = step.argmax(0)
                    best = step.max(0) + e[k]
                if b < len(e):
                    best = best + self.moves[:, O]
                tag = int(best.argmax())
                for k in range(b - 1, a - 1, -1):
                    out[k] = tag
                    tag = int(back[k - a, tag])
        return out

    def secrets(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the tagged secrets of a whole text."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return []
        tags = self.tags(self.scores(text, tokens))
        if not tags.any():
            return []
        out, places = [], [m.span() for m in _TOKEN.finditer(text)]
        for k in np.flatnonzero(tags):
            if tags[k] == I and out and out[-1][2] == k - 1:
                out[-1] = (out[-1][0], places[k][1], k)
            else:  # a begin, or an inside without one
                out.append((*places[k], k))
        return [(s, e) for s, e, _ in out]


def _hidden(text: str, spans: list[tuple[int, int, int, int]], chance: random.Random) -> str:
    """The text with other letters, of the same case, in the keywords and prefixes of its matches."""
    out, done = [], 0
    for start, kind, _, value in spans:
        stop = (value, start + 4, start)[kind]
        if start >= done and stop > start:
            other = [chance.choice(string.ascii_uppercase if c.isupper() else string.ascii_lowercase) if c.isalpha() else c for c in text[start:stop]]
            out += [text[done:start], *other]
            done = stop
    return "".join(out) + text[done:]


def _excerpt(text: str, spans: list[tuple[int, int, int, int]], middle: int, excerpt: int, chance: random.Random) -> tuple[str, list[int]]:
    """The part of a text around a place, and where its values begin and end, one after the other."""
    at = max(0, min(middle - excerpt // 2, len(text) - excerpt))
    stop = at + excerpt
    if chance.random() < 0.5:
        text = _hidden(text, spans, chance)
    return text[at:stop], [min(max(x - at, 0), excerpt) for _, _, e, v in spans if v < stop and e > at for x in (v, e)]


def _labelled(text: str, values: list[int]) -> tuple[list[str], list[int]]:
    """Tokens of an excerpt, and their tags."""
    tokens, tags, before = [], [], -1
    for m in _TOKEN.finditer(text):
        inside = next((i for i in range(0, len(values), 2) if values[i] < m.end() and m.start() < values[i + 1]), -1)
        tokens.append(m[0])
        tags.append(O if inside < 0 else I if inside == before else B)
        before = inside
    return tokens, tags


def _excerpts(docs: DataFrame, sample: int, excerpt: int) -> list[tuple[list[str], list[int], int]]:
    """The bounded sample. A task keeps the smallest hashes of its own rows, so little is shuffled."""
    fields = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("text", pa.string()), ("values", pa.list_(pa.int32())), ("file", pa.int32())])
    bounds = {-1: 2 * sample, **{kind: sample for kind in range(len(KINDS))}}  # -1: no match

    def run(batches):
        kept = {kind: {} for kind in bounds}
        for s in slices(batches):
            for h, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                text = text or ""
                spans, chance = base_spans(text), random.Random(h)
                places = {}
                for start, kind, _, _ in spans:
                    places.setdefault(kind, []).append(start)
                for kind, starts in (places or {-1: range(len(text) + 1)}).items():
                    got = kept[kind]
                    if h in got or len(got) >= bounds[kind] and h > max(got):
                        continue
                    got[h] = (*_excerpt(text, spans, chance.choice(starts), excerpt, chance), _file_feature(text))
                    if len(got) > bounds[kind]:
                        del got[max(got)]
        rows = [{"kind": kind, "h": h, "text": t, "values": v, "file": f} for kind, got in kept.items() for h, (t, v, f) in got.items()]
        yield pa.RecordBatch.from_pylist(rows, fields)

    got = docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "kind int, h long, text string, values array<int>, file int")
    one = got.groupBy("kind", "h").agg(F.min(F.struct("text", "values", "file")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("h"))
    rows = one.withColumn("nth", nth).where(F.col("nth") <= F.when(F.col("kind") < 0, 2 * sample).otherwise(sample)).orderBy("kind", "nth").collect()
    return [(*_labelled(r.x["text"], r.x["values"]), r.x["file"]) for r in rows]


def train(docs: DataFrame, sample: int = 120, excerpt: int = 500, rounds: int = 40, rate: float = 0.15,
          decay: float = 1e-4) -> Field:
    """Fit the field by gradient ascent (Adagrad) on the log likelihood of the sample. With no
    base match in the corpus there is nothing to learn: the field tags everything outside."""
    data = [x for x in _excerpts(known(docs, text="string"), sample, excerpt) if x[0]]
    weights, files, moves = np.zeros((4, BUCKETS, 3)), np.zeros((8, 3)), np.zeros((3, 3))
    if not any(any(tags) for _, tags, _ in data):
        files[:, O] = 1.0
        return Field(weights, files, moves)
    seqs = []
    for tokens, tags, file in data:
        forms = [_form(t) for t in tokens]
        seqs.append((np.array([_own(f) for f in forms]), np.array([_seen(f, t) for f, t in zip(forms, tokens)]), np.array(tags), file))
    seqs.sort(key=lambda s: -len(s[2]))
    n, most = len(seqs), len(seqs[0][2])
    live = np.array([len(s[2]) for s in seqs])
    own = np.zeros((n, most, seqs[0][0].shape[1]), int)
    seen = np.zeros((n, most, 2), int)
    gold = np.zeros((n, most), int)
    for i, (a, b, t, _) in enumerate(seqs):
        own[i, :len(t)], seen[i, :len(t)], gold[i, :len(t)] = a, b, t
    real = np.arange(most) < live[:, None]
    file = np.array([s[3] for s in seqs])
    eye = np.eye(3)
    sums = [np.zeros_like(x) for x in (weights, files, moves)]

    def added(buckets, g):
        """Sums of g (n, most, 3) per bucket, for each of the token's buckets."""
        at = buckets[real].ravel()
        return np.stack([np.bincount(at, np.repeat(g[real][:, y], buckets.shape[2]), BUCKETS) for y in range(3)], 1)

    shifts = ((1, 2, 0), (2, 1, 0), (3, 0, 1))  # slot, how far after, how far before the seen token
    for _ in range(rounds):
        e = weights[0][own].sum(2) + files[file][:, None]
        for slot, back, ahead in shifts:
            c = weights[slot][seen].sum(2) * real[..., None]
            if back:
                e[:, back:] += c[:, :-back]
            if ahead:
                e[:, :-ahead] += c[:, ahead:]
        fwd = np.zeros((n, most, 3))
        fwd[:, 0] = e[:, 0]
        for k in range(1, most):
            x = fwd[:, k - 1, :, None] + moves
            top = x.max(1)
            fwd[:, k] = np.log(np.exp(x - top[:, None]).sum(1)) + top + e[:, k]
        back_ = np.zeros((n, most, 3))
        for k in range(most - 2, -1, -1):
            x = moves + (e[:, k + 1] + back_[:, k + 1])[:, None]
            top = x.max(2)
            back_[:, k] = np.where((k + 1 < live)[:, None], np.log(np.exp(x - top[..., None]).sum(2)) + top, 0)
        last = fwd[np.arange(n), live - 1]
        z = np.log(np.exp(last - last.max(1, keepdims=True)).sum(1)) + last.max(1)
        p = np.exp(fwd + back_ - z[:, None, None]) * real[..., None]
        g = (eye[gold] - p) * real[..., None]
        both = np.exp(fwd[:, :-1, :, None] + moves + (e + back_)[:, 1:, None] - z[:, None, None, None]) * real[:, 1:, None, None]
        g_moves = np.einsum("nti,ntj->ij", eye[gold][:, :-1] * real[:, 1:, None], eye[gold][:, 1:]) - both.sum((0, 1))
        g_weights, g_files = np.zeros_like(weights), np.zeros_like(files)
        g_weights[0] = added(own, g)
        np.add.at(g_files, file, g.sum(1))
        for slot, back, ahead in shifts:
            c = np.zeros_like(g)
            if back:
                c[:, :-back] = g[:, back:]
            if ahead:
                c[:, ahead:] = g[:, :-ahead]
            g_weights[slot] = added(seen, c)
        for x, s, gx in zip((weights, files, moves), sums, (g_weights, g_files, g_moves)):
            gx = gx - decay * n * x
            s += gx * gx
            x += rate * gx / (np.sqrt(s) + 1e-8)
    return Field(weights.astype(np.float32), files.astype(np.float32), moves.astype(np.float32))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all spans as
    kind:start:end, by start) and n_crf, the field's spans outside every base span.

    The field (some 400 kB, whatever the corpus) goes to the tasks; there is no shuffle. Null
    texts are empty, null ids stay null, repeated rows are judged each, further columns are
    ignored, an empty table gives no rows. Texts of any length are tagged whole.
    """

    def joined(spans):
        return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))

    def run(batches):
        for s in slices(batches):
            cols = [[] for _ in range(6)]
            for text in s.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = [x for x in field.secrets(text) if not any(a < x[1] and x[0] < b for a, _, b, _ in base)] if field else []
                named = [(a, k, b, KINDS[k]) for a, k, b, _ in base]
                n = Counter(k for _, k, _, _ in base)
                for c, v in zip(cols, (n[0], n[1], n[2], hashlib.sha256(joined(named).encode()).hexdigest(),
                                       joined(named + [(a, 9, b, CRF) for a, b in more]), len(more))):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([s.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"])

    return known(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")
