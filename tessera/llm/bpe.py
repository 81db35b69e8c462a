"""BPE encoding and decoding by a prefix-sharing trie.

The pre-tokenizer cuts a text into pieces. The distinct pieces of a slice of rows go into a
trie, whose nodes are visited depth first. Each node keeps one state: the last token of the
encoding of the path that leads to it. That token is the one suffix ``t`` of the path that is
a token and may stand after the last token of the path without ``t``; two tokens may be
neighbours if merging their joint bytes keeps the border between them. So a prefix that many
pieces share is encoded once, and a piece's tokens are read by walking the states back.

Encodings of pieces are kept while a task runs, about twice ``CACHE`` of them. That bounds
memory and never changes results.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import known, slices, small_batches

CACHE = 200_000
#: Borders of tokens whose check is kept, at most.
BORDERS = 200_000
#: Bytes of text cut into pieces at a time.
SLICE = 1 << 20
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level pre-tokenizer's pattern (fixed values).
_PIECE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + "]+(?![^" + _SPACE + "])|["
    + _SPACE + "]+")
#: The same for texts below U+0250, whose letters and numbers are these; the standard
#: library's engine is several times faster.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND_LATIN = re.compile("[ɐ-\U0010ffff]")


def pieces(text: str) -> list[str]:
    """A text without special tokens, cut as the byte-level pre-tokenizer cuts it."""
    return (_PIECE if _BEYOND_LATIN.search(text) else _LATIN_PIECE).findall(text)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE file (``vocab``, ``merges``, added tokens).

    Tokens are ids; ``rank`` orders them by the merge that makes them (-1: a single byte).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of_char = _byte_chars()
        raw = {t: bytes(of_char[c] for c in t) for t in spec["model"]["vocab"]}
        self.id_of = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        size = max(self.bytes_of) + 1
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merge: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (self.id_of[raw[t]] for t in (m.split(" ") if isinstance(m, str) else m))
            made = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            if self.rank[made] >= 0:
                raise ValueError("two merges make one token")
            self.rank[made], self.left[made], self.right[made], self.merge[a, b] = r, a, b, r
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        ends: dict[bytes, set[int]] = {b: {len(b), 1} for b in self.id_of if len(b) < 3}
        for b in self.id_of:
            if len(b) > 2:
                ends.setdefault(b[-3:], {1, *([2] if b[-2:] in self.id_of else [])}).add(len(b))
        #: Lengths, longest first, of the tokens that end a path with these last three bytes.
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}
        #: Tokens whose own bytes encode to just them.
        self.alone = {t: self.rank[t] < 0 or self._stable(self.left[t], self.right[t], self.rank[t])
                      for t in self.id_of.values()}
        self.beside: dict[int, bool] = {}
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}

    def _stable(self, x: int, y: int, but: int = -1) -> bool:
        """Whether merging the joint bytes of x and y leaves the border between them (up to the
        merge of rank ``but``, if given).

        Merges are undone on both sides of the border, the latest first. While x and y meet at
        the border, their own merge must not come before the one that took either of them
        into a longer token; of equal ranks the left one comes first.
        """
        rank, until = self.rank, 1 << 60
        if but >= 0:
            until = but
        while True:
            r = self.merge.get((x, y))
            if r is not None and r < until:
                return False
            if rank[x] > rank[y]:
                until, x = rank[x], self.right[x]
            elif rank[y] >= 0:
                until, y = rank[y] + 1, self.left[y]
            else:
                return True

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, by one depth-first walk over their trie.

        The trie is kept as the sorted word list: that is its preorder, and the path of a word
        branches off its predecessor's where their common prefix ends. ``state[k]`` is the
        last token of the encoding of the current path's first k bytes.
        """
        out: dict[bytes, list[int]] = {}
        id_of, ends, alone, beside = self.id_of, self.ends, self.alone, self.beside
        state, before = [-1], b""
        append = state.append
        for w in sorted(words):
            n, k, shared = len(w), 0, min(len(before), len(w))
            while k < shared and before[k] == w[k]:
                k += 1
            del state[k + 1:]
            while k < n:
                k += 1
                tail = w[k - 3:k] if k > 2 else w[:k]
                for size in ends.get(tail) or ends.get(tail[1:], (1,)):
                    if size > k or (t := id_of.get(w[k - size:k])) is None:
                        continue
                    if size == k:
                        ok = alone[t]
                    elif (ok := beside.get(pair := state[k - size] << 32 | t)) is None:
                        ok = beside[pair] = self._stable(state[k - size], t)
                    if ok:
                        append(t)
                        break
                else:
                    raise ValueError(f"byte {w[k - 1]} is not in the vocabulary")
            before, ids = w, []
            while k:
                ids.append(t := state[k])
                k -= len(self.bytes_of[t])
            out[w] = ids[::-1]
        if len(beside) > BORDERS:
            beside.clear()
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Put the encodings of all pieces of these texts into the cache. It has two
        generations: frequent pieces move on to the new one, rare ones go with the old one."""
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older, new = self.cache, self.older, []
        for w in set().union(*texts):
            if w not in cache:
                if (got := older.get(w)) is not None:
                    cache[w] = got
                else:
                    new.append(w)
        coded = self.encode_words([w.encode() for w in new])
        for w in new:
            ids = coded[w.encode()]
            cache[w] = ",".join(map(str, ids)), len(ids), b"".join([self.bytes_of[i] for i in ids])

    def forget(self) -> None:
        """Empty the caches: a worker that goes on to other work does not keep them."""
        self.cache, self.older, self.beside = {}, {}, {}

    def split(self, text: str) -> list[str]:
        """Pieces of a text; a special token's text is a piece of its own."""
        if self.cut is None or not any(s in text for s in self.special):
            return pieces(text)
        out = []
        for part in self.cut.split(text):
            out.extend([part] if part in self.special else pieces(part))
        return out

    def code(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """(ids joined by commas, number of ids, text decoded from the ids) of each text."""
        cut = [self.split(t) for t in texts]
        special = {s: (str(i), 1, self.bytes_of[i]) for s, i in self.special.items()}
        self.learn([[p for p in ps if p not in special] if special.keys() & set(ps) else ps for ps in cut])
        out = []
        for ps in cut:
            got = [special.get(p) or self.cache[p] for p in ps] if special.keys() & set(ps) else [self.cache[p] for p in ps]
            out.append((",".join([g[0] for g in got]), sum([g[1] for g in got]),
                        b"".join([g[2] for g in got]).decode("utf-8", "replace")))
        return out


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str, with_ids: bool = True, with_text: bool = True,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and,
    if asked for, ``ids`` (array of int) and ``decoded`` (string). No shuffle.

    path: a byte-level BPE file that every executor can read. A null text is the empty text
    (no ids); a null id stays null; repeated rows are coded each; other columns are ignored;
    an empty table gives no rows. The text of a special token becomes that token. Texts of any
    length are coded whole: memory follows the longest text.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" \
        + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches):
        c = codec(path)
        for s in slices(batches, size=SLICE):
            texts = [t or "" for t in s.column(1).to_pylist()]
            got = c.code(texts)
            cols = [s.column(0), pa.array([g[1] for g in got], pa.int64()), pa.array([_sha(g[0]) for g in got]),
                    pa.array([_sha(g[2]) for g in got])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([list(map(int, g[0].split(","))) if g[0] else [] for g in got], pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                cols.append(pa.array([g[2] for g in got], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)
        c.forget()

    return known(small_batches(docs), **{id_col: "long", text_col: "string"}).mapInArrow(run, schema)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of stored ids. Null ids are no ids; an unknown id is an error."""

    def run(batches):
        c = codec(path)
        for s in slices(batches):
            texts = [b"".join(c.bytes_of[i] for i in row or ()).decode("utf-8", "replace") for row in s.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return known(small_batches(ids), **{id_col: "long", ids_col: "array<int>"}).mapInArrow(run, "doc_id long, text string")
