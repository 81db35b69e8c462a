"""Document quality: random-indexing word vectors, pooled, and a two-layer network.

Every token stands for two units, its word and its shape (``THE!!`` is ``A!``), each hashed
into a bounded set of buckets. Every bucket owns a sparse random index vector. A bucket's context
vector is the sum of the index vectors of its neighbours within ``REACH`` tokens, over all
documents of the corpus. A document is the mean of its units' normalised vectors, with a few
whole-text ratios beside it. A two-layer network, fitted on a bounded sample of labelled rows,
turns that into a score, and a temperature fitted on held-back rows of the sample calibrates
it (it only softens). Labels, language, source and id are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import known, saved, slices, small_batches

WORDS, SHAPES, DIM, REACH, NONZERO = 1 << 14, 1 << 10, 64, 2, 4
UNITS = WORDS + SHAPES
RATIOS = 6
#: Bytes of a shape: runs of a byte are written once, and this many count.
SHAPE_BYTES = 12
_FORM = np.arange(256, dtype=np.uint8)
_FORM[ord("a"):ord("z") + 1], _FORM[ord("A"):ord("Z") + 1], _FORM[ord("0"):ord("9") + 1] = ord("a"), ord("A"), ord("9")


def _index_vectors() -> np.ndarray:
    """(UNITS, DIM) of -1, 0 and 1: the same for any corpus."""
    rng = np.random.default_rng(20)
    out = np.zeros((UNITS, DIM), np.int8)
    rows = np.arange(UNITS)[:, None]
    out[rows, rng.permuted(np.tile(np.arange(DIM), (UNITS, 1)), axis=1)[:, :NONZERO]] = rng.choice([-1, 1], (UNITS, NONZERO))
    return out


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A polynomial hash, mixed, of each byte string ``data[at[i]:at[i + 1]]``."""
    sizes = np.diff(at)
    powers = np.cumprod(np.full(max(sizes.max(initial=0), 1), 0x100000001B3, np.uint64))
    place = np.arange(len(data)) - np.repeat(at[:-1], sizes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])])[at]
    h = sums[1:] - sums[:-1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _shapes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same strings as shapes: letters and digits by class, runs of a byte once."""
    form = _FORM[data]
    first = np.zeros(len(data), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    new = first.copy()
    new[1:] |= form[1:] != form[:-1]
    count = np.concatenate([[0], np.cumsum(new)])
    keep = new & (count[1:] - np.repeat(count[at[:-1]], np.diff(at)) <= SHAPE_BYTES)
    return form[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and shape bucket of each token of some texts, and where each text ends among them.
    Tokens are split and numbered in Arrow, and only distinct ones are hashed."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    _, at, data = coded.dictionary.buffers()
    at = np.frombuffer(at, np.int32)[:len(coded.dictionary) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[:at[-1]]
    word = (_hashes(data, at) % np.uint64(WORDS)).astype(np.int64)
    shape = (_hashes(*_shapes(data, at)) % np.uint64(SHAPES)).astype(np.int64) + WORDS
    ids = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    empty = np.diff(at) == 0
    if empty.any():  # an empty text is split into one empty token
        real = ~empty[ids]
        ids, ends = ids[real], np.concatenate([[0], np.cumsum(real)])[ends]
    return word[ids], shape[ids], ends


def context_vectors(docs: DataFrame) -> np.ndarray:
    """(UNITS, DIM): every unit's context vector over all documents, of length 1 (0 for units
    that do not occur). Its size is fixed, whatever the corpus."""

    def run(batches):
        index = _index_vectors()
        dims = list(np.argsort(-np.abs(index), 1, kind="stable")[:, :NONZERO].T.copy())
        signs = [index[np.arange(UNITS), d].astype(np.float64) for d in dims]
        total = np.zeros(UNITS * DIM)
        for s in slices(batches, 0):
            words, shapes, ends = units(s.column(0))
            of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))  # the text of each token
            for step in range(1, REACH + 1):
                near = np.flatnonzero(of[step:] == of[:-step])
                for ids in (words, shapes):
                    a, b = ids[near], ids[near + step]
                    for d, sign in zip(dims, signs):
                        total += np.bincount(a * DIM + d[b], sign[b], UNITS * DIM)
                        total += np.bincount(b * DIM + d[a], sign[a], UNITS * DIM)
        rows = total.reshape(UNITS, DIM)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(rows[used].astype(np.int64).ravel()), DIM).cast(pa.list_(pa.int64()))],
            ["unit", "v"])

    parts = known(docs, text="string").mapInArrow(run, "unit int, v array<long>")
    summed = saved(parts.groupBy("unit").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)]), "quality-vectors")
    out = np.zeros((UNITS, DIM))
    for r in summed.toLocalIterator():  # at most UNITS rows
        out[r[0]] = r[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each whole text: mean word vector, mean shape vector, ratios."""
    words, shapes, ends = units(texts)
    out = np.zeros((len(texts), 2 * DIM + RATIOS), np.float32)
    chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    lines = pc.fill_null(pc.count_substring(texts, "\n"), 0).to_numpy(zero_copy_only=False)
    for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends)):
        n = end - start
        if n:
            w = words[start:end]
            u, many = np.unique(w, return_counts=True)
            v, often = np.unique(shapes[start:end], return_counts=True)
            out[i, :DIM] = many @ vectors[u] / n
            out[i, DIM:2 * DIM] = often @ vectors[v] / n
            out[i, 2 * DIM:] = (np.log1p(n) / 10, len(u) / n, (w[1:] == w[:-1]).sum() / n, len(v) / n, chars[i] / n / 20, lines[i] / n)
    return out


class Network:
    """tanh hidden layer and a logistic output, with a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 16, rounds: int = 300, rate: float = 0.01, decay: float = 1e-3) -> Network:
    """Full-batch Adam on the log loss over four fifths of the rows; the temperature that suits
    the remaining fifth best. With no rows of either class the score is their share (0.5 for
    none at all)."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), np.log(share / (1 - share)), 1.0)
    held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z, t = (x[~held] - mean) / scale, y[~held]
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for k in range(1, rounds + 1):
        a = np.tanh(z @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - t) / len(t)
        back = np.outer(err, p[2]) * (1 - a * a)
        for i, g in enumerate((z.T @ back + decay * p[0], back.sum(0), a.T @ err + decay * p[2], err.sum())):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    net = Network(mean, scale, *p, 1.0)
    if held.any():
        z = net.logits(x[held])

        def loss(temperature):
            s = np.clip(z / temperature, -30, 30)
            return np.logaddexp(0, s).mean() - (s * y[held]).mean()

        net.temperature = float(min(np.geomspace(1, 8, 41), key=loss))
    return net


def held_out():
    """The fold that never trains: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_rows: int = 8000) -> Network:
    """Fit on the ``max_rows`` labelled rows outside the held-out fold with the smallest id hashes.
    A null label is none; of several labels of one id the largest counts."""
    chosen = (known(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null").where(~held_out())
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def run(batches):
        for s in slices(batches, 2):
            x = pooled(s.column(2), vectors).tolist()
            yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    rows = (known(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
            .mapInArrow(run, "doc_id long, quality int, x array<float>")
            .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").collect())  # at most max_rows
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), 2 * DIM + RATIOS)
    return fit(x, np.array([r["quality"] > 0 for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, at_least: float = 0.3, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from ``at_least`` on), and the
    other columns of documents if ``keep_text``.

    A null or empty text is scored like any other; a null id counts as empty text for the fold;
    repeated rows are scored each; further columns are ignored; an empty table gives no rows.
    The vectors (some 4 MB, whatever the corpus) and the network go to the tasks; texts are
    never shuffled.
    """
    vectors = context_vectors(small_batches(docs))
    net = train(docs, labels, vectors)
    d = known(docs, doc_id="long", text="string", **(dict(lang="string", source="string", n_chars="long") if keep_text else {}))

    def run(batches):
        for s in slices(batches):
            p = net(pooled(s.column(1), vectors).astype(float))
            yield pa.RecordBatch.from_arrays([*s.columns, pa.array(p), pa.array((p >= at_least).astype(np.int32))],
                                             [*s.schema.names, "score", "predicted"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema) + ", score double, predicted int"
    return d.mapInArrow(run, schema).withColumn("held_out", held_out())
