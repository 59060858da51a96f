"""Quality scores: random-indexing word vectors, pooled, and a two-layer network.

Words fall into hashed buckets.  Each bucket has a sparse random vector, and the
vector of a word is the sum of the random vectors of its neighbours over the whole
corpus.  A document is the mean and the spread of its words' vectors; a network
of two layers, trained in numpy on a bounded sample of labelled rows, turns that
into a probability whose temperature is set on rows it was not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import bucket_of, slices, stored, texts
from clicktide.llm.words import U, mix, raw, words

BUCKETS = 1 << 15
DIM = 32
NEIGHBOURS = (1, 2)  # distances, to both sides
SAMPLE = 8000  # labelled rows that the network learns from
HIDDEN = 32


def random_index() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket, two places of its random vector and the signs there."""
    h = mix(np.arange(BUCKETS, dtype=np.uint64) + U(12345))
    places = np.stack([(h >> U(8)) % U(DIM), (h >> U(24)) % U(DIM)], axis=1).astype(np.int64)
    signs = np.stack([(h >> U(40)) & U(1), (h >> U(41)) & U(1)], axis=1).astype(np.float64) * 2 - 1
    return places, signs


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sums of neighbours' random vectors, by bucket."""
    places, signs = random_index()
    total = np.zeros(BUCKETS * DIM)
    for whole in batches:
        for batch in slices(whole, "text"):
            w = words(*raw(batch.column(1)), lower=False)
            b = _buckets(w.hashes)
            cells, weights = [], []
            for d in NEIGHBOURS:
                same = np.flatnonzero(w.doc[:-d] == w.doc[d:]) if len(b) > d else np.empty(0, np.int64)
                for one, other in ((b[same], b[same + d]), (b[same + d], b[same])):
                    for j in range(2):
                        cells.append(one * DIM + places[other, j])
                        weights.append(signs[other, j])
            total += np.bincount(np.concatenate(cells), np.concatenate(weights), minlength=BUCKETS * DIM)
    sums = total.reshape(BUCKETS, DIM)
    some = np.flatnonzero(sums.any(axis=1))
    for i in range(0, len(some), 4096):
        part = some[i : i + 4096]
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums[part].astype(np.float32).ravel()), DIM)
        yield pa.RecordBatch.from_arrays([pa.array(part), vectors.cast(pa.list_(pa.float32()))], names=["bucket", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from every word of the corpus.

    Each task sends at most one row per bucket, whatever it reads; the driver
    gets the finished table, whose size is fixed.
    """
    parts = texts(docs).where("text is not null").mapInArrow(_context_sums, "bucket bigint, sums array<float>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.col("sums")[i].cast("double")).alias(f"d{i}") for i in range(DIM)])
    got = sums.toArrow()
    table = np.zeros((BUCKETS, DIM))
    if got.num_rows:
        table[got.column("bucket").to_numpy()] = np.stack([got.column(f"d{i}").to_numpy() for i in range(DIM)], axis=1)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(text: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text; zeros without words."""
    w = words(*raw(text), lower=False)
    n = len(text)
    out = np.zeros((n, 2 * DIM), np.float32)
    count = np.diff(w.first)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    vectors = table[_buckets(w.hashes)]
    starts, size = w.first[some], count[some][:, None]
    mean = np.add.reduceat(vectors, starts, axis=0) / size
    square = np.add.reduceat(vectors * vectors, starts, axis=0) / size
    out[some, :DIM] = mean
    out[some, DIM:] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """``doc_id`` and ``features`` of every document."""
    broad = docs.sparkSession.sparkContext.broadcast(table)  # of fixed size, 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                features = pool(batch.column(1), broad.value)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), 2 * DIM)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(pa.list_(pa.float32()))], names=["doc_id", "features"])

    return texts(docs).mapInArrow(run, "doc_id bigint, features array<float>")


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 3e-3) -> Network:
    """Adam on the log loss; every fifth row sets the temperature.  Without rows the score is 0.5."""
    rng = np.random.default_rng(11)
    order = np.lexsort((*x.T[:8], y)) if len(x) else np.empty(0, int)
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    held = np.arange(len(x)) % 5 == 0
    xs, ys = (x[~held], y[~held]) if (~held).any() else (x, y)
    d = x.shape[1] if x.ndim == 2 and x.shape[1] else 2 * DIM
    shift = xs.mean(axis=0) if len(xs) else np.zeros(d)
    scale = np.maximum(xs.std(axis=0), 1e-3) if len(xs) else np.ones(d)
    p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    p[2] = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (xs - shift) / scale
    for epoch in range(epochs if len(xs) else 0):
        step = rate * (1 - epoch / epochs)
        shuffled = rng.permutation(len(z))
        for i in range(0, len(z), 64):
            rows = shuffled[i : i + 64]
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - ys[rows]) / len(rows)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
            t += 1
            for j, grad in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad * grad
                p[j] = p[j] - step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    net = Network(shift, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if not len(xs):
        net.w2 = np.zeros(HIDDEN)
        net.b2 = 0.0
    elif held.any():
        z, truth = net.logits(x[held]), y[held]

        def loss(t: float) -> float:
            q = np.clip(1 / (1 + np.exp(-np.clip(z / t, -40, 40))), 1e-9, 1 - 1e-9)
            return float(-(truth * np.log(q) + (1 - truth) * np.log(1 - q)).mean())

        net.temperature = float(min(np.geomspace(0.1, 20, 80), key=loss))
    return net


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    The network learns from at most ``sample`` labelled rows outside the held-out
    fold, those of smallest hash; word vectors come from all texts.  A null or
    empty text has the features 0.  A document with several labels has the
    smallest; null labels are none; a null id is never learned from.  Repeated
    rows are scored each; an empty table gives no rows.
    """
    features = stored(pooled(docs, word_vectors(docs)), "quality-features")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isNotNull() & (bucket_of(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = features.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("quality", "features").toArrow()
    x = np.array(rows.column("features").to_pylist(), np.float32).reshape(-1, 2 * DIM)
    net = train(x, rows.column("quality").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, 2 * DIM).astype(np.float64)
            score = net.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = features.mapInArrow(run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
