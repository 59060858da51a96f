"""Language identification by averaged hashed subword embeddings and a linear softmax.

A subword is a run of 2 to 4 bytes of a lower-cased word with its boundaries.
Its embedding is a row of a table chosen by hash; a document is the average of
its subwords' rows.  Table and softmax are trained together by stochastic
gradient descent on a bounded sample of labelled documents; part of the sample
sets the temperature and the confidence below which a document is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktide.llm.common import bucket_of, slices, stored
from clicktide.llm.words import LOWER, NO_WORD, raw

BUCKETS = 1 << 16
DIM = 16
PER_LANGUAGE = 300  # sampled documents of each language
SALTS = 64
SIZES = (2, 3, 4)
CONFUSED = 0.005  # share of correctly told documents that rejection may cost at most
LOWEST = 0.5  # no document told with more confidence is rejected

# bytes as subwords see them: 0 is a boundary
SEEN = np.where(NO_WORD, 0, LOWER).astype(np.uint32)
SEEN[48:58] = 0  # digits tell nothing


def subwords(body: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, the bucket of the subword at each byte and whether there is one."""
    x = SEEN[body]
    n = len(x)
    letter = x != 0
    h = x.copy()
    ok = np.ones(n, dtype=bool)
    for size in range(2, max(SIZES) + 1):
        # one byte more; a text's last bytes begin no subword
        k = size - 1
        if n <= k:
            return
        h = h[:-1] * np.uint32(0x01000193) + x[k:]
        ok = ok[:-1]
        if size > 2:  # inside there are letters only
            ok &= letter[k - 1 : n - 1]
        over = at[1:] - k
        ok[over[(over >= 0) & (over < len(ok))]] = False
        some = ok & (letter[: n - k] | letter[k:]) if size == 2 else ok
        if size in SIZES:
            yield ((h * np.uint32(0x9E3779B1) + np.uint32(size)) * np.uint32(0x85EBCA6B)) >> np.uint32(16), some


def sums(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the sum of its subwords' rows of ``table`` (buckets x columns), and their number."""
    body, at = raw(texts)
    docs = len(at) - 1
    total, count = np.zeros((docs, table.shape[1])), np.zeros(docs)
    full = np.flatnonzero(np.diff(at))
    columns = [np.append(c, np.float32(0)) for c in table.T]
    for bucket, ok in subwords(body, at):
        here = full[at[full] < len(bucket)]
        if not len(here):
            continue
        starts = at[here]
        count[here] += np.add.reduceat(ok, starts, dtype=np.int64)
        bucket = np.where(ok, bucket, np.uint32(len(table)))
        for c, column in enumerate(columns):
            total[here, c] += np.add.reduceat(column[bucket], starts, dtype=np.float64)
    return total, count


def _counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    body, at = raw(text)
    total = np.zeros(BUCKETS, np.int64)
    for bucket, ok in subwords(body, at):
        total += np.bincount(bucket[ok], minlength=BUCKETS)
    some = np.flatnonzero(total)
    return some, total[some]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # BUCKETS x labels: embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, text: pa.Array) -> np.ndarray:
        total, count = sums(text, self.table)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], labels: list[str], epochs: int = 10, rate: float = 0.5) -> Model:
    """SGD over documents given as buckets, counts and label; every fifth calibrates."""
    rng = np.random.default_rng(7)
    # in an order of their own, so that the result does not hang on how rows arrive
    examples = sorted(examples, key=lambda e: (e[2], len(e[0]), int(e[1].sum()), e[0].tobytes(), e[1].tobytes()))
    held, rest = examples[::5], [x for i, x in enumerate(examples) if i % 5] or examples
    k = len(labels)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    weights, bias = np.zeros((DIM, k)), np.zeros(k)

    def batch(rows):
        ids = np.concatenate([r[0] for r in rows])
        share = np.concatenate([r[1] / max(1, r[1].sum()) for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        return ids, share, doc

    def averages(ids, share, doc, n):
        return np.stack([np.bincount(doc, emb[ids, d] * share, minlength=n) for d in range(DIM)], axis=1)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(rest))
        for i in range(0, len(order), 16):
            rows = [rest[j] for j in order[i : i + 16]]
            ids, share, doc = batch(rows)
            x = averages(ids, share, doc, len(rows))
            p = softmax(x @ weights + bias)
            p[np.arange(len(rows)), [r[2] for r in rows]] -= 1
            p /= len(rows)
            back = p @ weights.T
            weights -= step * x.T @ p
            bias -= step * p.sum(axis=0)
            # a subword's step follows its share of the document, 1 on average
            weight = share * np.array([len(r[0]) for r in rows])[doc]
            for d in range(DIM):
                emb[:, d] -= step * np.bincount(ids, back[doc, d] * weight, minlength=BUCKETS)
    truth = np.array([h[2] for h in held], dtype=int)
    z = np.zeros((0, k))
    if held:
        ids, share, doc = batch(held)
        z = averages(ids, share, doc, len(held)) @ weights + bias
    temperature, low = 1.0, 0.0
    if len(held):
        fits = [(-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean(), t) for t in np.geomspace(0.05, 10, 60)]
        temperature = float(min(fits)[1])
        p = softmax(z / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        if len(right):
            low = min(LOWEST, float(np.quantile(right, CONFUSED)))
    return Model(labels, (emb @ weights).astype(np.float32), bias, temperature, low)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Labelled documents outside the held-out fold: for each language those of smallest hash.

    The languages' labels must be few; a sample of ``per_language`` rows of each is
    what the driver gets.  Rows of one rank are ordered by id.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), 5) != 0)).select("doc_id", "lang")
    drawn = ids.withColumns({"draw": F.xxhash64("doc_id"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))})
    # within salted parts first, so that a frequent language meets as its few best alone
    for parts in (("lang", "salt"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy("draw", "doc_id"))
        drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    # stored, so that texts are shuffled only if the sample is too large to broadcast
    chosen = stored(drawn.select("doc_id", "lang").distinct(), "language-sample")
    return docs.where(F.col("text").isNotNull()).join(chosen, ["doc_id", "lang"], "left_semi").select("text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Train on ``doc_id``, ``text`` and ``lang``; None if no row is labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_counts(batch.column(0).slice(i, 1)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                names=["lang", "ids", "counts"],
            )

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = sample(plain, per_language).mapInArrow(run, "lang string, ids array<bigint>, counts array<bigint>").toArrow()
    names = rows.column("lang").to_pylist()
    labels = sorted(set(names))
    if not labels:
        return None
    lists = [(np.array(i.as_py(), np.int64), np.array(c.as_py(), np.int64)) for i, c in zip(rows.column("ids"), rows.column("counts"))]
    return train([(i, c, labels.index(n)) for (i, c), n in zip(lists, names)], labels)


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``doc_id`` and the columns ``keep`` with ``lang_pred``, ``score`` and ``rejected``.

    The score is the calibrated probability of the language.  A text that is null
    or has no letter is ``und`` with score 0 and is rejected, as is one told with
    less confidence than the model asks for, which keeps its prediction.  Without
    any labelled row every document is ``und``.
    """
    told = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *keep,
        F.col("text").cast("string").alias("__text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"),
    )
    names = told.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                letters = np.array(batch.column(len(names) + 1).to_pylist(), dtype=bool)
                if model is None:
                    label, score, no = ["und"] * batch.num_rows, np.zeros(batch.num_rows), ~np.zeros(batch.num_rows, bool)
                else:
                    p = model.probabilities(batch.column(len(names)))
                    best = p.argmax(axis=1)
                    label = [model.labels[b] if ok else "und" for b, ok in zip(best, letters)]
                    score = np.where(letters, p.max(axis=1), 0.0)
                    no = ~letters | (score < model.reject_below)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(names))), pa.array(label, pa.string()), pa.array(score), pa.array(no)],
                    names=[*names, "lang_pred", "score", "rejected"],
                )

    kinds = ", ".join(f"`{n}` {t}" for n, t in told.dtypes[:-2])
    return told.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the table's own labels and predict every document."""
    return predict(docs, fit(docs))
