"""Quality rules by robust multivariate outliers.

Each document's statistics are transformed to a vector.  For every language and
source the minimum-covariance-determinant estimate is found by concentration
steps: mean and covariance of the ``H`` share of rows that lie closest, until the
determinant stays.  Many starts (robust scatters, seeded subsets, all rows) are
tried on a sample of bounded size; the best go on over all rows as grouped sums, so
no group is ever in one task, and the one of least determinant over all rows counts.
A document too far from it by Mahalanobis distance is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import slices, stored
from clicktide.llm.words import raw, windows, words

H = 0.75  # share of rows that the estimate rests on
STEPS = 30  # concentration steps at most; they end when the misfit stays
TOLERANCE = 1e-3  # of a misfit
SAMPLE = 2000  # rows of a group in which starts are sought
SUBSETS = 20  # seeded starts of few rows, besides the robust ones
FINALISTS = 3  # estimates of a sample that go on over all rows
PRIOR_ROWS = 100  # the estimate over all rows counts as so many rows of each group
TAIL = 0.001  # share of normal rows beyond the cut
# Least standard deviation of each statistic among the ``H`` share, so that one that
# is nearly constant rejects nobody for a trifle.
FLOORS = {"length": 0.5, "word_length": 0.08, "symbols": 0.03, "dup_lines": 0.08, "repeats": 0.07, "line_length": 0.5}
# A share of few lines or words varies more.  Lines and words added below the line
# shrink it by as much: its variance is the floor's times (1 + added / n).
ADDED_LINES, ADDED_WORDS = 16, 150
STATS = list(FLOORS)
ALL = "*"  # the group of all rows


def _beyond(x: float, df: int) -> float:
    """Share of chi-square with an even number of degrees of freedom that exceeds x."""
    term = total = exp(-x / 2)
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return total


def _quantile(share: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _beyond(mid, df) > 1 - share else (low, mid)
    return low


# The covariance of the H share is smaller than that of all normal rows by this factor.
CONSISTENCY = H / (1 - _beyond(_quantile(H, len(STATS)), len(STATS) + 2))
CUT = CONSISTENCY * _quantile(1 - TAIL, len(STATS))  # squared distance, 30.6

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def counts(text: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of a column: see ``statistics``."""
    body, at = raw(text)
    n = len(text)
    w = words(body, at, lower=False)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[at[1:]] - total[at[:-1]]

    lead = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80, dtype=np.int64)))
    chars = np.zeros(n, np.int64)
    np.add.at(chars, w.doc, lead[w.end] - lead[w.start])
    # windows of three words found twice or more in a text
    h, first = windows(w, 3)
    doc = w.doc[first]
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    same = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
    again = np.zeros(len(hs), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(w.hashes), dtype=bool)
    for i in range(3):
        covered[first[order[again]] + i] = True
    dup, lines = _duplicate_lines(body, at, w)
    return {
        "n_words": np.diff(w.first), "word_chars": chars, "n_symbols": per_doc(SYMBOL[body]),
        "n_dup_lines": dup, "n_repeat_words": np.bincount(w.doc[covered], minlength=n), "n_lines": lines,
    }


def _duplicate_lines(body: np.ndarray, at: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, lines with a word that equal an earlier line, and lines with a word."""
    n = len(at) - 1
    breaks = np.flatnonzero(body == 10)
    starts = np.unique(np.concatenate((at[:-1][np.diff(at) > 0], breaks + 1)))
    starts = starts[starts < len(body)]
    doc = np.searchsorted(at, starts, "right") - 1
    ends = np.append(starts[1:], len(body))
    # a line ends before its line feed
    ends = ends - ((ends > starts) & (body[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends
    some = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, doc = starts[some], ends[some], doc[some]
    seen: set[tuple[int, bytes]] = set()
    data = body.tobytes()
    dup = np.zeros(n, np.int64)
    for d, s, e in zip(doc.tolist(), starts.tolist(), ends.tolist()):
        key = (d, data[s:e])
        if key in seen:
            dup[d] += 1
        else:
            seen.add(key)
    return dup, np.bincount(doc, minlength=n)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and the counts of every document.

    Words are runs without ASCII white space; ``word_chars`` are their code
    points, ``n_symbols`` the characters ``#*$%&|<>``, ``n_dup_lines`` the lines
    with a word that equal an earlier one, ``n_repeat_words`` the words inside
    three-word windows found twice or more, ``n_lines`` the lines with a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                c = counts(batch.column(3))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(3)), *(pa.array(c[k], pa.int64()) for k in _COUNTS)],
                    names=["doc_id", "lang", "source", *_COUNTS],
                )

    plain = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    )
    kinds = ", ".join(f"{k} bigint" for k in _COUNTS)
    return plain.mapInArrow(run, f"doc_id bigint, lang string, source string, {kinds}")


def vector() -> dict[str, Column]:
    """The transformed statistics of a document."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "length": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.log1p(F.col("word_chars") / n),
        "symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + ADDED_LINES)),
        "repeats": F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + ADDED_WORDS)),
        "line_length": F.log1p(F.col("n_words") / lines),
    }


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, means and products of each group."""
    sums = [F.count("*").alias("n")] + [F.avg(s).alias(f"m_{s}") for s in STATS]
    sums += [F.avg(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(STATS) for j, b in enumerate(STATS) if i <= j]
    return rows.groupBy(*keys).agg(*sums)


def _upper(inv: np.ndarray) -> list[float]:
    """The upper half of a symmetric matrix by rows, what stands beside the diagonal doubled."""
    return (inv * (2 - np.eye(len(inv))))[np.triu_indices(len(inv))].tolist()


def _estimates(moments: DataFrame, *keys: str) -> DataFrame:
    """Mean, misfit and the upper half of the inverse covariance, with floors, of each group."""
    p = len(STATS)
    upper = np.triu_indices(p)

    def run(batches: Iterator) -> Iterator:
        for f in batches:
            if not len(f):
                continue
            mean = f[[f"m_{s}" for s in STATS]].to_numpy(float)
            products = f[[f"p_{i}_{j}" for i, j in zip(*upper)]].to_numpy(float)
            inverse, misfit = [], []
            for m, half in zip(mean, products):
                cov = np.zeros((p, p))
                cov[upper] = half
                cov, far = _floored(cov + np.triu(cov, 1).T - np.outer(m, m))
                inverse.append(_upper(np.linalg.inv(cov)))
                misfit.append(far)
            out = f[[*keys, "n"]].copy()
            out["misfit"], out["mean"], out["inverse"] = misfit, list(mean), inverse
            yield out

    kinds = "".join(f"{k} {moments.schema[k].dataType.simpleString()}, " for k in keys)
    return moments.mapInPandas(run, f"{kinds}n bigint, misfit double, mean array<double>, inverse array<double>")


def _distance() -> Column:
    """Squared Mahalanobis distance from ``mean`` by ``inverse``."""
    z = [F.col(s) - F.col("mean")[i] for i, s in enumerate(STATS)]
    total, at = F.lit(0.0), 0
    for i in range(len(STATS)):
        for j in range(i, len(STATS)):
            total = total + F.col("inverse")[at] * z[i] * z[j]
            at += 1
    return total


def _floored(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The likeliest covariance with at least the floors' variance in every direction, and its misfit.

    Floors of single statistics would not do: several that move together leave
    directions without variance, and the least determinant to the outliers.  The
    misfit is the log determinant (in units of the floors) plus the mean squared
    distance of the rows; where no floor holds, it ranks as the determinant does.
    """
    floors = np.array([FLOORS[k] for k in STATS])
    units = np.outer(floors, floors)
    own, axes = np.linalg.eigh(cov / units)
    least = np.maximum(own, 1)
    return (axes * least) @ axes.T * units, float(np.sum(np.log(least) + own / least))


def _scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.mean(axis=0), _floored(np.cov(x.T, bias=True))[0]


def _closest(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, share: float) -> np.ndarray:
    z = x - mean
    d = np.einsum("ij,ij->i", z @ np.linalg.inv(cov), z)
    last = max(0, int(np.ceil(share * len(x))) - 1)
    return x[d <= np.partition(d, last)[last]]


def _concentrated(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Misfit, mean and covariance after concentration steps, until the misfit no longer falls."""
    last = np.inf
    for _ in range(steps):
        kept = _closest(x, mean, cov, H)
        mean = kept.mean(axis=0)
        cov, misfit = _floored(np.cov(kept.T, bias=True))
        if last - misfit < 1e-9:
            break
        last = misfit
    return misfit, mean, cov


def _robust(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The starts of deterministic MCD: scatters that far rows hardly move, scaled anew along their axes."""
    floors = np.array([FLOORS[k] for k in STATS])

    def spread(v: np.ndarray, least: np.ndarray | float) -> np.ndarray:
        return np.maximum(least, 1.4826 * np.median(np.abs(v - np.median(v, axis=0)), axis=0))

    middle, scale = np.median(x, axis=0), spread(x, floors)
    z = (x - middle) / scale
    ordered = np.sort(x, axis=0)
    ranks = np.column_stack([np.searchsorted(o, c, "left") + np.searchsorted(o, c, "right") for o, c in zip(ordered.T, x.T)]) / (2 * len(x))
    norms = np.sqrt(np.einsum("ij,ij->i", z, z))
    normal = np.array([NormalDist().inv_cdf(v) for v in (np.arange(1000) + 0.5) / 1000])
    half = z[norms <= np.median(norms)]
    for v in (np.tanh(z), ranks, normal[np.minimum((ranks * 1000).astype(int), 999)], z / np.maximum(norms, 1e-9)[:, None], half):
        axes = np.linalg.eigh(np.cov(v.T, bias=True) + 1e-9 * np.eye(len(STATS)))[1]
        along = z @ axes
        lengths = spread(along, 1e-3)
        center = axes @ np.median(along, axis=0)
        cov = (axes * lengths**2) @ axes.T
        yield middle + center * scale, _floored(cov * np.outer(scale, scale))[0]


def finalists(x: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best different estimates of a sample, by least misfit.

    Starts: the moments of all rows, five robust scatters (their closest half),
    and ``SUBSETS`` seeded subsets of which the best go on after two steps.
    """
    rng = np.random.default_rng(len(x))
    starts = [_scatter(x), *(_scatter(_closest(x, *s, 0.5)) for s in _robust(x))]
    drawn = (_scatter(x[rng.choice(len(x), min(len(x), len(STATS) + 1), replace=False)]) for _ in range(SUBSETS))
    tried = sorted((_concentrated(x, *s, 2) for s in drawn), key=lambda e: e[0])
    ends = sorted((_concentrated(x, *s, STEPS) for s in [*starts, *(e[1:] for e in tried[:FINALISTS])]), key=lambda e: e[0])
    best: list[tuple[float, np.ndarray, np.ndarray]] = []
    for e in ends:
        if len(best) < FINALISTS and all(abs(e[0] - b[0]) > TOLERANCE for b in best):
            best.append(e)
    return best


def _starts(rows: DataFrame) -> DataFrame:
    """Of each ``grp``, the estimates that a sample of about ``SAMPLE`` rows ends in."""
    p = len(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, sample in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = sample.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
                found = finalists(x[np.lexsort(x.T)])  # in an order of its own, whatever order rows came in
                yield pa.RecordBatch.from_arrays([
                    pa.array([grp] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()),
                    pa.array([float(e[0]) for e in found], pa.float64()), pa.array([e[1].tolist() for e in found], pa.list_(pa.float64())),
                    pa.array([_upper(np.linalg.inv(e[2])) for e in found], pa.list_(pa.float64())),
                ], names=["grp", "start", "misfit", "mean", "inverse"])

    sizes = stored(rows.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    # by id and statistics, so that the draw is that of the rows, however they are dealt out
    draw = F.pmod(F.xxhash64("doc_id", *STATS), F.lit(1 << 40)) * F.col("n") < F.lit(float(SAMPLE << 40))
    some = rows.join(sizes, "grp").where(draw)
    samples = some.groupBy("grp").agg(F.collect_list(F.array(*STATS)).alias("sample"))
    return samples.mapInArrow(run, "grp string, start int, misfit double, mean array<double>, inverse array<double>")


def _fit(rows: DataFrame) -> DataFrame:
    """The estimate of least misfit for each ``grp``, ``ALL`` among them, and the rows ``n`` it rests on.

    Each finalist of the samples takes concentration steps over all rows, by
    grouped sums, until its misfit stays as it is.
    """
    est = stored(_starts(rows), "mcd")
    done = []
    for step in range(STEPS):
        near = rows.join(est.select("grp", "start", "mean", "inverse"), "grp").select("grp", "start", *STATS, _distance().alias("d2"))
        # stored, so that its true size decides how it is joined
        cuts = stored(near.groupBy("grp", "start").agg(F.percentile_approx("d2", H, 10_000).alias("cut")), "mcd-cuts")
        kept = near.join(cuts, ["grp", "start"]).where(F.col("d2") <= F.col("cut"))
        new = _estimates(_moments(kept, "grp", "start"), "grp", "start")
        last = est.select("grp", "start", F.col("misfit").alias("last"))
        # the misfits of a sample are not those of all rows, so the first step ends nothing
        moved = (F.abs(F.col("misfit") - F.col("last")) > TOLERANCE) if step else F.lit(True)
        new = stored(new.join(last, ["grp", "start"]).withColumn("moved", moved).drop("last"), "mcd")
        going = new.where("moved")
        if step == STEPS - 1 or going.isEmpty():
            done.append(new)
            break
        done.append(new.where("not moved"))
        est = going
    ends = reduce(DataFrame.unionByName, done)
    return stored(ends.groupBy("grp").agg(F.min_by(F.struct("n", "mean", "inverse"), F.struct("misfit", "start")).alias("e")).select("grp", "e.*"), "mcd")


def _full(upper: np.ndarray) -> np.ndarray:
    """The matrix of which ``_upper`` gives a half."""
    m = np.zeros((len(STATS), len(STATS)))
    m[np.triu_indices(len(STATS))] = upper
    return (m + m.T) / 2


def _shrunk(est: DataFrame, overall: tuple[list[float], list[float]]) -> DataFrame:
    """Each group's estimate mixed with the one over all rows, which weighs ``PRIOR_ROWS`` rows.

    The weight grows with the group without a step: a handful of rows hardly
    counts against the whole, thousands hardly feel it.
    """
    mean0, cov0 = np.array(overall[0]), np.linalg.inv(_full(np.array(overall[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, inverses = [], []
            for n, mean, inverse in zip(*(c.to_pylist() for c in batch.columns[1:])):
                own = n / (n + PRIOR_ROWS)
                apart = np.array(mean) - mean0
                cov = own * np.linalg.inv(_full(np.array(inverse))) + (1 - own) * cov0 + own * (1 - own) * np.outer(apart, apart)
                means.append((mean0 + own * apart).tolist())
                inverses.append(_upper(np.linalg.inv(cov)))
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(means, lists), pa.array(inverses, lists)], names=["grp", "mean", "inverse"])

    return est.select("grp", "n", "mean", "inverse").mapInArrow(run, "grp string, mean array<double>, inverse array<double>")


def judge(docs: DataFrame) -> DataFrame:
    """Counts of every document with ``base_failed``, ``distance2`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them inside repeated
    windows.  Other documents are kept if their squared distance from the estimate
    of their language and source is at most ``CUT``; the estimate over all rows
    takes part in each group's with the weight of ``PRIOR_ROWS`` rows.  Null language
    or source is a group of its own; a null or empty text fails; repeated rows
    count each; other columns are ignored; an empty table gives no rows.
    """
    base = statistics(docs).withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "grp": F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}),
    }).withColumns(vector())
    rows = stored(base, "statistics")
    good = rows.where(~F.col("base_failed"))
    both = good.select("doc_id", F.explode(F.array("grp", F.lit(ALL))).alias("grp"), *STATS)
    est = _fit(both)
    overall = est.where(F.col("grp") == ALL).first()  # one row, or none without rows to learn from
    own = est.where(F.col("grp") != ALL).select("grp", "mean", "inverse")
    if overall:
        own = stored(_shrunk(est.where(F.col("grp") != ALL), (overall["mean"], overall["inverse"])), "mcd")

    def known(name: str) -> Column:
        return F.coalesce(name, F.array(*(F.lit(float(v)) for v in overall[name])) if overall else F.lit(None).cast("array<double>"))

    judged = rows.join(own, "grp", "left").withColumns({"mean": known("mean"), "inverse": known("inverse")})
    d2 = F.coalesce(_distance(), F.lit(0.0))
    return judged.withColumn("distance2", d2).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("distance2") <= CUT)).alias("kept"), "distance2",
    )
