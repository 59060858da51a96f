import numpy as np
from conftest import SMALL, STRANGE

import brute
from clicktide.llm import outliers
from clicktide.llm.common import table
from clicktide.llm.queries import QUERIES

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query(spark):
    text = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = QUERIES["op8_quality_rules"](spark, SMALL).collect()
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in rows} == {d: brute.rules(t) for d, t in text.items()}
    assert not any(r.kept and r.base_failed for r in rows)


def test_strange(strange):
    rows = outliers.judge(strange).collect()
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in rows} == {d: brute.rules(t) for d, t in STRANGE}
    assert outliers.judge(strange.where("false")).count() == 0


def test_only_base_failures(docs):
    rows = outliers.judge(docs([(1, "too short"), (2, None)])).collect()
    assert not any(r.kept for r in rows)


def mcd(x):
    """Concentration steps on one group."""
    floors = np.array([v**2 for v in outliers.FLOORS.values()])

    def estimate(rows):
        c = np.cov(rows.T, bias=True)
        return rows.mean(axis=0), np.linalg.inv(c + np.diag(np.maximum(0, floors - np.diag(c)) + 1e-9))

    m, inv = estimate(x)
    for _ in range(outliers.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, inv, x - m)
        m, inv = estimate(x[d <= np.sort(d)[int(np.ceil(outliers.H * len(x))) - 1]])
    return np.einsum("ij,jk,ik->i", x - m, inv, x - m)


def test_distances_and_planted_outliers(docs):
    rng = np.random.default_rng(5)
    vocab = [f"{'abcdefgh'[i % 8]}{'xyz'[i % 3] * (1 + i % 7)}{i}" for i in range(4000)]
    rows = [(i, "\n".join(" ".join(rng.choice(vocab, 12)) for _ in range(rng.integers(8, 30)))) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%$$$" for w in rng.choice(vocab, 150))) for i in range(8)]
    got = {r.doc_id: r for r in outliers.judge(docs(rows)).collect()}
    assert not any(got[1000 + i].kept for i in range(8))
    assert all(got[i].kept for i in range(300))
    x = []
    for _, t in rows:
        n, chars, sym, dup, rep, _ = brute.rules(t)
        lines = sum(bool(line.strip()) for line in t.split("\n"))
        x.append([np.log1p(n), np.log1p(chars / n), np.sqrt(sym / chars), np.sqrt(dup / lines), np.sqrt(rep / n), np.log1p(n / lines)])
    want = mcd(np.array(x))
    have = np.array([got[d].distance2 for d, _ in rows])
    np.testing.assert_allclose(have, want, rtol=0.05, atol=0.5)


def mixed(rng, n):
    """Clean texts of many lengths, word lengths, line lengths and rates of symbols and of repeated lines."""
    out = []
    for _ in range(n):
        size, per_line = int(rng.integers(2, 12)), int(np.exp(rng.normal(2.5, 0.7))) + 1
        vocab = [f"{i:x}" * size for i in range(300, 1500)]
        lines = [" ".join(rng.choice(vocab, per_line)) for _ in range(int(np.exp(rng.normal(5.3, 0.7))) // per_line + 60 // per_line + 1)]
        again = [lines[0]] * int(rng.integers(0, 3) * len(lines) // 12)
        rate = rng.uniform(0, 0.1)
        words = [[w + "%" * int(rng.random() < rate) for w in line.split()] for line in lines + again]
        out.append("\n".join(" ".join(w) for w in words))
    return out


def test_a_fifth_of_one_kind_of_junk(docs):
    """A cluster of 20 % must not become the estimate."""
    rng = np.random.default_rng(6)
    rows = list(enumerate(mixed(rng, 400)))
    # half of the lines are one line, with symbols
    rows += [(1000 + i, "\n".join(f"{a:x} {b:x}\nbuy now##" for a, b in rng.integers(300, 1500, (40, 2)))) for i in range(100)]
    got = {r.doc_id: r for r in outliers.judge(docs(rows)).collect()}
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(100))
    kept = [got[i].kept for i in range(400) if not got[i].base_failed]
    assert len(kept) > 380 and np.mean(kept) > 0.98


def test_least_misfit_of_a_cluster_in_several_statistics():
    rng = np.random.default_rng(7)
    x = np.abs(rng.normal([5.5, 1.8, 0, 0, 0.05, 3], [0.9, 0.1, 0.02, 0.03, 0.06, 0.6], (2000, 6)))
    x[:400] = rng.normal([5.5, 2.6, 0.4, 0.4, 0.5, 1], 0.02, (400, 6))
    ends = outliers.finalists(x)
    assert [e[0] for e in ends] == sorted(e[0] for e in ends)
    _, mean, cov = ends[0]
    d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    assert (d2[:400] > outliers.CUT).all() and (d2[400:] <= outliers.CUT).mean() > 0.999


def test_partial_repetition_and_sparse_symbols(docs):
    """Junk in a part of a text is rejected; short clean texts stay."""
    rng = np.random.default_rng(8)
    vocab = [f"{'abcdefgh'[i % 8]}{'xyz'[i % 3] * (1 + i % 7)}{i}" for i in range(4000)]
    fresh = [[list(rng.choice(vocab, int(rng.integers(9, 16)))) for _ in range(rng.integers(4, 40))] for _ in range(440)]
    planted = {
        "read more": lambda t: [line for part in t for line in (part, ["Read", "more"])],
        "lines": lambda t: t + t[: max(1, len(t) * 3 // 10)],
        "words": lambda t: t + [(words := sum(t, []))[: len(words) * 3 // 10]],
        "symbols": lambda t: [[w + "##" * (i % 8 == 0) for i, w in enumerate(line)] for line in t],
    }
    texts = {("clean", i): t for i, t in enumerate(fresh[:360])}
    for k, (kind, plant) in enumerate(planted.items()):
        texts |= {(kind, i): plant(t) for i, t in enumerate(t for t in fresh[360 + 10 * k : 370 + 10 * k] if len(t) >= 10)}
    # five lines; one of them comes twice, by chance
    texts |= {("short", i): t[:4] + ([["yes", "or", "no"]] * 2 if i % 2 else [["no"]]) for i, t in enumerate(fresh[400:])}
    ids = {k: i for i, k in enumerate(texts)}
    text = {k: "\n".join(" ".join(line) for line in t) for k, t in texts.items()}
    # clean short texts need 50 words to be judged by distance
    got = {r.doc_id: r for r in outliers.judge(docs([(ids[k], t) for k, t in text.items() if len(t.split()) >= 50])).collect()}
    kept = {kind: [got[i].kept for (what, _), i in ids.items() if what == kind and i in got and not got[i].base_failed] for kind in ["clean", "short", *planted]}
    assert np.mean(kept["clean"]) > 0.99 and len(kept["short"]) > 10 and all(kept["short"])
    assert all(len(kept[kind]) > 3 and not any(kept[kind]) for kind in planted), {k: (len(v), sum(v)) for k, v in kept.items()}


def test_cut():
    """Quantiles and the consistency factor of six normal statistics, by drawing."""
    d = np.sort((np.random.default_rng(9).normal(size=(2_000_000, 6)) ** 2).sum(axis=1))
    inner = d[: int(outliers.H * len(d))].mean() / 6  # variance that the H share keeps
    assert abs(outliers.CONSISTENCY * inner - 1) < 0.01
    assert abs(outliers.CUT / (d[int((1 - outliers.TAIL) * len(d))] / inner) - 1) < 0.02


def test_small_groups_lean_on_the_whole_without_a_step(spark):
    """The weight of a group grows with its rows; none is left to the whole alone."""
    p = len(outliers.STATS)
    rows = [(str(n), n, [1.0] * p, outliers._upper(np.eye(p))) for n in (1, 99, 100, 101, 100_000)]
    est = spark.createDataFrame(rows, "grp string, n bigint, mean array<double>, inverse array<double>")
    got = {int(r.grp): r for r in outliers._shrunk(est, ([0.0] * p, outliers._upper(np.eye(p)))).collect()}
    weights = [got[n].mean[0] for n in (1, 99, 100, 101, 100_000)]
    assert weights == sorted(weights) and weights[0] < 0.02 and weights[-1] > 0.99
    assert abs(weights[3] - weights[1]) < 0.01
    np.testing.assert_allclose(outliers._full(np.array(got[100].inverse)), np.linalg.inv(np.eye(p) + 0.25), atol=1e-9)


def test_the_draw_does_not_depend_on_partitions(spark):
    from clicktide.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    one, many = (sorted((r.doc_id, r.kept) for r in outliers.judge(docs.repartition(n)).collect()) for n in (1, 7))
    assert one == many
