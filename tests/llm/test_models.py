import numpy as np
from conftest import SMALL, STRANGE

import brute
from clicktide.llm import langid, quality
from clicktide.llm.common import table
from clicktide.llm.queries import QUERIES

D = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in table(spark, D, "documents").collect()}
    rows = QUERIES["op1_language_id"](spark, D).collect()
    assert {r.doc_id for r in rows} == set(lang) and len(rows) == len(lang)
    assert all(r.held_out == (brute.fold(r.doc_id, 5) == 0) for r in rows)
    told = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in told]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02


def test_language_of_strange_documents(spark, strange):
    model = langid.fit(table(spark, SMALL, "documents"))
    rows = {r.doc_id: r for r in langid.predict(strange, model).collect()}
    assert len(rows) == len(STRANGE)
    assert [rows[d].lang_pred for d in (1, 2, 3)] == ["und"] * 3 and rows[4].lang_pred != "und"
    assert all(rows[d].rejected and rows[d].score == 0 for d in (1, 2, 3))
    assert langid.predict(strange.where("false"), model).count() == 0
    none = langid.identify(strange.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}


def plain_subwords(text):
    """Buckets of the subwords of 2 to 4 bytes, byte by byte."""
    seen = []
    for b in (text or "").encode():
        c = chr(b).lower() if b < 128 else None
        seen.append(b if c is None else ord(c) if c.isalpha() else 0)
    out = []
    for i in range(len(seen)):
        for size in (2, 3, 4):
            piece = seen[i : i + size]
            if len(piece) < size or not all(piece[1:-1]) or (size == 2 and not any(piece)):
                continue
            h = piece[0]
            for b in piece[1:]:
                h = (h * 0x01000193 + b) % 2**32
            out.append((h * 0x9E3779B1 + size) % 2**32 * 0x85EBCA6B % 2**32 >> 16)
    return out


TEXTS = ["Ab c", "", None, "x", "été, 12 ab", "hello world", "A1b\n\nZ", "ß" * 9]


def test_subword_sums_are_those_of_a_loop():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    table_ = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    total, count = langid.sums(pa.array(TEXTS), table_)
    for i, text in enumerate(TEXTS):
        want = plain_subwords(text)
        assert count[i] == len(want)
        np.testing.assert_allclose(total[i], sum((table_[b].astype(float) for b in want), np.zeros(3)), atol=1e-4)
    assert count[3] == 0 and count[0] == 4  # ab, ab_, b_, _c


def test_probabilities_are_those_of_a_loop(spark):
    import pyarrow as pa

    model = langid.fit(table(spark, SMALL, "documents"))
    texts = [t for t in TEXTS if t and len(plain_subwords(t))]
    found = model.probabilities(pa.array(texts))
    for p, text in zip(found, texts):
        rows = [model.table[b].astype(float) for b in plain_subwords(text)]
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        e = np.exp(z - z.max())
        np.testing.assert_allclose(p, e / e.sum(), atol=1e-4)


def test_pooling_and_scores_are_those_of_a_loop():
    import pyarrow as pa

    from clicktide.llm.words import raw, words

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = ["One two one", "", None, "a\tb\n\nc  D", "x", "é è é"]
    found = quality.pool(pa.array(texts), vectors)
    net = quality.train(rng.normal(size=(40, 2 * quality.DIM)), rng.integers(0, 2, 40).astype(float), epochs=3)
    scores = net.score(found)
    for i, text in enumerate(texts):
        rows = [vectors[quality._buckets(words(*raw(pa.array([w])), lower=False).hashes)[0]].astype(float) for w in (text or "").split()]
        mean = [sum(r[d] for r in rows) / len(rows) if rows else 0 for d in range(quality.DIM)]
        spread = [(sum((r[d] - mean[d]) ** 2 for r in rows) / len(rows)) ** 0.5 if rows else 0 for d in range(quality.DIM)]
        x = mean + spread
        np.testing.assert_allclose(found[i], x, atol=2e-3)
        hidden = [np.tanh(sum((x[k] - net.shift[k]) / net.scale[k] * net.w1[k, j] for k in range(len(x))) + net.b1[j]) for j in range(len(net.b1))]
        z = sum(h * w for h, w in zip(hidden, net.w2)) + net.b2
        assert abs(scores[i] - 1 / (1 + np.exp(-z / net.temperature))) < 2e-3


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = QUERIES["op4_quality"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000
    assert all(r.held_out == (brute.fold(r.doc_id, 3) == 1) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_of_strange_documents(spark, strange):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (11, 0), (4, 1), (7, 1)], "doc_id bigint, quality int")
    rows = quality.quality(strange, labels).collect()
    assert len(rows) == len(STRANGE) and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(strange.where("false"), labels).count() == 0
    assert {r.score for r in quality.quality(strange, labels.where("false")).collect()} == {0.5}
