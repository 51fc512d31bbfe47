"""Quality classifier: statistics by hand, the discriminant against a plain density, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm.catalog import QUERIES
from tidewatch.llm.quality import FAR, FEATURES, TO_IDENTITY, TO_POOLED, classify, fit, moments, text_statistics, train, train_on_texts, with_score, with_statistics, with_text_score

SF = "/root/testdata/sf0.01"


def test_statistics_by_hand():
    x = dict(zip(FEATURES, text_statistics(pa.array(["the the cat\nA# 42\nthe the cat"]))[0]))
    share = lambda n, of: np.arcsin(np.sqrt(n / of))
    assert x["log_words"] == pytest.approx(np.log(9))
    assert x["word_length"] == pytest.approx(np.log1p(22 / 8))
    assert x["distinct"] == pytest.approx(share(4, 8)) and x["twins"] == pytest.approx(share(2, 8))
    assert x["repeat_3"] == pytest.approx(share(1, 6)) and x["top_word"] == pytest.approx(share(4, 8))
    assert x["symbols"] == pytest.approx(share(1, 22)) and x["digits"] == pytest.approx(share(2, 22))
    assert x["capitals"] == pytest.approx(share(1, 19)) and x["letters"] == pytest.approx(share(19, 22))
    assert x["plain_words"] == pytest.approx(share(1, 8)) and x["log_lines"] == pytest.approx(np.log(4))
    assert x["repeat_lines"] == pytest.approx(share(1, 3))
    texts = ["a b", None, "", "x " * 3000, "Été"]
    alone = np.concatenate([text_statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(text_statistics(pa.array(texts)), alone) and np.isfinite(alone).all()


def test_discriminant_against_density():
    rng = np.random.default_rng(0)
    d = len(FEATURES)
    x = [rng.normal(size=(400, d)) @ rng.normal(size=(d, d)), rng.normal(size=(300, d)) + 1]
    sums = [(k, len(a), a.sum(0), a.T @ a) for k, a in enumerate(x)]
    m = fit(sums, to_pooled=0, to_identity=0)
    want = 0
    for sign, a in zip((-1, 1), x):
        c = np.cov(a.T, bias=True)
        e = x[0] - a.mean(0)
        want = want + sign * (np.log((len(a) + 1) / 702) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
    assert np.allclose(m.log_odds(x[0]), want)
    none = fit([(0, 0, np.zeros(d), np.zeros((d, d))), (1, 0, np.zeros(d), np.zeros((d, d)))])
    assert np.all(none.score(x[0]) == 0.5)


def test_moments_do_not_depend_on_partitions(spark):
    df = with_statistics(spark.createDataFrame([(i, "w " * i, i % 2) for i in range(50)], "doc_id long, text string, label int"))
    a, b = moments(df.repartition(1)), moments(df.repartition(6))
    for p, q in zip(a, b):
        assert p[1] == q[1] == 25 and np.allclose(p[2], q[2]) and np.allclose(p[3], q[3])


def test_held_out_accuracy(spark):
    got = QUERIES["op7_quality_classifier"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all() and len(got) == 1000
    test = got[got.held_out & got.doc_id.isin(labels.index)]
    assert (labels[test.doc_id].to_numpy() == test.predicted).mean() > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (2, "x y z", "c"), (2, "x y z", "c"), (None, "q", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 1), (2, 1), (1, 0), (9, 1), (None, 0), (2, None)], "doc_id long, label int")
    out = classify(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classify(docs.limit(0), labels).count() == 0
    assert train(with_statistics(docs), labels).means.shape == (2, len(FEATURES))


def test_query_equals_a_plain_version(spark):
    """Every score of the query from numpy alone: shrunk covariances inverted, densities written out."""
    small = "/root/testdata/sf0.001"
    got = QUERIES["op7_quality_classifier"](spark, small).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    x = dict(zip(docs.doc_id, text_statistics(pa.array(docs.text, pa.string()))))
    known = [(i, q) for i, q in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality").toPandas().itertuples(index=False)
             if i in x and zlib.crc32(str(i).encode()) % 3 != 1]
    d, total = len(FEATURES), len(known)
    parts = [np.array([x[i] for i, q in known if q == label]) for label in (0, 1)]
    pooled = sum(len(p) * np.cov(p.T, bias=True) for p in parts) / total
    odds = np.zeros(len(docs))
    for sign, p in zip((-1, 1), parts):
        c = (1 - TO_POOLED) * np.cov(p.T, bias=True) + TO_POOLED * pooled
        c = (1 - TO_IDENTITY) * c + TO_IDENTITY * max(np.trace(c) / d, 1e-6) * np.eye(d)
        e = np.array([x[i] for i in docs.doc_id]) - p.mean(axis=0)
        odds += sign * (np.log((len(p) + 1) / (total + 2)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
    want = 1 / (1 + np.exp(-np.clip(odds, -FAR, FAR)))
    assert np.allclose(got.loc[docs.doc_id, "score"], want, atol=1e-6)


def test_texts_give_the_model_and_scores_of_their_statistics(spark):
    rows = [(i, f"{'w ' * (i % 7)} text {i} # {'A' * (i % 3)}", i % 2) for i in range(60)] + [(60, None, 1), (61, "", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[::2]] + [(3, None), (5, 7)], "doc_id long, label int")
    one, two = train(with_statistics(docs), labels), train_on_texts(docs, labels)
    assert np.allclose(one.means, two.means) and np.allclose(one.factors, two.factors) and np.allclose(one.offsets, two.offsets)
    a = {r.doc_id: r.score for r in with_score(with_statistics(docs), one).collect()}
    b = {r.doc_id: r.score for r in with_text_score(docs, one).collect()}
    assert a == pytest.approx(b)
