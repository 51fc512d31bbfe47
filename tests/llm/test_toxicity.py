"""Toxicity: the index against all cosines, held-out accuracy, odd rows."""

import zlib

import numpy as np

from tidewatch.llm.catalog import QUERIES
from tidewatch.llm.toxicity import BlockMaxIndex, TextIndex, choose_terms, classify, term_counts

SF = "/root/testdata/sf0.01"


def test_index_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    centres = [np.sort(rng.choice(200, 8, replace=False)) for _ in range(30)]
    vectors = []
    for _ in range(3000):
        t = np.sort(rng.choice(centres[rng.integers(30)], rng.integers(0, 7), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum()) if len(t) else w))
    index = BlockMaxIndex(vectors, 200, block=32)
    dense = np.zeros((3000, 200))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    queries = range(0, 3000, 60)
    for i in queries:
        near, cos = index.search(*vectors[i], 10, skip=i)
        all_ = dense @ dense[i]
        all_[i] = -1
        want = sorted(((-round(c, 12), j) for j, c in enumerate(all_) if round(c, 12) > 0))[:10]
        assert [j for _, j in want] == near.tolist() and np.allclose([-c for c, _ in want], cos)
    assert index.opened < len(queries) * index.blocks * 0.7


def test_whole_texts_are_searched_exactly():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.15, (700, 300)) * rng.integers(1, 4, (700, 300))
    counts[:, :20] += rng.poisson(1.0, (700, 20))
    counts[5] = 0
    counts[5, 299] = 2
    idf = rng.uniform(1, 5, 300)
    weight = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    weight /= np.sqrt((weight**2).sum(axis=1, keepdims=True))
    row, term = np.nonzero(counts)
    bounds = np.searchsorted(row, np.arange(701))
    index = TextIndex(bounds, term.astype(np.int32), counts[row, term].astype(np.uint8), idf, dense=20)
    # one array holds the example and its weight for every posting outside the dense block
    assert len(index.postings) == len(term) - (index.slot[term] >= 0).sum() and index.postings.imag.min() > 0
    queries = [(np.flatnonzero(w), w[w > 0]) for w in weight[:150]] + [(np.zeros(0, np.int64), np.zeros(0))]
    skip = [i if i % 2 else -1 for i in range(150)] + [-1]
    for i, (near, cos) in enumerate(index.search(queries, 15, skip)):
        all_ = np.round(weight @ weight[i], 12) if i < 150 else np.zeros(700)
        if skip[i] >= 0:
            all_[skip[i]] = -1
        want = sorted((-c, j) for j, c in enumerate(all_) if c > 0)[:15]
        assert [j for _, j in want] == near.tolist() and np.allclose([-c for c, _ in want], cos, atol=1e-11)


def test_held_out_accuracy(spark):
    got = QUERIES["op3_toxicity"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    assert len(got) == 1000 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    test = got[got.held_out & got.doc_id.isin(labels.index)]
    assert (labels[test.doc_id].to_numpy() == test.predicted).mean() > 0.95


def test_terms_by_hand(spark):
    rows = [(f"bad, {i} word", 1) for i in range(20)] + [(f"good {i} word", 0) for i in range(20)]
    chosen = choose_terms(spark.createDataFrame(rows, "text string, label int"))
    assert len(chosen) == 1  # "word" is in all, "good" in the others
    docs = spark.createDataFrame([(1, "BAD good-good bad!"), (2, None), (3, "other")], "doc_id long, text string")
    got = {r.doc_id: sorted(r["counts"]) for r in term_counts(docs, chosen).collect()}
    assert got == {1: [2], 2: [], 3: []}


def test_odd_rows(spark):
    rows = [(i, f"idiot scum {i}" if i % 2 else f"fine day {i}", "x") for i in range(60)] + [(None, None, "x"), (900, "", "x"), (901, "idiot " * 5000, "x"), (901, "idiot " * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (7, 1), (6, 3)], "doc_id long, label int")
    out = classify(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all(by[i].predicted == i % 2 for i in range(60)) and by[901].predicted == 1 and by[901].evidence[0].toxic == 1
    assert by[900].evidence == [] and by[900].score == by[None].score
    assert {r.predicted for r in classify(docs, labels.limit(0)).collect()} == {0}
    assert classify(docs.limit(0), labels).count() == 0


def test_neighbours_are_those_of_whole_texts(spark):
    """No text here has a term that passes chi-squared, and a long text that shares one word is far from short ones."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 60, rng.integers(5, 40)))) for i in range(120)] + [(500, "w1 " + " ".join(f"w{j}" for j in range(2, 60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(80)], "doc_id long, label int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    terms = sorted({t for _, text in rows[:80] for t in text.split()})
    counts = np.array([[text.split().count(t) for t in terms] for _, text in rows], float)
    weight = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * (np.log((len(rows) + 1) / ((counts > 0).sum(axis=0) + 1)) + 1)
    weight /= np.sqrt((weight**2).sum(axis=1, keepdims=True))
    cos = weight @ weight[:80].T
    for n, (i, _) in enumerate(rows):
        near = sorted((-round(c, 12), j) for j, c in enumerate(cos[n]))[:3]
        assert [e.doc_id for e in got[i].evidence] == [j for _, j in near]
        assert np.allclose([e.cosine for e in got[i].evidence], [-c for c, _ in near])
    assert len({r.score for r in got.values()}) > 60
