"""Nearest vectors: recall and scores against all inner products, ties, odd vectors."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidewatch.llm.catalog import QUERIES
from tidewatch.llm import neighbours
from tidewatch.llm.neighbours import Block, Cells, chi2_below, nearest

SF = "/root/testdata/sf0.1"


def test_chi_square():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(200_000, 8)) ** 2).sum(axis=1)
    for q in (2.0, 7.0, 15.0):
        assert chi2_below(np.array(q), 8) == pytest.approx((x <= q).mean(), abs=0.01)


def test_block_stops_early_and_finds():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32)) * 3
    v = centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 32)) * 0.3
    block = Block(v, float(np.sqrt((v * v).sum(axis=1)).max()), leaf=64)
    hit = 0
    found = block.search(v[:100], 20)
    for q, rows in zip(v, found):
        hit += len(set(rows.tolist()) & set(np.argsort(-(v @ q))[:20].tolist()))
    assert hit / 2000 > 0.9 and block.verified < 100 * 6000 * 0.8


def test_recall(spark):
    got = QUERIES["op8_nearest_neighbours"](spark, SF).toPandas()
    data = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, v = data.vec_id.to_numpy(), np.stack(data.embedding).astype(np.float64)
    at = {i: n for n, i in enumerate(ids)}
    assert set(got.query_id) == {i for i in ids if i % 20 == 0} and (got.groupby("query_id").size() == 20).all()
    hit = 0
    for q, part in got.groupby("query_id"):
        score = v @ v[at[q]]
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.score, score[[at[i] for i in part.vec_id]], rtol=0, atol=1e-12)
        assert (np.diff(part.score) <= 0).all()
        score[at[q]] = -np.inf
        hit += len(set(part.vec_id) & set(ids[np.argsort(-score, kind="stable")[:20]]))
    assert hit / len(got) >= 0.95


def test_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0], "a") for i in range(100)] + [(i, [0.5, 0.5], "b") for i in range(100, 110)]
    rows += [(200, None, ""), (201, [0.0, 0.0], ""), (202, [1.0, None], ""), (203, [float("nan"), 1.0], ""), (204, [float("inf"), 0.0], ""), (205, [1.0], ""),
             (None, [1.0, 1.0], ""), (0, [1.0, 0.0], "a"), (220, [-1.0, 3.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    out = nearest(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {0, 20, 40, 60, 80, 100, 220}
    assert by[20] == [(i, 1.0) for i in range(21) if i != 20] and by[0] == [(i, 1.0) for i in range(1, 21)]
    assert by[100][:9] == [(220, 1.0)] + [(i, 0.5) for i in range(0, 8)] and len(by[220]) == 20 and by[220][0] == (100, 1.0)
    few = nearest(df.filter("vec_id >= 100"), F.col("vec_id") == 220).collect()
    assert [r.vec_id for r in sorted(few, key=lambda r: r["rank"])] == list(range(100, 110))
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def plain(rows, k):
    """All inner products in double precision, ties to the smaller id."""
    out = set()
    for q, x in rows:
        if q % 20 == 0:
            best = sorted((-(np.array(v) * np.array(x)).sum(), i) for i, v in rows if i != q and len(v) == len(x))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block_rows", [100, 16384])
def test_ties_among_different_vectors(spark, monkeypatch, block_rows):
    """Small integers tie everywhere; every list is that of brute force, over one block or many, and for each length."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(6)
    v = rng.integers(-1, 2, (1200, 16)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v) if x.any()] + [(5000 + i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(100)]
    rows = [(i, x) for i, x in rows if any(x)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, block string, dim int").repartition(3)
    got = {tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, sure=2.0).collect()}
    assert got == plain(rows, 20)


def test_clusters_are_searched_in_part(spark, monkeypatch):
    """On clustered vectors the stop test keeps most blocks shut, and nearly all neighbours are found."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 250)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24)) * 4
    v = (centres[rng.integers(30, size=6000)] + rng.normal(size=(6000, 24)) * 0.3).round(3)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in nearest(df, F.col("vec_id") % 20 == 0).collect()}
    want = set()
    for q in range(0, 6000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-s, kind="stable")[:20]}
    assert len(got & want) >= 0.95 * len(want)


def test_cells_are_even():
    p = np.random.default_rng(0).normal(size=(4000, 8))
    cells = Cells(p, 8)
    n = np.bincount(cells.of(p), minlength=8)
    assert len(n) == 8 and n.min() > 400 and (Cells(p, 1).of(p) == 0).all()
