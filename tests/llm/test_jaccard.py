"""Jaccard join: components against all pairs, the trees against all pairs, odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import common, jaccard
from tidewatch.llm.jaccard import Bands, SignatureTree, bitmap, components_of, keys_of, shingle_sets, tree_pairs


def plain_set(t, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1)))


def plain_components(rows, k, percent):
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, plain_set(t, k)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in up}


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.55:  # a copy with some edits, of any earlier text
            w = (rng.choice(rows)[1] or "x").split() or ["x"]
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12])):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.2:
                w = w[: max(1, int(len(w) * rng.choice([0.8, 0.9, 0.95])))]
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 30, 80, 200, 400])))
            if rng.random() < 0.4:
                text += "\n" + line
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_components(spark, monkeypatch, seed, k, percent):
    monkeypatch.setattr(jaccard, "SAMPLE_TIMES", 8)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in components_of(df, k, percent).collect()}
    want = plain_components(rows, k, percent)
    assert got == {i: (len(plain_set(t, k)), want[i]) for i, t in rows}


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 200)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    base = [f"b{i}" for i in range(60)]
    rng = random.Random(9)
    rows = []
    for i in range(90):  # a large group of near copies, and texts just past the threshold
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(60)] = f"x{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in components_of(df).collect()}
    assert got == plain_components(rows, 4, 85)


def test_odd_rows(spark):
    rows = [(3, None, 1), (4, "", 1), (5, " \n", 1), (6, "a b", 1), (7, "A  b", 1), (7, "A  b", 1), (2, "a b c d e", 1), (2, "totally other words here now", 1),
            (9, "a b c d e", 1), (8, "totally other words here now", 1), (None, "a b", 1), (None, "alone text", 1), (10, "long " * 30000, 1), (11, "long " * 29000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in components_of(df).collect() if r.component_id is not None)
    assert out == [(-1, 1, 6), (2, 2, 2), (2, 2, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (7, 1, 6), (8, 2, 2), (9, 2, 2), (10, 1, 10), (11, 1, 10)]
    assert components_of(df.limit(0)).count() == 0


def test_null_id_before_its_equal(spark):
    """A row without a doc_id comes first in the task of its equal set, which has a near-duplicate."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (5, text), (6, text + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.component_id) for r in components_of(df).orderBy("doc_id").collect()] == [(None, 5), (5, 5), (6, 5)]


@pytest.mark.parametrize("percent", [80, 85])
def test_blocking_loses_nothing(percent):
    rng = np.random.default_rng(percent)
    bands = Bands(percent)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 60, n).astype(np.uint64)
        d = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        b = np.unique(np.concatenate([a[d // 2:], rng.integers(0, 1 << 60, d - d // 2).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both) and (len(a) != both or len(b) != both):
            hot = rng.random() < 0.5
            rare = lambda x: (x % np.uint64(3) == 0) if hot else np.ones(len(x), bool)
            assert len(np.intersect1d(keys_of(a, rare(a), bands), keys_of(b, rare(b), bands)))


def whole(p, q, percent):
    a, b, looked = zip(*tree_pairs(p, q, percent))
    return np.concatenate(a), np.concatenate(b), sum(looked)


@pytest.mark.parametrize("front", [1 << 22, 1])
def test_trees_lose_nothing_and_prune(monkeypatch, front):
    monkeypatch.setattr(jaccard, "FRONT_BYTES", front)
    rng = np.random.default_rng(4)
    families = [rng.integers(0, 1 << 60, 100).astype(np.uint64) for _ in range(20)]
    sets = []
    for i in range(300):
        x = families[i % 20].copy()
        x[rng.integers(0, 100, rng.integers(0, 12))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(x))
    maps = np.stack([np.frombuffer(bitmap(x, 512), np.uint64) for x in sets])
    sizes, comps = np.array([len(x) for x in sets]), rng.integers(0, 40, 300)
    tree = SignatureTree(sizes, maps, comps)
    a, b, looked = whole(tree, tree, 85)
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    half = np.arange(300) < 150
    p, q = SignatureTree(sizes[half], maps[half], comps[half]), SignatureTree(sizes[~half], maps[~half], comps[~half])
    a, b, _ = whole(p, q, 85)
    across = set(zip(a.tolist(), (b + 150).tolist()))
    for i in range(300):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if comps[i] != comps[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found
                assert not (j < 150 <= i) or (j, i) in across
    assert looked < 300 * 300 and len(found) < 300 * 299 / 2 * 0.3


def test_sets_by_hand():
    texts = ["a b c d e", "A b c d e", "a b", "a b a b a b", None, "", "b c"]
    value, bounds = shingle_sets(pa.array(texts), 4)
    parts = [frozenset(value[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    assert [len(p) for p in parts] == [len(plain_set(t, 4)) for t in texts]
    assert parts[0] == parts[1] and not parts[2] & parts[6]


def test_keys_are_shuffled_once(spark):
    rows = [(k, v) for k in range(40) for v in range(k % 4)] * 2
    got = jaccard.shared_keys(spark.createDataFrame(rows, "key long, v long"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(k, v, v - 1 if v else None) for k in range(40) for v in range(k % 4) if k % 4 > 1], key=str)
