"""Repeated word sequences: removal against a plain dictionary of windows, the parse's consistency, odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import substrings
from tidewatch.llm.substrings import Parse, deduplicated, fingerprints, picks
from tidewatch.llm.words import Words


def plain(rows, window):
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p: p + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for p in range(len(w) - window + 1):
                if least[tuple(w[p: p + window])] < i:
                    gone.update(range(p, p + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the"] * 20
    passages = [[rng.choice(words) for _ in range(rng.choice([20, 49, 50, 51, 80, 200]))] for _ in range(8)]
    passages += [["run"] * 120, (["a", "b"] * 60), ["x"] * 30 + ["y"] * 25]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.2:
            text = rng.choice(rows)[1]
        else:
            w = []
            for _ in range(rng.randint(0, 4)):
                w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 150))]
            text = rng.choice([" ", "\n", "  "]).join(w)
        rows.append((i, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window,ids", [(1, 50, 10**6), (2, 50, 0), (3, 12, 10**6)])
def test_removal(spark, monkeypatch, seed, window, ids):
    monkeypatch.setattr(substrings, "BROADCAST_IDS", ids)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((tuple(r) for r in deduplicated(df, window).collect()), key=str)
    assert got == plain(rows, window)


def test_equal_windows_pick_equal_symbols():
    rng = np.random.default_rng(0)
    shared = " ".join(f"s{i}" for i in rng.integers(0, 30, 50))
    keys = set()
    for _ in range(200):
        around = [" ".join(f"s{i}" for i in rng.integers(0, 30, rng.integers(0, 70))) for _ in range(2)]
        text = f"{around[0]} {shared} {around[1]}"
        at = len(around[0].split())
        _, key, a, b = picks(Words(pa.array([text])), 50)
        keys.add(int(key[(a <= at) & (at <= b)][0]))
        assert a[0] == 0 and (a[1:] == b[:-1] + 1).all() and b[-1] == len(text.split()) - 50
    assert len(keys) == 1


def test_parse_is_monotone_and_shrinks():
    rng = np.random.default_rng(1)
    w = Words(pa.array([" ".join(f"w{i}" for i in rng.integers(0, 500, n)) for n in (0, 1, 3000, 2, 500)]))
    p = Parse(w)
    assert (np.diff(p.low) >= 0).all() and (np.diff(p.high) >= 0).all() and p.size.sum() == len(w) and p.size.max() <= 16
    assert len(p.name) < 0.5 * len(w)
    one, two = fingerprints(w.hashes(), np.arange(10, 300), 50)
    assert len(set(one.tolist())) == len(set(two.tolist())) == 290


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60000))
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(70))
    rows = [(5, None), (6, ""), (7, a), (7, a), (8, a + " tail"), (9, b), (9, "head " + a), (10, b), (None, a), (None, None), (11, long), (12, long + " z"), (3, "\n \n"), (10, b)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")
    got = sorted((tuple(r) for r in deduplicated(df).collect()), key=str)
    assert got == plain(rows, 50)
    assert deduplicated(df.limit(0)).count() == 0
