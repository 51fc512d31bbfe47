"""Phrases against a plain count, whatever the shards, the bitmap and the rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm.collocations import PieceWords, collocations, counts_of, phrases, support


def plain(rows, least, top):
    pieces = {}
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            pieces.setdefault("und" if lang is None else lang, []).append(re.findall("[^ \t]+", piece))
    out = []
    for lang, found in pieces.items():
        f = Counter(tuple(w[i:i + k]) for w in found for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(len(w) for w in found)
        many = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        made = []
        for p, a in many.items():
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in many.items())
            cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            if not inside:
                score, _, l, r = min(cuts)
                made.append((-score, -a, " ".join(p).encode(), l, r))
        made.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -score) for i, (score, a, p, l, r) in enumerate(made[:top])]
    return sorted(out)


def sample():
    rng = random.Random(2)
    words = ["the", "The", "of", "and", "new", "york", "é", "日本", "x" * 300, "a b", "\x1f"]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(["new york city", "in order to", rng.choice(words), rng.choice(words), "a a a a a a"]))
            parts.append(rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]))
        rows.append((rng.choice(["en", "en", "en", None, "und", ""]), "".join(parts)))
    return rows + [(None, None), ("en", ""), ("fr", "   "), ("en", rows[0][1]), ("en", "tail " * 5000)]


ROWS = sample()


@pytest.mark.parametrize("size, bits", [(1 << 30, 1 << 20), (300, 1 << 20), (1, 1 << 10), (2000, 64)])
def test_plain_count(spark, size, bits):
    """One shard, many, one a slice; roomy and full bitmaps (a full one marks everything)."""
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in ROWS], "lang string, text string, n int, phrase string, key int").repartition(5)
    got = collocations(df, least=8, top=40, size=size, filter_bits=bits)
    assert sorted(map(tuple, got.collect())) == plain(ROWS, 8, 40)


def test_ranks_and_ties(spark):
    rows = [("en", "a b, c d, e f. ") for _ in range(4)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert [(r.rank, r.phrase) for r in collocations(df, least=4, top=2).orderBy("rank").collect()] == [(1, "a b"), (2, "c d")]
    assert collocations(df, least=5).count() == 0
    assert collocations(df.filter("false")).count() == 0


def test_support_of_shards_loses_nothing():
    """Any cut of the words: a frequent phrase has the support of some shard, and the bound is no lower than its count."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        total, shards, least = int(rng.integers(20, 400)), int(rng.integers(1, 12)), int(rng.integers(1, 60))
        sizes = rng.multinomial(total, np.full(shards, 1 / shards))
        counts = [int(rng.integers(0, s + 1)) for s in sizes]
        needs = [support(least, int(s), total) if s else 1 for s in sizes]
        given = [(c, n) for c, n in zip(counts, needs) if c >= n]
        if sum(counts) >= least:
            assert given
        assert sum(c - (n - 1) for c, n in given) + sum(n - 1 for n in needs) >= sum(counts)


def test_keys_of_phrases():
    w = PieceWords(pa.array(["A b, a b", None, "b a b.c"]))
    found = {length: (key, ok) for length, key, ok in phrases("en", w.hashes(), w.piece, 3)}
    key, ok = found[2]
    assert ok.tolist() == [True, False, True, False, True, True, False]
    assert key[0] == key[2] == key[5] != key[4]
    assert found[3][1].sum() == 1 and not any(key[0] in k for _, k, _ in phrases("de", w.hashes(), w.piece, 2))
    value, times = counts_of(key[ok])
    assert sorted(times.tolist()) == [1, 3] and (np.sort(value) == value).all()
