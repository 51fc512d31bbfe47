"""The numpy split against a regular expression."""

import re

import numpy as np
import pyarrow as pa

from tidewatch.llm.words import Words, slices

TEXTS = ["", None, "a", "  a\tbb\n ccc", "end\n", "été ñ x", "b", "a bb ccc", "\x0b\x0c\r\x1f\x85", "word " * 50]


def split(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_split_and_hashes():
    w = Words(pa.array(TEXTS))
    got = [bytes(w.data[s:e]).decode() for s, e in zip(w.starts, w.ends)]
    want = [x for t in TEXTS for x in split(t)]
    assert got == want
    assert list(w.counts()) == [len(split(t)) for t in TEXTS]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(want))
    assert {x: v for x, v in zip(want, h)} == dict(zip(want, h))
    alone = [int(Words(pa.array([x])).hashes()[0]) for x in want]
    assert alone == [int(x) for x in h]


def test_lower_and_slices():
    a, b = Words(pa.array(["AbC ÉX"]), lower=True), Words(pa.array(["abc Éx"]))
    assert np.array_equal(a.hashes(), b.hashes())
    rows = pa.array(["x" * 10] * 7).slice(2)
    assert [r for lo, hi in slices(rows) for r in range(lo, hi)] == list(range(5))
    assert len(Words(pa.array([], pa.string()))) == 0
