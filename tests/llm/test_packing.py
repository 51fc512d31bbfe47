"""Packing: ids against the tokenizer itself, gapless windows, little padding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewatch.llm.packing import Encoder, minimum_slack, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "\n a", "a b\n", "don't we'll I'M", "x<|endoftext|>y", "été ñandú", "日本 語",
    "1234 5,6", "tab\tand\x0bmore", "“quoted” – dash…", "a b c ", "emoji 🙂 end", "\x85 x", "one two one two",
]


def test_encoder_equals_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    ids, bounds = Encoder(PATH)(ODD)
    for i, text in enumerate(ODD):
        assert ids[bounds[i]: bounds[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids + [0], text
    ids, bounds = Encoder(PATH)([])
    assert len(ids) == 0 and bounds.tolist() == [0]


def test_minimum_slack_uses_all_and_fills():
    rng = np.random.default_rng(1)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(rng.integers(1, 1024, 5000), return_counts=True))))
    plan = minimum_slack(counts)
    used = dict.fromkeys(counts, 0)
    for window, repeats in plan:
        assert sum(n * c for n, c in window.items()) <= 1024
        for n, c in window.items():
            used[n] += c * repeats
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert sum(r for _, r in plan) <= -(-total // 1024) * 1.01 + 2
    assert minimum_slack({}) == [] and minimum_slack({7: 3}, 10) == [({7: 1}, 3)]
    assert minimum_slack({3: 10**12, 7: 10**12}, 10) == [({7: 1, 3: 1}, 10**12)]


@pytest.mark.parametrize("partitions", [1, 5])
def test_pack(spark, partitions):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, " a", "y"), (None, None, None), (500, "word " * 5000, "z"), (501, "b c" * 900, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(partitions)
    got = pack(docs, PATH, with_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = {}
    for i, text, _ in rows:
        want.setdefault(i, t.encode(text or "", add_special_tokens=False).ids + [0])
    full = {}
    for r in got:
        ids = want[r.doc_id][r.start: r.start + r.length]
        assert r.ids == ids and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        full.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded))
    assert sum(r.length for r in got) == sum(len(want[i]) for i, _, _ in rows)
    assert sorted(full) == list(range(len(full)))
    for parts in full.values():
        end = 0
        for offset, length, padded in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024 and padded == (end if end & (end - 1) == 0 else 1024)
    assert pack(docs.limit(0), PATH).count() == 0
