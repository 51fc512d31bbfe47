"""The pipeline, stage by stage, against plain versions over the same small tables."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_jaccard import plain_components
from test_mixing import rounds
from test_secrets import base_spans
from tidewatch.llm.quality import fit, text_statistics
from tidewatch.llm.secrets import scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(step(spark, docs, SF), "test_" + name.replace(" ", "_"))
        out.append((before, docs))
    return out


def rows(df):
    return df.toPandas()


def test_columns(results):
    given = results[0][0].columns
    assert all(after.columns == given for _, after in results[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "packing"]


def test_quality(spark, results):
    before, after = map(rows, results[0])
    labels = rows(spark.read.parquet(f"{SF}/labels.parquet"))
    labels = labels[[zlib.crc32(str(i).encode()) % 3 != 1 for i in labels.doc_id]].set_index("doc_id").quality
    x = dict(zip(before.doc_id, text_statistics(pa.array(before.text, pa.string()))))
    sums = []
    for k in (0, 1):
        a = np.array([x[i] for i in labels.index[labels == k]])
        sums.append((k, len(a), a.sum(0), a.T @ a))
    model = fit(sums)
    want = {i for i in before.doc_id if model.score(x[i][None])[0] >= 0.5}
    assert set(after.doc_id) == want and len(after) == len(want)
    clean = set(labels.index[labels == 1])
    assert len(clean & want) >= 0.97 * len(clean)


def test_near_duplicates(results):
    before, after = map(rows, results[1])
    comp = plain_components(list(zip(before.doc_id, before.text)), 5, 80)
    assert sorted(after.doc_id) == sorted(i for i, c in comp.items() if i == c)
    assert dict(zip(after.doc_id, after.text)).items() <= dict(zip(before.doc_id, before.text)).items()


def test_secrets(spark, results):
    before, after = rows(results[2][0]), rows(results[2][1]).set_index("doc_id")
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in scan(results[2][0]).collect()}
    for i, t in zip(before.doc_id, before.text):
        assert [s for s in found[i] if s[1] < 3] == base_spans(t)
        done, at = "", 0
        for a, _, b in found[i]:
            done += t[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        assert after.text[i] == done + t[at:]
        assert found[i] == [] or after.n_chars[i] == len(after.text[i])


def test_mixing(results):
    before, after = rows(results[3][0]), rows(results[3][1])
    size = {i: len(t.split()) for i, t in zip(before.doc_id, before.text)}
    by = Counter()
    for s, i in zip(before.source, before.doc_id):
        by[s] += size[i]
    target = rounds(dict(by))
    got = Counter()
    for s, t in zip(after.source, after.text):
        got[s] += len(t.split())
    assert all(abs(got[s] - t) <= 1 for s, t in target.items())
    per = Counter(after.doc_id)
    assert max(per.values()) <= 2
    whole = dict(zip(before.doc_id, before.text))
    assert sum(t != whole[i] for i, t in zip(after.doc_id, after.text)) <= 2 * len(by)


def test_packing(results):
    before, after = rows(results[4][0]), rows(results[4][1])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in zip(before.doc_id, before.text))
    assert Counter({k: v for k, v in Counter(zip(after.doc_id[after.start == 0], after.doc_tokens[after.start == 0])).items()}) == want
    assert after.length.sum() == sum(n * c for (_, n), c in want.items())
    full = after.groupby("sequence_id").length.sum()
    assert full.max() <= 1024 and after.length.sum() / (1024 * len(full)) > 0.98


def test_helper_columns_do_not_clash(spark):
    """Columns named like the helpers stay as they are; a map column, rows that repeat one id with other texts."""
    import corpus_pipeline

    text = "some plain words of a text that nobody copied " * 3
    rows = [(1, text, 1.5, "a", {"k": 1}), (1, text, 1.5, "a", {"k": 1}), (1, "quite another text " * 20, 2.5, "b", {}), (2, None, 0.5, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans double, _clean string, _row map<string,int>")
    clean = corpus_pipeline.without_secrets(spark, docs, "")
    assert sorted((r["_spans"], r["_clean"]) for r in clean.collect()) == [(0.5, "c"), (1.5, "a"), (1.5, "a"), (2.5, "b")]
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert sorted((r.doc_id, r["_spans"], str(r["_row"])) for r in kept.collect()) == [(1, 1.5, "{'k': 1}"), (1, 2.5, "{}"), (2, 0.5, "None")]
