"""Quality rules: statistics against a plain count, the order of the cascade, and odd rows."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm.rules import Rule, cascade, plan_order, statistics

TEXTS = [
    None, "", " \n ", "a b c d", "a b c a b c", "x x x x x x", "l one\nl one\nl two\n\n\nl one", "# | <a> *b*",
    "a b c q a b c r z a b c", "the end\x0bof\x1fit\x85now", "é " * 60, "w1 w2 w3 " * 900 + "tail", " ".join(f"u{i}" for i in range(300)),
]


def plain(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def frame(spark, texts):
    return spark.createDataFrame([(i // 2, t, "kept?") for i, t in enumerate(texts)], "doc_id long, text string, kept string")


def test_statistics(spark):
    rows = statistics(frame(spark, TEXTS)).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain(r.text), r.text
    assert len(rows) == len(TEXTS)


def test_cascade_and_edges(spark):
    df = frame(spark, TEXTS)
    out = cascade(df).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        n, _, _, _, rep = plain(r.text)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (not r.base_failed and r.rejected_by is None)
    assert cascade(df.limit(0)).count() == 0
    # an order of any kind gives the same verdicts
    again = {(r.doc_id, r.text): r.kept for r in cascade(df, sample_rows=3).collect()}
    assert again == {(r.doc_id, r.text): r.kept for r in out}


def test_order_is_by_rejection_per_cost(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id").withColumn("x", F.col("doc_id") % 10)
    rules = [
        Rule("dear", F.col("x") < 5, F.lit(100.0)), Rule("cheap", F.col("x") < 1, F.lit(1.0)),
        Rule("never", F.col("x") > 100, F.lit(1.0)), Rule("good", F.col("x") < 4, F.lit(2.0)), Rule("null", F.lit(None).cast("boolean"), F.lit(1.0)),
    ]
    order = plan_order(df, rules)
    assert [x[0] for x in order] == ["good", "cheap", "dear", "never", "null"]
    assert abs(order[0][1] - 0.4) < 0.1 and order[0][2] == 2.0
