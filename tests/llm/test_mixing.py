"""Mixing: targets against water-filling by rounds, the schedule's evenness, and the parts against the totals."""

import re
from collections import Counter, defaultdict

import pytest

from tidewatch.llm.mixing import fill_targets, mix, mixed_documents, point, taken
from pyspark.sql import functions as F


def rounds(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, None: 5}, {"a": 1, "b": 1, "c": 1, "d": 1}, {"a": 0, "b": 7}, {"é": 100, "z": 3, "Z": 40, None: 900}, {"only": 3}, {"none": 0},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in fill_targets(df).collect()}
    assert got == pytest.approx(rounds(sizes))


def docs_of(spark, partitions=3):
    rows = [(i, f"w{i} " * (i % 40 + 1), "hot" if i % 3 else f"s{i % 5}", "x") for i in range(400)]
    rows += [(1000, None, "hot", "x"), (1001, "", None, "x"), (1002, "a b c", None, "x"), (5, "dup dup", "hot", "x"), (5, "dup dup", "hot", "x"),
             (None, "q w", "s1", "x"), (1003, "long " * 5000, "s2", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(partitions)


def test_taken_and_parts(spark):
    rows, docs = docs_of(spark)
    got = taken(docs, block=16).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, _, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    parts = mix(docs, block=16).filter("slot IS NOT NULL").collect()
    by_source, per_slot = Counter(), defaultdict(list)
    for p in parts:
        by_source[p.skey] += p.part_words
        per_slot[p.slot].append((p.place, p.part_words, p.skey))
    targets = {p.skey: p.target for p in parts}
    for s, t in targets.items():
        assert abs(by_source[s] - t) <= 1
    for s in per_slot.values():  # the parts of a slot are gapless and of one source
        end = 0
        for place, n, _ in sorted(s):
            assert place == end
            end += n
        assert len({x[2] for x in s}) == 1
    # any stretch of slots is near the target proportions
    order = sorted(per_slot)
    half = Counter(x[2] for k in order[: len(order) // 2] for x in per_slot[k][:1])
    whole = sum(targets.values())
    for s, t in targets.items():
        assert abs(half[s] / (len(order) // 2) - t / whole) < 0.05


def test_reruns_agree(spark):
    _, docs = docs_of(spark)
    a = sorted(map(str, taken(docs, block=16).drop("slots").collect()))
    b = sorted(map(str, taken(docs.repartition(7), block=64).drop("slots").collect()))
    assert a == b


def test_documents(spark):
    _, docs = docs_of(spark)
    want = {(r.doc_id, r.size): 0 for r in taken(docs).collect()}
    for r in taken(docs).collect():
        want[r.doc_id, r.size] += r.taken
    got = Counter()
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
    by_id = Counter()
    for (i, _), n in want.items():
        by_id[i] += n
    assert {i: n for i, n in by_id.items() if n} == dict(got)
    assert taken(docs.limit(0)).count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_documents_come_in_the_order_of_the_schedule(spark):
    _, docs = docs_of(spark)
    rows = [(r.doc_id, r.source, len(r.text.split())) for r in mixed_documents(docs.filter("doc_id <> 1003"), block=16).collect()]
    first = {}
    for p in mix(docs.filter("doc_id <> 1003"), block=16).filter("slot IS NOT NULL").collect():
        at = (p.doc_id, p.nth, p.skey, p.cell, p.read)
        first[at] = min(first.get(at, (p.slot, p.place)), (p.slot, p.place))
    assert [i for i, _, _ in rows] == [at[0] for at in sorted(first, key=first.get)]
    # so half of the rows have every source in nearly its share
    share = lambda part: {s: sum(n for _, x, n in part if x == s) / sum(n for _, _, n in part) for s in {x for _, x, _ in rows}}
    half, whole = share(rows[: len(rows) // 2]), share(rows)
    assert all(abs(half[s] - whole[s]) < 0.05 for s in whole)


def test_points(spark):
    k = [0, 1, 2, 10**6, 10**9 + 7, 2**39]
    got = [r.u for r in spark.createDataFrame([(x,) for x in k], "k long").select(point(F.col("k")).alias("u")).collect()]
    from fractions import Fraction

    phi = Fraction(0.6180339887498949)
    assert got == pytest.approx([float(x * phi % 1) for x in k], abs=1e-6)
