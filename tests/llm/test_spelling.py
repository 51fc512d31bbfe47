"""Spelling variants against brute force: pairs, partitions of any size, forms, roots and odd texts."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidewatch.llm.spelling import Acceptor, near_words, one_edit, slipped, variants, vocabulary


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def plain(words):
    form, count = {}, {}
    for w, n in words.items():
        mates = [(-m, v) for v, m in words.items() if near(w, v)]
        count[w] = len(mates)
        if mates and -min(mates)[0] >= 2 * n:
            form[w] = min(mates)[1]
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, count[w], words.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def test_composition_gives_each_pair_once():
    rng = random.Random(3)
    for _ in range(300):
        letters = "abc"[: rng.choice([1, 2, 3])]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 70))})
        got = list(one_edit(Acceptor(words)))
        want = {(u, v) for u in words for v in words if near(u, v) and (len(u), u) < (len(v), v)}
        assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abc" for b in "xy" for c in ("tion", "ing", ""))
    made = Acceptor(words)
    reached, stack = {0}, [0]
    while stack:
        for to in made.edges[stack.pop()].values():
            if to not in reached:
                reached.add(to)
                stack.append(to)
    def language(q):
        return frozenset((["" ] if made.final[q] else []) + [c + x for c, to in made.edges[q].items() for x in language(to)])
    assert language(0) == set(words)
    assert len({language(q) for q in reached}) == len(reached)


def test_slip():
    run = next(f"w{chr(97 + i % 26)}ord{'x' * (i // 26)}" for i in range(20000) if zlib.crc32(f"5:w{chr(97 + i % 26)}ord{'x' * (i // 26)}".encode()) % 97 == 0)
    h = zlib.crc32(f"5:{run}".encode())
    assert len(slipped(run.encode(), h)) == len(run) - 1
    assert slipped("éà".encode(), 97) == "é".encode() and slipped(b"abc", 1) == b"abc"


@pytest.mark.parametrize("most", [2, 10, 20_000])
def test_partitions_of_any_size(spark, most):
    """One letter in a third of all first halves, long words, accents; pairs counted once however they are cut."""
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 8))): rng.randrange(3, 50) for _ in range(250)}
    words |= {"aaaa" + "".join(rng.choice("ab") for _ in range(5)): rng.randrange(3, 50) for _ in range(40)}
    long = "".join(rng.choice("xyz") for _ in range(1500))
    words |= {long: 5, long[:700] + long[701:]: 12, long[:-1] + "q": 30, "z" * 900: 3, "z" * 901: 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best, r.best_n) for r in near_words(df, most).collect()}
    want = {}
    for w in words:
        mates = [(-m, v) for v, m in words.items() if near(w, v)]
        if mates:
            want[w] = (len(mates), min(mates)[1], -min(mates)[0])
    assert got == want


def sample():
    rng = random.Random(8)
    base = ["colour", "color", "colours", "Grüße", "grüsse", "naïve", "naive", "recieve", "receive", "receives", "letter", "better", "bitter", "banana"]
    rows = []
    for i in range(400):
        text = rng.choice([" ", "-", "\n", "1", "ā"]).join(rng.choice(base[: 1 + i % len(base)]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice([i, i, 7, None]), text))
    rows += [(900 + i, "qwerta " * 3 + "qwertas " * 9 + "qwertase " * 30 + "qwertasen " * 90) for i in range(3)]  # forms of forms
    return rows + [(1, None), (None, None), (2, ""), (3, "abcde" * 300 + " " + "abcde" * 300 + " " + "abcde" * 300), (4, "ÀÀÀÀÀ ààààà ×××××÷ " * 4)]


def test_variants(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = plain(words_of(rows))
    got = sorted(map(tuple, variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == want and any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])
    empty = df.filter("false")
    assert variants(empty).count() == 0 and vocabulary(empty).count() == 0
