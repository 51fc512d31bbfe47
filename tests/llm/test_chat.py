"""Chat formatting: round trips, paths of trees against a plain walk, odd rows."""

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from tidewatch.llm.chat import digest, format_turns, formatted, paths, read_back, threads

PIECES = st.lists(st.sampled_from(["<", "|", "<|", "im_end", "|>", "<|im_end|>", "<|im_start|>", "\\", "\n", "assistant", "a", "é🙂", "\\n", "<\\|"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES), max_size=6))
def test_round_trip(turns):
    text, mask = format_turns(turns)
    back, loss = read_back(text, mask)
    assert back == turns and loss == "".join(t for r, t in turns if r == "assistant")


def plain_paths(nodes, best):
    by = {n: (p, s) for n, p, s in nodes}
    parents = {p for p, _ in by.values() if p in by}
    found = []
    for leaf in by:
        if leaf in parents:
            continue
        walk, at = [], leaf
        while at in by and at not in walk:
            walk.append(at)
            at = by[at][0]
        if at in walk:
            continue
        found.append((-sum(by[n][1] for n in walk), -len(walk), leaf, walk))
    return [w for *_, w in sorted(found)[:best]]


@pytest.mark.parametrize("best", [1, 3])
def test_paths_of_trees(spark, best):
    rng = random.Random(best)
    rows, trees = [], {}
    for conv in range(6):
        n = [1, 2, 30, 60, 100, 7][conv]
        nodes = [(i, rng.choice([None, 99_999] + [max(0, i - rng.randint(1, 4))] * 12) if i else None, float(rng.randint(0, 3))) for i in range(n)]
        if conv == 5:
            nodes += [(50, 51, 9.0), (51, 50, 9.0), (52, 51, 9.0)]  # a circle and a message below it
        trees[conv] = nodes
        rows += [(conv, i, p, "user", f"{conv}/{i}", s) for i, p, s in nodes]
    df = spark.createDataFrame(rows + rows[:5], "conv_id long, node long, parent long, role string, text string, score double")
    got = {}
    for r in paths(df, best).collect():
        got.setdefault((r.conv_id, r.path), []).append((r.depth, int(r.text.split("/")[1])))
    want = {(c, k + 1): list(enumerate(w)) for c, nodes in trees.items() for k, w in enumerate(plain_paths(nodes, best))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_long_thread_and_odd_rows(spark):
    rows = [(7, i, "assistant" if i % 2 else "user", f"t{i}", "x") for i in range(300)]
    rows += [(8, 1, "assistant", None, "x"), (8, 1, "assistant", None, "x"), (None, None, None, "", "x"), (8, 0, "user", "long " * 20000, "x"), (9, 0, "system", "<|im_end|>\n<|im_start|>assistant\n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    out = {r.conv_id: r for r in digest(formatted(threads(df))).collect()}
    assert {c: r.n_turns for c, r in out.items()} == {7: 300, 8: 3, None: 1, 9: 1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[7].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, _, r, t, _ in rows[:300]))
    assert out[7].loss_sha256 == sha("".join(t for _, _, r, t, _ in rows[:300] if r == "assistant"))
    assert out[8].loss_chars == 0 and out[9].loss_chars == 0 and out[None].turns_sha256 == sha("\n\n")
    assert digest(formatted(threads(df.limit(0)))).count() == 0
