"""Spelling variants: pairs of words one edit apart, by composing automata.

Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, lower-cased for A-Z, with a planted slip: if 97 divides
h = crc32("<doc_id>:<run>"), the code point h mod length is left out.  The vocabulary is all results of
``LETTERS`` code points or more that occur ``TIMES`` times or more.

Near words are the pairs that V o E o V accepts, V the minimised acceptor of the vocabulary and E the transducer
with exactly one insertion, deletion or replacement.  One composition of the whole vocabulary would sit in one
task, so it is cut by the state that a pair reaches before its edit: of two words one edit apart, with the shorter
of s letters, either the first s / 2 or the last s - s / 2 letters are equal.  Words with one such half form a
partition; both acceptors start in that state and only what is left of the words is composed.  Partitions of more
than ``PARTITION_WORDS`` words are cut again in the same way, level by level; after few levels so few letters are
left that a partition cannot be larger.  A pair that both halves would find counts in the first only.

Within a partition the acceptor is built from sorted words with equivalent states merged.  Before the edit both
sides are in one state; at the edit they part, and after it only transitions of both are followed, through pairs
of states that still reach a common end.  Every partition gives one row per word: near words and the best of them.

A word's form is its near word of largest n (ties: the smallest), if that is at least twice its own n; ``root``
follows forms by pointer doubling (n doubles with each step, so the rounds are few).

Edge cases: null or empty texts have no words; a null doc_id reads ``null``; repeated rows count again; columns other
than doc_id and text are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.jaccard import roots
from tidewatch.llm.words import raw, slices
from tidewatch.session import stage, unstage

LETTERS, TIMES = 5, 3
SLIP = 97
#: Words of a partition that is composed in one piece.
PARTITION_WORDS = 20_000
#: Letters that a partition composes at most; words with more left are cut again whatever the number.
LONG = 64
#: Distinct words that a task counts before it gives them back.
HELD_WORDS = 200_000

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def slipped(run: bytes, h: int) -> bytes:
    """The run without its code point h mod length, if 97 divides h."""
    if h % SLIP:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}

    def give() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return made

    for batch in batches:
        ids, text = batch.column("doc_id").to_pylist(), batch.column("text")
        for lo, hi in slices(text):
            data, bounds = raw(text.slice(lo, hi - lo))
            data = data.tobytes().lower()  # of bytes: A to Z only
            for i in range(hi - lo):
                own: dict[bytes, int] = {}
                for run in RUN.findall(data[bounds[i]: bounds[i + 1]]):
                    if len(run) >= LETTERS:
                        own[run] = own.get(run, 0) + 1
                start = zlib.crc32(f"{ids[lo + i]}:".encode())
                for run, times in own.items():
                    h = zlib.crc32(run, start)
                    if not h % SLIP:
                        run = slipped(run, h)
                    counts[run] = counts.get(run, 0) + times
                if len(counts) >= HELD_WORDS:
                    yield give()
    if counts:
        yield give()


def vocabulary(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n of the words of all texts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), "text")
    counts = rows.mapInArrow(_count, "word string, n long").filter(F.length("word") >= LETTERS)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (key, path, word, n, lo, hi, short) in its two partitions one level down.

    ``word[lo:hi]`` is what is not yet known to be equal and ``short`` its length in the shorter word of a pair.
    """
    head = F.floor(F.col("short") / 2).cast("int")
    tail = F.col("short") - head
    first = F.struct(
        F.concat("key", F.lit("<"), F.expr("substring(word, lo + 1, short div 2)")).alias("key"), F.concat("path", F.lit("<")).alias("path"),
        (F.col("lo") + head).alias("lo"), F.col("hi").alias("hi"), tail.alias("short"))
    last = F.struct(
        F.concat("key", F.lit(">"), F.expr("substring(word, hi - (short - short div 2) + 1, short - short div 2)")).alias("key"),
        F.concat("path", F.lit(">")).alias("path"), F.col("lo").alias("lo"), (F.col("hi") - tail).alias("hi"), head.alias("short"))
    return rows.select("word", "n", F.explode(F.array(first, last)).alias("p")).select("p.key", "p.path", "word", "n", "p.lo", "p.hi", "p.short")


def partitions(words: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """The words in every partition in which they may meet a near word; none has more than ``most`` of them if it can be cut."""
    m = F.length("word")
    start = words.select("word", "n", F.explode(F.array(m - 1, m)).alias("short")).filter(F.col("short") >= LETTERS)
    rows = stage(_halves(start.select(
        F.col("short").cast("string").alias("key"), F.lit("").alias("path"), "word", "n", F.lit(0).alias("lo"), m.alias("hi"), "short")), "spelling_level")
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.first("short").alias("short")).filter("size > 1")
        large = stage(sizes.select("key", ((F.col("size") > most) & (F.col("short") > 1) | (F.col("short") > LONG)).alias("large")), "spelling_sizes")
        again = large.filter("large").limit(1).count()
        sized = rows.join(large, "key")
        if not again:
            return sized.drop("large")
        small = sized.filter("NOT large").drop("large")
        cut = stage(small.unionByName(_halves(sized.filter("large").drop("large"))), "spelling_level")
        unstage(rows, large)
        rows = cut


class Acceptor:
    """Minimised acceptor of sorted distinct words: ``edges[q]`` maps letters to states, ``final[q]`` tells if a word ends."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        register: dict[tuple, int] = {}
        path, before = [0], ""

        def merge(depth: int) -> None:
            """Replace the states of the last word below ``depth`` by equivalent ones."""
            while len(path) - 1 > depth:
                q = path.pop()
                same = register.setdefault((self.final[q], tuple(self.edges[q].items())), q)
                if same != q:
                    self.edges[path[-1]][before[len(path) - 1]] = same

        for word in words:
            common = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                common += 1
            merge(common)
            for letter in word[common:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[path[-1]][letter] = len(self.edges) - 1
                path.append(len(self.edges) - 1)
            self.final[path[-1]] = True
            before = word
        merge(0)


def one_edit(acceptor: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs (u, v) of accepted words that one replacement (u < v) or one insertion (into u) tells apart, each once."""
    edges, final = acceptor.edges, acceptor.final
    common: dict[tuple[int, int], list] = {}

    def ends(p: int, q: int) -> list:
        """What both states accept: a list of (letter, what follows), with None where both end."""
        key = (p, q) if p < q else (q, p)
        got = common.get(key)
        if got is None:
            got = [None] if final[p] and final[q] else []
            a, b = edges[p], edges[q]
            if len(b) < len(a):
                a, b = b, a
            for letter, to in a.items():
                other = b.get(letter)
                if other is not None:
                    rest = suffixes(to) if to == other else ends(to, other)
                    if rest:
                        got.append((letter, rest))
            common[key] = got
        return got

    whole: dict[int, list] = {}

    def suffixes(q: int) -> list:
        got = whole.get(q)
        if got is None:
            got = [None] if final[q] else []
            got += [(letter, suffixes(to)) for letter, to in edges[q].items()]
            whole[q] = got
        return got

    def spelt(tree: list, lead: str = "") -> Iterator[str]:
        for branch in tree:
            if branch is None:
                yield lead
            else:
                yield from spelt(branch[1], lead + branch[0])

    stack = [(0, "")]
    while stack:
        q, prefix = stack.pop()
        out = list(edges[q].items())
        for i, (a, p) in enumerate(out):
            for b, r in out[i + 1:]:
                rest = suffixes(p) if p == r else ends(p, r)
                for x in spelt(rest):
                    yield (prefix + a + x, prefix + b + x) if a < b else (prefix + b + x, prefix + a + x)
            # an inserted letter stands behind its equals, so each pair comes once
            for x in spelt(ends(p, q)):
                if not x.startswith(a):
                    yield prefix + x, prefix + a + x
            stack.append((p, prefix + a))


def _first_found(u: str, v: str, path: str, short: int) -> bool:
    """No earlier partition (a first half where ``path`` takes the last) holds the pair too."""
    lo = 0
    for turn in path:
        head = short // 2
        if turn == "<":
            lo, short = lo + head, short - head
        elif u[lo: lo + head] == v[lo: lo + head]:
            return False
        else:
            short = head
    return True


def near_in(path: str, size: int, words: list[str], rests: list[str], counts: list[int]) -> list[tuple[str, int, str, int]]:
    """(word, near words, best of them, its n) within a partition of words whose ``rests`` are sorted; ``size``: letters of the shorter of a pair."""
    at = {rest: i for i, rest in enumerate(rests)}
    seen: dict[int, list] = {}
    for x, y in one_edit(Acceptor(rests)):
        i, j = at[x], at[y]
        u, v = words[i], words[j]
        if min(len(u), len(v)) != size or not _first_found(u, v, path, size):
            continue
        for me, other in ((i, j), (j, i)):
            got = seen.setdefault(me, [0, 0, ""])
            got[0] += 1
            if counts[other] > got[1] or (counts[other] == got[1] and words[other] < got[2]):
                got[1], got[2] = counts[other], words[other]
    return [(words[i], k, best, n) for i, (k, n, best) in seen.items()]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, group = None, []

    def found() -> list[tuple]:
        if len(group) < 2:
            return []
        return near_in(group[0][1], int(key.split("<", 1)[0].split(">", 1)[0]), [r[2] for r in group], [r[4] for r in group], [r[3] for r in group])

    def rows(made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n_near", "best", "best_n"])

    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "word", "n", "rest"))):
            if row[0] != key:
                out += found()
                key, group = row[0], []
            group.append(row)
        yield rows(out)
    yield rows(found())


def near_words(words: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """word, n_near, best (near word of largest n, ties to the smallest), best_n of the words (word, n) that have near words."""
    parts = partitions(words, most)
    parts = parts.select("key", "path", "word", "n", F.expr("substring(word, lo + 1, hi - lo)").alias("rest"))
    parts = parts.repartition("key").sortWithinPartitions("key", "rest")
    made = parts.mapInArrow(_compose, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return made.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.n")).alias("best_n"))


def variants(docs: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = stage(vocabulary(docs), "spelling_words")
    near = words.join(near_words(words, most), "word", "left")
    formed = F.col("best_n") >= 2 * F.col("n")
    named = stage(near.select(
        "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n")), "spelling_forms")
    unstage(words)
    tops = roots(named.filter("form IS NOT NULL").select(F.col("word").alias("v"), F.col("form").alias("up")))
    out = named.join(tops.select(F.col("v").alias("word"), F.col("comp").alias("root")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
