"""Phrase collocations per language by partitioning (SON): mine shards completely, then count the union exactly.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\n-\\r]`` into pieces and those at spaces and tabs into words.
A phrase of 2 to 5 words lies within one piece; f is the number of its occurrences in a language, overlaps
included, and n the number of all words of the language.

1. *Mine.*  A task fills shards of about ``SHARD_WORDS`` words.  A phrase that occurs ``least`` times in a
   language of N words has in some shard with s of these words at least least * s / N occurrences, so every
   shard gives all its phrases at or above that support, with what they have above the most that it may hide
   (its support less one).
2. *Union.*  The phrases that shards gave are joined.  What a phrase has above those amounts in the shards that gave
   it, and those amounts of all shards, bound its count; if that is below ``least`` it is no candidate.  The
   candidates are marked in a bitmap of ``FILTER_BITS`` bits (its size does not grow).
3. *Count.*  Every occurrence of a marked phrase is counted: per shard, then by Spark.  A phrase that is marked
   by chance is counted exactly too and falls below ``least``, so the bitmap costs time and never results.

Words and pairs are mined and counted first, then phrases of 3 to 5 words all of whose pairs are frequent; when
shards become so many that a support is one occurrence, words and pairs alone bear that, and the union is
already exact.  Phrases are 64-bit hashes (with their language) until the frequent ones get their words back;
scores and ranks are DataFrame steps.

Edge cases: null text is empty and null lang is ``und``; a piece without words has no phrases; repeated rows
count as often as they stand there; columns other than text and lang are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewatch.llm.words import Words, raw, slices
from tidewatch.session import stage, unstage

LEAST = 100
MOST_WORDS = 5
TOP = 2000
#: Words that a task mines at once; it waits for half as many more, so that no small rest is a shard of its own.
SHARD_WORDS = 2_500_000
#: Words of a language for each part in which its mined phrases are joined.
UNION_WORDS = 1 << 21
#: Words of which a task gives back the phrases as text at once.
TEXT_WORDS = 1_000_000
FILTER_BITS = 1 << 27
#: One task in so many tells the words of a phrase.
TURNS = 8
#: Phrases of which a task remembers that it has given them back as text.
TOLD = 1_000_000
#: Parts in which the first ranks of a language are found before the last ranking.
RANK_PARTS = 64

_U = np.uint64
_CUT = np.zeros(256, bool)
_CUT[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
_BLANK = _CUT.copy()
_BLANK[[32, 9]] = True
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"


class PieceWords(Words):
    """Words of lower-cased texts, and ``piece``: a number that grows with every piece."""

    def __init__(self, text: pa.Array):
        data, bounds = raw(text)
        self.data = data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        self.bounds = bounds
        inside = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self._inside = inside
        self.piece = np.cumsum(_CUT[data] | edge[:-1], dtype=np.int32)[self.starts]


class Shard:
    """Words of some texts, in order: hash, piece and language of each."""

    def __init__(self, parts: list[tuple], languages: dict[str, tuple[int, int]]):
        """``parts`` are (hashes, pieces, codes); ``languages`` have the code and the number of words of all texts."""
        n = sum(len(p[0]) for p in parts)
        self.word, self.piece, self.lang = np.empty(n, np.uint64), np.empty(n, np.int32), np.empty(n, np.int32)
        at = steps = 0
        while parts:  # the parts are given up as they are taken over
            word, piece, lang = parts.pop(0)
            to = at + len(word)
            self.word[at:to], self.piece[at:to], self.lang[at:to] = word, piece + np.int32(steps), lang
            at, steps = to, steps + (int(piece[-1]) + 1 if len(piece) else 0)
        self.languages = languages

    def by_language(self) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Name, words of all texts, and places, hashes and pieces of the words here."""
        order = np.argsort(self.lang, kind="stable").astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(self.lang, minlength=len(self.languages)))])
        for name, (code, total) in self.languages.items():
            at = order[ends[code]: ends[code + 1]]
            if len(at):
                yield name, total, at, self.word[at], self.piece[at]


def phrases(lang: str, word: np.ndarray, piece: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length: the key of the phrase at each word of a language, and whether it lies within a piece."""
    g, n, seed = word, len(word), _U(xxhash.xxh64_intdigest(lang))
    for length in range(1, min(longest, n) + 1):
        last = n - length + 1
        if length > 1:
            g = g[:last] * _U(0x9E3779B97F4A7C15)
            g += word[length - 1:]
            g += _U(length)
            scramble(g)
        yield length, scramble(g ^ seed), piece[:last] == piece[length - 1:]


def scramble(x: np.ndarray) -> np.ndarray:
    """``mix`` in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    return x


def counts_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is there."""
    key.sort()  # a copy of the caller's
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def support(least: int, here: int, total: int) -> int:
    """Occurrences that a phrase with ``least`` in all texts has in some shard with its share of the words."""
    return -(-least * here // total)


def marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & _U(len(bits) * 64 - 1)
    return (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def by_shard(size: int, work: Callable[[Shard], Iterator[pa.RecordBatch]]) -> Callable:
    """An Arrow map over (text, lang, n) that hands ``work`` shards of about ``size`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, languages, total = [], {}, 0
        for batch in batches:
            names, sizes = batch.column("lang").to_pylist(), batch.column("n").to_pylist()
            text = batch.column("text")
            for lo, hi in slices(text):
                w = PieceWords(text.slice(lo, hi - lo))
                code = np.array([languages.setdefault(names[i], (len(languages), sizes[i]))[0] for i in range(lo, hi)], np.int32)
                parts.append((w.hashes(), w.piece, np.repeat(code, w.counts())))
                total += len(w)
                if 2 * total >= 3 * size:
                    ready, left = [], total
                    while left > size // 2:
                        ready.append(parts.pop(0))
                        left -= len(ready[-1][0])
                    yield from work(Shard(ready, languages))
                    total = left
        if total:
            yield from work(Shard(parts, languages))

    return run


MINED = "lang string, block int, slack long, keys array<long>, excess array<int>"


def _mined_batch(lang: str, total: int, need: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A shard's phrases of a language, in parts by the first bits of their keys; part 0 tells what the shard may hide."""
    bits = max(0, (-(-total // UNION_WORDS) - 1).bit_length())
    key, times = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    block = (key >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    blocks = np.union1d(block, [0])
    bounds = pa.array(np.append(np.searchsorted(block, blocks), len(key)).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(blocks), pa.string()), pa.array(blocks.astype(np.int32)), pa.array(np.where(blocks == 0, need - 1, 0)),
        pa.ListArray.from_arrays(bounds, pa.array(key.view(np.int64))),
        pa.ListArray.from_arrays(bounds, pa.array((times - (need - 1)).astype(np.int32))),
    ], ["lang", "block", "slack", "keys", "excess"])


COUNTED = "block int, words byte, keys array<long>, counts array<int>"


def _counts_batch(length: int, total: int, keys: np.ndarray) -> pa.RecordBatch:
    """Counts of a shard, in parts by the first bits of the keys."""
    value, times = counts_of(keys)
    bits = max(0, (-(-total // UNION_WORDS) - 1).bit_length())
    block = (value >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
    blocks, first = np.unique(block, return_index=True)
    bounds = pa.array(np.append(first, len(value)).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(((bits << 24) + blocks).astype(np.int32)), pa.array(np.full(len(blocks), length, np.int8)),
        pa.ListArray.from_arrays(bounds, pa.array(value.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
    ], ["block", "words", "keys", "counts"])


def _joined(given: pa.Table, keys: str, amounts: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of packed rows and the sums of their amounts."""
    key = np.concatenate([c.flatten().to_numpy() for c in given.column(keys).chunks] or [np.zeros(0, np.int64)])
    n = np.concatenate([c.flatten().to_numpy() for c in given.column(amounts).chunks] or [np.zeros(0, np.int32)])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def candidates(mined: DataFrame, least: int) -> DataFrame:
    """The keys whose count can reach ``least`` by what the shards gave and may hide."""
    hidden = mined.groupBy("lang").agg(F.sum("slack").alias("hidden"))

    def join(given: pa.Table) -> pa.Table:
        key, more = _joined(given, "keys", "excess")
        return pa.table([pa.array(key[more + given.column("hidden")[0].as_py() >= least])], ["key"])

    return mined.join(hidden, "lang").groupBy("lang", "block").applyInArrow(join, "key long")


def marks_of(keys: DataFrame, size: int) -> np.ndarray:
    """The keys as a bitmap: at most size / 64 rows reach the driver."""
    slot = F.shiftright(F.col("key").bitwiseAND(F.lit(size - 1)), 6).cast("int").alias("slot")
    rows = keys.select(slot, F.expr("shiftleft(1L, CAST(key & 63L AS INT))").alias("bits")).groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def counted(docs: DataFrame, least: int, size: int, filter_bits: int) -> DataFrame:
    """key, words (1 to 5), f of every phrase, and of every single word, with f >= least; docs has text, lang, n."""

    def mine_pairs(shard: Shard) -> Iterator[pa.RecordBatch]:
        for lang, total, _, word, piece in shard.by_language():
            need, found = support(least, len(word), total), []
            for _, key, ok in phrases(lang, word, piece, 2):
                value, times = counts_of(key[ok])
                found.append((value[times >= need], times[times >= need]))
            yield _mined_batch(lang, total, need, found)

    def marks(task: Callable) -> np.ndarray:
        mined = stage(docs.mapInArrow(by_shard(size, task), MINED), "collocations_mined")
        made = marks_of(candidates(mined, least), filter_bits)
        unstage(mined)
        return made

    def add(given: pa.Table) -> pa.Table:
        key, n = _joined(given, "keys", "counts")
        kept = n >= least
        return pa.table([pa.array(key[kept]), pa.array(np.full(int(kept.sum()), given.column("words")[0].as_py(), np.int8)), pa.array(n[kept])], ["key", "words", "f"])

    def total_of(task: Callable, name: str) -> DataFrame:
        counts = docs.mapInArrow(by_shard(size, task), COUNTED)
        return stage(counts.groupBy("block", "words").applyInArrow(add, "key long, words byte, f long"), name)

    first = marks(mine_pairs)

    def count_pairs(shard: Shard) -> Iterator[pa.RecordBatch]:
        for lang, total, _, word, piece in shard.by_language():
            for length, key, ok in phrases(lang, word, piece, 2):
                yield _counts_batch(length, total, key[ok & marked(first, key)])

    short = total_of(count_pairs, "collocations_pairs")
    common = marks_of(short.filter("words = 2"), filter_bits)

    def mine_long(shard: Shard) -> Iterator[pa.RecordBatch]:
        for lang, total, _, word, piece in shard.by_language():
            need, found, ok = support(least, len(word), total), [], np.zeros(0, bool)
            for length, key, within in phrases(lang, word, piece, MOST_WORDS):
                if length == 2:
                    ok = within & marked(common, key)
                elif length > 2:
                    at = np.flatnonzero(ok[:-1] & ok[1:])
                    value, times = counts_of(key[at])
                    value, times = value[times >= need], times[times >= need]
                    found.append((value, times))
                    ok = np.zeros(len(key), bool)
                    if len(value):
                        ok[at] = value[np.minimum(np.searchsorted(value, key[at]), len(value) - 1)] == key[at]
            yield _mined_batch(lang, total, need, found)

    second = marks(mine_long)

    def count_long(shard: Shard) -> Iterator[pa.RecordBatch]:
        for lang, total, _, word, piece in shard.by_language():
            ok = np.zeros(0, bool)
            for length, key, within in phrases(lang, word, piece, MOST_WORDS):
                if length == 2:
                    ok = within & marked(common, key)
                elif length > 2:
                    # all parts of a candidate are candidates or frequent pairs
                    ok = ok[:-1] & ok[1:]
                    ok[ok] = marked(second, key[ok])
                    yield _counts_batch(length, total, key[ok])

    long = total_of(count_long, "collocations_long")
    out = short.unionByName(long)
    out.tables = (short, long)
    return out


def spelt(docs: DataFrame, bits: np.ndarray, turns: int) -> DataFrame:
    """key, lang, phrase of marked phrases, from the tasks whose turn it is: one in ``turns`` for each phrase."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, names, waiting = [], [], 0
        told, turn = np.zeros(0, np.uint64), _U(TaskContext.get().partitionId() % turns)

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal told
            text = pa.concat_arrays(texts)
            w = PieceWords(text)
            languages: dict = {}
            code = np.array([languages.setdefault(x, (len(languages), 1))[0] for x in names], np.int32)
            shard = Shard([(w.hashes(), w.piece, np.repeat(code, w.counts()))], languages)
            data = w.data.tobytes()
            for name, _, places, word, piece in shard.by_language():
                lo, hi = w.starts[places], w.ends[places]
                for length, key, ok in phrases(name, word, piece, MOST_WORDS):
                    at = np.flatnonzero(ok & marked(bits, key))
                    at = at[(key[at] >> _U(40)) % _U(turns) == turn]
                    value, one = np.unique(key[at], return_index=True)
                    new = ~np.isin(value, told, assume_unique=True)
                    value, one = value[new], one[new]
                    told = np.concatenate([told if len(told) < TOLD else told[:0], value])
                    words = [b" ".join(data[lo[j]: hi[j]] for j in range(i, i + length)).decode() for i in at[one].tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(value.view(np.int64)), pa.array([name] * len(value), pa.string()), pa.array(words, pa.string())], ["key", "lang", "phrase"])

        for batch in batches:
            text, lang = batch.column("text"), batch.column("lang").to_pylist()
            for lo, hi in slices(text):
                texts.append(text.slice(lo, hi - lo))
                names += lang[lo:hi]
                waiting += texts[-1].nbytes // 6
                if waiting >= TEXT_WORDS:
                    yield from give()
                    texts, names, waiting = [], [], 0
        if texts:
            yield from give()

    rows = docs.mapInArrow(spell, "key long, lang string, phrase string")
    return rows.groupBy("key").agg(F.first("lang").alias("lang"), F.min("phrase").alias("phrase"))


def with_words(docs: DataFrame, found: DataFrame, filter_bits: int) -> DataFrame:
    """``found`` (key, words, f) with lang and phrase: most are told by one task in TURNS, the rest by every task that has them."""
    columns = ["lang", "phrase", F.col("words").cast("int").alias("words"), "f", "key"]
    first = stage(found.join(spelt(docs, marks_of(found, filter_bits), TURNS), "key").select(*columns), "collocations_spelt")
    left = found.join(first.select("key"), "key", "left_anti")
    rest = left.join(spelt(docs, marks_of(left, filter_bits), 1), "key").select(*columns)
    known = stage(first.unionByName(rest).drop("key"), "collocations_known")
    unstage(first)
    return known


def part(words: str, first, length) -> F.Column:
    """Words first .. first + length - 1 (from 1) of an array column, as a phrase."""
    return F.array_join(F.slice(words, first, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, size: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases (see the module and the README)."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    totals = stage(texts.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("n")), "collocations_totals")
    sized = texts.join(totals, "lang").select("text", "lang", "n")
    found = counted(sized, least, size, filter_bits)
    known = with_words(sized, found, filter_bits)
    unstage(*found.tables)
    many = known.filter("words >= 2").withColumn("w", F.split("phrase", " "))
    # the lowest-scoring cut
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part("w", F.lit(1), F.col("k")).alias("left"),
                       part("w", F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    name = lambda c, n: known.select("lang", F.col("phrase").alias(c), F.col("f").alias(n))
    cuts = cuts.join(name("left", "l"), ["lang", "left"]).join(name("right", "r"), ["lang", "right"]).join(totals, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * big("a")).cast("decimal(23,0)")).withColumn("up", (F.col("up") * big("n")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("down", (big("l") * big("r")).cast("decimal(38,0)")).withColumn("score", F.expr("up div down"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")
    # phrases that a longer one covers
    inner = many.filter("words >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    inner = inner.groupBy("lang", part("w", F.col("i"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a")
    # the first of each part of a language, then of the language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(parted)).filter(F.col("rank") <= top).drop("rank")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
