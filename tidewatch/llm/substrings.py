"""Removal of long repeated word sequences by recompression.

A text is parsed in rounds.  The first names every maximal run of one word by the word and its length;
each further round names pairs: a coin that hangs on the symbol alone makes it left or right, and a left
symbol joins the right symbol behind it unless the two hold more than ``MOST_WORDS`` words.  Names are
content hashes, so all tasks name equal runs and pairs alike without asking one another, and equal word
sequences get equal symbols but near their ends.  How near is tracked: every symbol knows the stretch of
words that decides it.

* Each stretch of half a window picks the smallest of the symbols decided within it, so equal stretches
  pick equal symbols; a stretch without one picks its own hash.  Picks, one for ten words, are shuffled
  by name.
* Only windows whose first and last half both picked symbols of two documents are looked at further:
  their 96-bit fingerprints meet, and a window is removed if a smaller doc_id has it too.  This verifies
  whole windows.
* Documents with equal word sequences are represented by the smallest before any of this.

No all-pairs step exists: symbols and windows only meet in minima per key, with partial aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewatch.llm.words import Words, mix, slices
from tidewatch.session import stage, unstage

WINDOW = 50
ROUNDS = 3
MOST_WORDS = 16
#: Ids up to this many are sent to all tasks instead of moving texts to them.
BROADCAST_IDS = 1_000_000
#: Two odd multipliers of the window fingerprints.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_U = np.uint64


class Parse:
    """The symbols of some texts after all rounds: name, row, and the words [low, high) that decide it."""

    def __init__(self, words: Words, rounds: int = ROUNDS):
        h, row = words.hashes(), words.rows()
        n = len(h)
        new = np.ones(n, bool)
        if n:
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], n)[: len(at)]
        self.name = mix(h[at] ^ mix((end - at).astype(np.uint64)))
        self.row, self.size = row[at], end - at
        # a run is known once the words beside it are seen to differ
        self.low, self.high = at - 1, end + 1
        for r in range(rounds):
            self._pairs(r)

    def _pairs(self, r: int) -> None:
        name, row, size, low, high = self.name, self.row, self.size, self.low, self.high
        if len(name) < 2:
            return
        left = (mix(name + _U(r + 1)) & _U(1)).astype(bool)
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & ~left[1:] & (row[:-1] == row[1:]) & (size[:-1] + size[1:] <= MOST_WORDS)
        taken = np.concatenate([[False], joins[:-1]])
        # unpaired symbols hang on the neighbour that they could have joined
        behind, before = np.append(high[1:], high[-1] + 1), np.concatenate([[low[0] - 1], low[:-1]])
        last = np.append(row[1:] != row[:-1], True)
        first = np.concatenate([[True], row[1:] != row[:-1]])
        behind = np.where(last, high + 1, behind)
        before = np.where(first, low - 1, before)
        new_high = np.where(joins | left, behind, high)
        new_low = np.where(left, low, before)
        nxt = np.append(name[1:], _U(0))
        new_name = np.where(joins, mix(name * _U(3) + mix(nxt + _U(r))), name)
        new_size = np.where(joins, size + np.append(size[1:], 0), size)
        keep = ~taken
        self.name, self.row, self.size = new_name[keep], row[keep], new_size[keep]
        self.low, self.high = new_low[keep], new_high[keep]


def fingerprints(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the ``window`` words from each start."""
    out = []
    for i, m in enumerate(MULTIPLIERS):
        inverse = pow(m, -1, 1 << 64)
        power = np.cumprod(np.concatenate([[_U(1)], np.full(max(len(h) - 1, 0), m, np.uint64)]))
        back = np.cumprod(np.concatenate([[_U(1)], np.full(max(len(h) - 1, 0), inverse, np.uint64)]))
        total = np.concatenate([[_U(0)], np.cumsum(mix(h + _U(i)) * power[: len(h)], dtype=np.uint64)])
        out.append(mix((total[starts + window] - total[starts]) * back[starts]) if len(starts) else np.zeros(0, np.uint64))
    return out[0], out[1]


def picks(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, first, last): the symbol picked by the stretches of ``window`` words that start at words first .. last of the row."""
    h, n, first = words.hashes(), words.counts(), words.first
    parse = Parse(words)
    # all windows, as numbers of their first words within the slice
    many = np.maximum(n - window + 1, 0)
    row = np.repeat(np.arange(len(n)), many)
    start = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[:-1][row]
    none = (np.zeros(0, np.int64),) * 4
    if not len(start):
        return none[0], np.zeros(0, np.uint64), none[0], none[0]
    # low and high never fall along the symbols, so the symbols decided in a window are neighbours
    i = np.searchsorted(parse.low, start, side="left")
    j = np.searchsorted(parse.high, start + window, side="right")
    order = mix(parse.name + _U(17))
    levels = [order]
    while (1 << len(levels)) <= window:
        t, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(t, np.concatenate([t[step:], np.full(min(step, len(t)), t.max() if len(t) else 0, np.uint64)])[: len(t)]))
    found = j > i
    size = np.where(found, j - i, 1)
    k = np.floor(np.log2(size)).astype(np.int64)
    key = np.zeros(len(start), np.uint64)
    for level in range(int(k.max()) + 1):
        here = found & (k == level)
        t = levels[level]
        key[here] = np.minimum(t[i[here]], t[j[here] - (1 << level)])
    bare = np.flatnonzero(~found)
    if len(bare):
        key[bare] = mix(fingerprints(h, start[bare], window)[0] ^ _U(0xABCDEF))
    # windows in a row with one key make one pick
    begin = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(begin)
    stop = np.append(at[1:], len(key)) - 1
    return row[at], key[at], start[at] - first[:-1][row[at]], start[stop] - first[:-1][row[at]]


def _sequence(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of the whole word sequence of each row."""
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for m in MULTIPLIERS:
        total = np.concatenate([[_U(0)], np.cumsum(mix(h ^ mix(place.astype(np.uint64) * _U(m) + _U(1))), dtype=np.uint64)])
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _tag(f: np.ndarray) -> np.ndarray:
    """Tells rows apart that have one doc_id and different texts."""
    return f.view(np.uint64) & _U(0xFFFF)


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, whole (array of tags), windows (array<bigint> of 65536 * start + tag): what is to be removed, where there is something.

    A row named in ``whole`` equals a document with a smaller doc_id and has a window; in ``windows`` are
    the starts of windows that a document with a smaller doc_id has too.  Null doc_ids take no part.
    """
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    half = max(1, window // 2)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for lo, hi in slices(text):
                w = Words(text.slice(lo, hi - lo))
                n = w.counts()
                f1, f2 = _sequence(w.hashes(), w.first)
                r, key, a, b = picks(w, half)
                bounds = np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32)
                made = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["key", "a", "b"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(f1), pa.array(f2), pa.ListArray.from_arrays(pa.array(bounds), made),
                ], ["doc_id", "n", "f1", "f2", "picks"])

    parsed = stage(docs.mapInArrow(
        first, f"doc_id {kind}, n bigint, f1 bigint, f2 bigint, picks array<struct<key:bigint,a:int,b:int>>").filter(f"n >= {window}"), "repeat_picks")
    classes = parsed.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    tag = F.col("f1").bitwiseAND(0xFFFF)
    copies = stage(parsed.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"]).filter("doc_id > least").select("doc_id", tag.alias("tag")).distinct(), "repeat_copies")
    own = parsed.withColumn("tag", tag).join(_few(copies), ["doc_id", "tag"], "left_anti")
    own = own.select("doc_id", F.explode("picks").alias("pick")).select("doc_id", "pick.*")
    shared = own.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("key")
    spans = own.join(shared, "key").groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    spans = stage(spans, "repeat_spans")
    unstage(parsed)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.column(1), batch.column(2)
            for lo, hi in slices(text):
                w = Words(text.slice(lo, hi - lo))
                h = w.hashes()
                f1, _ = _sequence(h, w.first)
                part = spans.slice(lo, hi - lo)
                flat, bounds = part.flatten(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(part).to_numpy(zero_copy_only=False))])
                a, b = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                row = np.repeat(np.arange(hi - lo), np.diff(bounds).astype(np.int64))
                n = w.counts()
                b = np.minimum(b, n[row] - half)  # a row of another text with this doc_id may be shorter
                # words at which a stretch with a shared pick starts
                edge = np.zeros(len(h) + 1, np.int64)
                some = b >= a
                np.add.at(edge, (w.first[:-1][row] + a)[some], 1)
                np.add.at(edge, (w.first[:-1][row] + b + 1)[some], -1)
                begins = np.cumsum(edge)[: len(h)] > 0
                r = w.rows()
                at = np.arange(len(h)) - w.first[:-1][r]
                both = begins & (at + window <= n[r])
                both &= begins[np.minimum(np.arange(len(h)) + window - half, max(len(h) - 1, 0))]
                r, at = r[both], at[both]
                one, two = fingerprints(h, at + w.first[:-1][r], window)
                place = at * 65536 + _tag(f1)[r].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(r)), pa.array(one.view(np.int64)), pa.array((two >> _U(32)).astype(np.uint32).view(np.int32)), pa.array(place)],
                    ["doc_id", "w1", "w2", "place"])

    looked = docs.join(_few(spans.select("doc_id")), "doc_id", "left_semi").join(spans, "doc_id").select("doc_id", "text", "spans")
    met = looked.mapInArrow(second, f"doc_id {kind}, w1 bigint, w2 int, place bigint")
    met = met.withColumn("least", F.min("doc_id").over(W.partitionBy("w1", "w2"))).filter("doc_id > least")
    gone = met.groupBy("doc_id").agg(F.collect_list("place").alias("windows"))
    whole = copies.groupBy("doc_id").agg(F.collect_set("tag").alias("whole"))
    return gone.join(whole, "doc_id", "full")


def deduplicated(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Each row of (doc_id, text) without the words of windows that also start in a document with a smaller doc_id.

    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, unless
    left out, kept (that text).  Null and empty texts have no words.  Rows that repeat one doc_id do not
    remove one another; a null doc_id neither loses nor removes words.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stage(repeats(docs, window), "repeats")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, windows, whole = batch.column(1), batch.column(2), batch.column(3)
            for lo, hi in slices(text):
                w = Words(text.slice(lo, hi - lo))
                n, first = w.counts(), w.first
                data = w.data.tobytes()
                f1, _ = _sequence(w.hashes(), first)
                rows = []
                for i in range(hi - lo):
                    tag = int(_tag(f1[i: i + 1])[0])
                    starts, ends = w.starts[first[i]: first[i + 1]], w.ends[first[i]: first[i + 1]]
                    stay = np.ones(n[i], bool)
                    places = windows[lo + i].values
                    if tag in (whole[lo + i].as_py() or ()) and n[i] >= window:
                        stay[:] = False
                    elif places is not None and len(places):
                        p = places.to_numpy(zero_copy_only=False)
                        p = p[(p & 0xFFFF) == tag] >> 16
                        edge = np.bincount(p, minlength=n[i] + 1)[: n[i] + 1] - np.bincount(np.minimum(p + window, n[i]), minlength=n[i] + 1)[: n[i] + 1]
                        stay = np.cumsum(edge)[: n[i]] <= 0
                    joined = b" ".join([data[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())])
                    rows.append((int(n[i]), int(n[i] - stay.sum()), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
                names = ["n_words", "n_removed", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns[: 3 + with_text]], ["doc_id", *names[: 3 + with_text]])

    ids = _few(found.select("doc_id"))
    changed = docs.join(ids, "doc_id", "left_semi").join(found, "doc_id")
    rest = docs.join(ids, "doc_id", "left_anti").withColumn("windows", F.lit(None).cast("array<bigint>")).withColumn("whole", F.lit(None).cast("array<bigint>"))
    rows = changed.select("doc_id", "text", "windows", "whole").unionByName(rest)
    return rows.mapInArrow(keep, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)
