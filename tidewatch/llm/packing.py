"""Packing of documents into fixed windows by minimum bin slack.

Every document becomes its token ids and an end id.  Whole windows are cut off its front, so at most
one piece per document is shorter than the window.  For those pieces only the *number of pieces of
each length* matters: a table of at most ``capacity - 1`` counts, whatever the size of the corpus.
The plan is made from these counts on the driver.  A window is opened for the longest length that is
left; a bitset subset-sum over the other lengths finds the multiset that comes closest to the
remaining room; its counts are backtracked, and the window is repeated as often as the counts allow.
Pieces then look up their window by their rank among pieces of equal length, which is counted in two
levels (hash range, then row), so a length that a third of all pieces share is spread over many tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from tidewatch.llm.common import id_hash
from tidewatch.llm.words import give_back
from tidewatch.session import stage

CAPACITY = 1024
END_ID = 0
#: Texts for the reference tokenizer itself: spaces next to other white space, its control string,
#: and characters whose class may depend on the Unicode version of the pattern engine.
ODD = re.compile(r"\s \s?| \s|^\s|\s$|<\||[^\x00-\u02ff\u2000-\u206f]")
#: The vocabulary's split pattern, written so that it never backtracks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Rows of text that a task encodes together.
ROWS = 250


class Encoder:
    """Token ids of texts as one array and row bounds.

    Repeated words are encoded once per call: no token of this vocabulary reaches over a single space
    between other characters, so text is cut there and equal parts share their ids.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        special = self.whole.get_added_tokens_decoder()
        byte = {letter: b for b, letter in enumerate(_byte_letters())}
        ranks = {
            bytes(byte[x] for x in word): i
            for word, i in self.whole.get_vocab(with_added_tokens=False).items() if i not in special
        }
        self.parts = Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        for b, i in ranks.items():
            self.opens[i] = b[:1] == b" "

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [t if t and not ODD.search(t) else None for t in texts]
        lists = pc.split_pattern(pa.array([t for t in plain if t is not None], pa.large_string()), " ")
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        ids = np.array(self.parts.encode_ordinary(" " + " ".join(words)) if words else [], np.uint32)
        first = np.flatnonzero(self.opens[ids]) if len(ids) else np.zeros(0, np.int64)
        if len(first) != len(words):
            raise ValueError("a token of this vocabulary reaches over a single space")
        size = np.diff(np.append(first, len(ids)))
        # heads of texts (no space before them), odd texts, and the end id are entries of their own
        own: list[list[int]] = []
        for t in plain:
            if t is not None:
                own.append(self.parts.encode_ordinary(t.partition(" ")[0]))
        for t, p in zip(texts, plain):
            if p is None:
                own.append(self.whole.encode(t, add_special_tokens=False).ids if t else [])
        own.append([END_ID])
        flat = np.concatenate([ids, np.array([i for x in own for i in x], np.uint32)])
        size = np.concatenate([size, [len(x) for x in own]]).astype(np.int64)
        first = np.concatenate([first, len(ids) + np.cumsum([0] + [len(x) for x in own])[:-1]]).astype(np.int64)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(words)
        heads = bounds[:-1] - bounds[0]
        index[heads] = n + np.arange(len(heads))
        end = n + len(own) - 1
        sequence, k, odd = [], 0, n + len(heads)
        for p in plain:
            if p is None:
                sequence.append(np.array([odd, end]))
                odd += 1
            else:
                sequence.append(index[bounds[k] - bounds[0]: bounds[k + 1] - bounds[0]])
                sequence.append(np.array([end]))
                k += 1
        parts = np.concatenate(sequence) if sequence else np.zeros(0, np.int64)
        counts = size[parts]
        at = np.cumsum(counts) - counts
        out = flat[np.repeat(first[parts] - at, counts) + np.arange(int(counts.sum()))]
        stops = (at + counts)[parts == end]
        return out.astype("<u4"), np.concatenate([[0], stops])


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut each document of (doc_id, text) into pieces of at most ``capacity`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, and ids when asked for.  Null and empty
    texts have the end id alone.  Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids, bounds = encode([t or "" for t in part.column("text").to_pylist()])
                row, start, length = [], [], []
                total = np.diff(bounds)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), n)
                nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = nth * capacity
                length = np.minimum(capacity, total[row] - start)
                begin = bounds[row] + start
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * b: 4 * (b + m)]) for b, m in zip(begin.tolist(), length.tolist())]
                columns = [
                    part.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total[row], pa.int64()),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    edges = np.append(begin, bounds[-1]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(cut, schema + ", ids array<int>" * with_ids)


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Windows as (copies of each length, repeats) that use up ``counts`` exactly.

    Each step uses up at least one length or opens the last window of a kind, so there are at most a
    few windows per length, however large the counts are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while left:
        seed = max(left)
        room = capacity - seed
        fill = _closest({n: c - (n == seed) for n, c in left.items() if n <= room}, room)
        window = dict(fill)
        window[seed] = window.get(seed, 0) + 1
        repeats = min(left[n] // c for n, c in window.items())
        plan.append((window, repeats))
        for n, c in window.items():
            left[n] -= c * repeats
            if not left[n]:
                del left[n]
    return plan


def _closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset with the largest sum that is at most ``room``: bit s of ``reach`` says that s can be made.

    Lengths enter in falling order with their counts split in powers of two; the states before each
    entry are kept, and the best sum is traced back through them.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted(counts, reverse=True):
        many, part = min(counts[n], room // n), 1
        while many > 0:
            take = min(part, many)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            many -= take
            part *= 2
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            total -= n * take
            found[n] = found.get(n, 0) + take
    return found


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``pieces`` with the place of each piece: sequence_id, offset; and padded, the final length of its sequence.

    Sequence ids are 0, 1, ... without a gap.  A sequence is padded to ``capacity`` unless its filled
    length is a power of two.  An empty table gives an empty result; extra columns are left out.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    key = id_hash(F.col("doc_id"))
    placed = cut.withColumn("cell", F.substring(key, 1, 3)).withColumn("key", key)
    cells = placed.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("cell")
    cells = stage(cells.withColumn("rank0", F.sum("n").over(before) - F.col("n")), "piece_cells")
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("n")).collect()}
    # at most ``capacity`` lengths, so the plan below is bounded whatever the corpus
    rows, base, taken = [], 0, dict.fromkeys(counts, 0)
    for window, repeats in minimum_slack(counts, capacity):
        offset, filled = 0, sum(n * c for n, c in window.items())
        padded = filled if filled & (filled - 1) == 0 else capacity
        for n, c in sorted(window.items(), reverse=True):
            rows.append((n, taken[n], taken[n] + c * repeats, c, base, offset, padded))
            taken[n] += c * repeats
            offset += n * c
        base += repeats
    plan = spark.createDataFrame(
        rows, "length bigint, lo bigint, hi bigint, copies bigint, base bigint, at bigint, padded bigint"
    )
    by_cell = W.partitionBy("length", "cell").orderBy("key", "start", "ids_crc32", "doc_tokens")
    ranked = placed.join(F.broadcast(plan.groupBy("length").agg(F.array_sort(F.collect_list(
        F.struct("lo", "hi", "copies", "base", "at", "padded"))).alias("plan"))), "length")
    ranked = ranked.withColumn("nth", F.row_number().over(by_cell) - 1).join(
        cells.select("length", "cell", "rank0"), ["length", "cell"]
    ).withColumn("rank", F.col("rank0") + F.col("nth"))
    slot = F.element_at(F.filter("plan", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), 1)
    ranked = ranked.withColumn("slot", slot).withColumn("within", F.col("rank") - F.col("slot.lo"))
    repeat = F.floor(F.col("within") / F.col("slot.copies"))
    return ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.base") + repeat).cast("long").alias("sequence_id"),
        (F.col("slot.at") + (F.col("within") - repeat * F.col("slot.copies")) * F.col("length")).cast("long").alias("offset"),
        F.col("slot.padded").alias("padded"), *(["ids"] if with_ids else []),
    )
