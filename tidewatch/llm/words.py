"""Words of text: column expressions for the JVM and the same split in numpy for Arrow tasks.

A word is a run of characters other than space and the controls 9 to 13.  Null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"
#: Bytes of text that a task holds in numpy at once; a longer text is held alone.
SLICE_BYTES = 1 << 19

_U = np.uint64


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text."""
    offsets = _offsets(text)
    lo, n = 0, len(text)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _offsets(text: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    return np.frombuffer(text.buffers()[1], kind)[text.offset: text.offset + len(text) + 1]


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and len + 1 row bounds; null counts as empty."""
    if text.null_count:
        text = text.fill_null("")
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = _offsets(text).astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0]: at[-1]], at - at[0]


class Words:
    """Words of some rows: byte bounds, 64-bit hashes, and the first word of each row.

    ``lower`` folds A to Z; ``bare`` takes ASCII punctuation for blanks.
    """

    def __init__(self, text: pa.Array, lower: bool = False, bare: bool = False):
        data, bounds = raw(text)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        if bare:
            kept = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 48) & (data <= 57) | (data >= 128)
            data = np.where(kept, data, np.uint8(32))
        self.data, self.bounds = data, bounds
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        before = np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            before[bounds[:-1][bounds[:-1] < len(data)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        # a word ends where the next byte is a blank or another row
        after = np.empty_like(inside)
        if len(data):
            after[-1], after[:-1] = False, inside[1:]
            cut = bounds[1:] - 1
            after[cut[(cut >= 0) & (bounds[1:] > bounds[:-1])]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        powers = np.cumprod(np.concatenate([[_U(1)], np.full(int(lens.max()), _U(0x9E3779B97F4A7C15), np.uint64)]))
        lead = np.zeros(len(self.data), np.int64)
        lead[self.starts] = self.starts
        place = np.arange(len(self.data)) - np.maximum.accumulate(lead)
        value = (self.data.astype(np.uint64) + _U(1)) * powers[np.minimum(place, len(powers) - 1)]
        value[~self._inside] = 0
        return mix(np.add.reduceat(value, self.starts) ^ (lens.astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
