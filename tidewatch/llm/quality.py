"""Quality of documents by a regularised quadratic discriminant over transformed text statistics.

Statistics of whole texts are made once, in numpy inside Arrow tasks, and kept as a narrow table.  Class
means and covariances are sums over all labelled training rows, added up by Spark; only they reach the
driver.  Each class covariance is shrunk towards the pooled one and towards a multiple of the identity,
its Cholesky factor is kept with the model, and a document's score is the logistic of the difference of
the two log densities (Mahalanobis distances by triangular solves against the factors).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import few
from tidewatch.llm.words import Words, give_back, slices
from tidewatch.session import stage

FEATURES = (
    "log_words", "word_length", "length_spread", "distinct", "twins", "repeat_3", "top_word", "symbols", "marks", "capitals", "digits",
    "letters", "plain_words", "log_lines", "repeat_lines",
)
#: Shrinkage of a class covariance to the pooled one, and of that to a multiple of the identity.
TO_POOLED, TO_IDENTITY = 0.2, 0.02
#: Log densities further apart than this say no more.
FAR = 30.0


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Arcsine of the root of a share, which evens out its variance; 0 of 0 is 0, as in a long text without any."""
    return np.arcsin(np.sqrt(np.clip(n / np.maximum(of, 1), 0, 1)))


def _per_row(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct keys, and the count of the most frequent one."""
    if not len(key):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(k)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r[at], size)
    return np.bincount(r[at], minlength=rows), top


def text_statistics(text: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; null counts as empty."""
    return np.concatenate([_statistics(text.slice(lo, hi - lo)) for lo, hi in slices(text)] or [np.zeros((0, len(FEATURES)))])


def _statistics(text: pa.Array) -> np.ndarray:
    w = Words(text)
    b, bounds, rows = w.data, w.bounds, len(w.bounds) - 1
    n = w.counts().astype(np.float64)
    row, h, size = w.rows(), w.hashes(), (w.ends - w.starts).astype(np.float64)
    per_word = np.maximum(n, 1)
    mean = np.bincount(row, size, rows) / per_word
    spread = np.sqrt(np.maximum(np.bincount(row, size**2, rows) / per_word - mean**2, 0))
    distinct, top = _repeats(row, h, rows)
    twin = np.zeros(len(h), bool)
    if len(h):
        twin[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    same3 = (row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, bool)
    grams = (h[:-2] * np.uint64(3) ^ h[1:-1] * np.uint64(5) ^ h[2:] * np.uint64(7))[same3] if len(h) > 2 else h[:0]
    gram_row = row[:-2][same3] if len(h) > 2 else row[:0]
    distinct3, _ = _repeats(gram_row, grams, rows)
    n3 = np.bincount(gram_row, minlength=rows)
    upper = (b >= 65) & (b <= 90)
    # capital letters with an accent: the second byte of U+00C0 to U+00DE
    accent = np.zeros(len(b), bool)
    if len(b):
        accent[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)
    upper |= accent
    lead = b >= 0xC0
    alpha = upper & ~accent | (b >= 97) & (b <= 122) | lead
    digit = (b >= 48) & (b <= 57)
    symbol = np.isin(b, np.frombuffer(b"#*$%&|<>{}[]=_\\^~@+/", np.uint8))
    mark = np.isin(b, np.frombuffer(b"!?;:()\"", np.uint8))
    # characters are bytes that do not continue one
    chars = _per_row((b & 0xC0) != 0x80, bounds) - _per_row((b == 32) | ((b >= 9) & (b <= 13)), bounds)
    letters = _per_row(alpha, bounds)
    has_letter = np.add.reduceat(alpha.astype(np.int64), w.starts) > 0 if len(w) else np.zeros(0, bool)
    # lines as hashes of their words: equal lines have equal sums of place-weighted word hashes
    feed = np.concatenate([[0], np.cumsum(b == 10)])
    line = feed[w.starts] + row if len(w) else row
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1])])) if len(w) else np.zeros(0, np.int64)
    place = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w)))) if len(w) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(h * (2 * place.astype(np.uint64) + np.uint64(1)), first) if len(w) else h
    line_row = row[first] if len(w) else row
    distinct_lines, _ = _repeats(line_row, line_hash, rows)
    lines = np.bincount(line_row, minlength=rows)
    return np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread), _share(distinct, n), _share(np.bincount(row[twin], minlength=rows), n),
        _share(n3 - distinct3, n3), _share(top, n), _share(_per_row(symbol, bounds), chars), _share(_per_row(mark, bounds), chars),
        _share(_per_row(upper, bounds), letters), _share(_per_row(digit, bounds), chars), _share(letters, chars),
        _share(np.bincount(row[~has_letter], minlength=rows), n), np.log1p(lines), _share(lines - distinct_lines, lines),
    ], axis=1).astype(np.float64)


def with_statistics(docs: DataFrame, into: str = "stats") -> DataFrame:
    """``docs`` with an array column of FEATURES."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def stats(text: pa.Array) -> pa.Array:
        x = text_statistics(text)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))

    return docs.withColumn(into, stats("text"))


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, Cholesky factor of the shrunk covariance, and half its log determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        out = np.zeros(len(x))
        for sign, mean, factor, offset in zip((-1.0, 1.0), self.means, self.factors, self.offsets):
            z = np.linalg.solve(factor, (x - mean).T) if len(x) else np.zeros((len(mean), 0))
            out += sign * (offset - 0.5 * (z * z).sum(axis=0))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -FAR, FAR)))


def moments(rows: DataFrame, stats: str = "stats", of: Callable[[pa.Array], np.ndarray] | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(label, count, sums, sums of products) per class, added up by Spark from one partial row per task.

    ``of`` makes the statistics from the column ``stats`` if it does not hold them, in the same Python process.
    """
    d = len(FEATURES)
    of = of or (lambda x: x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for batch in batches:
            x = of(batch.column(1))
            y = batch.column(0).to_numpy(zero_copy_only=False)
            for label, s in sums.items():
                part = x[y == label]
                s += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        for label, s in sums.items():
            if s[0]:
                n = len(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, label)), pa.array(np.arange(n)), pa.array(s)], ["label", "at", "value"])
        give_back()

    parts = rows.select(F.col("label").cast("int").alias("label"), stats).mapInArrow(partial, "label long, at long, value double")
    found = parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    out = []
    for label in (0, 1):
        s = np.zeros(1 + d + d * d)
        for r in found:
            if r.label == label:
                s[r["at"]] = r.value
        out.append((label, int(s[0]), s[1: 1 + d], s[1 + d:].reshape(d, d)))
    return out


def fit(sums: list[tuple[int, int, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """Without rows of a class its mean and covariance are the pooled ones; without any rows every score is 1/2."""
    d = len(FEATURES)
    total = sum(n for _, n, _, _ in sums)
    if not total:
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    centre = sum(s for _, _, s, _ in sums) / total
    scatter = np.zeros((d, d))
    means, covs = [], []
    for _, n, s, q in sums:
        mean = s / n if n else centre
        part = q - n * np.outer(mean, mean)
        scatter += part
        means.append(mean)
        covs.append(part / n if n else None)
    pooled = scatter / total
    factors, offsets = [], []
    for (_, n, _, _), cov in zip(sums, covs):
        shrunk = pooled if cov is None else (1 - to_pooled) * cov + to_pooled * pooled
        shrunk = (1 - to_identity) * shrunk + to_identity * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        factors.append(factor)
        offsets.append(np.log((n + 1) / (total + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(np.stack(means), np.stack(factors), np.array(offsets))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on (doc_id, stats) and (doc_id, label 0 or 1); other labels and nulls are left out, repeated rows count again."""
    return fit(moments(stats.join(labels.filter("label IN (0, 1)"), "doc_id").select("label", "stats")))


def with_score(rows: DataFrame, model: Discriminant, stats: str = "stats", into: str = "score") -> DataFrame:
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))

    return rows.withColumn(into, score(stats))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs`` (doc_id, text), trained on ``labels`` (doc_id, label).

    Null and empty texts have the statistics of an empty text and a score like any other.
    """
    rows = stage(with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats"), "quality_stats")
    out = with_score(rows, train(rows, labels)).select("doc_id", "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def train_on_texts(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """As ``train`` from (doc_id, text): one Python process a task makes statistics and sums."""
    known = docs.select("doc_id", "text").join(few(labels.filter("label IN (0, 1)")), "doc_id").select("label", "text")
    return fit(moments(known, "text", text_statistics))


def with_text_score(docs: DataFrame, model: Discriminant, into: str = "score") -> DataFrame:
    """``docs`` with the score of their texts: one Python process a task makes statistics and scores."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        made = pa.array(model.score(text_statistics(text)))
        give_back()
        return made

    return docs.withColumn(into, score("text"))
