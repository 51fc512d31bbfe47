"""Toxicity by the nearest labelled examples under TF-IDF cosine, with their votes as score and evidence.

Terms are words without ASCII punctuation, A to Z folded.  The vector space has all terms of the examples;
their document frequencies are counted over all documents.  Examples are at most about ``EXAMPLES``
labelled rows, drawn by a hash of their ids, so the index is bounded whatever the corpus.  The terms in
most examples are a dense block, the others postings; the dense part in single precision and the postings leave a few
candidates, whose cosines are put together again in double precision, so the neighbours are exact.

A few words seldom turn the cosine of a long text, so a second vote is taken among the terms that are more
frequent in toxic examples (chi-squared above ``LEAST_CHI2``, at most ``TERMS`` of them), in an inverted
index whose postings lie in blocks of examples, with the largest weight of each term in each block.  A
query adds these maxima into an upper bound per block and opens blocks in falling order until no bound
beats its k-th cosine.  The score weighs both votes; weights come from the examples, each left out of its
own votes.  The evidence is that of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import id_hash
from tidewatch.llm.words import Words, give_back, slices
from tidewatch.session import stage

EXAMPLES = 20_000
TERMS = 1024
LEAST_CHI2 = 20.0
NEIGHBOURS = 15
BLOCK = 256
#: Terms in most examples that are compared as a dense block, and queries that are compared at once.
DENSE, QUERIES = 512, 128
#: Examples of which one maximum is taken.
GROUP = 64
#: More than the error of a cosine in single precision.
SLACK = 1e-4


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash as signed, count) of each distinct term of each row."""
    row, h = w.rows(), w.hashes()
    if not len(h):
        return row, h.view(np.int64), row
    order = np.argsort(h)
    # a stable sort of short numbers counts them, which is faster than comparing pairs
    order = order[np.argsort(row[order].astype(np.min_scalar_type(int(row[-1]))), kind="stable")]
    r, k = row[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])]))
    return r[at], k[at].view(np.int64), np.diff(np.append(at, len(k)))


def _words(text: pa.Array) -> Words:
    return Words(text, lower=True, bare=True)


def choose_terms(examples: DataFrame, terms: int = TERMS, least: float = LEAST_CHI2) -> np.ndarray:
    """Hashes, sorted, of the terms of (text, label) most tied to label 1; those in fewer than three examples are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, label = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in slices(text):
                r, k, _ = _distinct(_words(text.slice(lo, hi - lo)))
                term, where = np.unique(k, return_inverse=True)
                toxic = np.bincount(where, label[lo + r] == 1, len(term)).astype(np.int64)
                n = np.bincount(where, minlength=len(term)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(toxic), pa.array(n)], ["term", "toxic", "n"])

    sizes = {r[0]: r[1] for r in examples.groupBy("label").count().collect()}
    a, b = sizes.get(1, 0), sizes.get(0, 0)
    if not a or not b:
        return np.zeros(0, np.int64)
    counts = examples.select("text", "label").mapInArrow(count, "term long, toxic long, n long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).filter("n >= 3")
    expected = F.col("n") * F.lit(a / (a + b))
    chi2 = F.pow(F.col("toxic") - expected, F.lit(2)) / (expected * F.lit(b / (a + b)) * (1 - (F.col("n") - 1) / F.lit(float(a + b))))
    best = counts.withColumn("chi2", chi2).filter((F.col("chi2") >= least) & (F.col("toxic") > F.col("n") * F.lit(a / (a + b)))).orderBy(F.desc("chi2"), "term").limit(terms)
    return np.sort(np.array([r.term for r in best.collect()], np.int64))


def term_counts(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(doc_id, terms array<int>, counts array<int>) per row of (doc_id, text): the chosen terms that it has."""
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = sent.value
        for batch in batches:
            text = batch.column(1)
            for lo, hi in slices(text):
                r, k, n = _distinct(_words(text.slice(lo, hi - lo)))
                at = np.searchsorted(chosen, k)
                hit = chosen[np.minimum(at, max(len(chosen) - 1, 0))] == k if len(chosen) else np.zeros(len(k), bool)
                bounds = np.searchsorted(r[hit], np.arange(hi - lo + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(bounds), pa.array(at[hit].astype(np.int32)))
                counts = pa.ListArray.from_arrays(pa.array(bounds), pa.array(n[hit].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), terms, counts], ["doc_id", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(look, f"doc_id {kind}, terms array<int>, counts array<int>")


def all_terms(examples: DataFrame) -> np.ndarray:
    """Hashes, sorted, of all terms of (text, ...)."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for lo, hi in slices(text):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_distinct(_words(text.slice(lo, hi - lo)))[1]))], ["term"])

    found = examples.select("text").mapInArrow(distinct, "term long").distinct().toArrow()
    return np.sort(found.column("term").to_numpy().astype(np.int64))


def document_counts(rows: DataFrame, terms: int) -> np.ndarray:
    """The rows of (terms array<int>) that have each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        term = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(n[term])], ["term", "n"])

    found = rows.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


class TextIndex:
    """TF-IDF vectors of examples over all terms; ``search`` gives the exact nearest of many queries.

    The terms in most examples are a dense block, the others postings.  A posting is a complex number, its example and
    the example's weight (1 + log count) idf / norm, so that both come from memory together.
    """

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, dense: int = DENSE):
        """Example i has ``terms`` with ``counts`` from bounds[i] to bounds[i + 1]."""
        size = len(idf)
        self.n, self.dense = len(bounds) - 1, min(dense, size)
        # all arrays over postings are narrow and none is made twice: every Python worker makes this index
        place = np.repeat(np.arange(self.n, dtype=np.min_scalar_type(max(self.n, 1))), np.diff(bounds))
        self.gain = 1 + np.log(np.maximum(np.arange(int(counts.max(initial=1)) + 1), 1))
        self.gain[0] = 0.0
        norm2 = np.zeros(self.n)
        for at in range(0, len(terms), 1 << 18):
            part = slice(at, at + (1 << 18))
            weight = self.gain[counts[part]] * idf[terms[part]]
            norm2 += np.bincount(place[part], weight * weight, self.n)
        self.scale = 1 / np.sqrt(norm2)
        top = np.argsort(-np.bincount(terms, minlength=size), kind="stable")[: self.dense]
        self.slot = np.full(size, -1, np.int32)
        self.slot[top] = np.arange(len(top))
        often = np.flatnonzero(self.slot[terms] >= 0).astype(np.int32)
        slot, column = self.slot[terms[often]], place[often]
        self.width = -(-self.n // GROUP) * GROUP
        self.block = np.zeros((self.dense, self.width), np.float32)
        self.block[slot, column] = self.gain[counts[often]] * idf[terms[often]] * self.scale[column]
        # counts of the dense terms, for their part of a cosine in double precision
        self.often = np.zeros((self.n, self.dense), counts.dtype)
        self.often[column, slot] = counts[often]
        self.often_idf = idf[top]
        del often, slot, column
        rest = np.flatnonzero(self.slot[terms] < 0).astype(np.int32)
        rest = rest[np.argsort(terms[rest], kind="stable")]
        of = terms[rest]
        self.ends = np.searchsorted(of, np.arange(size + 1)).astype(np.int32)
        self.postings = np.empty(len(rest), np.complex128)
        self.postings.real = place[rest]
        self.postings.imag = self.gain[counts[rest]]
        self.postings.imag *= idf[of]
        self.postings.imag *= self.scale[place[rest]]
        del rest, of
        give_back()

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and cosines of the k nearest of each query with a positive cosine, nearest first, ties to the smaller number."""
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        out, postings = [], self.postings
        for at in range(0, len(queries), QUERIES):
            some = queries[at: at + QUERIES]
            often = np.zeros((len(some), self.dense))
            seldom = []
            for j, (t, w) in enumerate(some):
                slot = self.slot[t]
                dense = slot >= 0
                often[j, slot[dense]] = w[dense]
                lo, hi = self.ends[t], self.ends[t + 1]
                found = np.flatnonzero(~dense & (hi > lo))
                seldom.append((w[found], lo[found], hi[found]))
            score = often.astype(np.float32) @ self.block
            for j, (w, lo, hi) in enumerate(seldom):
                row = score[j]
                sums = None
                if len(w):
                    met = np.concatenate([postings[a:b] for a, b in zip(lo.tolist(), hi.tolist())])
                    sums = np.bincount(met.real.astype(np.int64), np.repeat(w, hi - lo) * met.imag, self.width)
                    row += sums
                if skip is not None and skip[at + j] >= 0:
                    row[skip[at + j]] = -1
                # the k-th largest of the maxima of groups is no larger than the k-th largest cosine
                groups = row.reshape(-1, GROUP)
                best = groups.max(axis=1)
                least = max(np.partition(best, -k)[-k] - SLACK if len(best) >= k else 0.0, 0.0)
                group = np.flatnonzero(best >= least)
                of, inside = np.nonzero((groups[group] >= least) & (groups[group] > 0))
                near = group[of] * GROUP + inside
                cos = self.gain[self.often[near]] @ (often[j] * self.often_idf) * self.scale[near]
                cos = np.round(cos if sums is None else sums[near] + cos, 12)
                order = np.lexsort((near, -cos))[:k]
                order = order[cos[order] > 0]
                out.append((near[order], cos[order]))
        return out


class BlockMaxIndex:
    """Unit vectors of examples as postings in blocks; ``search`` gives the exact nearest."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        # examples in the order of their heaviest terms share blocks, which keeps the block maxima telling
        heavy = [tuple(t[np.argsort(-w, kind="stable")][:4].tolist()) for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=heavy.__getitem__), np.int64)
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        sizes = np.array([len(vectors[i][0]) for i in self.order], np.int64)
        term = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, np.int64)])
        self.weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        place = np.repeat(np.arange(self.n), sizes)
        by = np.lexsort((place, term))
        term, place, self.weight = term[by], place[by], self.weight[by]
        self.inside = place % block
        # postings of term t in block b lie at ends[t, b] .. ends[t, b + 1]
        cell = term * self.blocks + place // block
        self.ends = np.searchsorted(cell, np.arange(terms * self.blocks + 1))
        self.top = np.zeros((max(terms, 1), self.blocks))
        np.maximum.at(self.top.reshape(-1), cell, self.weight)
        self.opened = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest with a positive cosine, nearest first, ties to the smaller number."""
        near, cos = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms) or not self.n:
            return near, cos
        bound = weights @ self.top[terms]
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(cos) == k and bound[b] < cos[-1] - 1e-12:
                break
            self.opened += 1
            cells = terms * self.blocks + b
            lo, hi = self.ends[cells], self.ends[cells + 1]
            size = hi - lo
            at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            score = np.round(np.bincount(self.inside[at], np.repeat(weights, size) * self.weight[at], self.block), 12)
            hits = np.flatnonzero(score > 0 if len(cos) < k else score >= cos[-1])
            number = self.order[b * self.block + hits]
            hits, number = hits[number != skip], number[number != skip]
            near, cos = np.concatenate([near, number]), np.concatenate([cos, score[hits]])
            best = np.lexsort((near, -cos))[:k]
            near, cos = near[best], cos[best]
        return near, cos


class Voter:
    """Votes of the nearest examples; ``left_out`` are those of the examples, each left out of its own vote.

    Examples with equal vectors are one neighbour that votes with its share of toxic labels.
    """

    def __init__(self, examples: list[tuple], idf: np.ndarray, whole: bool, k: int = NEIGHBOURS):
        """``examples`` are (id, label, terms, counts) with arrays; ``whole`` takes the index for whole texts."""
        self.idf, self.k, self.whole = idf, k, whole
        groups: dict[tuple, list] = {}
        self.group = []
        for i, label, terms, counts in examples:
            g = groups.setdefault((terms.tobytes(), counts.tobytes()), [len(groups), i, 0, 0, terms, counts])
            g[2] += 1
            g[3] += label
            self.group.append(g[0])
        toxic, n = sum(g[3] for g in groups.values()), len(examples)
        self.prior = (toxic + 0.5) / (n + 2)
        # documents without any term of the space have no neighbours: the rate among such examples
        blank = groups.get((b"", b""), [-1, None, 0, 0])
        self.blank = (blank[3] + 2 * self.prior) / (blank[2] + 2)
        kept = [g for g in groups.values() if len(g[4])]
        number = {g[0]: j for j, g in enumerate(kept)}
        self.group = [number.get(g, -1) for g in self.group]
        self.ids = [g[1] for g in kept]
        self.count = np.array([g[2] for g in kept], np.float64)
        self.toxic = np.array([g[3] for g in kept], np.float64)
        # what is sent to the tasks is small; each process makes the index from it once
        self.bounds = np.concatenate([[0], np.cumsum([len(g[4]) for g in kept])]).astype(np.int64)
        self.terms = np.concatenate([g[4] for g in kept] or [np.zeros(0)]).astype(np.int32)
        counts = np.concatenate([g[5] for g in kept] or [np.zeros(0, np.int64)])
        self.counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
        self.made = None
        self.seen: dict[tuple, float] = {}

    @property
    def index(self) -> TextIndex | BlockMaxIndex:
        if self.made is None:
            if self.whole:
                self.made = TextIndex(self.bounds, self.terms, self.counts, self.idf)
            else:
                self.made = BlockMaxIndex([self.example(i) for i in range(len(self.ids))], len(self.idf))
        return self.made

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.bounds[i], self.bounds[i + 1])
        return self.vector(self.terms[at].astype(np.int64), self.counts[at])

    def vector(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts.astype(np.float64))) * self.idf[t] if len(t) else np.zeros(0)
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def _vote(self, near: np.ndarray, cos: np.ndarray, share: np.ndarray) -> float:
        weight = cos**2
        return (float(weight @ share) + 0.2 * self.prior) / (float(weight.sum()) + 0.2) if len(near) else self.blank

    def _search(self, vectors: list, skip: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.whole:
            return self.index.search(vectors, self.k, skip)
        return [self.index.search(*v, self.k, s) for v, s in zip(vectors, skip)]

    def left_out(self, numbers: list[int]) -> list[tuple[float, float]]:
        """The votes on these groups of equal examples for one with label 0 and for one with label 1 that is left out."""
        out = []
        found = self._search([self.example(i) for i in numbers], [i if self.count[i] == 1 else -1 for i in numbers])
        for i, (near, cos) in zip(numbers, found):
            share = self.toxic[near] / self.count[near]
            rest = max(self.count[i] - 1, 1)
            out.append(tuple(self._vote(near, cos, np.where(near == i, (self.toxic[i] - y) / rest, share)) for y in (0, 1)))
        return out

    def votes(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list]]:
        """The vote on each (terms, counts), and its first three neighbours as (id, cosine, share of toxic labels); equal rows are searched once."""
        number: dict[tuple, int] = {}
        which = [number.setdefault((t.tobytes(), c.tobytes()), len(number)) for t, c in rows]
        first = np.unique(which, return_index=True)[1].tolist() if rows else []
        out = []
        for near, cos in self._search([self.vector(*rows[i]) for i in first], [-1] * len(first)):
            share = self.toxic[near] / self.count[near]
            out.append((self._vote(near, cos, share), [(self.ids[i], float(c), float(y)) for i, c, y in zip(near[:3].tolist(), cos[:3].tolist(), share[:3].tolist())]))
        return [out[i] for i in which]

    def vote_again(self, terms: np.ndarray, counts: np.ndarray) -> float:
        key = (terms.tobytes(), counts.tobytes())
        if key not in self.seen:
            if len(self.seen) >= 20_000:
                self.seen.clear()
            self.seen[key] = self.votes([(terms, counts)])[0][0]
        return self.seen[key]


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Intercept and slopes by Newton's method to convergence, drawn towards 0 and the mean of the columns."""
    start = np.concatenate([[0.0], np.full(x.shape[1], 1 / x.shape[1])])
    beta, design = start.copy(), np.concatenate([np.ones((len(x), 1)), x], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - ridge * (beta - start)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta)), slope)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    beta[1:] = np.maximum(beta[1:], 1e-3)
    return beta


def _lists(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each row."""
    terms, counts = batch.column("terms"), batch.column("counts")
    at = terms.offsets.to_numpy().astype(np.int64)
    t, c = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
    return [(t[a - at[0]: b - at[0]], c[a - at[0]: b - at[0]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _part(lean: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = lean[terms]
    return t[t >= 0], counts[t >= 0]


def classify(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS, k: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row of (doc_id, text), from labels (doc_id, label 0 or 1).

    Other and null labels are left out, repeated ones count once, other columns are ignored.  Evidence holds up to three neighbours with the cosine of the whole
    texts and share of toxic labels.  ``terms`` bounds the toxic terms of the second vote alone.
    Null and empty texts, and texts without a term of any example, get the rate of such examples.  Repeated
    rows get equal scores; without labelled rows all scores are that of an even prior, below 1/2.
    """
    labels = labels.filter("label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    n = labels.count()
    part = F.conv(F.substring(id_hash(F.col("doc_id"), "examples"), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    drawn = labels.filter(part < F.lit(min(1.0, examples / max(n, 1))))
    # about ``examples`` rows of an id and a label: bounded by the parameter
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "toxic_examples")
    vocabulary = all_terms(sample)
    chosen = choose_terms(sample, terms)
    rows = stage(term_counts(docs, vocabulary), "toxic_terms")
    total = rows.count()
    idf = np.log((total + 1) / (document_counts(rows, len(vocabulary)) + 1)) + 1
    at = np.searchsorted(vocabulary, chosen)
    lean = np.full(len(vocabulary), -1)
    lean[at] = np.arange(len(chosen))
    own = term_counts(sample, vocabulary).join(F.broadcast(drawn), "doc_id").toArrow()
    model = [(i, y, *r) for b in own.to_batches() for i, y, r in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), _lists(b))]
    model.sort(key=lambda m: (m[0], m[1], m[2].tobytes(), m[3].tobytes()))
    del own
    sc = docs.sparkSession.sparkContext
    whole = Voter(model, idf, True, k)
    part_ = Voter([(i, y, *_part(lean, t, c)) for i, y, t, c in model], idf[at], False, k)
    made = sc.broadcast((whole, part_, lean))

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part_, _ = made.value
        for batch in batches:
            voters, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for which, voter in ((0, whole), (1, part_)):
                mine = number[voters == which]
                out = np.array(voter.left_out(mine.tolist())).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), which)), pa.array(mine), pa.array(out[:, 0]), pa.array(out[:, 1])], ["voter", "number", "clean", "toxic"])

    beta = np.array([0.0, 0.5, 0.5])
    y = np.array([label for _, label, _, _ in model], np.float64)
    if 0 < y.sum() < len(y):
        spark = docs.sparkSession
        each = [spark.range(len(v.ids)).select(F.lit(j).cast("long").alias("voter"), F.col("id").alias("number")) for j, v in enumerate((whole, part_))]
        found = each[0].unionByName(each[1]).repartition(sc.defaultParallelism * 2).mapInArrow(left_out, "voter long, number long, clean double, toxic double").toArrow()
        which, number = found.column("voter").to_numpy(), found.column("number").to_numpy()
        x = []
        for j, voter in enumerate((whole, part_)):
            votes = np.full((len(voter.ids) + 1, 2), voter.blank)  # the last row is for examples without a term
            votes[number[which == j], 0] = found.column("clean").to_numpy()[which == j]
            votes[number[which == j], 1] = found.column("toxic").to_numpy()[which == j]
            x.append(_logit(votes[np.array(voter.group), y.astype(np.int64)]))
        beta = _logistic(np.stack(x, axis=1), y)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, part_, lean = made.value
        for batch in batches:
            lists = _lists(batch)
            out = whole.votes(lists)
            both = np.array([(v, part_.vote_again(*_part(lean, *r))) for (v, _), r in zip(out, lists)]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-(beta[0] + _logit(both) @ beta[1:])))
            evidence = [[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in e] for _, e in out]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)),
                pa.array(evidence, pa.list_(pa.struct([("doc_id", batch.column("doc_id").type), ("cosine", pa.float64()), ("toxic", pa.float64())]))),
            ], ["doc_id", "score", "predicted", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:{kind},cosine:double,toxic:double>>"
    return rows.mapInArrow(judge, shape)
