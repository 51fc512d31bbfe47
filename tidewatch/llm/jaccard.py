"""Jaccard join of documents on word shingles, exact, with signature trees.

A document is its set of hashed shingles; equal sets are one vertex, its smallest doc_id.  Three steps
find every link with Jaccard >= percent / 100:

1. *Blocking that loses nothing.*  Linked sets share many of the first elements of both in one order of all
   shingles (rare ones first), so every set emits that prefix, about a fifth of it, and one that shares too few
   of its prefix with other sets is done.  The others fall in size bands so that linked sets are in the same or
   the next band.  For a pair of bands at most D elements differ, so of m > D hashed parts of the sets at least
   m - D are equal.  Each set emits a key per part.  Shingles that are frequent in a bounded sample
   are left out of the parts (they cannot add differences); sets that then have too few telling
   parts also emit the parts of the full set, down to single-element and empty parts if it takes them.
2. *A linear number of checks first.*  Each vertex is compared with the smaller one with which it is
   neighbour in most keys; verified links make a forest, whose roots are found by pointer doubling.
3. *Signature trees for the rest.*  Components that share a key form clusters.  A cluster is split in
   blocks of bounded size; each pair of blocks builds trees whose nodes hold the OR and the AND of token
   bitmaps and a range of sizes, and a dual traversal drops node pairs of one component and those whose
   largest possible overlap is too small.  Surviving pairs are verified on the sets, likely ones first,
   until their components are joined, so a task returns at most one link per join.

No step holds a whole group in one task or writes all pairs of a group; copies never meet one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.llm.common import few, id_hash, unused
from tidewatch.llm.words import Words, give_back, mix, slices
from tidewatch.session import stage, unstage

SHINGLE_WORDS = 4
PERCENT = 85
#: Bounded sample for frequent shingles, how often they occur in it, and how many are kept.
SAMPLE_ROWS, SAMPLE_TIMES, MOST_FREQUENT = 10_000, 8, 1 << 18
#: Set elements of a block of one cluster.
BLOCK_GRAMS = 1 << 20
MAX_BITS = 1 << 15
#: Bytes of the bitmaps of one group; more members have shorter ones, which prune less but lose nothing.
MAP_BYTES = 1 << 23
#: Bytes of bitmaps that are compared at once.
FRONT_BYTES = 1 << 22
#: A prefix has room for one more common shingle per so many shingles of a set.
PREFIX_PART = 20
#: Texts of which a task remembers that it has emitted their prefix.
SEEN = 200_000

_U = np.uint64


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and row bounds."""
    w = Words(text, lower=True)
    h, first, n = w.hashes(), w.first, w.counts()
    rows = len(n)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    # hash of words i .. i+k-1, or to the end of a text with fewer words
    row = w.rows()
    left = first[1:][row] - np.arange(len(h))
    size = np.minimum(k, n[row])
    start = left >= size
    start &= (n[row] >= k) | (np.arange(len(h)) == first[:-1][row])
    at = np.flatnonzero(start)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        more = j < size[at]
        value = np.where(more, mix(value * _U(0x9E3779B97F4A7C15) + h[np.minimum(at + j, len(h) - 1)] + _U(j + 1)), value)
    r = row[at]
    order = np.lexsort((value, r))
    r, value = r[order], value[order]
    keep = np.concatenate([[True], (r[1:] != r[:-1]) | (value[1:] != value[:-1])])
    r, value = r[keep], value[keep]
    return value, np.searchsorted(r, np.arange(rows + 1))


class Bands:
    """Size bands in which linked sets are neighbours, and the parts of each pair of bands."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def of(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(-(-self.lows[-1] * 100 // self.percent) if self.percent < 100 else self.lows[-1] + 1)
            if self.lows[-1] == self.lows[-2]:
                self.lows[-1] += 1
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def parts(self, slot: int) -> tuple[int, int]:
        """(parts, largest number of differing elements) for sets of bands slot - 1 and slot."""
        while len(self.lows) <= slot + 1:
            self.of(self.lows[-1])
        most = self.lows[slot + 1] - 1
        differ = 2 * most * (100 - self.percent) // (100 + self.percent)
        return differ + 2 + -(-differ * 15 // 100), differ


def _sum_by_part(x: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Content hash and number of elements of each part."""
    part = (mix(x ^ _U(seed)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    total = np.concatenate([[_U(0)], np.cumsum(mix(x + _U(seed))[order], dtype=np.uint64)])
    n = np.bincount(part, minlength=parts)
    ends = np.cumsum(n)
    return total[ends] - total[ends - n], n


def keys_of(x: np.ndarray, rare: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set of which ``rare`` marks the elements that are not frequent; the last byte is the pair of bands."""
    out, band = [], bands.of(len(x))
    for slot in (band, band + 1):
        parts, differ = bands.parts(slot)
        if not differ:
            continue  # linked sets are equal
        base = _U(slot * 0xA24BAED4963EE407 % (1 << 64))
        number = np.arange(parts).astype(np.uint64) * _U(0x9FB21C651E98DF25)
        content, n = _sum_by_part(x[rare], parts, 2 * slot)
        made = [mix((content ^ base) + number)[n >= 2]]
        if (n < 2).sum() >= parts - differ:
            content, n = _sum_by_part(x, parts, 2 * slot + 1)
            least = 2
            while least > 0 and (n < least).sum() >= parts - differ:
                least -= 1
            made.append(mix((content ^ base ^ _U(0x5851F42D4C957F2D)) + number)[n >= least])
        out += [k & ~_U(255) | _U(slot & 255) for k in made]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bitmap(x: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits // 64, np.uint64)
    at = mix(x + _U(99)) % _U(bits)
    np.bitwise_or.at(out, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    return out.tobytes()


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes, sorted, of the shingles that occur in ``SAMPLE_TIMES`` or more of about ``SAMPLE_ROWS`` documents."""
    n = docs.count()
    part = F.conv(F.substring(id_hash(F.col("doc_id"), "shingles"), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    sample = docs.filter(part < F.lit(min(1.0, SAMPLE_ROWS / max(n, 1)))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0)
            for lo, hi in slices(text):
                value, times = np.unique(shingle_sets(text.slice(lo, hi - lo), k)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], ["h", "n"])

    counts = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= SAMPLE_TIMES)
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(np.uint64))


def extra(n: Column) -> Column:
    """Common shingles that a prefix has room for beyond the first."""
    return F.floor(n / F.lit(PREFIX_PART))


def vertices(docs: DataFrame, k: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (set size), f1, f2 (fingerprint of the set) and prefix of each document; a prefix once per task for equal sets.

    Shingles have one order for all sets, the ``frequent`` ones last.  The prefix is the first
    n - ceil(percent n / 100) + 1 + n // PREFIX_PART of a set.  A row without a doc_id names no vertex, so it
    has no prefix and does not stand for its equal sets.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            text = batch.column(1)
            for lo, hi in slices(text):
                value, bounds = shingle_sets(text.slice(lo, hi - lo), k)
                n = np.diff(bounds)
                one = np.concatenate([[_U(0)], np.cumsum(mix(value + _U(11)), dtype=np.uint64)])
                two = np.concatenate([[_U(0)], np.cumsum(mix(value + _U(77)), dtype=np.uint64)])
                f1, f2 = (t[bounds[1:]] - t[bounds[:-1]] for t in (one, two))
                known = batch.column(0).slice(lo, hi - lo).is_valid().to_pylist()
                first = np.zeros(hi - lo, bool)
                for i, name in enumerate(zip(f1.tolist(), f2.tolist())):
                    if n[i] and known[i] and name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        first[i] = True
                length = np.where(first, n - -(-percent * n // 100) + 1 + n // PREFIX_PART, 0)
                length = np.minimum(length, n)
                if len(frequent) and len(value):
                    late = frequent[np.minimum(np.searchsorted(frequent, value), len(frequent) - 1)] == value
                    value = value[np.lexsort((value, late, np.repeat(np.arange(hi - lo), n)))]
                place = np.arange(len(value)) - np.repeat(bounds[:-1], n)
                kept = value[place < np.repeat(length, n)]
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(kept.view(np.int64))),
                ], ["doc_id", "n", "f1", "f2", "prefix"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, n bigint, f1 bigint, f2 bigint, prefix array<bigint>")


def open_sets(made: DataFrame, percent: int) -> DataFrame:
    """f1 of the sets that may be linked to another.

    Linked sets of a and b shingles share at least T = ceil(percent max(a, b) / 100), and the first j of these lie
    in the first a - T + j and b - T + j.  So both prefixes hold the first ``extra`` + 1 of the smaller one, and a
    set of n shingles that shares fewer than that of ceil(percent n / 100) with other sets has no link.
    """
    rows = made.filter(F.size("prefix") > 0).select("f1", "n", F.explode("prefix").alias("h"))
    beside = W.partitionBy("h").orderBy("f1")
    met = rows.withColumn("p", F.lag("f1").over(beside)).withColumn("q", F.lead("f1").over(beside))
    met = met.filter("p <> f1 OR q <> f1").select("f1", "n", "h").distinct()
    least = extra(F.ceil(F.col("n") * percent / 100)) + 1
    return met.groupBy("f1", "n").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least).select("f1").distinct()


def keys_in(sets: DataFrame, percent: int, frequent: np.ndarray) -> DataFrame:
    """(key, v) of sets (v, n, grams); frequent shingles make no keys where others are enough."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            grams = batch.column(1)
            for i in range(batch.num_rows):
                x = grams[i].values.to_numpy().view(np.uint64)
                rare = np.ones(len(x), bool)
                if len(frequent):
                    rare = frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] != x
                keys = keys_of(x, rare, bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(np.full(len(keys), i)))], ["key", "v"])
        give_back()

    kind = sets.schema["v"].dataType.simpleString()
    return sets.select("v", "grams").mapInArrow(make, f"key bigint, v {kind}")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, v, p) of the keys (key, v) of more than one v; p is the next smaller v, null for the smallest.

    Rows are dealt by key alone, so repeated rows and neighbours are found after one shuffle.
    """
    beside = W.partitionBy("key").orderBy("v")
    rows = keys.repartition("key").distinct().withColumn("p", F.lag("v").over(beside)).withColumn("q", F.lead("v").over(beside))
    return rows.filter("p IS NOT NULL OR q IS NOT NULL").select("key", "v", "p")


def sets_of(docs: DataFrame, ids: DataFrame, k: int, percent: int) -> DataFrame:
    """v, n, band and grams array<bigint> of the documents in ``ids`` (v)."""
    ids = few(ids.select(F.col("v").alias("doc_id")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            text = batch.column(1)
            for lo, hi in slices(text):
                value, bounds = shingle_sets(text.slice(lo, hi - lo), k)
                band = [bands.of(n) if n else 0 for n in np.diff(bounds).tolist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(band, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64))),
                ], ["v", "n", "band", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(make, f"v {kind}, n bigint, band int, grams array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard >= percent / 100."""
    left = sets.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    sized = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("ga", "gb"))
    small = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return sized.filter(small).withColumn("both", both).filter(
        100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct()


class SignatureTree:
    """Binary tree over members sorted by component and size: nodes hold OR, AND, size range and their component if it is one."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, comps: np.ndarray):
        self.order = np.lexsort((sizes, comps))
        n = 1
        while n < len(sizes):
            n *= 2
        s, m, c = sizes[self.order], maps[self.order], comps[self.order]
        fill = n - len(s)
        empty = np.zeros((fill, m.shape[1]), np.uint64)
        self.levels = [(
            np.concatenate([m, empty]), np.concatenate([m, ~empty]), np.concatenate([s, np.full(fill, 1 << 62)]),
            np.concatenate([s, np.full(fill, -1)]), np.concatenate([c, np.full(fill, -2)]),
        )]
        while len(self.levels[0][2]) > 1:
            o, a, lo, hi, comp = self.levels[0]
            left, right = comp[::2], comp[1::2]
            one = np.where(right == -2, left, np.where(left == right, left, -1))
            self.levels.insert(0, (o[::2] | o[1::2], a[::2] & a[1::2], np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), one))


def tree_pairs(p: SignatureTree, q: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Members (of p, of q) that may be linked and are of different components, and the node pairs looked at, in bounded blocks."""
    depth = max(len(p.levels), len(q.levels))
    front = max(64, FRONT_BYTES // (8 * p.levels[0][0].shape[1]))
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        np_, nq = p.levels[min(level, len(p.levels) - 1)], q.levels[min(level, len(q.levels) - 1)]
        lo_p, hi_p, lo_q, hi_q = np_[2][a], np_[3][a], nq[2][b], nq[3][b]
        ok = (hi_p >= 0) & (hi_q >= 0) & (100 * hi_p >= percent * lo_q) & (100 * hi_q >= percent * lo_p)
        ok &= (np_[4][a] != nq[4][b]) | (np_[4][a] == -1)
        looked, i, j = len(a), a[ok], b[ok]
        most = np.minimum(
            np_[3][i] - np.bitwise_count(np_[1][i] & ~nq[0][j]).sum(axis=1).astype(np.int64),
            nq[3][j] - np.bitwise_count(nq[1][j] & ~np_[0][i]).sum(axis=1).astype(np.int64))
        keep = (100 + percent) * most >= percent * (np_[2][i] + nq[2][j])
        a, b = i[keep], j[keep]
        if level + 1 == depth:
            if p is q:
                a, b = a[a != b], b[a != b]
            yield p.order[a], q.order[b], looked
            continue
        yield a[:0], b[:0], looked
        if level + 1 < len(p.levels):
            a, b = np.concatenate([2 * a, 2 * a + 1]), np.concatenate([b, b])
        if level + 1 < len(q.levels):
            a, b = np.concatenate([a, a]), np.concatenate([2 * b, 2 * b + 1])
        if p is q:
            a, b = a[a <= b], b[a <= b]
        stack += [(level + 1, a[at: at + front], b[at: at + front]) for at in range(0, len(a), front)]


def roots(parents: DataFrame) -> DataFrame:
    """(v, comp) of a forest (v, up) with one row per v, up smaller than v; vertices that are only an ``up`` are roots of their own."""
    step = stage(parents, "jaccard_forest")
    while True:
        above = step.select(F.col("v").alias("up"), F.col("up").alias("next"))
        after = step.join(above, "up", "left").select("v", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
        after = stage(after, "jaccard_forest")
        unstage(step)
        step = after
        if not step.filter("moved").limit(1).count():
            return step.select("v", F.col("up").alias("comp"))


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of (a, b): the smallest vertex that it reaches.

    Rounds of hooking the largest to the smallest neighbour: first every vertex sends its smaller neighbours
    to the smallest of them, then its larger ones to the smallest, until nothing changes.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct(), "jaccard_edges")
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        # every larger neighbour goes to the smallest
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # of the smaller neighbours each goes to the smallest, and so does the vertex itself
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(least, "x")
        small = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
        after = stage(small.filter("x <> y").distinct(), "jaccard_edges")
        if not after.exceptAll(edges).limit(1).count() and not edges.exceptAll(after).limit(1).count():
            unstage(edges)
            return after.select(F.col("x").alias("v"), F.col("y").alias("comp"))
        unstage(edges)
        edges = after


def components_of(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text).

    Null, empty and blank texts have no shingles and are their own components.  Equal sets are linked.
    Rows with one doc_id are one vertex; a row with a null doc_id belongs to its equal sets, if any, and
    else has a null component.
    """
    docs = docs.select("doc_id", "text")
    frequent = frequent_shingles(docs, k)
    made = stage(vertices(docs, k, percent, frequent), "jaccard_vertices")
    classes = made.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("v"))
    named = stage(made.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.col("v")).otherwise(F.col("doc_id")).alias("v")), "jaccard_named")
    # the smallest document of each set that may have a link
    able = stage(classes.filter("v IS NOT NULL").join(open_sets(made, percent), "f1", "left_semi").select("v"), "jaccard_open")
    unstage(made)
    sets = stage(sets_of(docs, able, k, percent), "jaccard_sets")
    unstage(able)
    shared = stage(shared_keys(keys_in(sets, percent, frequent)), "jaccard_shared")
    # a linear number of checks
    best = shared.filter("p IS NOT NULL").groupBy("v", "p").agg(F.count("*").alias("times"))
    best = best.groupBy("v").agg(F.max(F.struct("times", (-F.col("p")).alias("p"))).alias("m")).select(F.col("v").alias("a"), (-F.col("m.p")).alias("b"))
    first = verified(best, sets, percent).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("up"))
    forest = stage(roots(first), "jaccard_roots")
    # components that share a key are compared, all in their cluster of such components
    members = stage(shared.join(forest, "v", "left").select("key", "v", F.coalesce("comp", "v").alias("comp")), "jaccard_members")
    open_ = members.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most")
    beside = members.join(open_, "key").filter("comp <> least").select(F.col("comp").alias("a"), F.col("least").alias("b")).distinct()
    clusters = components(beside).select(F.col("v").alias("comp"), F.col("comp").alias("cluster"))
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("comp"), "cluster").distinct())
    inside = members.select("v", "comp").distinct().join(clusters, "comp").join(sets, "v")
    inside = stage(inside, "jaccard_inside")
    unstage(shared, members, sets)
    second = stage(cross_links(inside, percent), "jaccard_links")
    unstage(inside)
    linked = second.join(forest.select(F.col("v").alias("a"), F.col("comp").alias("ca")), "a", "left").join(
        forest.select(F.col("v").alias("b"), F.col("comp").alias("cb")), "b", "left"
    ).select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
    top = components(linked).select(F.col("v").alias("comp"), F.col("comp").alias("top"))
    out = named.join(forest, "v", "left").withColumn("comp", F.coalesce("comp", "v")).join(top, "comp", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("top", "comp").alias("component_id"))
    out = stage(out, "jaccard_components")
    unstage(named, forest, second)
    return out


def representatives(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the one with the smallest doc_id.

    Of rows with that one doc_id and one text one stays.  Documents without words and rows that
    only have a null doc_id are never linked to another and all stay.
    """
    found = components_of(docs, k, percent)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    gone = gone.join(found.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_anti")
    kept = docs.join(few(stage(gone, "jaccard_gone")), "doc_id", "left_anti")
    again = stage(found.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "jaccard_again")
    again = few(again)
    twice = kept.join(again, "doc_id", "left_semi")
    once = kept.join(again, "doc_id", "left_anti")
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    row = unused(docs.columns, "_row")
    # to_json also orders what has no order of its own, such as maps
    least = twice.groupBy("doc_id", "text").agg(F.min_by(F.struct(F.lit(0).alias("a"), *others), F.to_json(F.struct(F.lit(0).alias("a"), *others))).alias(row))
    return once.unionByName(least.select("doc_id", "text", *[F.col(row)[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")]))


def meetings(rows: DataFrame) -> DataFrame:
    """Rows (cluster, v, n, band, ...) with the groups in which they meet: g (struct) and left (which side of it).

    A cluster of up to ``BLOCK_GRAMS`` set elements is one group.  A larger one is cut by band and hash into
    blocks of that size; blocks of one band and of neighbouring bands meet two at a time.
    """
    parts = rows.groupBy("cluster", "band").agg(F.sum("n").alias("grams"))
    parts = parts.groupBy("cluster").agg(
        F.sum("grams").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("grams") / BLOCK_GRAMS).cast("int").alias("p")))).alias("p"))
    at = rows.join(parts, "cluster")
    own, nxt, prev = (F.element_at("p", F.col("band") + d) for d in (0, 1, -1))
    at = at.withColumn("own", own).withColumn("i", F.pmod(F.xxhash64("v"), F.col("own")).cast("int")).withColumn("nxt", nxt).withColumn("prev", prev)
    meet = lambda k, i, k2, j, left: F.struct(
        k.alias("k"), i.alias("i"), k2.alias("k2"), j.alias("j"), left.alias("left"))
    band, i, yes, no = F.col("band"), F.col("i"), F.lit(True), F.lit(False)
    each = lambda n, f: F.when(n.isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), n - 1), f))
    many = F.concat(
        each(F.col("own"), lambda j: meet(band, F.least(i, j), band, F.greatest(i, j), i <= j)),
        each(F.col("nxt"), lambda j: meet(band, i, band + 1, j, yes)),
        each(F.col("prev"), lambda j: meet(band - 1, j, band, i, no)),
    )
    zero = F.lit(0)
    one = F.array(meet(zero, zero, zero, zero, yes))
    at = at.withColumn("m", F.explode(F.when(F.col("total") <= BLOCK_GRAMS, one).otherwise(many)))
    return at.select("*", F.struct("cluster", "m.k", "m.i", "m.k2", "m.j").alias("g"), F.col("m.left").alias("left")).drop("p", "own", "nxt", "prev", "i", "m", "total")


def group_links(group: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a group's members: one per join, verified on the sets.

    Members that ``left`` marks meet the others, or one another if there are no others.
    """
    grams = [np.asarray(r["grams"], np.int64).view(np.uint64) for r in group]
    sizes = np.array([r["n"] for r in group])
    room = 8 * MAP_BYTES // len(group)
    bits = max(64, min(MAX_BITS, 1 << int(8 * sizes.max()).bit_length(), 1 << max(room, 1).bit_length() - 1))
    maps = np.stack([np.frombuffer(bitmap(x, bits), np.uint64) for x in grams])
    names: dict = {}
    comps = np.array([names.setdefault(r["comp"], len(names)) for r in group])
    mine = np.array([r["left"] for r in group])
    left = np.flatnonzero(mine)
    right = np.flatnonzero(~mine) if not mine.all() else left
    if len(names) < 2 or not len(left) or not len(right):
        return []
    p = SignatureTree(sizes[left], maps[left], comps[left])
    q = p if right is left else SignatureTree(sizes[right], maps[right], comps[right])
    up, found, step = np.arange(len(names)), [], max(64, FRONT_BYTES // (8 * maps.shape[1]))

    def flat() -> None:
        while (up[up] != up).any():
            up[:] = up[up]

    for a, b, _ in tree_pairs(p, q, percent):
        a, b = left[a], right[b]
        flat()
        apart = up[comps[a]] != up[comps[b]]
        a, b = a[apart], b[apart]
        # likely pairs first: the sooner components join, the fewer sets are compared
        shared = np.concatenate([np.bitwise_count(maps[a[t: t + step]] & maps[b[t: t + step]]).sum(axis=1) for t in range(0, len(a), step)] or [np.zeros(0)])
        for t in np.argsort(-(shared / np.maximum(sizes[a], sizes[b])), kind="stable").tolist():
            x, y = int(a[t]), int(b[t])
            r, s = int(comps[x]), int(comps[y])
            while up[r] != r:
                r = int(up[r])
            while up[s] != s:
                s = int(up[s])
            if r == s:
                continue
            both = len(np.intersect1d(grams[x], grams[y], assume_unique=True))
            if 100 * both >= percent * (len(grams[x]) + len(grams[y]) - both):
                up[r] = s
                found.append((x, y))
    return found


def cross_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components (comp) within each cluster of (cluster, v, comp, n, band, grams)."""
    kind = rows.schema["v"].dataType.simpleString()
    groups = meetings(rows).groupBy("g").agg(F.collect_list(F.struct("v", "comp", "n", "left", "grams")).alias("rows"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column("rows"), []
            ids = column.type.value_type.field("v").type
            for n in range(batch.num_rows):
                group = [{"v": r["v"].as_py(), "comp": r["comp"].as_py(), "n": r["n"].as_py(), "left": r["left"].as_py(),
                          "grams": r["grams"].values.to_numpy()} for r in column[n]]
                out += [(group[x]["v"], group[y]["v"]) for x, y in group_links(group, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], ids), pa.array([y for _, y in out], ids)], ["a", "b"])
        give_back()

    return groups.select("rows").mapInArrow(link, f"a {kind}, b {kind}")
