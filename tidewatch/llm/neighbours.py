"""Nearest vectors by inner product: stable projections in a kd-tree, verified until a chi-square test stops.

A vector x gets one more component sqrt(M^2 - |x|^2), M the largest norm, and a query gets 0 there, so the
largest inner product is the smallest Euclidean distance.  A Gaussian (2-stable) projection to a few
dimensions keeps distances up to a chi-square factor: |projected|^2 / distance^2 has as many degrees of
freedom as there are projected dimensions.  The projections lie in a kd-tree; a query opens its leaves in
the order of their distance and verifies their vectors exactly.  It stops once a vector nearer than its
k-th would, with chance ``SURE``, have been projected nearer than the next leaf.

Blocks of the index are cells of projected space (a kd-tree over a bounded sample cuts them, a cell with too many
vectors is dealt over several blocks), and every valid row is in one.  A query is answered by the block of its
nearest cell; its k-th there and the same test decide which other blocks it visits.  A task reads the vectors of a
block, then its queries as they come, so it holds a block and a few queries, and vectors move once.  Equal vectors
are one entry with their smallest ids.  Rows that rounding cannot tell from the k-th are all compared in exact
order, so ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewatch.session import stage

#: Projected dimensions; even, so that the chi-square distribution has a closed form.
DIMS = 8
SURE = 0.97
LEAF = 512
BLOCK_ROWS = 16384
CHUNK_QUERIES = 512
#: Rows of the sample that cuts the cells, for each cell; queries that one copy of a block answers.
SAMPLE_A_CELL, MOST_QUERIES = 64, 100_000
#: Rows that a query keeps beyond those asked for, to tell ties.
SPARE = 12
SEED = 20


def chi2_below(x: np.ndarray, df: int) -> np.ndarray:
    """P(chi-square of an even number of degrees <= x)."""
    h = np.minimum(x / 2, 700.0)
    return 1 - np.exp(-h) * sum(h**j / factorial(j) for j in range(df // 2))


class Tree:
    """A kd-tree of points as leaves with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves, open_ = [], [np.arange(len(points))]
        while open_:
            rows = open_.pop()
            if len(rows) <= leaf:
                if len(rows):
                    self.leaves.append(rows)
                continue
            p = points[rows]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            order = np.argpartition(p[:, axis], len(rows) // 2)
            open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2:]]]
        self.low = np.array([points[r].min(axis=0) for r in self.leaves])
        self.high = np.array([points[r].max(axis=0) for r in self.leaves])

    def distances2(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each of some points (rows) to every leaf (columns)."""
        out = np.zeros((len(q), len(self.leaves)))
        for d in range(q.shape[1]):
            at = q[:, d, None]
            gap = np.maximum(np.maximum(self.low[:, d] - at, at - self.high[:, d]), 0)
            out += gap * gap
        return out


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim + 1, DIMS))


class Block:
    """The index of some vectors."""

    def __init__(self, vectors: np.ndarray, most: float, leaf: int = LEAF):
        self.vectors, self.most2 = vectors, most * most
        self.matrix = projection(vectors.shape[1])
        self.tree = Tree(augmented(vectors, most) @ self.matrix, leaf)
        # more than the error of a product of two rows in any order of summation
        self.slack = 4 * np.finfo(float).eps * (vectors.shape[1] + 1) * float(np.sqrt((vectors * vectors).sum(axis=1).max(initial=0)))
        self.verified = 0

    def search(self, q: np.ndarray, k: int, sure: float = SURE, known: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query (row) the rows of, nearly always, its k nearest and of all that rounding cannot tell from the k-th.

        In round t every query that has not stopped opens its t-th leaf; queries at one leaf are verified together.
        ``known`` are scores that k rows elsewhere reach: smaller ones may be left out.
        """
        near2 = self.tree.distances2(q @ self.matrix[:-1])
        order = np.argsort(near2, axis=1)
        pool = k + SPARE
        rows, scores = np.full((len(q), pool), -1), np.full((len(q), pool), -np.inf)
        q2, active = (q * q).sum(axis=1), np.arange(len(q))
        known = np.full(len(q), -np.inf) if known is None else known
        kth = known.copy()
        for t in range(order.shape[1]):
            leaf = order[active, t]
            full = np.isfinite(kth[active])
            worst2 = np.maximum(q2[active] + self.most2 - 2 * np.where(full, kth[active], 0), 1e-300)
            stop = full & (chi2_below(near2[active, leaf] / worst2, DIMS) >= sure)
            active, leaf = active[~stop], leaf[~stop]
            if not len(active):
                break
            for one in np.unique(leaf):
                who, own = active[leaf == one], self.tree.leaves[one]
                self.verified += len(who) * len(own)
                both = np.concatenate([scores[who], q[who] @ self.vectors[own].T], axis=1)
                names = np.concatenate([rows[who], np.broadcast_to(own, (len(who), len(own)))], axis=1)
                best = np.argpartition(-both, pool - 1, axis=1)[:, :pool]
                scores[who], rows[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                kth[who] = np.maximum(known[who], -np.partition(-scores[who], k - 1, axis=1)[:, k - 1])
        out, margin = [], self.slack * np.sqrt(q2)
        for i in range(len(q)):
            least = kth[i] - margin[i]
            if scores[i].min() >= least and rows[i].min() >= 0:  # more rows than the pool holds may tie with the k-th
                out.append(np.flatnonzero(self.vectors @ q[i] >= least))
            else:
                out.append(rows[i][(rows[i] >= 0) & (scores[i] >= least)])
        return out


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(most * most - (vectors * vectors).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


class Cells:
    """Cuts of projected space into cells of about equal size, from a sample of points."""

    def __init__(self, points: np.ndarray, cells: int):
        self.cuts: list[tuple[int, float] | None] = []  # a heap: children of i at 2 i + 1 and 2 i + 2
        level = [points]
        for _ in range(max(0, (cells - 1).bit_length())):
            below = []
            for p in level:
                axis = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
                at = float(np.median(p[:, axis])) if len(p) else 0.0
                self.cuts.append((axis, at))
                below += [p[p[:, axis] < at], p[p[:, axis] >= at]]
            level = below

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        depth = (len(self.cuts) + 1).bit_length() - 1
        axis = np.array([c[0] for c in self.cuts], np.int64)
        at = np.array([c[1] for c in self.cuts])
        for _ in range(depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= at[node])
        return node - len(self.cuts)


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>, dim) without null ids and without null, zero or non-finite vectors."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.filter(~F.exists("v", odd) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _project(most: dict[int, float] | None, cells: dict[int, Cells] | None) -> Callable:
    """An Arrow map that adds ``p`` (projection) and ``cell`` of (v, dim); queries have no ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                p = augmented(v, most[dim]) @ projection(dim) if most else v @ projection(dim)[:-1]
                cell = cells[dim].of(p) if cells else np.zeros(len(p), np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, DIMS, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array(cell)], [*part.schema.names, "p", "cell"])

    return run


def _search(most: dict[int, float], k: int, sure: float) -> Callable:
    """An Arrow map over rows sorted by (dim, block, part, query_id nulls first): the vectors of a block, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block, ids = None, [], None, []

        def answers(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal block, ids
            if block is None:
                stored = np.concatenate([h.column("v").flatten().to_numpy(zero_copy_only=False) for h in held]).reshape(-1, key[0]) if held else np.zeros((0, key[0]))
                ids = [x for h in held for x in h.column("ids").to_pylist()]
                block = Block(stored, most[key[0]]) if len(stored) else None
                held.clear()
            out_q, out_v, out_s = [], [], []
            if block is not None:
                q = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                known = rows.column("known").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                # one more than asked for: the query's own row is no candidate
                for qid, one, found in zip(rows.column("query_id").to_pylist(), q, block.search(q, k + 1, sure, known)):
                    exact = (block.vectors[found] * one).sum(axis=1)
                    best = sorted((-s, i) for r, s in zip(found.tolist(), exact.tolist()) for i in ids[r] if i != qid)[:k]
                    out_q += [qid] * len(best)
                    out_v += [i for _, i in best]
                    out_s += [-s for s, _ in best]
            return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "block", "part")], axis=1)
            asks = batch.column("query_id").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                now = tuple(keys[lo].tolist())
                if now != key:
                    key, block, ids = now, None, []
                    held.clear()
                if not asks[lo]:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                for at in range(lo, hi, CHUNK_QUERIES):
                    yield answers(batch.slice(at, min(CHUNK_QUERIES, hi - at)))

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", sure: float = SURE
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products with each query's vector.

    ``is_query`` is a condition on vec_id.  A query's own row is no candidate.  Ties go to the smaller
    vec_id; rows repeated with one id and vector count once.  With fewer than ``k`` candidates all are given.
    Vectors of each length are searched for the queries of that length.  Other columns are ignored; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors, vec_id, embedding).distinct()
    # equal vectors: no result can hold more than k of them besides the query itself
    rank = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    entries = rows.withColumn("nth", rank).filter(F.col("nth") <= k + 1).groupBy("v", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = stage(entries, "vector_entries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stats = entries.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()  # a row per length
    most = {r["dim"]: r["most"] for r in stats}
    shape = "dim int, v array<double>, p array<double>, cell long"
    # cells of about BLOCK_ROWS vectors, cut by a sample of SAMPLE_A_CELL rows for each
    cells = {}
    for r in stats:
        count = max(1, -(-r["n"] // BLOCK_ROWS))
        some = entries.filter(F.col("dim") == r["dim"]).filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < F.lit(min(1.0, SAMPLE_A_CELL * count / r["n"]) * (1 << 30)))
        found = some.select("dim", "v").mapInArrow(_project(most, None), shape).select("p").toArrow() if count > 1 else None
        points = np.array(found.column("p").to_pylist(), float).reshape(-1, DIMS) if found else np.zeros((0, DIMS))
        cells[r["dim"]] = Cells(points, count)
    placed = stage(entries.select("dim", "v", "ids").mapInArrow(_project(most, cells), "dim int, v array<double>, ids array<bigint>, p array<double>, cell long"), "vector_cells")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("size"))
    placed = placed.join(sizes, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("v"), F.ceil(F.col("size") / F.lit(2.0 * BLOCK_ROWS))))
    placed = stage(placed.withColumn("block", F.xxhash64("cell", "sub")).select("dim", "block", "ids", "v", "p"), "vector_blocks")
    low, high = ([f(F.col("p")[d]).alias(f"{f.__name__}{d}") for d in range(DIMS)] for f in (F.min, F.max))
    boxes = stage(placed.groupBy("dim", "block").agg(F.array(*low).alias("low"), F.array(*high).alias("high")), "vector_boxes")
    asked = stage(rows.filter(is_query).mapInArrow(_project(None, None), "vec_id long, v array<double>, dim int, p array<double>, cell long").select(
        F.col("vec_id").alias("query_id"), "v", "dim", "p"), "vector_queries")

    def visits(queries: DataFrame) -> DataFrame:
        """Every (query, block) with the squared distance of the query to the block's box; there is a box for each BLOCK_ROWS vectors."""
        gap = F.zip_with("p", F.zip_with("low", "high", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x, s: F.greatest(s["a"] - x, x - s["b"], F.lit(0.0)))
        return queries.join(F.broadcast(boxes), "dim").withColumn("away", F.aggregate(gap, F.lit(0.0), lambda a, x: a + x * x)).drop("low", "high")

    def answer(pairs: DataFrame) -> DataFrame:
        """Search of blocks for the queries that visit them; a block with many queries is copied for each MOST_QUERIES of them."""
        many = pairs.groupBy("dim", "block").agg(F.ceil(F.count("*") / F.lit(float(MOST_QUERIES))).cast("int").alias("parts"))
        stored = placed.join(many, ["dim", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        calls = pairs.join(many, ["dim", "block"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        both = stored.select("dim", "block", "part", F.lit(None).cast("long").alias("query_id"), "ids", "v", F.lit(None).cast("double").alias("known")).unionByName(
            calls.select("dim", "block", "part", "query_id", F.lit(None).cast("array<bigint>").alias("ids"), "v", "known"))
        both = both.repartition("dim", "block", "part").sortWithinPartitions("dim", "block", "part", F.col("query_id").asc_nulls_first())
        return both.mapInArrow(_search(most, k, sure), "query_id long, vec_id long, score double")

    # the nearest block tells how near the k-th is; blocks that pass the stop test at that distance stay shut
    home = visits(asked).groupBy("query_id", "dim").agg(F.min_by("block", F.struct("away", "block")).alias("block"))
    first = stage(answer(asked.join(home, ["query_id", "dim"]).withColumn("known", F.lit(None).cast("double"))), "vector_first")
    reached = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("kth")).filter(F.col("found") >= k)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    tops = spark.createDataFrame([(int(d), float(m)) for d, m in most.items()], "dim int, most double")
    again = asked.join(home.select("query_id", F.col("block").alias("home")), "query_id").join(reached.select("query_id", "kth"), "query_id", "left")
    rest = visits(again.join(tops, "dim")).filter("block <> home")
    worst2 = F.greatest(square + F.col("most") * F.col("most") - 2 * F.col("kth"), F.lit(1e-300))
    h = F.least(F.col("away") / worst2 / 2, F.lit(700.0))
    below = 1 - F.exp(-h) * sum((F.pow(h, F.lit(j)) / F.lit(float(factorial(j))) for j in range(1, DIMS // 2)), F.lit(1.0))
    opened = rest.filter(F.col("kth").isNull() | (below < sure)).withColumn("known", F.col("kth"))
    found = first.unionByName(answer(opened.select("dim", "block", "query_id", "v", "known")))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
