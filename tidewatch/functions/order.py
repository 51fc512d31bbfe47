"""One range-partitioned order for all keys: exact ranks, quantiles and areas of groups of any size.

Rows are sorted by (keys, value) over range partitions, so a partition holds many short groups or a piece of a long
one.  Within a partition a *segment* is the run of rows of one key; all segments of a partition are numbered and
summed at once.  Only a partition's first and last segment can belong to a group that other partitions hold too,
so what is carried from earlier partitions is a table of at most one row per partition, known by the first value of
the segment.  No group is collected, no row is copied and nothing depends on how many rows a group has.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidewatch.session import stage

FIRST, TIE = "_first", "_first_tie"


def _segments(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Starts of the runs of equal keys, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = pc.fill_null(pc.dictionary_encode(table.column(k)).combine_chunks().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of a partition, which Spark has bounded by the number of ranges; None for an empty one."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy()


def sorted_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` sorted by keys and order over as many ranges as the session has shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)


def _with_carried(rows: DataFrame, carried: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a table with at most two rows per range, null keys included."""
    named = carried.select(*[F.col(c).alias(f"_k{on.index(c)}") if c in on else F.col(c) for c in carried.columns])
    condition = F.lit(True)
    for i, c in enumerate(on):
        condition &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(named), condition, "left").drop(*[f"_k{i}" for i in range(len(on))])


def _distinct(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column]) -> DataFrame:
    """Sums of the measures per key and value, as doubles; a tie is one row, so it cannot fill a partition."""
    return df.groupBy(*keys, value).agg(*[F.sum(c).cast("double").alias(m) for m, c in measures.items()])


def below(df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column]) -> DataFrame:
    """Per distinct value of a key: each measure's sum there and ``<m>_below`` at lower values."""
    keys, names = list(keys), list(measures)
    ranges = sorted_ranges(_distinct(df, keys, value, measures), keys, [value])
    lower = [f"{m}_below" for m in names]
    schema = T.StructType(ranges.schema.fields + [T.StructField(x, T.DoubleType()) for x in lower] + [T.StructField(FIRST, ranges.schema[value].dataType)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        at = _segments(table, keys)
        size = np.diff(at)
        for m, x in zip(names, lower):
            v = _floats(table.column(m))
            before = np.concatenate([[0.0], np.cumsum(v)])[:-1]
            table = table.append_column(x, pa.array(before - np.repeat(before[at[:-1]], size)))
        table = table.append_column(FIRST, table.column(value).take(pa.array(np.repeat(at[:-1], size))))
        yield from table.to_batches()

    rows = stage(ranges.mapInArrow(number, schema), "order_below")
    sums = rows.groupBy(*keys, FIRST).agg(*[F.sum(m).alias(f"_s_{m}") for m in names])
    earlier = Window.partitionBy(*keys).orderBy(FIRST).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, FIRST, *[F.sum(f"_s_{m}").over(earlier).alias(f"_c_{m}") for m in names])
    carried = carried.filter(F.col(f"_c_{names[0]}").isNotNull())  # at most one row per range
    added = [(F.col(x) + F.coalesce(F.col(f"_c_{m}"), F.lit(0.0))).alias(x) for m, x in zip(names, lower)]
    return _with_carried(rows, carried, [*keys, FIRST]).select(*keys, value, *names, *added)


def area(df: DataFrame, keys: Sequence[str], value: str, hit: Column, miss: Column) -> DataFrame:
    """``keys, hits, misses, area``: the sum over hits of the misses at lower values, ties half."""
    keys = list(keys)
    ranges = sorted_ranges(_distinct(df, keys, value, {"_p": hit, "_q": miss}), keys, [value])
    out = T.StructType([ranges.schema[k] for k in keys] + [T.StructField(FIRST, ranges.schema[value].dataType)]
                       + [T.StructField(c, T.DoubleType()) for c in ("_p", "_q", "_area")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        at = _segments(table, keys)
        p, q = _floats(table.column("_p")), _floats(table.column("_q"))
        before = np.cumsum(q) - q
        before -= np.repeat(before[at[:-1]], np.diff(at))
        first = table.take(pa.array(at[:-1]))
        parts = [np.add.reduceat(x, at[:-1]) for x in (p, q, p * (before + 0.5 * q))]
        yield from pa.Table.from_arrays(
            [*[first.column(k) for k in keys], first.column(value), *[pa.array(x) for x in parts]], [*keys, FIRST, "_p", "_q", "_area"]).to_batches()

    segments = ranges.mapInArrow(add, out)
    earlier = Window.partitionBy(*keys).orderBy(FIRST).rowsBetween(Window.unboundedPreceding, -1)
    carried = segments.withColumn("_area", F.col("_area") + F.col("_p") * F.coalesce(F.sum("_q").over(earlier), F.lit(0.0)))
    return carried.groupBy(*keys).agg(F.sum("_p").alias("hits"), F.sum("_q").alias("misses"), F.sum("_area").alias("area"))


def areas(scores: np.ndarray, hit: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ROC area of every column of ``scores``; ties count half, NaN if a class is missing."""
    order = np.argsort(scores, axis=0, kind="stable")
    ranked = np.take_along_axis(scores, order, 0)
    p, q = (np.where(side, weight, 0.0)[order] for side in (hit, ~hit))
    upto = np.cumsum(q, axis=0)
    new = np.ones(ranked.shape, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    last = np.roll(new, -1, axis=0)
    last[-1] = True
    below = np.maximum.accumulate(np.where(new, upto - q, 0.0), axis=0)
    to = np.minimum.accumulate(np.where(last, upto, np.inf)[::-1], axis=0)[::-1]
    hits, misses = p.sum(0), q.sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((hits > 0) & (misses > 0), (p * 0.5 * (below + to)).sum(0) / (hits * misses), np.nan)


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float | str], tie: str | None, count: str,
) -> DataFrame:
    """Per key the number of non-null values and, per probability, linear interpolation between the closest ranks.

    A probability is a number or the name of a column that is constant within a key.  ``tie`` is a column that
    tells equal values apart, so a value that a third of all rows have is spread over ranges.
    """
    own = [p for p in probs.values() if isinstance(p, str)]
    keys, held = list(keys), [*keys, *own]
    rows = df.select(*held, F.col(value).cast("double").alias("_v"), (F.col(tie) if tie else F.lit(0)).cast("long").alias(TIE)).filter("_v IS NOT NULL")
    ranges = sorted_ranges(rows, keys, ["_v", TIE])
    schema = T.StructType([ranges.schema[k] for k in held] + [T.StructField("_v", T.DoubleType()), T.StructField("_at", T.LongType()),
                          T.StructField("_size", T.LongType()), T.StructField(FIRST, T.DoubleType()), T.StructField(TIE, T.LongType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        at = _segments(table, keys)
        n = np.diff(at)
        size, start = np.repeat(n, n), np.repeat(at[:-1], n)
        place = np.arange(table.num_rows) - start
        # a group that lies within this partition needs the wanted ranks only
        kept = np.zeros(table.num_rows, bool)
        kept[: at[1]] = True
        kept[at[-2]:] = True
        for p in probs.values():
            rank = (_floats(table.column(p)) if isinstance(p, str) else p) * (size - 1)
            kept |= (place == np.floor(rank)) | (place == np.ceil(rank))
        kept = np.flatnonzero(kept)
        head = table.take(pa.array(start[kept]))
        yield from pa.Table.from_arrays(
            [*[head.column(k) for k in held], table.column("_v").take(pa.array(kept)), pa.array(place[kept]), pa.array(size[kept]), head.column("_v"), head.column(TIE)],
            [*held, "_v", "_at", "_size", FIRST, TIE]).to_batches()

    kept = stage(ranges.mapInArrow(choose, schema), "order_statistics")
    segments = kept.groupBy(*keys, FIRST, TIE).agg(F.first("_size").alias("_size"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(FIRST, TIE).rowsBetween(Window.unboundedPreceding, -1)
    carried = segments.select(*keys, FIRST, TIE, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
                              F.sum("_size").over(whole).alias("_total"), F.count(F.lit(1)).over(whole).alias("_pieces"))
    carried = carried.filter("_pieces > 1").drop("_pieces")  # at most two rows per range
    placed = _with_carried(kept, carried, [*keys, FIRST, TIE]).select(
        *held, "_v", (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("_at"), F.coalesce("_total", "_size").alias(count))
    rank = [(F.col(p) if isinstance(p, str) else F.lit(p)) * (F.col(count) - 1) for p in probs.values()]
    sides = [F.max(F.when(F.col("_at") == f(r), F.col("_v"))).alias(f"_{side}{i}") for i, r in enumerate(rank) for side, f in (("a", F.floor), ("b", F.ceil))]
    out = placed.groupBy(*held, count).agg(*sides)
    exact = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (r - F.floor(r)) for i, r in enumerate(rank)]
    return out.select(*keys, count, *[e.alias(name) for e, name in zip(exact, probs)])


def positions(rows: DataFrame, keys: Sequence[str], value: str, tie: str, edges: DataFrame, count: str) -> DataFrame:
    """``edges`` with ``count``: rows of their key with a smaller value, or no larger where ``inclusive`` is true.

    Edges and rows are merged in one order, so the work is linear in both, however many edges a key has.  The
    other columns of ``edges`` are kept.
    """
    keys = list(keys)
    kept = [c for c in edges.columns if c not in (*keys, value, "inclusive")]
    kind = F.when(F.col("inclusive"), F.lit(2)).otherwise(F.lit(0))
    asked = edges.select(*keys, F.col(value).alias("_v"), kind.alias("_kind"), F.lit(0).cast("long").alias(TIE), *kept)
    own = rows.select(*keys, F.col(value).alias("_v"), F.lit(1).alias("_kind"), F.col(tie).cast("long").alias(TIE)).filter("_v IS NOT NULL")
    ranges = sorted_ranges(own.unionByName(asked, allowMissingColumns=True), keys, ["_v", "_kind", TIE])
    place = T.StructType([ranges.schema["_v"], ranges.schema["_kind"], ranges.schema[TIE]])
    schema = T.StructType([*ranges.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_size", T.LongType()), T.StructField(FIRST, place)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        at = _segments(table, keys)
        is_row = table.column("_kind").to_numpy() == 1
        before = np.cumsum(is_row) - is_row
        before -= np.repeat(before[at[:-1]], np.diff(at))
        size = np.repeat(np.add.reduceat(is_row.astype(np.int64), at[:-1]), np.diff(at))
        # the edges, and the first row of every segment for its size
        out = ~is_row
        out[at[:-1]] = True
        out = np.flatnonzero(out)
        head = table.select(["_v", "_kind", TIE]).take(pa.array(np.repeat(at[:-1], np.diff(at))[out]))
        first = pa.StructArray.from_arrays([c.combine_chunks() for c in head.columns], ["_v", "_kind", TIE])
        got = table.take(pa.array(out))
        for name, column in (("_at", pa.array(before[out])), ("_size", pa.array(size[out])), (FIRST, first)):
            got = got.append_column(name, column)
        yield from got.to_batches()

    found = stage(ranges.mapInArrow(number, schema), "order_positions")
    segments = found.groupBy(*keys, FIRST).agg(F.first("_size").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(FIRST).rowsBetween(Window.unboundedPreceding, -1)
    carried = segments.select(*keys, FIRST, F.sum("_size").over(earlier).alias("_before")).filter("_before > 0")  # at most one row per range
    placed = _with_carried(found.filter("_kind <> 1"), carried, [*keys, FIRST])
    return placed.select(*keys, F.col("_v").alias(value), (F.col("_kind") == 2).alias("inclusive"), *kept, (F.col("_at") + F.coalesce("_before", F.lit(0))).alias(count))
