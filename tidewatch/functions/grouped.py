"""Whole groups in order, many to a task: for steps that need all rows of a series that is known to be short."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.functions.order import _segments

#: Rows of results that are sent together.
EMIT = 1 << 16


def groups_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted rows; one run and one batch are held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _segments(pa.Table.from_batches([batch]), keys)
        goes_on = bool(held) and all(held[-1].column(k)[-1].equals(batch.column(k)[0]) for k in keys)
        if held and not goes_on:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(at[:-1], at[1:]):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], solve: Callable[[pa.Table], pa.Table], schema: str | T.StructType, keeps: bool = False,
) -> DataFrame:
    """``solve`` on the rows of every group, sorted by ``order``; results are sent in large batches.

    ``keeps`` says that ``solve`` keeps the rows' keys and order; another step over the same groups then needs no shuffle.
    """
    keys = list(keys)
    layout = (tuple(keys), tuple(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for group in groups_of(batches, keys):
            done.append(solve(group))
            size += done[-1].num_rows
            if size >= EMIT:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done, size = [], 0
        if size:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df if getattr(df, "grouped", None) == layout else df.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    out = laid.mapInArrow(run, schema)
    if keeps:
        out.grouped = layout
    return out


def matrix(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns as doubles, one row per row; null is NaN."""
    return np.column_stack([pc.cast(table.column(c), pa.float64()).to_numpy() for c in names]) if names else np.empty((table.num_rows, 0))
