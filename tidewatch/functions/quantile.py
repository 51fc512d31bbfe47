"""Exact percentiles that hold for groups of any size (see ``order``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.order import order_statistics


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    part: str | None = "chunk",
    count: str = "n_values",
    carry: str | None = None,
) -> DataFrame:
    """One row per ``keys`` with the number of non-null values and one column per prob.

    ``part`` is a column that tells equal values of a key apart (the chunk the rows are in).  ``carry`` is a
    column that is constant within a series (its length) and is passed on.
    """
    return order_statistics(df, [*keys, carry] if carry else keys, value, probs, part, count)


def percentiles_by(
    df: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, names: Sequence[str],
    part: str = "chunk", count: str = "n_values",
) -> DataFrame:
    """As ``percentiles`` with probabilities that differ between groups.

    ``wanted`` has the keys and one probability column per name; it meets the rows on (keys, part), so a long
    group is spread over its parts.
    """
    spans = df.groupBy(*keys).agg(F.min(part).alias("_p0"), F.max(part).alias("_p1"))
    asked = wanted.select(*keys, *[F.col(n).cast("double").alias(f"_w_{n}") for n in names])
    spread = spans.join(asked, list(keys)).withColumn(part, F.explode(F.sequence("_p0", "_p1"))).drop("_p0", "_p1")
    return order_statistics(df.join(spread, [*keys, part]), keys, value, {n: f"_w_{n}" for n in names}, part, count)
