"""Combining scorer outputs into one score and a flag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.numeric import largest, num


def ratio(raw: Column, threshold: Column) -> Column:
    """Score in units of its threshold; null where the scorer is off."""
    return F.when(threshold > 0, raw / (threshold + num(1e-12)))


def or_vote(df: DataFrame, pairs: Mapping[str, str], active: Column | None = None) -> DataFrame:
    """Add ``score`` (largest raw/threshold) and ``flag`` (score at least 1).

    ``pairs`` maps raw columns to threshold columns.  Rows where ``active`` is false are
    on probation: their score, flag and raw values are 0.
    """
    active = F.lit(True) if active is None else active
    score = largest([ratio(F.col(r), F.col(t)) for r, t in pairs.items()])
    out = df.withColumn("score", F.when(active, score).otherwise(num(0)))
    for r in pairs:
        out = out.withColumn(r, F.when(active, F.col(r)).otherwise(num(0)))
    return out.withColumn("flag", (F.col("score") >= 1.0).cast("int"))
