"""Normalisers and score transforms.

Statistics are one grouped aggregate per series, attached chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.numeric import finite, num
from tidewatch.functions.quantile import percentiles
from tidewatch.operators.jumps import percentile
from tidewatch.operators.layout import IDX, LEN, SERIES, attach
from tidewatch.session import stage

#: Rows of a series that one task standardises.
IN_TASK = 1 << 16
CAL_RATIO = 0.15
MIN_CAL = 50


def calibration_end(ratio: float = CAL_RATIO, least: int = MIN_CAL) -> Column:
    """Rows before this position calibrate."""
    share = F.floor(F.col(LEN) * num(ratio)).cast("long")
    return F.least(F.greatest(F.lit(least).cast("long"), share), F.col(LEN) - 1)


def series_stats(df: DataFrame, cols: Sequence[str], rows: Column | None = None) -> DataFrame:
    """``n`` and, per column, ``<c>_mu`` and ``<c>_sd`` over the rows where ``rows`` holds."""
    pick = (lambda c: F.col(c)) if rows is None else (lambda c: F.when(rows, F.col(c)))
    aggs = [F.max(LEN).alias(LEN)]
    for c in cols:
        aggs += [F.avg(pick(c)).alias(f"{c}_mu"), F.stddev_pop(pick(c)).alias(f"{c}_sd")]
    return df.groupBy(SERIES).agg(*aggs)


def znorm(df: DataFrame, cols: Sequence[str], rows: Column | None = None, eps: float = 1e-10) -> DataFrame:
    """Replace each column by its z-score against the chosen rows of the series."""
    stats = series_stats(df, cols, rows)
    out = attach(df, stats)
    for c in cols:
        out = out.withColumn(c, (F.col(c) - F.col(f"{c}_mu")) / (F.col(f"{c}_sd") + num(eps)))
    return out.drop(*[f"{c}_{s}" for c in cols for s in ("mu", "sd")])


def calibration_znorm(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    df = df.withColumn("cal_end", calibration_end())
    return znorm(df, cols, F.col(IDX) < F.col("cal_end"))


def clean_znorm(df: DataFrame, cols: Sequence[str], masked: str = "masked") -> DataFrame:
    return znorm(df, cols, ~F.col(masked))


def safe_z(col: str) -> Column:
    """z-score from ``<col>_mu``/``<col>_sd``; a flat column is only centred."""
    centred = F.col(col) - F.col(f"{col}_mu")
    return F.when(F.col(f"{col}_sd") < 1e-10, centred).otherwise(centred / F.col(f"{col}_sd"))


def zscore_safe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = attach(df, series_stats(df, cols))
    for c in cols:
        out = out.withColumn(c, safe_z(c))
    return out.drop(*[f"{c}_{s}" for c in cols for s in ("mu", "sd")])


def symmetric(df: DataFrame, cols: Sequence[str], frames: int | Column) -> DataFrame:
    """Absolute z-score against the first ``frames`` rows of the series.

    Fewer than two such rows, or no row after them, is an error, as it is for one series.
    """
    last = frames if isinstance(frames, Column) else F.lit(frames)
    bad = (last < 2) | (last >= F.col(LEN))
    checked = F.when(bad, F.raise_error(F.lit("calibration_frames must be at least 2 and below n"))
                     .cast("boolean")).otherwise(F.col(IDX) < last)
    out = znorm(df, cols, checked, eps=1e-8)
    for c in cols:
        out = out.withColumn(c, F.abs(c))
    return out


def calibration_score_z(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Signed z-score of scores against the calibration rows (used by ensembles)."""
    return znorm(df, cols, F.col(IDX) < calibration_end(), eps=1e-12)


def adaptive(df: DataFrame, col: str) -> DataFrame:
    """Robust z-score with the part beyond +-2 compressed logarithmically.

    Series of up to ``IN_TASK`` rows are standardised many to a task, the others by one order of all rows.
    """
    df = stage(df, "standardise")
    short = _adaptive_in_task(df.filter(F.col(LEN) <= IN_TASK), col)
    long = df.filter(F.col(LEN) > IN_TASK)
    return short if long.isEmpty() else short.unionByName(_adaptive_by_order(long, col))


def _adaptive_in_task(df: DataFrame, col: str) -> DataFrame:
    def solve(group: pa.Table) -> pa.Table:
        x = matrix(group, [col])[:, 0]
        med = percentile(x, 0.5)
        mad = percentile(np.abs(x - med), 0.5)
        if mad > 0:
            z = 0.6745 * (x - med) / mad
        else:
            known = x[~np.isnan(x)]
            z = (x - known.mean()) / (known.std() + 1e-10) if len(known) else x
        far = np.sign(z) * (2 + 3 * np.log1p(np.maximum(np.abs(z) - 2, 0.0)))
        return group.set_column(group.schema.get_field_index(col), col, pa.array(np.where(np.abs(z) < 2, z, far), from_pandas=True))

    return per_group(df, [SERIES], [], solve, T.StructType([T.StructField(col, T.DoubleType()) if f.name == col else f for f in df.schema.fields]))


def _adaptive_by_order(df: DataFrame, col: str) -> DataFrame:
    base = series_stats(df, [col])
    med = percentiles(df, [SERIES], col, {"_med": 0.5}).drop("n_values")
    first = attach(df, base.join(med, SERIES)).withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    mad = percentiles(first, [SERIES], "_dev", {"_mad": 0.5}, carry=LEN).drop("n_values")
    out = attach(first, mad)
    mu, sd = F.col(f"{col}_mu"), F.col(f"{col}_sd")
    z = (
        F.when(F.col("_mad") > 0, 0.6745 * (F.col(col) - F.col("_med")) / F.col("_mad"))
        .otherwise((F.col(col) - mu) / (sd + num(1e-10)))
    )
    out = out.withColumn("_z", z)
    squeezed = F.signum("_z") * (2 + 3 * F.log1p(F.abs("_z") - 2))
    return out.withColumn(col, F.when(F.abs("_z") < 2, F.col("_z")).otherwise(squeezed)).drop(
        "_z", "_med", "_mad", "_dev", f"{col}_mu", f"{col}_sd"
    )


def iqr_scale(df: DataFrame, col: str) -> DataFrame:
    """``(x - median) / (1.5 IQR)``; falls back to the z-score, then to the raw value."""
    base = series_stats(df, [col])
    q = percentiles(df, [SERIES], col, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    out = attach(df, base.join(q.drop("n_values"), SERIES))
    iqr, sd = F.col("_q3") - F.col("_q1"), F.col(f"{col}_sd")
    scaled = (
        F.when(iqr > 0, (F.col(col) - F.col("_q2")) / (1.5 * iqr))
        .when(sd > 0, (F.col(col) - F.col(f"{col}_mu")) / sd)
        .otherwise(F.col(col))
    )
    return out.withColumn(col, scaled).drop("_q1", "_q2", "_q3", f"{col}_mu", f"{col}_sd")


def power(col: Column, exponent: float = 0.8) -> Column:
    return F.signum(col) * F.pow(F.abs(col), num(exponent))


def minmax(df: DataFrame, col: str) -> DataFrame:
    """Scale to [0, 1] by the finite values; non-finite rows and flat series give 0."""
    df = df.withColumn(col, finite(F.col(col), F.lit(None).cast("double")))
    ends = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN), F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    out = attach(df, ends)
    width = F.col("_hi") - F.col("_lo")
    return out.withColumn(col, F.when(width >= 1e-12, F.coalesce((F.col(col) - F.col("_lo")) / width, num(0))).otherwise(num(0))).drop(
        "_lo", "_hi"
    )


def align(base: DataFrame, scores: DataFrame, col: str) -> DataFrame:
    """One score per row of ``base``: missing positions are 0, extra ones are dropped."""
    keys = [SERIES, "chunk", IDX]
    return base.join(scores.select(*keys, col), keys, "left").withColumn(col, F.coalesce(col, num(0)))
