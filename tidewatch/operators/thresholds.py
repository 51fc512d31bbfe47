"""Score thresholds per group of calibration or clean rows.

A null threshold switches a scorer off.  Inputs are long rows with ``chunk`` and ``n``;
groups may be of any size (see ``functions.quantile``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.numeric import num
from tidewatch.functions.quantile import percentiles
from tidewatch.operators.layout import IDX, LEN, SERIES, attach

METHODS = ("percentile", "trimmed_percentile", "iqr", "mad", "capped")
MIN_VALUES = 5


def positive_percentile(
    df: DataFrame, keys: Sequence[str], value: str, above: float | Column = 0.0,
    prob: float = 0.99,
) -> DataFrame:
    """Percentile of the values above ``above``; needs more than five of them."""
    positive = df.filter(F.col(value) > above)
    q = percentiles(positive, keys, value, {"q": prob})
    return q.select(
        *keys, F.when(F.col("n_values") > MIN_VALUES, F.col("q")).alias("threshold"),
        F.col("n_values").alias("n_positive"),
    )


def robust_threshold(
    df: DataFrame, keys: Sequence[str], value: str, method: str = "percentile",
    prob: float = 0.99, trim: float = 0.01, iqr_k: float = 3.0, mad_k: float = 2.5,
    cap_ratio: float = 5.0, cap_prob: float = 0.9, cap_off: Column | None = None,
) -> DataFrame:
    """``keys, n_values, threshold`` by one of ``METHODS``; fewer than five values is off.

    ``cap_off`` is an expression over ``n_values`` under which ``capped`` does not cap.
    """
    if method not in METHODS:
        raise ValueError(f"unknown threshold method {method!r}, expected one of {METHODS}")
    extra = [k for k in keys if k != SERIES]

    def q(frame, probs):
        return percentiles(frame, keys, value, probs, carry=LEN)

    asked = {"percentile": {}, "trimmed_percentile": {"_cut": 1 - trim}, "iqr": {"_q1": 0.25, "_q3": 0.75}, "mad": {"_q2": 0.5}, "capped": {"_cap": cap_prob}}
    first = q(df, {"_p": prob, **asked[method]})
    out = F.col("_p")
    if method == "trimmed_percentile":
        kept = attach(df, first.select(*keys, LEN, "_cut"), on=extra).filter(F.col(value) <= F.col("_cut"))
        second = percentiles(kept, keys, value, {"_t": prob}, count="_left")
        first = first.join(second, list(keys), "left")
        out = F.when(F.col("_left") < MIN_VALUES, F.col("_cut")).otherwise(F.col("_t"))
    elif method == "mad":
        dev = attach(df, first.select(*keys, LEN, "_q2"), on=extra).withColumn(
            "_dev", F.abs(F.col(value) - F.col("_q2"))
        )
        second = percentiles(dev, keys, "_dev", {"_mad": 0.5}, count="_m")
        first = first.join(second, list(keys), "left")
        out = F.when(F.col("_mad") <= 0, F.col("_p")).otherwise(
            F.col("_q2") + mad_k * 1.4826 * F.col("_mad")
        )
    elif method == "iqr":
        iqr = F.col("_q3") - F.col("_q1")
        out = F.when(iqr <= 0, F.col("_p")).otherwise(F.col("_q3") + iqr_k * iqr)
    elif method == "capped":
        uncapped = F.col("_cap") <= 0
        if cap_off is not None:
            uncapped = uncapped | cap_off
        out = F.when(uncapped, F.col("_p")).otherwise(F.least(F.col("_p"), cap_ratio * F.col("_cap")))
    return first.select(*keys, "n_values", F.when(F.col("n_values") >= MIN_VALUES, out).alias("threshold"))


def sigma_threshold(df: DataFrame, keys: Sequence[str], value: str, rows: Column, k: float = 3.0) -> DataFrame:
    """Mean plus ``k`` standard deviations over the calibration ``rows``."""
    v = F.when(rows, F.col(value))
    return df.groupBy(*keys).agg(
        (F.avg(v) + num(k) * (F.stddev_pop(v) + num(1e-12))).alias("threshold")
    )


def regime_thresholds(
    df: DataFrame, value: str = "raw", scorer: str = "scorer", method: str = "trimmed_percentile",
    min_frames: int = 50, small: int = 300,
) -> DataFrame:
    """Threshold per (series, regime, scorer) over the positive scores of clean rows.

    A regime with fewer than ``min_frames`` clean rows is off; a small regime is not
    capped.  Input rows need ``regime`` and ``regime_rows`` (clean rows of the regime).
    """
    keys = [SERIES, "regime", scorer]
    enough = df.filter((F.col("regime_rows") >= min_frames) & (F.col(value) > 1e-12))
    sized = enough if method != "capped" else enough.withColumn("_small", F.col("regime_rows") < small)
    if method != "capped":
        return robust_threshold(sized, keys, value, method)
    out = robust_threshold(sized, [*keys, "_small"], value, method, cap_off=F.col("_small"))
    return out.drop("_small")
