"""Feature expansion of a univariate series, channel means and delay embedding."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidewatch.functions import trailing
from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.numeric import clip, correlation, finite, mean_of, num, total
from tidewatch.functions.quantile import percentiles
from tidewatch.operators.layout import IDX, KEYS, LEN, SERIES, attach, by_chunk, frame, home, with_halo

WINDOW = 30
MIN_ROWS = 2


def rolling_mean(col: str = "f0", window: int = WINDOW) -> Column:
    return F.avg(col).over(frame(-(window - 1), 0))


def rolling_std(col: str = "f0", window: int = WINDOW) -> Column:
    """Sample standard deviation; 0 where fewer than two rows are in the window."""
    return finite(F.stddev_samp(col).over(frame(-(window - 1), 0)))


def second_difference(col: str = "f0") -> Column:
    w = by_chunk()
    x1, x2 = F.lag(col, 1).over(w), F.lag(col, 2).over(w)
    return F.coalesce(F.col(col) - 2 * x1 + x2, num(0))


def rolling_autocorr(col: str = "f0", lagged: str = "_lag", window: int = WINDOW) -> Column:
    """Pearson correlation with the previous row over the window, clipped to [-1, 1]; 0 where one of them is flat.

    ``lagged`` must already hold the previous value, null on the first row.
    """
    return clip(finite(correlation(col, lagged, frame(-(window - 1), 0))), -1.0, 1.0)


def expand_5(df: DataFrame, col: str = "f0", window: int = WINDOW) -> DataFrame:
    """``f0..f4``: value, rolling mean, rolling std, second difference, autocorrelation.

    Series shorter than two rows are left out, as they have no such features.  The windows of a chunk are taken at once
    within its task, value by value as by ``rolling_mean`` and its like.
    """
    wide = with_halo(df.filter(F.col(LEN) >= MIN_ROWS), back=window + 1)
    names = ["f1", "f2", "f3", "f4"]
    schema = T.StructType([f for f in wide.schema.fields if f.name != "home"] + [T.StructField(c, T.DoubleType()) for c in names])

    def features(group: pa.Table) -> pa.Table:
        own, column = group.column("home"), group.column(col)
        group = group.drop_columns("home")
        for name, (value, null) in zip(names, series_features(matrix(group, [col])[:, 0], column.is_valid().to_numpy(), window)):
            group = group.append_column(name, pa.array(value, mask=null))
        return group.filter(own)

    out = per_group(wide, KEYS, [IDX], features, schema)
    return out if col == "f0" else out.withColumn("f0", F.col(col))


def series_features(x: np.ndarray, known: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """``rolling_mean``, ``rolling_std``, ``second_difference`` and ``rolling_autocorr`` of consecutive rows, and which are null."""
    with np.errstate(all="ignore"):
        count, total_, square = trailing.moments(x, known, window)
        deviation = np.where(count > 1, np.sqrt(square / (count - 1)), 0.0)
        before = np.append(np.nan, x[:-1])[: len(x)]
        there = known & np.append(False, known[:-1])[: len(x)]
        follows = trailing.correlation(x, before, there, window)
        bend = np.zeros(len(x))
        bend[2:] = x[2:] - 2 * x[1:-1] + x[:-2]
        bend[2:][~(known[2:] & known[1:-1] & known[:-2])] = 0.0
        none = np.zeros(len(x), bool)
        return [(total_ / count, count == 0), (np.where(np.isfinite(deviation), deviation, 0.0), none), (bend, none),
                (np.clip(np.where(np.isfinite(follows), follows, 0.0), -1.0, 1.0), none)]


def expand_6(df: DataFrame, col: str = "f0", window: int = WINDOW) -> DataFrame:
    """``expand_5`` plus ``f5``: capped distance of the rolling std from its median, in MADs."""
    five = expand_5(df, col, window)
    med = percentiles(five, [SERIES], "f2", {"_med": 0.5}, carry=LEN)
    centred = attach(five, med.drop("n_values")).withColumn("_dev", F.abs(F.col("f2") - F.col("_med")))
    mad = percentiles(centred, [SERIES], "_dev", {"_mad": 0.5}, carry=LEN)
    out = attach(centred, mad.drop("n_values"))
    return out.withColumn("f5", F.least(num(50), F.col("_dev") / (F.col("_mad") + 1e-12))).drop(
        "_med", "_dev", "_mad"
    )


def expand(df: DataFrame, width: int, col: str = "f0") -> DataFrame:
    """Feature set of 1, 5 or 6 columns."""
    if width == 1:
        return df
    if width == 5:
        return expand_5(df, col)
    if width == 6:
        return expand_6(df, col)
    raise ValueError(f"feature sets have 1, 5 or 6 columns, not {width}")


def channel_mean(cols: Sequence[str]) -> Column:
    return mean_of(cols)


def row_stats(cols: Sequence[str]) -> list[Column]:
    """Mean and population standard deviation over the features of a row."""
    mean = mean_of(cols)
    var = total([(F.col(c) - mean) * (F.col(c) - mean) for c in cols]) / num(len(cols))
    return [mean.alias("row_mean"), F.sqrt(var).alias("row_std")]


def delay_embedding(df: DataFrame, cols: Sequence[str], width: int = 20) -> DataFrame:
    """Column ``z``: the last ``width`` feature rows, oldest first; null before that."""
    wide = with_halo(df, back=width - 1)
    rows = F.collect_list(F.array(*cols)).over(frame(-(width - 1), 0))
    return home(wide.withColumn("z", F.when(F.col(IDX) >= width - 1, F.flatten(rows))))
