"""Jumps per feature and across features.

Features stay in columns, so one sort per chunk serves every feature's frames.  Jump rows
are sparse; pairs of features are counted from them within a fixed lag window.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.numeric import clip, num, total
from tidewatch.functions.quantile import percentiles, percentiles_by
from tidewatch.operators.layout import (
    CHUNK, CHUNK_ROWS, IDX, KEYS, LEN, SERIES, attach, by_chunk, frame, home, long_form, runs, with_halo,
)
from tidewatch.session import stage

# fixed values: default jump parameters
DIFF_PROB = 0.94
LOCAL_HALF = 15
LOCAL_PROB = 0.91
TENSION = 30
LAG = 5
CLUSTER = 3
#: Rows of a series that one task measures; longer series are measured by chunks, with percentiles from one order of all rows.
IN_TASK = 1 << 16


@dataclass(frozen=True)
class Jumps:
    """What jump detection produces: rows, per-feature figures and feature pairs."""

    rows: DataFrame
    features: DataFrame
    cols: tuple[str, ...]


def difference(col: str) -> Column:
    """First difference; 0 on the first row."""
    return F.coalesce(F.col(col) - F.lag(col).over(by_chunk()), num(0))


def centred_std(col: str, half: int = LOCAL_HALF) -> Column:
    return F.stddev_pop(col).over(frame(-half, half))


def tension(col: str, back: int = TENSION) -> Column:
    """Deviation over the current and the previous ``back`` rows."""
    return F.stddev_pop(col).over(frame(-back, 0))


def measures(df: DataFrame, cols: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """``d_`` difference, ``ls_`` local deviation and ``rho_`` tension per feature."""
    wide = with_halo(df, back=max(TENSION, LOCAL_HALF, 1), ahead=LOCAL_HALF, rows=rows)
    new = []
    for c in cols:
        new += [difference(c).alias(f"d_{c}"), centred_std(c).alias(f"ls_{c}"), tension(c).alias(f"rho_{c}")]
    return home(wide.select("*", *new))


def local_ratio(c: str) -> Column:
    return F.abs(F.col(f"d_{c}")) / (F.col(f"ls_{c}") + num(1e-8))


def _wide_thresholds(long: DataFrame, cols: Sequence[str], names: dict[str, str]) -> DataFrame:
    """(series, n, feature, values) rows to one row per series."""
    aggs = [
        F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"{prefix}_{c}")
        for c in cols for v, prefix in names.items()
    ]
    return long.groupBy(SERIES, LEN).agg(*aggs)


def percentile(values: np.ndarray, prob: float) -> float:
    """Linear interpolation between the closest ranks of the values that are not NaN; NaN if there are none."""
    values = np.sort(values[~np.isnan(values)])
    if not len(values) or np.isnan(prob):
        return np.nan
    rank = prob * (len(values) - 1)
    low = int(np.floor(rank))
    a, b = values[low], values[int(np.ceil(rank))]
    return a + (b - a) * (rank - low)


def fixed_spread(x: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Population deviation of the values that are not NaN from ``back`` rows before to ``ahead`` rows after each.

    Values enter one by one, as in the frames of longer series, so ties with thresholds fall the same way.
    """
    wide = np.pad(x, [(back, ahead), (0, 0)], constant_values=np.nan)
    count, mean, square = np.zeros(x.shape), np.zeros(x.shape), np.zeros(x.shape)
    for lo in range(back + ahead + 1):
        value = wide[lo: lo + len(x)]
        there = ~np.isnan(value)
        count += there
        apart = np.where(there, value - mean, 0.0)
        step = apart / np.maximum(count, 1.0)
        mean += step
        square += apart * (apart - step)
    with np.errstate(invalid="ignore"):
        return np.sqrt(square / count)


def spread(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Population deviation from ``start`` to before ``end`` of each row."""
    centred = x - np.round(x.mean())  # whole numbers stay whole, so equal windows stay equal
    s1 = np.concatenate([[0.0], np.cumsum(centred)])
    s2 = np.concatenate([[0.0], np.cumsum(centred * centred)])
    count = end - start
    first, second = s1[end] - s1[start], s2[end] - s2[start]
    return np.sqrt(np.maximum(count * second - first * first, 0.0)) / count


def _thresholds(d: np.ndarray, ls: np.ndarray, rho: np.ndarray, probs: np.ndarray, local: np.ndarray, above: float) -> dict[str, np.ndarray]:
    ratio = np.abs(d) / (ls + 1e-8)
    counted = np.where(ratio > above, ratio, np.nan)
    each = range(d.shape[1])
    return {"d": d, "ls": ls, "rho": rho, "ratio": ratio, "thr": np.array([percentile(np.abs(d[:, j]), probs[j]) for j in each]),
            "lthr": np.array([percentile(counted[:, j], local[j]) for j in each])}


def _differences(values: np.ndarray) -> np.ndarray:
    d = np.diff(values, axis=0, prepend=np.full((1, values.shape[1]), np.nan))
    return np.where(np.isnan(d), 0.0, d)


def fixed_measures(values: np.ndarray, prob: float, local_prob: float) -> dict[str, np.ndarray]:
    """Differences, deviations and thresholds of one whole series with the fixed windows; a column per feature."""
    k = values.shape[1]
    near, past = fixed_spread(values, LOCAL_HALF, LOCAL_HALF), fixed_spread(values, TENSION, 0)
    return _thresholds(_differences(values), near, past, np.full(k, prob), np.full(k, local_prob), -np.inf)


def tuned_measures(values: np.ndarray, w: np.ndarray, tw: np.ndarray, p: np.ndarray, lp: np.ndarray) -> dict[str, np.ndarray]:
    """As ``fixed_measures`` with the windows and probabilities of each feature."""
    at, n = np.arange(len(values)), len(values)
    ls = np.column_stack([spread(x, np.maximum(0, at - int(b)), np.minimum(n, at + int(b) + 1)) for x, b in zip(values.T, w)])
    rho = np.column_stack([spread(x, np.maximum(0, at - int(b)), at + 1) for x, b in zip(values.T, tw)])
    return _thresholds(_differences(values), ls, rho, p, lp, 0.0)


def tuned_windows(values: np.ndarray, window: int, prob: float) -> tuple[np.ndarray, ...]:
    """``feature_parameters`` of one whole series: both windows and both probabilities of each feature."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # features without any value
        v = np.nanstd(values, axis=0) / (np.nanmean(np.abs(values), axis=0) + 1e-10)
    w = np.fmax(5, np.fmin(np.floor(window / (1 + v)), 50))
    p = np.fmin(np.fmax(prob - v * 0.015, 0.80), 0.98)
    return w, np.floor(w * 0.8), p, p - 0.02


def series_flags(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``_flags`` and ``_feature_stats`` of one whole series."""
    d, thr = found["d"], found["thr"]
    pos, neg = d > thr, d < -thr
    hit = pos | neg
    up, down, count = np.where(pos, d, 0.0).sum(0), np.where(neg, -d, 0.0).sum(0), hit.sum(0)
    known = hit & ~np.isnan(found["rho"])
    strain = np.where(known, found["rho"], 0.0).sum(0) / np.maximum(known.sum(0), 1)
    hits = hit.sum(1).astype(float)
    return {"hit": hit, "hits": hits, "threshold": thr, "n_jumps": count, "n_local": (found["ratio"] > found["lthr"]).sum(0), "intensity": up + down,
            "asymmetry": (up - down) / (up + down + 1e-10), "power": (up + down) * count * (1 + strain) / len(d)}


def series_score(d: np.ndarray, flags: dict[str, np.ndarray]) -> np.ndarray:
    """``batch_score`` of one whole series."""
    importance = flags["hits"] / d.shape[1]
    high = percentile(np.where(importance > 0, importance, np.nan), 0.75)
    top = np.array([percentile(x, 0.98) for x in np.abs(d).T])
    strong = np.abs(flags["asymmetry"])
    gain = flags["intensity"] * np.where(strong > 0.8, 1 + strong, 1.0)
    best = np.where(flags["hit"] & (np.abs(d) > top), gain, 0.0).max(1)
    own = np.where((importance > 0) & (importance >= (0.5 if np.isnan(high) else high)), importance, 0.0)
    return own + 0.5 * np.maximum(best, 0.0)


def _measured_in_task(df: DataFrame, cols: Sequence[str], prob: float | None = None, local_prob: float | None = None) -> DataFrame:
    """The rows of whole series with their measures and thresholds (``thr_``, ``lthr_``).

    Without ``prob`` the windows and probabilities are the columns of ``feature_parameters``.  The rows stay wide, so
    all measures and percentiles of a series take one shuffle.
    """
    tuned, cols = prob is None, list(cols)
    schema = T.StructType(df.schema.fields + [T.StructField(f"{x}_{c}", T.DoubleType()) for c in cols for x in ("d", "ls", "rho", "thr", "lthr")])

    def solve(group: pa.Table) -> pa.Table:
        values = matrix(group, cols)
        if tuned:
            given = [matrix(group.slice(0, 1), [f"{k}_{c}" for c in cols])[0] for k in ("w", "tw", "p", "lp")]
            found = tuned_measures(values, *given)
        else:
            found = fixed_measures(values, prob, local_prob)
        for j, c in enumerate(cols):
            for name in ("d", "ls", "rho", "thr", "lthr"):
                group = group.append_column(f"{name}_{c}", pa.array(np.broadcast_to(found[name], values.shape)[:, j], pa.float64(), from_pandas=True))
        return group

    return per_group(df, [SERIES], [IDX], solve, schema)


def _flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        d = F.col(f"d_{c}")
        df = (
            df.withColumn(f"pos_{c}", d > F.col(f"thr_{c}"))
            .withColumn(f"neg_{c}", d < -F.col(f"thr_{c}"))
            .withColumn(f"loc_{c}", F.coalesce(local_ratio(c) > F.col(f"lthr_{c}"), F.lit(False)))
        )
    hits = total([(F.col(f"pos_{c}") | F.col(f"neg_{c}")).cast("double") for c in cols])
    return df.withColumn("hits", hits).withColumn("unified", F.col("hits") > 0).withColumn(
        "importance", F.col("hits") / num(len(cols))
    )


def _feature_stats(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    aggs = [F.max(LEN).alias(LEN)]
    for c in cols:
        d, pos, neg = F.col(f"d_{c}"), F.col(f"pos_{c}"), F.col(f"neg_{c}")
        up = F.coalesce(F.sum(F.when(pos, d)), num(0))
        down = F.coalesce(F.sum(F.when(neg, -d)), num(0))
        count = F.count(F.when(pos | neg, F.lit(1)))
        strain = F.coalesce(F.avg(F.when(pos | neg, F.col(f"rho_{c}"))), num(0))
        aggs.append(F.struct(
            F.lit(c).alias("feature"), F.max(f"thr_{c}").alias("threshold"), count.alias("n_jumps"),
            F.count(F.when(F.col(f"loc_{c}"), F.lit(1))).alias("n_local"),
            (up + down).alias("intensity"), ((up - down) / (up + down + num(1e-10))).alias("asymmetry"),
            ((up + down) * count * (num(1) + strain) / F.max(LEN)).alias("power"),
            *[F.max(f"{e}_{c}").alias(e) for e in extra],
        ).alias(c))
    return df.groupBy(SERIES).agg(*aggs).select(SERIES, LEN, F.inline(F.array(*cols)))


def detect(
    df: DataFrame, cols: Sequence[str], prob: float = DIFF_PROB, local_prob: float = LOCAL_PROB, rows: int = CHUNK_ROWS,
) -> Jumps:
    """Jumps of every feature with one set of parameters.

    The measured rows are staged, as thresholds and flags both read them.
    """
    short = _measured_in_task(df.filter(F.col(LEN) <= IN_TASK), cols, prob, local_prob)
    m = stage(short.unionByName(measures(df.filter(F.col(LEN) > IN_TASK), cols, rows), allowMissingColumns=True), "jump-measures")
    out = m.filter(F.col(LEN) <= IN_TASK)
    long = m.filter(F.col(LEN) > IN_TASK).drop(*[f"{x}_{c}" for c in cols for x in ("thr", "lthr")])
    if not long.isEmpty():
        keep = [*KEYS, LEN]
        sizes = long_form(long.select(*keep, *[F.abs(f"d_{c}").alias(c) for c in cols]), cols, "feature", "v", keep)
        ratios = long_form(long.select(*keep, *[local_ratio(c).alias(c) for c in cols]), cols, "feature", "v", keep)
        a = percentiles(sizes, [SERIES, "feature"], "v", {"t": prob}, carry=LEN).drop("n_values")
        b = percentiles(ratios, [SERIES, "feature"], "v", {"l": local_prob}).drop("n_values")
        thr = _wide_thresholds(a.join(b, [SERIES, "feature"]), cols, {"t": "thr", "l": "lthr"})
        out = out.unionByName(attach(long, thr, rows))
    out = _flags(out, cols)
    return Jumps(out, _feature_stats(out, cols), tuple(cols))


def flagged(df: DataFrame, cols: Sequence[str], prob: float = DIFF_PROB, local_prob: float = LOCAL_PROB) -> DataFrame:
    """The rows of ``detect`` for series that fit a task, not staged."""
    return _flags(_measured_in_task(df, cols, prob, local_prob), cols)


def feature_parameters(df: DataFrame, cols: Sequence[str], window: Column, prob: Column) -> DataFrame:
    """Window and percentiles of each feature from its relative spread.

    ``df`` must carry what ``window`` and ``prob`` (a fraction) refer to per series.
    """
    aggs = [F.max(LEN).alias(LEN), F.first(window).alias("_w"), F.first(prob).alias("_p")]
    for c in cols:
        aggs.append((F.stddev_pop(c) / (F.avg(F.abs(c)) + num(1e-10))).alias(f"v_{c}"))
    stats = df.groupBy(SERIES).agg(*aggs)
    for c in cols:
        v = F.col(f"v_{c}")
        w = F.greatest(F.lit(5), F.least(F.floor(F.col("_w") / (1 + v)), F.lit(50))).cast("int")
        p = clip(F.col("_p") - v * 0.015, 0.80, 0.98)
        stats = (
            stats.withColumn(f"w_{c}", w).withColumn(f"tw_{c}", F.floor(F.col(f"w_{c}") * 0.8).cast("int"))
            .withColumn(f"p_{c}", p).withColumn(f"lp_{c}", p - 0.02)
        )
    return stats.drop("_w", "_p")


def _variable_std(df: DataFrame, cols: Sequence[str], rows: int) -> DataFrame:
    """``ls_`` and ``rho_`` with window lengths that differ between series and features.

    Frame bounds of a window function are literals, so this is a map over single chunks.
    """
    new = [T.StructField(f"{p}_{c}", T.DoubleType()) for c in cols for p in ("ls", "rho")]
    wide = with_halo(df, back=50, ahead=50, rows=rows)
    schema = T.StructType([f for f in wide.schema.fields if f.name != "home"] + new)

    def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        at = np.arange(len(pdf))
        for c in cols:
            x = pdf[c].to_numpy(dtype=float)
            w, t = int(pdf[f"w_{c}"].iloc[0]), int(pdf[f"tw_{c}"].iloc[0])
            pdf[f"ls_{c}"] = spread(x, np.maximum(0, at - w), np.minimum(len(x), at + w + 1))
            pdf[f"rho_{c}"] = spread(x, np.maximum(0, at - t), at + 1)
        return pdf[pdf["home"]].drop(columns="home")

    return wide.groupBy(*KEYS).applyInPandas(fill, schema)


def detect_tuned(
    df: DataFrame, cols: Sequence[str], window: Column | int, prob: Column | float, rows: int = CHUNK_ROWS,
) -> Jumps:
    """Jumps with per-feature windows and percentiles.

    ``window`` and ``prob`` (a fraction) are literals or columns constant in a series.
    """
    window = window if isinstance(window, Column) else F.lit(window)
    prob = prob if isinstance(prob, Column) else num(prob)
    params = feature_parameters(df, cols, window, prob)
    tuned = attach(df, params, rows)
    short = _measured_in_task(tuned.filter(F.col(LEN) <= IN_TASK), cols)
    diffs = with_halo(tuned.filter(F.col(LEN) > IN_TASK), back=1, rows=rows)
    diffs = home(diffs.select("*", *[difference(c).alias(f"d_{c}") for c in cols]))
    m = stage(short.unionByName(_variable_std(diffs, cols, rows), allowMissingColumns=True), "jump-measures")
    out = m.filter(F.col(LEN) <= IN_TASK)
    long = m.filter(F.col(LEN) > IN_TASK).drop(*[f"{x}_{c}" for c in cols for x in ("thr", "lthr")])
    if not long.isEmpty():
        keep = [*KEYS, LEN]
        sizes = long_form(long.select(*keep, *[F.abs(f"d_{c}").alias(c) for c in cols]), cols, "feature", "v", keep)
        ratios = long_form(
            long.select(*keep, *[F.when(local_ratio(c) > 0, local_ratio(c)).alias(c) for c in cols]),
            cols, "feature", "v", keep,
        )
        wanted = params.filter(F.col(LEN) > IN_TASK).select(SERIES, LEN, F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"p_{c}").alias("t"), F.col(f"lp_{c}").alias("l")) for c in cols
        ])))
        keys = [SERIES, LEN, "feature"]
        a = percentiles_by(sizes, keys, "v", wanted, ["t"]).drop("n_values")
        b = percentiles_by(ratios, keys, "v", wanted, ["l"]).drop("n_values")
        thr = _wide_thresholds(a.join(b, keys, "left"), cols, {"t": "thr", "l": "lthr"})
        out = out.unionByName(attach(long, thr, rows))
    out = _flags(out, cols)
    return Jumps(out, _feature_stats(out, cols, ("v", "w", "tw", "p")), tuple(cols))


def jump_rows(jumps: Jumps) -> DataFrame:
    """Jump rows with the positions of the features that jump there."""
    listed = F.filter(
        F.array(*[F.when(F.col(f"pos_{c}") | F.col(f"neg_{c}"), F.lit(i)) for i, c in enumerate(jumps.cols)]),
        lambda x: x.isNotNull(),
    )
    return jumps.rows.filter("unified").select(*KEYS, IDX, LEN, listed.alias("features"))


def sync_profile(jumps: Jumps, lag: int = LAG, rows: int = CHUNK_ROWS) -> DataFrame:
    """Share of rows where ``f1`` jumps and ``f2`` jumps ``lag`` rows later, per lag.

    Only lags with a common jump appear.  Each jump row looks at the jump rows within
    ``lag`` positions of it in its own chunk.
    """
    sparse = with_halo(jump_rows(jumps), back=lag, ahead=lag, rows=rows)
    near = by_chunk().rangeBetween(-lag, lag)
    seen = sparse.withColumn("_near", F.collect_list(F.struct(IDX, "features")).over(near)).filter("home")
    pairs = (
        seen.select(SERIES, LEN, IDX, F.explode("features").alias("f1"), "_near")
        .select(SERIES, LEN, "f1", IDX, F.explode("_near").alias("_o"))
        .select(SERIES, LEN, "f1", (F.col("_o")[IDX] - F.col(IDX)).alias("lag"), F.explode("_o.features").alias("f2"))
        .filter(F.col("f1") < F.col("f2"))
    )
    counted = pairs.groupBy(SERIES, LEN, "f1", "f2", "lag").agg(F.count(F.lit(1)).alias("both"))
    names = F.array(*[F.lit(c) for c in jumps.cols])
    return counted.filter(F.abs("lag") < F.col(LEN)).select(
        SERIES, F.get(names, F.col("f1")).alias("f1"), F.get(names, F.col("f2")).alias("f2"), "lag", (F.col("both") / (F.col(LEN) - F.abs("lag"))).alias("rate")
    )


def sync_matrix(jumps: Jumps, lag: int = LAG, rows: int = CHUNK_ROWS) -> DataFrame:
    """Every feature pair ``f1 < f2`` with its highest rate and the first lag reaching it."""
    cols = list(jumps.cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    best = sync_profile(jumps, lag, rows).groupBy(SERIES, "f1", "f2").agg(
        F.max(F.struct(F.col("rate"), (-F.col("lag")).alias("_l"))).alias("_b")
    )
    series = jumps.features.select(SERIES).distinct()
    if not pairs:
        return series.limit(0).select(
            SERIES, F.lit("").alias("f1"), F.lit("").alias("f2"), num(0).alias("max_sync"), F.lit(0).cast("long").alias("lag"))
    every = series.select(SERIES, F.inline(F.array(*[
        F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2")) for a, b in pairs
    ])))
    return every.join(best, [SERIES, "f1", "f2"], "left").select(
        SERIES, "f1", "f2", F.coalesce("_b.rate", num(0)).alias("max_sync"),
        F.coalesce(-F.col("_b._l"), F.lit(0)).cast("long").alias("lag"),
    )


def clusters(jumps: Jumps, least: int = CLUSTER, rows: int = CHUNK_ROWS) -> DataFrame:
    """Runs of at least ``least`` jump rows; ``end`` is exclusive."""
    size = F.col("end") - F.col("start") + 1
    return (
        runs(jumps.rows, "unified", rows, total="hits").withColumn("size", size).filter(F.col("size") >= least)
        .select(SERIES, "start", (F.col("end") + 1).alias("end"), "size",
                (F.col("hits") / F.col("size")).alias("density"), F.col("hits").alias("total_importance"))
    )


def summary(jumps: Jumps, rows: int = CHUNK_ROWS) -> DataFrame:
    """Jump rows, clusters and strongest synchronisation per series."""
    base = jumps.rows.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.count(F.when(F.col("unified"), F.lit(1))).alias("n_total_jumps")
    )
    groups = clusters(jumps, rows=rows).groupBy(SERIES).agg(F.count(F.lit(1)).alias("n_clusters"))
    sync = sync_matrix(jumps, rows=rows).groupBy(SERIES).agg(F.max("max_sync").alias("max_sync"))
    return base.join(groups, SERIES, "left").join(sync, SERIES, "left").select(
        SERIES, LEN, "n_total_jumps", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"),
        F.coalesce("max_sync", num(0)).alias("max_sync"),
    )


def batch_score(jumps: Jumps, rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with ``jump_score``: strong importance plus the strongest feature's intensity."""
    df, cols = jumps.rows, jumps.cols
    positive = df.select(*KEYS, LEN, F.when(F.col("importance") > 0, F.col("importance")).alias("v"))
    q = percentiles(positive, [SERIES], "v", {"_imp": 0.75}).drop("n_values")
    keep = [*KEYS, LEN]
    sizes = long_form(df.select(*keep, *[F.abs(f"d_{c}").alias(c) for c in cols]), cols, "feature", "v", keep)
    strong = percentiles(sizes, [SERIES, "feature"], "v", {"_s": 0.98}, carry=LEN)
    figures = strong.join(jumps.features.select(SERIES, "feature", "intensity", "asymmetry"), [SERIES, "feature"])
    wide = _wide_thresholds(figures, cols, {"_s": "p98", "intensity": "int", "asymmetry": "asym"})
    out = attach(df, wide.join(q, SERIES, "left"), rows)
    parts = []
    for c in cols:
        jump = (F.col(f"pos_{c}") | F.col(f"neg_{c}")) & (F.abs(f"d_{c}") > F.col(f"p98_{c}"))
        asym = F.abs(f"asym_{c}")
        gain = F.when(asym > 0.8, 1 + asym).otherwise(num(1))
        parts.append(F.when(jump, F.col(f"int_{c}") * gain).otherwise(num(0)))
    kept = F.col("unified") & (F.col("importance") >= F.coalesce("_imp", num(0.5)))
    own = F.when(kept, F.col("importance")).otherwise(num(0))
    best = F.greatest(num(0), *parts)
    return out.withColumn("jump_score", own + 0.5 * best).drop(
        "_imp", *[f"{p}_{c}" for c in cols for p in ("p98", "int", "asym")]
    )


def consistency(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Sum over paths of -importance*|step| on jump rows and 0.1*|step| elsewhere."""
    wide = with_halo(df, back=1, rows=rows)
    steps = home(wide.select("*", *[F.abs(difference(p)).alias(f"_d_{p}") for p in paths]))
    step = total([F.col(f"_d_{p}") for p in paths])
    term = F.when(F.col("unified"), -F.col("importance") * step).otherwise(0.1 * step)
    return steps.groupBy(SERIES).agg(F.sum(term).alias("consistency"))


def rescore(df: DataFrame, jumps_clusters: DataFrame, score: str = "score", rows: int = CHUNK_ROWS) -> DataFrame:
    """Strengthen or damp the score on jump rows by importance, agreement and cluster."""
    from tidewatch.operators.masks import mark_ranges

    ranges = jumps_clusters.select(SERIES, "start", (F.col("end") - 1).alias("end"))
    out = mark_ranges(df, ranges, "_clustered", rows)
    share = F.col("importance")
    agreement = F.when(share > 0.8, F.sqrt(share)).otherwise(share * share)
    factor = (1 + share) * agreement * F.when(F.col("_clustered"), num(1.2)).otherwise(num(1))
    return out.withColumn(score, F.when(F.col("unified"), F.col(score) * factor).otherwise(F.col(score))).drop("_clustered")


def sync_score(jumps: Jumps, above: float = 0.7, rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with ``sync_score``: mean synchronisation of each jumping, well-coupled feature."""
    m, cols = sync_matrix(jumps, rows=rows), jumps.cols
    both = m.select(SERIES, F.col("f1").alias("feature"), "max_sync").unionByName(
        m.select(SERIES, F.col("f2").alias("feature"), "max_sync"))
    mean = both.groupBy(SERIES, "feature").agg(F.avg("max_sync").alias("sync"))
    lengths = jumps.features.select(SERIES, LEN).distinct()
    wide = _wide_thresholds(mean.join(lengths, SERIES), cols, {"sync": "sync"})
    out = attach(jumps.rows, wide, rows)
    terms = [
        F.when((F.col(f"sync_{c}") > above) & (F.col(f"pos_{c}") | F.col(f"neg_{c}")), F.col(f"sync_{c}")).otherwise(num(0))
        for c in cols
    ]
    return out.withColumn("sync_score", total(terms) / num(len(cols)))
