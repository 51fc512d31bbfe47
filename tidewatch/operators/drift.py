"""Drift and slow trends over whole series."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidewatch.functions.numeric import num, total
from tidewatch.functions.quantile import percentiles
from tidewatch.operators.layout import (
    CHUNK, CHUNK_ROWS, IDX, KEYS, LEN, SERIES, attach, chunk_of, frame, home, long_form, running, with_halo,
)
from tidewatch.session import stage

REF_WINDOW = 50
SLACK = 1.0
DECAY = 0.95
MODES = ("rolling", "static")
TREND_WINDOWS = (500, 1000, 2000)
REFERENCE_ROWS = 1000
SMOOTH_SIGMA = 100.0
#: Largest logarithm of decay^-m within a chunk.
LARGEST_SCALE = 300.0


def rolling_cusum(
    df: DataFrame, cols: Sequence[str], ref_window: int = REF_WINDOW, k: float = SLACK,
    decay: float = DECAY, rows: int = CHUNK_ROWS, carried: Sequence[str] = (),
) -> DataFrame:
    """Add ``drift``: mean over features of the decayed CUSUM of rolling |z|.

    The first ``m`` steps of a chunk turn a state s into max(a, decay^m s + c), where a is the CUSUM that starts
    from 0 and c the decayed sum; both are running sums and minima of values scaled by decay^-m.  The last such
    pair of each chunk is its summary; composed along the series, they give the state at the start of every
    chunk.  A halo of ``ref_window`` rows is all that a chunk sees of the one before, whatever the decay.
    Chunks are cut short enough for decay^-m to stay far from overflow.

    ``carried`` names a column per feature that holds the state after rows that are already done: the state
    goes on from the last of these, and the columns are filled for all rows.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie strictly between 0 and 1")
    span = min(rows, max(1, int(LARGEST_SCALE / -log(decay))))
    w, so_far = frame(-ref_window, -1), frame(Window.unboundedPreceding, 0)
    wide = with_halo(df, back=ref_window, rows=span)
    z = {c: F.when(F.count(c).over(w) >= ref_window, F.abs(F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + num(1e-8))) for c in cols}
    own = home(wide.select("*", *[v.alias(f"_z_{c}") for c, v in z.items()]))
    fresh = F.col(carried[0]).isNull() if carried else F.lit(True)
    own = own.withColumn("_known", F.col(f"_z_{cols[0]}").isNotNull() & fresh)
    own = own.withColumn("_m", F.sum(F.col("_known").cast("int")).over(so_far))
    scaled = {c: F.when(F.col("_known"), (F.col(f"_z_{c}") - num(k)) * F.pow(num(decay), -F.col("_m"))) for c in cols}
    own = own.select("*", *[F.coalesce(F.sum(v).over(so_far), num(0)).alias(f"_p_{c}") for c, v in scaled.items()])
    lows = {c: F.coalesce(F.min(F.when(F.col("_known"), F.col(f"_p_{c}"))).over(so_far), F.col(f"_p_{c}")) for c in cols}
    own = own.withColumn("_b", F.pow(num(decay), F.col("_m")))
    own = own.select("*", *[x for c in cols for x in (
        ((F.col(f"_p_{c}") - lows[c]) * F.col("_b")).alias(f"_a_{c}"), (F.col(f"_p_{c}") * F.col("_b")).alias(f"_c_{c}"))])
    steps = ["_b", *[f"_{x}_{c}" for c in cols for x in "ac"]]
    ends = own.groupBy(*KEYS).agg(F.max_by(F.struct(*steps), IDX).alias("_e")).select(*KEYS, "_e.*")
    states = [f"_s_{c}" for c in cols]
    if carried:
        last = df.filter(~fresh).groupBy(SERIES).agg(F.max_by(F.struct(*[F.col(x).alias(f"_0_{c}") for x, c in zip(carried, cols)]), IDX).alias("_l"))
        ends = ends.join(last.select(SERIES, "_l.*"), SERIES, "left").fillna(0.0, [f"_0_{c}" for c in cols])
    else:
        ends = ends.select("*", *[num(0).alias(f"_0_{c}") for c in cols])
    start = T.StructType([df.schema[SERIES], T.StructField(CHUNK, T.LongType())] + [T.StructField(s, T.DoubleType()) for s in states])

    def compose(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        b, a, c = pdf["_b"].to_numpy(), pdf[[f"_a_{x}" for x in cols]].to_numpy(), pdf[[f"_c_{x}" for x in cols]].to_numpy()
        at = np.tile(pdf[[f"_0_{x}" for x in cols]].to_numpy()[:1], (len(a), 1))
        for i in range(1, len(at)):  # one step per chunk
            at[i] = np.maximum(a[i - 1], b[i - 1] * at[i - 1] + c[i - 1])
        out = pdf[[SERIES, CHUNK]].copy()
        out[states] = at
        return out

    starts = ends.groupBy(SERIES).applyInPandas(compose, start)
    now = [F.greatest(F.col(f"_a_{c}"), F.col("_b") * F.col(f"_s_{c}") + F.col(f"_c_{c}")) for c in cols]
    drift = F.when(F.col("_known"), total(now) / num(len(cols))).otherwise(num(0))
    after = {x: F.when(fresh, v).otherwise(F.col(x)).alias(x) for x, v in zip(carried, now)}
    kept = [chunk_of(rows=rows).alias(CHUNK) if x == CHUNK else after.get(x, F.col(x)) for x in df.columns]
    return own.join(starts, KEYS).select(*kept, drift.alias("drift"))


def static_cusum(
    df: DataFrame, cols: Sequence[str], k_factor: float = 0.5, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``drift``: two-sided CUSUM of value and of absolute deviation, feature mean.

    An undecayed CUSUM is the running sum minus its running minimum (at most 0).
    """
    keep = list(df.columns)

    def with_median(frame_, prefix, name):
        names = [f"{prefix}{c}" for c in cols]
        long = long_form(frame_, names, "feature", "v", [*KEYS, LEN])
        q = percentiles(long, [SERIES, "feature"], "v", {"q": 0.5}, carry=LEN)
        wide = q.groupBy(SERIES, LEN).agg(*[
            F.max(F.when(F.col("feature") == f"{prefix}{c}", F.col("q"))).alias(f"{name}{c}") for c in cols
        ])
        return attach(frame_, wide, rows)

    out = with_median(df, "", "_mu_")
    for c in cols:
        out = out.withColumn(f"_a_{c}", F.abs(F.col(c) - F.col(f"_mu_{c}")))
    # the centre of the deviation is the MAD of the value; its own MAD takes one more pass
    out = with_median(stage(out, "cusum-deviation"), "_a_", "_mad_")
    for c in cols:
        out = out.withColumn(f"_b_{c}", F.abs(F.col(f"_a_{c}") - F.col(f"_mad_{c}")))
    out = with_median(stage(out, "cusum-spread"), "_b_", "_mb_")
    values = {}
    for c in cols:
        k = k_factor * 1.4826 * (F.col(f"_mad_{c}") + num(1e-8))
        ks = k_factor * 1.4826 * (F.col(f"_mb_{c}") + num(1e-8))
        dev, spread = F.col(c) - F.col(f"_mu_{c}"), F.col(f"_a_{c}") - F.col(f"_mad_{c}")
        for i, v in enumerate((dev - k, -dev - k, spread - ks, -spread - ks)):
            values[f"_s{i}_{c}"] = v
    sums = running(out, values)
    lows = running(sums, {f"_low{s}": F.least(num(0), F.col(s)) for s in values}, F.min)
    up = {s: F.col(s) - F.col(f"_low{s}") for s in values}
    parts = [F.greatest(up[f"_s0_{c}"], up[f"_s1_{c}"]) + F.greatest(up[f"_s2_{c}"], up[f"_s3_{c}"]) for c in cols]
    return lows.withColumn("drift", total(parts) / num(len(cols))).select(*keep, "drift")


def drift(df: DataFrame, cols: Sequence[str], mode: str = "rolling", **options) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown drift mode {mode!r}, expected one of {MODES}")
    return rolling_cusum(df, cols, **options) if mode == "rolling" else static_cusum(df, cols, **options)


def gaussian_taps(sigma: float) -> np.ndarray:
    """Normalised Gaussian weights cut at four deviations."""
    radius = int(4.0 * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2)
    return g / g.sum()


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with mirrored ends, by FFT."""
    taps = gaussian_taps(sigma)
    radius = len(taps) // 2
    padded = np.pad(x, radius, mode="symmetric")
    size = 1 << int(np.ceil(np.log2(len(padded) + len(taps))))
    full = np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(taps, size), size)
    return full[2 * radius: 2 * radius + len(x)]


def sustained_trend(df: DataFrame, sig: str = "sig", windows: Sequence[int] = TREND_WINDOWS, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``trend_<w>`` for windows shorter than the series: smoothed |gradient of the smoothed signal|.

    The smoothers reach four deviations to each side, which is the halo; mirrored ends
    apply at the two ends of a series and the halo covers the other chunk edges.
    """
    reach = max(int(4 * w / 3.0 + 0.5) + int(4 * w / 6.0 + 0.5) + 2 for w in windows)
    wide = with_halo(df, back=reach, ahead=reach, rows=rows)
    schema = T.StructType(
        [f for f in wide.schema.fields if f.name != "home"]
        + [T.StructField(f"trend_{w}", T.DoubleType()) for w in windows]
    )

    def scale(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        x, n = pdf[sig].to_numpy(dtype=float), int(pdf[LEN].iloc[0])
        level = x.mean()
        for w in windows:
            if w >= n or len(x) < 2:
                pdf[f"trend_{w}"] = np.nan
                continue
            slope = np.gradient(smooth(x - level, w / 3.0))
            pdf[f"trend_{w}"] = smooth(np.abs(slope), w / 6.0)
        return pdf[pdf["home"]].drop(columns="home")

    return wide.groupBy(*KEYS).applyInPandas(scale, schema)


def gradual_transition(df: DataFrame, sig: str = "sig", windows: Sequence[int] = TREND_WINDOWS, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``gradual``: mean z-score of the sustained trend over the usable scales."""
    t = sustained_trend(df, sig, windows, rows)
    aggs = [F.max(LEN).alias(LEN)]
    for w in windows:
        aggs += [F.avg(f"trend_{w}").alias(f"_m{w}"), F.stddev_pop(f"trend_{w}").alias(f"_s{w}")]
    out = attach(t, t.groupBy(SERIES).agg(*aggs), rows)
    usable = [F.coalesce(F.col(f"_s{w}") > 1e-10, F.lit(False)) for w in windows]
    zs = [F.when(u, (F.col(f"trend_{w}") - F.col(f"_m{w}")) / F.col(f"_s{w}")).otherwise(num(0)) for u, w in zip(usable, windows)]
    count = total([u.cast("double") for u in usable])
    return out.withColumn("gradual", F.when(count > 0, total(zs) / count).otherwise(num(0))).drop(
        *[f"{p}{w}" for w in windows for p in ("_m", "_s", "trend_")]
    )


def structural_drift(
    df: DataFrame, sig: str = "sig", reference: int = REFERENCE_ROWS, sigma: float = SMOOTH_SIGMA, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``state_drift``: smoothed relative distance of the centred mean from the start's mean."""
    quarter = F.greatest(F.lit(10), F.floor(F.col(LEN) / 4))
    ref_rows = F.greatest(F.lit(10), F.least(F.lit(reference), quarter))
    ref = df.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.avg(F.when(F.col(IDX) < ref_rows, F.col(sig))).alias("_ref")
    )
    marked = attach(df, ref, rows).withColumn("_half", F.greatest(F.lit(1), F.floor(ref_rows / 2)).cast("int"))
    radius = int(4 * sigma + 0.5) if sigma > 0 else 0
    reach = max(1, reference // 2) + radius + 1
    wide = with_halo(marked, back=reach, ahead=reach, rows=rows)
    schema = T.StructType(
        [f for f in wide.schema.fields if f.name not in ("home", "_ref", "_half")]
        + [T.StructField("state_drift", T.DoubleType())]
    )

    def distance(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX)
        x, n = pdf[sig].to_numpy(dtype=float), int(pdf[LEN].iloc[0])
        half, base = int(pdf["_half"].iloc[0]), float(pdf["_ref"].iloc[0])
        at = np.arange(len(x))
        start, end = np.maximum(0, at - half), np.minimum(len(x), at + half)
        sums = np.concatenate([[0.0], np.cumsum(x - base)])
        away = np.abs((sums[end] - sums[start]) / np.maximum(end - start, 1)) / (abs(base) + 1e-10)
        if sigma > 0 and sigma * 3 < n:
            away = smooth(away, sigma)
        pdf["state_drift"] = away if n >= 20 else 0.0
        return pdf[pdf["home"]].drop(columns=["home", "_ref", "_half"])

    return wide.groupBy(*KEYS).applyInPandas(distance, schema)
