"""Weighted combination of component scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidewatch.functions.grouped import EMIT, matrix, per_group
from tidewatch.functions.numeric import num, total
from tidewatch.functions.order import areas
from tidewatch.functions.quantile import percentiles
from tidewatch.operators.evaluate import auc
from tidewatch.operators.jumps import percentile
from tidewatch.operators.layout import CHUNK, IDX, KEYS, LEN, SERIES, attach
from tidewatch.operators.scale import calibration_score_z, safe_z, series_stats, symmetric, zscore_safe
from tidewatch.session import stage

#: Labelled rows of a series that one task ranks; longer series are ranked by one sort for all.
IN_TASK = 1 << 16
# fixed values: default weights of the batch components
DEFAULT_WEIGHTS = {"jump": 0.20, "hybrid": 0.35, "kernel": 0.30, "structural": 0.15}


def renormalise(weights: Mapping[str, float], names: Sequence[str]) -> dict[str, float]:
    """Weights of a subset, scaled to sum 1."""
    kept = {n: weights[n] for n in names if n in weights}
    scale = sum(kept.values())
    if scale <= 0:
        raise ValueError("the chosen components have no weight")
    return {k: v / scale for k, v in kept.items()}


def integrate(df: DataFrame, weights: Mapping[str, float], name: str = "score") -> DataFrame:
    """Weighted sum of z-scored components.

    Every weight counts in the denominator; components without a weight are ignored and a
    flat component is used as it is.
    """
    used = [c for c in weights if c in df.columns]
    scale = sum(weights.values())
    out = attach(df, series_stats(df, used))
    terms = []
    for c in used:
        z = F.when(F.col(f"{c}_sd") > 1e-10, (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd")).otherwise(F.col(c))
        terms.append(num(weights[c] / scale) * z)
    return out.withColumn(name, total(terms)).drop(*[f"{c}_{s}" for c in used for s in ("mu", "sd")])


def combine(df: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS, symmetric_parts: Sequence[str] = (),
            frames: int | None = None, name: str = "score") -> DataFrame:
    """``integrate`` after making chosen components symmetric about their calibration."""
    if symmetric_parts:
        if frames is None:
            raise ValueError("symmetric components need calibration frames")
        df = symmetric(df, symmetric_parts, frames)
    return integrate(df, weights, name)


def ensemble_max(df: DataFrame, a: str, b: str, name: str = "score") -> DataFrame:
    """Larger of two scores after calibration-window z-scoring."""
    return calibration_score_z(df, [a, b]).withColumn(name, F.greatest(a, b))


def dual_track(df: DataFrame) -> DataFrame:
    """Acute (jump, hybrid) and chronic (structural, kernel, drift) tracks, larger z wins."""
    parts = ["jump", "hybrid", "structural", "kernel", "drift"]
    z = attach(df, series_stats(df, parts))
    z = z.withColumn("acute", 0.4 * safe_z("jump") + 0.6 * safe_z("hybrid")).withColumn(
        "chronic", (safe_z("structural") + safe_z("kernel") + safe_z("drift")) / 3)
    z = z.drop(*[f"{c}_{s}" for c in parts for s in ("mu", "sd")])
    final = zscore_safe(z, ["acute", "chronic"])
    return final.withColumn("score", F.greatest("acute", "chronic"))


def clear_rows(df: DataFrame, score: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Rows below the low or above the high percentile, labelled 0 or 1.

    Series with five or fewer rows on a side give none.
    """
    q = percentiles(df, [SERIES], score, {"_lo": low, "_hi": high}, carry=LEN).drop("n_values")
    marked = attach(df, q).withColumn(
        "label", F.when(F.col(score) > F.col("_hi"), 1).when(F.col(score) < F.col("_lo"), 0))
    sizes = marked.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.count(F.when(F.col("label") == 1, 1)).alias("_c1"), F.count(F.when(F.col("label") == 0, 1)).alias("_c0"))
    ok = attach(marked.filter("label is not null"), sizes)
    return ok.filter("_c1 > 5 and _c0 > 5").drop("_lo", "_hi", "_c0", "_c1")


def weight_lattice(names: Sequence[str], least: float = 0.05, step: float = 0.1) -> list[dict[str, float]]:
    """Weight vectors with every weight at least ``least`` that sum to 1, in steps."""
    units = round((1 - least * len(names)) / step)

    def split(left, parts):
        if parts == 1:
            yield (left,)
            return
        for x in range(left + 1):
            for rest in split(left - x, parts - 1):
                yield (x, *rest)

    return [{n: least + step * u for n, u in zip(names, combo)} for combo in split(units, len(names))]


def search_weights(df: DataFrame, names: Sequence[str], label: str = "label", least: float = 0.05, step: float = 0.1) -> DataFrame:
    """Best weights per series on labelled rows by class-balanced AUC over a weight lattice.

    Rows of the rarer class weigh more (power 1.5 of the class ratio, within [0.1, 10]).
    A series of up to ``IN_TASK`` labelled rows tries all lattice points within a task, so no row is copied; the
    rows of longer ones are ranked in one job for all points.  Both ways are always planned and give the same
    weights; ties go to the most even ones.
    """
    counts = df.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    z = attach(df, counts.join(series_stats(df, names).drop(LEN), SERIES))
    own = F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    z = z.withColumn("_w", F.greatest(num(0.1), F.least(num(10), F.pow(F.col("_n") / (2 * own), num(1.5)))))
    parts = {n: F.when(F.col(f"{n}_sd") > 1e-10, (F.col(n) - F.col(f"{n}_mu")) / F.col(f"{n}_sd")).otherwise(F.col(n)) for n in names}
    z = z.select(SERIES, "_n", label, "_w", *[v.alias(n) for n, v in parts.items()])
    lattice = weight_lattice(names, least, step)
    return _search_in_task(z.filter(F.col("_n") <= IN_TASK), names, label, lattice).unionByName(
        _search_in_one_sort(z.filter(F.col("_n") > IN_TASK), names, label, lattice))


def _evenness(w: Mapping[str, float]) -> float:
    return -sum(v * v for v in w.values())


def _search_in_one_sort(z: DataFrame, names: Sequence[str], label: str, lattice: Sequence[Mapping[str, float]]) -> DataFrame:
    points = F.array(*[F.struct(*[num(w[n]).alias(f"w_{n}") for n in names], num(_evenness(w)).alias("_even")) for w in lattice])
    score = total([F.col(f"w_{n}") * F.col(n) for n in names])
    ws = [f"w_{n}" for n in names]
    long = z.select("*", F.inline(points)).select(SERIES, label, "_w", "_even", *ws, F.round(score, 9).alias("_score"))
    ranked = auc(long, [SERIES, "_even", *ws], "_score", label, weight="_w")
    best = ranked.groupBy(SERIES).agg(F.max(F.struct(F.round("auc", 9).alias("auc"), F.round("_even", 9).alias("_even"), *ws)).alias("_b"))
    return best.select(SERIES, *[F.col(f"_b.{w}").alias(w) for w in ws], F.col("_b.auc").alias("auc"))


def _search_in_task(z: DataFrame, names: Sequence[str], label: str, lattice: Sequence[Mapping[str, float]]) -> DataFrame:
    names, ws = list(names), [f"w_{n}" for n in names]
    weights = np.array([[w[n] for n in names] for w in lattice])
    even = np.round([_evenness(w) for w in lattice], 9)

    def solve(group: pa.Table) -> pa.Table:
        x = matrix(group, names)
        hit, weight = matrix(group, [label])[:, 0] == 1, matrix(group, ["_w"])[:, 0]
        found = []
        block = max(1, (1 << 19) // len(x))
        for lo in range(0, len(weights), block):
            score = sum(x[:, j, None] * weights[None, lo: lo + block, j] for j in range(len(names)))
            found.append(areas(np.where(np.isnan(score), -np.inf, np.rint(score * 1e9)), hit, weight))  # null is first
        area = np.round(np.concatenate(found), 9)
        # the largest (area, evenness, weights); a missing area comes last
        best = np.lexsort([*weights.T[::-1], even, np.where(np.isnan(area), -1.0, area)])[-1]
        return pa.table({SERIES: group.column(SERIES).slice(0, 1), **{w: [float(v)] for w, v in zip(ws, weights[best])},
                         "auc": pa.array([area[best]], pa.float64(), from_pandas=True)})

    kind = z.schema[SERIES].dataType.simpleString()
    return per_group(z, [SERIES], [], solve, f"{SERIES} {kind}, " + ", ".join(f"{w} double" for w in ws) + ", auc double")


def adaptive(df: DataFrame, weights: Mapping[str, float] | None = None, least: float = 0.05, step: float = 0.1) -> DataFrame:
    """Add ``score`` with weights that each series learns from its own clear rows, and those weights ``w_<name>``.

    Clear rows are the ends of the score under the given weights, which also stay where there are too few of them.
    """
    weights = dict(weights or DEFAULT_WEIGHTS)
    names = list(weights)
    start = F.round(total([num(w) * F.col(n) for n, w in weights.items()]), 9)
    clear = stage(clear_rows(df.withColumn("_start", start), "_start").drop("_start"), "clear-rows")
    found = search_weights(clear, names, least=least, step=step).drop("auc")
    lengths = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN))
    learned = lengths.join(found, SERIES, "left").select(SERIES, LEN, *[F.coalesce(f"w_{n}", num(weights[n])).alias(f"w_{n}") for n in names])
    out = attach(df, learned)
    return out.withColumn("score", total([F.col(f"w_{n}") * F.col(n) for n in names]))


def weak_anomalies(
    df: DataFrame, cols: Sequence[str], score: str, low: float = 0.1, high: float = 0.9,
) -> DataFrame:
    """Clear rows plus the stronger of the weak anomalies between them, with ``label``.

    A middle row is weakly anomalous when many features are far from their median, when it
    no longer correlates with a neighbour, when its surroundings have one strong frequency,
    or when it is a weak jump.  Those in the top 30 % by score count as anomalies.  Series of up to ``IN_TASK`` rows
    are marked within a task, after one shuffle; longer ones take a job per step.  Both ways take the same steps.
    """
    keep = [*KEYS, IDX, LEN, *cols, score, *[c for c in ("importance",) if c in df.columns]]
    df = stage(df.select(*dict.fromkeys(keep)), "weak-input")
    short = _weak_in_task(df.filter(F.col(LEN) <= IN_TASK), cols, score, low, high)
    long = df.filter(F.col(LEN) > IN_TASK)
    return short if long.isEmpty() else short.unionByName(_weak_by_jobs(long, cols, score, low, high))


def spectra_around(x: np.ndarray, half: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the mean magnitude of the spectrum of the rows up to ``half`` away, and the largest of the low frequencies."""
    n, size = len(x), 2 * half + 1
    mean, peak = np.empty(n), np.empty(n)

    def fill(at, view: np.ndarray) -> None:  # rows x features x positions
        m = view.shape[2]
        turn = lambda ks: np.exp(-2j * np.pi * np.outer(np.arange(m), ks) / m)
        mean[at] = np.abs(view @ turn(np.arange(m))).sum((1, 2)) / (m * x.shape[1])
        peak[at] = np.abs(view @ turn(np.arange(1, max(1, m // 2 - 1) + 1))).max((1, 2))

    inner = range(half, n - half)
    if len(inner):
        view = np.lib.stride_tricks.sliding_window_view(x, size, axis=0)
        for lo in range(0, len(view), EMIT):
            fill(slice(half + lo, half + min(lo + EMIT, len(view))), view[lo:lo + EMIT])
    for i in (i for i in range(n) if i not in inner):
        fill(slice(i, i + 1), x[max(0, i - half): i + half + 1].T[None])
    return mean, peak


def series_weak(x: np.ndarray, score: np.ndarray, importance: np.ndarray | None, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``weak_anomalies`` of one whole series: the weak rows, those where that is null, and the label, -1 for none; NaN is null."""
    n, d = x.shape
    at = np.arange(n)
    there = lambda v: v[~np.isnan(v)]
    middle_of = np.array([percentile(there(v), 0.5) if len(there(v)) else np.nan for v in x.T])
    spread = np.array([there(v).std() if len(there(v)) else np.nan for v in x.T])
    known = there(score)
    lo, hi = (percentile(known, p) if len(known) else np.nan for p in (low, high))
    distance = np.abs(x - middle_of) / (spread + 1e-10)
    far, no_far = (distance > 3).sum(1) >= 0.3 * d, np.isnan(distance).any(1)
    off = x - x.mean(1, keepdims=True)
    size = (off * off).sum(1)
    norm = np.sqrt(size[1:] * size[:-1])
    alike = np.append(np.nan, np.where(norm > 0, (off[1:] * off[:-1]).sum(1) / np.where(norm > 0, norm, 1.0), np.nan))
    apart = (at > 1) & (at < n - 1) & ((alike < 0.3) | (np.append(alike[1:], np.nan) < 0.3))
    mean, peak = spectra_around(x)
    hum, no_hum = peak > 5 * mean, np.isnan(mean)
    jump, no_jump = (np.zeros(n, bool),) * 2 if importance is None else ((importance > 0.2) & (importance < 0.4), np.isnan(importance))
    hit = (far & ~no_far) | apart | hum | jump
    unsure = ~hit & (no_far | no_hum | no_jump)
    middle = (score >= lo) & (score <= hi)
    weak, null = middle & hit, np.where(np.isnan(score), hit | unsure, middle & unsure)
    cut = percentile(score[weak], 0.7) if weak.any() else np.nan
    strong = (score > hi) | (weak & (score >= cut))
    return weak, null, np.where(strong, 1, np.where(score < lo, 0, -1)).astype(np.int32)


def _weak_in_task(df: DataFrame, cols: Sequence[str], score: str, low: float, high: float) -> DataFrame:
    kept = [SERIES, CHUNK, IDX, LEN, score]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("weak", T.BooleanType()), T.StructField("label", T.IntegerType())])

    def solve(group: pa.Table) -> pa.Table:
        jump = matrix(group, ["importance"])[:, 0] if "importance" in group.column_names else None
        with np.errstate(all="ignore"):
            weak, null, label = series_weak(matrix(group, cols), matrix(group, [score])[:, 0], jump, low, high)
        out = group.select(kept).append_column("weak", pa.array(weak, mask=null)).append_column("label", pa.array(label))
        return out.filter(pa.array(label >= 0))

    return per_group(df, [SERIES], [IDX], solve, schema)


def _weak_by_jobs(df: DataFrame, cols: Sequence[str], score: str, low: float, high: float) -> DataFrame:
    from tidewatch.operators.layout import by_chunk, frame, home, long_form, with_halo

    d = len(cols)
    long = long_form(df, cols, "feature", "_v", [*KEYS, LEN])
    med = percentiles(long, [SERIES, "feature"], "_v", {"_m": 0.5}, carry=LEN)
    meds = med.groupBy(SERIES, LEN).agg(*[F.max(F.when(F.col("feature") == c, F.col("_m"))).alias(f"_m_{c}") for c in cols])
    q = percentiles(df, [SERIES], score, {"_lo": low, "_hi": high}).drop("n_values")
    base = attach(df, meds.join(q, SERIES).join(series_stats(df, cols).drop(LEN), SERIES))
    wide = with_halo(base, back=5, ahead=5)
    w = by_chunk()

    def row_corr(other):
        a, b = F.array(*cols), other
        ma, mb = (F.aggregate(x, num(0), lambda s, v: s + v) / d for x in (a, b))
        da, db = F.transform(a, lambda v: v - ma), F.transform(b, lambda v: v - mb)
        dot_ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), num(0), lambda s, v: s + v)
        return F.try_divide(dot_(da, db), F.sqrt(dot_(da, da) * dot_(db, db)))  # null for a row of equal values

    wide = wide.withColumn("_prev", F.lag(F.array(*cols)).over(w)).withColumn("_next", F.lead(F.array(*cols)).over(w))
    wide = wide.withColumn("_near", F.collect_list(F.array(*cols)).over(frame(-5, 5)))
    rows = home(wide)
    far = total([(F.abs(F.col(c) - F.col(f"_m_{c}")) / (F.col(f"{c}_sd") + num(1e-10)) > 3).cast("int") for c in cols])
    apart = (F.col(IDX) > 1) & (F.col(IDX) < F.col(LEN) - 1) & ((row_corr(F.col("_prev")) < 0.3) | (row_corr(F.col("_next")) < 0.3))
    m = F.size("_near")

    def magnitude(k, j):
        angle = lambda i: 2 * 3.141592653589793 * k * i / m
        re = F.aggregate(F.transform("_near", lambda r, i: r[j] * F.cos(angle(i))), num(0), lambda s, v: s + v)
        im = F.aggregate(F.transform("_near", lambda r, i: r[j] * F.sin(angle(i))), num(0), lambda s, v: s + v)
        return F.sqrt(re * re + im * im)

    def bins(first, last):
        def of(j):
            return F.transform(F.sequence(first, last), lambda k: magnitude(k, j))
        return F.flatten(F.array(*[of(j) for j in range(d)]))

    spectra = bins(F.lit(0), m - 1)
    mean = F.aggregate(spectra, num(0), lambda s, v: s + v) / (m * d)
    peak = F.array_max(bins(F.lit(1), F.greatest(F.lit(1), F.floor(m / 2).cast("int") - 1)))
    hum = peak > 5 * mean
    weak_jump = (F.col("importance") > 0.2) & (F.col("importance") < 0.4) if "importance" in df.columns else F.lit(False)
    middle = (F.col(score) >= F.col("_lo")) & (F.col(score) <= F.col("_hi"))
    tagged = rows.withColumn("weak", middle & ((far >= 0.3 * d) | F.coalesce(apart, F.lit(False)) | hum | weak_jump))
    # the marks are dear and read three times
    tagged = stage(tagged.select(SERIES, CHUNK, IDX, LEN, score, "_lo", "_hi", "weak"), "weak-rows")
    cut = percentiles(tagged.withColumn("_ws", F.when(F.col("weak"), F.col(score))), [SERIES], "_ws", {"_cut": 0.7}, carry=LEN)
    out = attach(tagged, cut.drop("n_values"))
    strong = (F.col(score) > F.col("_hi")) | (F.col("weak") & (F.col(score) >= F.col("_cut")))
    label = F.when(strong, 1).when(F.col(score) < F.col("_lo"), 0)
    return out.select(SERIES, CHUNK, IDX, LEN, score, "weak", label.alias("label")).filter("label is not null")
