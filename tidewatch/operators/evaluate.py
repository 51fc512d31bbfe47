"""Evaluation of scores against labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.numeric import correlation, num, total
from tidewatch.functions.order import area, areas, below
from tidewatch.functions.quantile import percentiles
from tidewatch.operators.layout import CHUNK, CHUNK_ROWS, IDX, KEYS, LEN, SERIES, attach, chunk_of, frame, long_form, running
from tidewatch.session import stage

#: Rows of a series that one task ranks by all weightings; longer ones are ranked in one job.
IN_TASK = 1 << 16

# fixed values: cost profiles of the published benchmark (true positive, false positive, false negative)
PROFILES = {
    "standard": (1.0, 0.11, 1.0),
    "reward_low_FP_rate": (1.0, 0.22, 1.0),
    "reward_low_FN_rate": (1.0, 0.11, 2.0),
}
# fixed values: files per benchmark category
CATEGORY_FILES = {
    "realKnownCause": 7, "realAWSCloudwatch": 16, "realTraffic": 7,
    "artificialWithAnomaly": 6, "realAdExchange": 6, "realTweets": 10,
}


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """Exact ROC area per key; ties count half; null when only one class is present."""
    w = num(1) if weight is None else F.col(weight)
    hit = F.col(label) == 1
    parts = area(df, keys, score, F.when(hit, w).otherwise(num(0)), F.when(hit, num(0)).otherwise(w))
    return parts.select(*keys, F.when((F.col("hits") > 0) & (F.col("misses") > 0), F.col("area") / (F.col("hits") * F.col("misses"))).alias("auc"))


def top_rows(df: DataFrame, score: str, k: int = 10) -> DataFrame:
    """The ``k`` best rows of a series: best of each chunk first, then of those."""
    order = [F.col(score).desc(), F.col(IDX)]
    local = df.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))).filter(F.col("_r") <= k)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy(SERIES).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def top_precision(df: DataFrame, score: str, label: str, k: int = 10) -> DataFrame:
    return top_rows(df, score, k).groupBy(SERIES).agg(F.avg(F.col(label).cast("double")).alias("precision"))


def change_point(
    df: DataFrame, truth: DataFrame, score: str, method: str = "percentile", prob: float = 0.99, k: float = 3.0,
) -> DataFrame:
    """Detection metrics per series.

    ``truth`` has ``true_start``, ``true_end`` (exclusive) and ``n_pre`` per series.  Half
    of the normal rows before the change, at least 10, calibrate the threshold.
    """
    if method not in ("percentile", "mean_plus_sigma"):
        raise ValueError(f"unknown threshold method {method!r}")
    cal = F.least(F.greatest(F.lit(10), F.floor(F.col("n_pre") / 2)), F.col("true_start") - 1)
    lengths = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN))
    checked = F.when(cal < 5, F.raise_error(F.lit("fewer than 5 calibration rows")).cast("long")).otherwise(cal)
    plan = truth.join(lengths, SERIES).withColumn("cal", checked.cast("long"))
    rows = attach(df, plan)
    v = F.when(F.col(IDX) < F.col("cal"), F.col(score))
    stats = rows.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.avg(v).alias("cal_mean"), (F.stddev_pop(v) + num(1e-12)).alias("cal_std"))
    if method == "percentile":
        q = percentiles(rows.withColumn("_v", v), [SERIES], "_v", {"threshold": prob}).drop("n_values")
        stats = stats.join(q, SERIES)
    else:
        stats = stats.withColumn("threshold", F.col("cal_mean") + k * F.col("cal_std"))
    out = attach(rows, stats)
    start, end, at = F.col("true_start"), F.col("true_end"), F.col(IDX)
    above = F.col(score) > F.col("threshold")
    pre, post, inside = (at >= F.col("cal")) & (at < start), at >= end, (at >= start) & (at < end)

    def count(c):
        return F.count(F.when(c, F.lit(1)))

    label = F.when(inside, F.lit(1)).otherwise(F.lit(0))
    area = auc(rows.withColumn("_label", label), [SERIES], score, "_label")
    agg = out.groupBy(SERIES).agg(
        F.max("threshold").alias("threshold"), F.max("cal_mean").alias("cal_mean"), F.max("cal_std").alias("cal_std"),
        F.max("true_start").alias("_start"),
        F.min(F.when(above & (at >= F.col("cal")), at)).alias("first_detection"),
        count(pre & above).alias("false_alarms_pre"), count(post & above).alias("false_alarms_post"),
        (count(pre & above) / F.greatest(count(pre), F.lit(1))).alias("rate_pre"),
        (count(post & above) / F.greatest(count(post), F.lit(1))).alias("rate_post"),
        F.avg(F.when(inside, above.cast("double"))).alias("recall"), F.max(inside & above).alias("detected"),
    )
    first = F.col("first_detection")
    return agg.withColumn("ttd", F.greatest(first - F.col("_start"), F.lit(0))).withColumn(
        "overshoot", F.greatest(F.col("_start") - first, F.lit(0))).drop("_start").join(area, SERIES)


def labelled_calibration(lengths: DataFrame, positions: DataFrame) -> DataFrame:
    """Calibration length and truth from the first label window of each series."""
    first = positions.groupBy(SERIES).agg(F.min(F.struct("start", "end")).alias("_w"))
    cal = F.greatest(F.lit(50), F.floor(F.col(LEN) * 0.15))
    capped = F.greatest(F.lit(5), F.least(cal, F.col("_w.start") - 1)).cast("long")
    return lengths.join(first, SERIES).select(
        SERIES, LEN, capped.alias("calibration_rows"), F.col("_w.start").alias("true_start"), (F.col("_w.end") + 1).alias("true_end"))


def _sigmoid(x: Column) -> Column:
    return F.when(x > 3, num(-1)).otherwise(2 / (1 + F.exp(5 * x)) - 1)


def sweep(df: DataFrame, positions: DataFrame, score: str, profiles: Mapping[str, tuple] = PROFILES) -> DataFrame:
    """Best threshold and normalised benchmark score per series and profile.

    A row inside a label window is worth more the earlier it is, a window counts its best
    row; a row outside costs more the further it is behind the last window.  Raising a
    window's best row and adding false alarms are both increments along falling scores,
    so one cumulative sum per series gives the score of every threshold.  Series without
    label windows have nothing to find and are left out.
    """
    lengths = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN), F.max(CHUNK).alias("_last"))
    windows = positions.select(SERIES, "start", "end")
    rows = attach(df, windows.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_n")).join(lengths, SERIES).drop("_last")).filter(F.col("_n").isNotNull())
    at, whole = F.col(IDX), F.struct("start", "end")
    # the window that a row lies in: the first of several; what is new in each window is carried on from its first row
    cut = windows.withColumn("_w", whole).withColumn(CHUNK, F.explode(F.sequence(chunk_of("start"), chunk_of("end"))))
    cut = cut.withColumn("start", F.greatest("start", F.col(CHUNK) * CHUNK_ROWS)).withColumn("end", F.least("end", (F.col(CHUNK) + 1) * CHUNK_ROWS - 1))
    before = Window.partitionBy(*KEYS).orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("start", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(-1)) + 1)).filter("start <= end")
    news = cut.groupBy(*KEYS, F.col("start").alias(IDX)).agg(F.max(F.struct("end", "_w")).alias("_in"))
    # the last window that ended before a row
    over = windows.groupBy(SERIES, (F.col("end") + 1).alias(IDX)).agg(F.max(whole).alias("_past")).withColumn(CHUNK, chunk_of())
    marked = rows.join(news, [*KEYS, IDX], "left").join(over, [*KEYS, IDX], "left")
    marked = marked.withColumn("_in", F.last("_in", ignorenulls=True).over(frame(Window.unboundedPreceding, 0)))
    marked = running(marked, {"_previous": F.col("_past")}, F.max)
    current, previous = F.when(F.col("_in.end") >= at, F.col("_in._w")), F.col("_previous")
    width = current["end"] - current["start"] + 1
    probation = F.least(F.floor(F.col(LEN) * 0.15), F.lit(750))
    placed = marked.filter(at >= probation).select(
        SERIES, CHUNK, IDX, LEN, F.col(score).alias("_s"), "_n", current["start"].alias("_win"),
        _sigmoid(-(current["end"] - at + 1) / width).alias("_tp"),
        F.when(previous.isNull(), num(-1)).otherwise(_sigmoid(
            (at - previous["end"]) / F.greatest(previous["end"] - previous["start"], F.lit(1)))).alias("_fp"),
    )
    best_possible = _sigmoid(num(-1))
    costs = F.array(*[
        F.struct(F.lit(name).alias("profile"), num(tp).alias("tp_w"), num(fp).alias("fp_w"), num(fn).alias("fn_w"))
        for name, (tp, fp, fn) in profiles.items()
    ])
    costed = placed.select("*", F.inline(costs))
    worth = F.col("_tp") * F.col("tp_w") / best_possible
    high_first = Window.partitionBy(SERIES, "profile", "_win").orderBy(F.col("_s").desc())
    hits = costed.filter(F.col("_win").isNotNull()).groupBy(SERIES, "profile", "_win", "_n", "_s", "tp_w", "fn_w").agg(F.max(worth).alias("_worth"))
    reached = F.max("_worth").over(high_first)
    before = F.max("_worth").over(high_first.rowsBetween(Window.unboundedPreceding, -1))
    gains = hits.select(SERIES, "profile", "_n", "tp_w", "fn_w", "_s", (
        F.greatest(reached, -F.col("fn_w")) - F.greatest(F.coalesce(before, -F.col("fn_w")), -F.col("fn_w"))).alias("_d"))
    alarms = costed.filter(F.col("_win").isNull()).select(
        SERIES, "profile", "_n", "tp_w", "fn_w", "_s", (F.col("_fp") * F.col("fp_w")).alias("_d"))
    keys = [SERIES, "profile", "_n", "tp_w", "fn_w"]
    falling = below(gains.unionByName(alarms).withColumn("_neg", -F.col("_s")), keys, "_neg", {"_d": F.col("_d")})
    null_score = -F.col("_n") * F.col("fn_w")
    reached_score = null_score + F.col("_d_below") + F.col("_d")
    top = falling.groupBy(*keys).agg(F.max(F.struct(reached_score.alias("v"), (-F.col("_neg")).alias("t"))).alias("_b"))
    best = F.greatest(F.col("_b.v"), null_score)
    perfect = F.col("_n") * F.col("tp_w")
    return top.select(
        SERIES, "profile", F.when(F.col("_b.v") > null_score, F.col("_b.t")).alias("best_threshold"), best.alias("best_raw"),
        null_score.alias("null_score"), perfect.alias("perfect"),
        F.when(perfect - null_score > 1e-12, 100 * (best - null_score) / (perfect - null_score)).otherwise(num(0)).alias("normalized"),
    )


def summarise_profiles(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, lowest and highest normalised score per profile."""
    return results.groupBy(*keys, "profile").agg(
        F.avg("normalized").alias("mean"), F.min("normalized").alias("min"), F.max("normalized").alias("max"))


def weighted_mean(results: DataFrame, value: str, weight: str) -> DataFrame:
    return results.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted"))


def correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregate."""
    pairs = list(combinations(cols, 2))
    return df.groupBy(*keys).agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs]).select(
        *keys, F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])))


def rank_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spearman correlation: Pearson of average ranks."""
    long = long_form(df, cols, "scorer", "_s", [*KEYS, IDX, LEN])
    ranks = below(long, [SERIES, "scorer"], "_s", {"_c": num(1)}).select(
        SERIES, "scorer", "_s", (F.col("_c_below") + (F.col("_c") + 1) / 2).alias("_rank"))
    wide = long.join(ranks, [SERIES, "scorer", "_s"]).groupBy(*KEYS, IDX).agg(
        *[F.max(F.when(F.col("scorer") == c, F.col("_rank"))).alias(c) for c in cols])
    return correlations(wide, cols)


def subsets(cols: Sequence[str], sizes: Sequence[int] | None = None) -> dict[str, dict[str, float]]:
    """Equal-weight subsets of the components by name, e.g. ``a+b``."""
    sizes = sizes or range(1, len(cols) + 1)
    return {"+".join(c): {x: 1.0 / s for x in c} for s in sizes for c in combinations(cols, s)}


def leave_one_out(weights: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """The remaining weights rescaled to sum 1, for each left-out component."""
    out = {}
    for gone in weights:
        rest = {k: v for k, v in weights.items() if k != gone}
        scale = sum(rest.values())
        out[f"without {gone}"] = {k: v / scale for k, v in rest.items()}
    return out


def sweep_weight(base: Mapping[str, float], extra: str, shares: Sequence[float]) -> dict[str, dict[str, float]]:
    """Give ``extra`` each share and scale the other weights to the rest."""
    scale = sum(base.values())
    return {f"{extra}={s:g}": {**{k: v / scale * (1 - s) for k, v in base.items()}, extra: s} for s in shares}


def ablation(z: DataFrame, weights: Mapping[str, Mapping[str, float]], label: str) -> DataFrame:
    """AUC per series and weighting; ``z`` holds standardised component scores.

    A series of up to ``IN_TASK`` rows is scored by all weightings within a task, so no row is copied; the rows of
    longer ones are ranked in one job for all weightings.
    """
    names = list(dict.fromkeys(c for w in weights.values() for c in w))
    z = stage(z.select(SERIES, LEN, label, *names), "ablation")
    short = _ablation_in_task(z.filter(F.col(LEN) <= IN_TASK), names, weights, label)
    long = z.filter(F.col(LEN) > IN_TASK)
    return short if long.isEmpty() else short.unionByName(_ablation_in_one_sort(long, weights, label))


def _ablation_in_task(z: DataFrame, names: Sequence[str], weights: Mapping[str, Mapping[str, float]], label: str) -> DataFrame:
    def solve(group: pa.Table) -> pa.Table:
        x, hit = matrix(group, names), matrix(group, [label])[:, 0] == 1
        absent = np.column_stack([group.column(c).is_null().to_numpy() for c in names])
        scores = np.empty((len(x), len(weights)))
        for i, w in enumerate(weights.values()):
            at = [names.index(c) for c in w]
            score = sum(v * x[:, j] for v, j in zip(w.values(), at))
            # a null is the lowest score, a NaN the highest
            scores[:, i] = np.where(absent[:, at].any(1), -np.inf, np.where(np.isnan(score), np.inf, score))
        area = areas(scores, hit, np.ones(len(x)))
        key = group.column(SERIES).combine_chunks()
        return pa.table({SERIES: pa.concat_arrays([key.slice(0, 1)] * len(weights)), "config": list(weights), "auc": pa.array(area, pa.float64(), from_pandas=True)})

    kind = z.schema[SERIES].dataType.simpleString()
    return per_group(z, [SERIES], [], solve, f"{SERIES} {kind}, config string, auc double")


def _ablation_in_one_sort(z: DataFrame, weights: Mapping[str, Mapping[str, float]], label: str) -> DataFrame:
    combos = {
        name: total([num(v) * F.col(c) for c, v in w.items()]) for name, w in weights.items()
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("config"), c.alias("_score")) for n, c in combos.items()])
    long = z.select(SERIES, label, F.inline(pairs))
    return auc(long, [SERIES, "config"], "_score", label)


def path_agreement(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    """Mean and lowest correlation of the magnitudes of two sets of paths."""
    agg = df.groupBy(SERIES).agg(*[correlation(F.abs(x), F.abs(y)).alias(f"c{i}") for i, (x, y) in enumerate(zip(a, b))])
    cs = [F.col(f"c{i}") for i in range(len(a))]
    low = F.least(*cs) if len(cs) > 1 else cs[0]
    return agg.select(SERIES, (total(cs) / num(len(cs))).alias("mean_corr"), low.alias("min_corr"))


def robustness(results: DataFrame, keys: Sequence[str], value: str = "auc") -> DataFrame:
    """Mean and spread of a metric over runs, keyed by configuration."""
    return results.groupBy(*keys).agg(
        F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
