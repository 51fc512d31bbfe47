"""Window sizes and parameters that follow from the data, as columns per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.numeric import clip, correlation, num, total
from tidewatch.functions.spectrum import spectrum
from tidewatch.operators.layout import IDX, LEN, SERIES, by_chunk, frame, home, long_form, with_halo

BASE = 30
LEAST = 10
SCALES = (0.5, 1.0, 2.0, 4.0, 8.0)


def _chain(start: Column, rules) -> Column:
    """Multiply by the factor of the first matching condition of every rule."""
    out = start
    for rule in rules:
        factor = None
        for condition, value in rule:
            factor = F.when(condition, num(value)) if factor is None else factor.when(condition, num(value))
        out = out * factor.otherwise(num(1))
    return out


def volatility(df: DataFrame, cols: Sequence[str], base: int = BASE) -> DataFrame:
    """The five figures that the window sizes depend on, one row per series."""
    d = len(cols)
    wide = with_halo(df, back=1, ahead=base - 1)
    w, ahead = by_chunk(), frame(0, base - 1)
    row_sum = total([F.col(c) for c in cols])
    row_sq = total([F.col(c) * F.col(c) for c in cols])
    rows = wide.withColumn("_s", row_sum).withColumn("_q", row_sq)
    rows = home(rows.select("*", F.sum("_s").over(ahead).alias("_ws"), F.sum("_q").over(ahead).alias("_wq"),
                            *[(F.col(c) - F.lag(c).over(w)).alias(f"_d_{c}") for c in cols]))
    mean = F.col("_ws") / num(base * d)
    local = F.sqrt(F.greatest(F.col("_wq") / num(base * d) - mean * mean, num(0)))
    starts = (F.col(IDX) % (base // 2) == 0) & (F.col(IDX) < F.col(LEN) - base)
    rows = rows.withColumn("_local", F.when(starts, local))
    count, whole = F.count(F.lit(1)) * d, F.sum("_s")
    global_std = F.sqrt(F.greatest(F.sum("_q") / count - (whole / count) * (whole / count), num(0)))
    mean_abs = F.sum(total([F.abs(c) for c in cols])) / count
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    complexity = num(1) - total([F.abs(correlation(a, b)) for a, b in pairs]) / num(len(pairs)) if pairs else num(0)
    agg = rows.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), global_std.alias("global_std"), (global_std / (mean_abs + num(1e-10))).alias("global_volatility"),
        (total([F.stddev_pop(f"_d_{c}") for c in cols]) / num(d)).alias("temporal_volatility"),
        complexity.alias("correlation_complexity"),
        (F.stddev_pop("_local") / (F.avg("_local") + num(1e-10))).alias("local_variation"))
    s = spectrum(long_form(df, cols, "feature", "x", [SERIES, IDX]), [SERIES, "feature"], "x")
    low = F.sum(F.when(F.col("k") < F.floor(F.col("m") / 10), F.col("amp")))
    ratio = s.groupBy(SERIES).agg(
        (F.coalesce(low, num(0)) / F.sum(F.when(F.col("k") < F.floor(F.col("m") / 2), F.col("amp")))).alias("low_freq_ratio"))
    return agg.join(ratio, SERIES)


def window_sizes(v: DataFrame, base: int = BASE, least: int = LEAST) -> DataFrame:
    """Scale factor and windows for each purpose."""
    n = F.col(LEN)
    # fixed values: bounds of the windows and the base window by length
    top = F.greatest(F.lit(100), F.least(F.floor(n / 10), F.lit(2000)))
    sized = F.when(n > 300, F.lit(base)).when(n > 100, F.lit(int(base * 0.8))).otherwise(F.lit(int(base * 0.6)))
    sized = F.greatest(sized, F.floor(n / 20))
    gv, tv, gs = F.col("global_volatility"), F.col("temporal_volatility"), F.col("global_std")
    cc, lv, lf = F.col("correlation_complexity"), F.col("local_variation"), F.col("low_freq_ratio")
    # fixed values: cut-offs of each measure and the factors of the scale
    scale = _chain(num(1), [
        [(gv > 2.0, 0.8), (gv < 0.3, 1.5)], [(tv > gs * 2.0, 0.9), (tv < gs * 0.3, 1.4)],
        [(cc > 0.7, 1.2), (cc < 0.3, 0.9)], [(lv > 1.0, 0.85)], [(lf > 0.8, 1.4), (lf < 0.3, 0.8)],
    ])

    def window(x, lo, hi):
        return F.least(F.greatest(F.floor(x), lo if isinstance(lo, Column) else F.lit(lo)), hi).cast("int")

    out = v.withColumn("scale_factor", scale).withColumn("_top", top)
    out = out.withColumn("w_local", window(sized * F.col("scale_factor"), least, F.col("_top")))
    local = F.col("w_local")
    out = (
        out.withColumn("w_jump", window(local * 0.5, least // 2, F.floor(F.col("_top") / 3)))
        .withColumn("w_entropy", window(local * 1.3, least * 2, F.col("_top")))
        .withColumn("w_tension", window(local * 1.5, least, F.col("_top")))
    )
    for i, s in enumerate(SCALES):
        out = out.withColumn(f"w_scale_{i}", window(local * s, least, F.col("_top")))
    return out.drop("_top")


def jump_percentile() -> Column:
    """Percentile for tuned jump detection from the global volatility, as a fraction."""
    return clip(94.0 - (F.col("global_volatility") - 1.0) * 2.0, 85.0, 98.0) / 100


def refine(sizes: DataFrame, result: DataFrame) -> DataFrame:
    """Adjust windows by an analysis result and derive percentiles and regularisers.

    ``result`` has ``mean_stability`` and ``jump_density`` per series.
    """
    df = sizes.join(result, SERIES, "left")
    unstable = F.coalesce(F.col("mean_stability") > 2.0, F.lit(False))
    dense = F.coalesce(F.col("jump_density") > 0.2, F.lit(False))

    def shrink(col, factor):
        return F.floor(F.col(col) * factor).cast("int")

    # fixed values: factors, percentiles and regularisers of the refinement
    df = df.withColumn("w_local", F.when(unstable, shrink("w_local", 0.8)).otherwise(F.col("w_local")))
    df = df.withColumn("w_jump", F.when(unstable, shrink("w_jump", 0.7)).otherwise(F.col("w_jump")))
    df = df.withColumn("w_jump", F.when(dense, F.greatest(F.lit(5), shrink("w_jump", 0.6))).otherwise(F.col("w_jump")))
    gv, tv, sf = F.col("global_volatility"), F.col("temporal_volatility"), F.col("scale_factor")
    for i in range(len(SCALES)):
        c = f"w_scale_{i}"
        df = df.withColumn(c, F.when(dense, F.greatest(F.lit(5), shrink(c, 0.7))).otherwise(F.col(c)))
        df = df.withColumn(f"p_scale_{i}", clip(85.0 + 3.0 * i - (gv - 1.0) * 5.0, 80.0, 98.0))
    return (
        df.withColumn("delta_percentile", F.when(gv > 1.5, num(92)).when(gv < 0.5, num(96)).otherwise(num(94)))
        .withColumn("local_percentile", F.when(tv > gv, num(89)).otherwise(num(91)))
        .withColumn("jump_scale", 1.5 / sf).withColumn("alpha", 0.05 * sf).withColumn("beta", 0.005 * sf)
        .withColumn("use_union", F.col("local_variation") > 0.8)
        .withColumn("w_topo", 0.3 + 0.2 * F.col("correlation_complexity")).withColumn("w_pulse", 0.2 + 0.1 * tv)
    )
