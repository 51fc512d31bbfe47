"""Batch scores from paths: reconstruction, hybrid, kernel and structural."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.kernels import ENSEMBLE, Kernel, best_kernel, candidates, weighted_sums
from tidewatch.functions.numeric import num, total
from tidewatch.operators.layout import (
    CHUNK, CHUNK_ROWS, IDX, KEYS, LEN, SERIES, attach, by_chunk, home, over_chunks, with_halo,
)
from tidewatch.operators.paths import (
    HASH_MOD, HASH_STEP, frobenius_sq, position_hash, quadratic, series_steps, small_matrices, step_over, with_step_stats,
)
from tidewatch.operators.scale import series_stats
from tidewatch.session import stage, staged

BLOCK = 2048
#: Rows of a series whose pairs meet within one task; longer ones meet block by block.
IN_TASK = 1 << 13
#: Rows of a series whose hybrid score is taken within one task.
ROWS_IN_TASK = 1 << 16
SAMPLE = 300


def _lengths(df: DataFrame) -> DataFrame:
    return df.groupBy(SERIES).agg(F.max(LEN).alias(LEN))


def reconstruction_error(df: DataFrame, cols: Sequence[str], paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``recon_error``: row norm of the difference of the normalised Gram matrices.

    The n x n row norms are quadratic forms in the d x d, d x p and p x p sums.
    """
    out = attach(df, small_matrices(df, cols, paths), rows)
    g, r = F.sqrt(frobenius_sq("xx")), F.sqrt(frobenius_sq("ll"))
    g, r = F.when(g > 0, g).otherwise(num(1)), F.when(r > 0, r).otherwise(num(1))
    sq = (
        quadratic(cols, "xx", cols) / (g * g) - 2 * quadratic(cols, "xl", paths) / (g * r)
        + quadratic(paths, "ll", paths) / (r * r)
    )
    return out.withColumn("recon_error", F.sqrt(F.greatest(sq, num(0)))).drop("xx", "xl", "ll")


def hybrid_score(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], stats: DataFrame, alpha: float = 0.3, jump_scale: float = 1.2,
    use_union: bool = True, w_topo: float = 0.5, w_pulse: float = 0.3, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``recon_error`` and ``hybrid``: reconstruction error, its part on path jumps, and path strength.

    ``stats`` has charge, stability, intensity, asymmetry and power per path.  The jumps are those of any path, or without
    ``use_union`` those of the path with the largest total change.  Series of up to ``ROWS_IN_TASK`` rows are scored within a
    task, after one shuffle; longer ones take a job per step.  Both ways take the same steps.
    """
    df = staged(df, "hybrid-rows")
    options = {"alpha": alpha, "jump_scale": jump_scale, "use_union": use_union, "w_topo": w_topo, "w_pulse": w_pulse}
    short = _hybrid_in_task(df.filter(F.col(LEN) <= ROWS_IN_TASK), cols, paths, stats, options)
    long = df.filter(F.col(LEN) > ROWS_IN_TASK)
    if long.isEmpty():
        return short
    return short.unionByName(_hybrid_by_jobs(long, cols, paths, stats, rows=rows, **options))


def _hybrid_in_task(df: DataFrame, cols: Sequence[str], paths: Sequence[str], stats: DataFrame, options: dict) -> DataFrame:
    kinds = ("charge", "stability", "intensity", "asymmetry", "power")
    ahead = stats.groupBy(SERIES).agg(*[F.array(*[F.max(F.when(F.col("path") == p, F.col(k))) for p in paths]).alias(f"_{k}") for k in kinds])
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType()) for c in ("recon_error", "hybrid")])

    def solve(group: pa.Table) -> pa.Table:
        first = group.column(IDX).null_count  # the figures of the series' paths, if there are any
        found = {k: np.array(group.column(f"_{k}")[0].as_py() if first else [None] * len(paths), dtype=float) for k in kinds}
        group = group.drop_columns([f"_{k}" for k in kinds]).slice(first)
        x, p = matrix(group, cols), matrix(group, paths)
        error, score = np.empty(0), np.empty(0)
        if len(x):
            with np.errstate(all="ignore"):
                error, score = series_reconstruction(x, p), series_hybrid(x, p, found, **options)
        return group.append_column("recon_error", pa.array(error, from_pandas=True)).append_column("hybrid", pa.array(score, pa.float64(), from_pandas=True))

    return per_group(df.unionByName(ahead, allowMissingColumns=True), [SERIES], [IDX], solve, schema)


def _hybrid_by_jobs(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], stats: DataFrame, alpha: float, jump_scale: float,
    use_union: bool, w_topo: float, w_pulse: float, rows: int,
) -> DataFrame:
    strength = w_topo * (F.abs("charge") + 0.5 * F.col("stability")) + w_pulse * (
        0.4 * F.col("intensity") + 0.3 * F.abs("asymmetry") + 0.3 * F.col("power"))
    wide = stats.withColumn("_v", strength).groupBy(SERIES).agg(*[
        F.max(F.when(F.col("path") == p, F.col("_v"))).alias(f"_v_{p}") for p in paths])
    base = with_step_stats(reconstruction_error(df, cols, paths, rows), paths, rows)
    out = attach(base, wide.join(_lengths(df), SERIES), rows)
    over = [step_over(p, jump_scale) for p in paths]
    if use_union:
        jump = over[0]
        for o in over[1:]:
            jump = jump | o
    else:
        # the path with the largest total change decides
        change = base.groupBy(SERIES).agg(F.max(LEN).alias(LEN), F.array(*[F.abs(F.sum(f"dx_{p}")) for p in paths]).alias("_t"))
        out = attach(out, change.withColumn("_main", F.array_position("_t", F.array_max("_t"))).drop("_t"), rows)
        jump = F.lit(False)
        for i, o in enumerate(over):
            jump = jump | (o & (F.col("_main") == i + 1))
    part = alpha * F.col("recon_error") + (1 - alpha) * F.when(jump, F.col("recon_error")).otherwise(num(0))
    structure = total([F.abs(p) * F.col(f"_v_{p}") for p in paths])
    scored = out.withColumn("hybrid", part + structure)
    z = attach(scored, series_stats(scored, ["hybrid"]), rows)
    z = z.withColumn("hybrid", F.when(F.col("hybrid_sd") > 0, (F.col("hybrid") - F.col("hybrid_mu")) / F.col("hybrid_sd")).otherwise(F.col("hybrid")))
    drop = [f"{x}{p}" for p in paths for x in ("dx_", "dm_", "ds_", "_v_")] + ["hybrid_mu", "hybrid_sd", "_main"]
    return z.drop(*[c for c in drop if c in z.columns])


def structural_score(df: DataFrame, paths: Sequence[str], charges: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``structural``: uneven path changes, change of effective charge, concentration."""
    wide = charges.groupBy(SERIES).agg(*[
        F.max(F.when(F.col("path") == p, F.abs("charge"))).alias(f"_q_{p}") for p in paths])
    known = with_halo(attach(df, wide.join(_lengths(df), SERIES), rows), back=1, rows=rows)
    k, w = len(paths), by_chunk()
    known = known.withColumn("_eff", total([F.abs(p) * F.col(f"_q_{p}") for p in paths]))
    change = [F.abs(F.col(p) - F.lag(p).over(w)) for p in paths]
    known = known.select("*", *[c.alias(f"_c_{p}") for c, p in zip(change, paths)], F.abs(F.col("_eff") - F.lag("_eff").over(w)).alias("_de"))
    cs = [F.col(f"_c_{p}") for p in paths]
    mean = total(cs) / num(k)
    spread = F.sqrt(total([(c - mean) * (c - mean) for c in cs]) / num(k))
    top = F.greatest(*cs) if k > 1 else cs[0]
    sq = [F.col(p) * F.col(p) for p in paths]
    share = (F.greatest(*sq) if k > 1 else sq[0]) / (total(sq) + num(1e-10))
    score = F.coalesce(spread * top, num(0)) + F.coalesce(F.col("_de"), num(0)) + share * share
    return home(known.withColumn("structural", score)).drop("_eff", "_de", *[f"{x}_{p}" for p in paths for x in ("_c", "_q")])


def kernel_errors(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], kernels: Sequence[Kernel] = ENSEMBLE, block: int = BLOCK,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``kernel_0..``: row error of the path-weighted kernel matrix, per kernel.

    A row's error needs three sums over all rows of its series: K^2, K^2 P and K^2 P^2.
    Series of up to ``IN_TASK`` rows are scored many to a task, over half of the pairs.  Rows of longer ones
    meet block by block inside tasks and only these sums leave them.  The work is
    quadratic in the series length, as the score is defined over all pairs; the automatic
    choice (``kernel_auto``) is the linear alternative.
    """
    df = stage(df, "kernel-rows")
    short = _kernel_errors_in_task(df.filter(F.col(LEN) <= IN_TASK), cols, paths, kernels)
    long = df.filter(F.col(LEN) > IN_TASK)
    if long.isEmpty():
        return short
    return short.unionByName(_kernel_errors_by_blocks(long, cols, paths, kernels, block, rows))


def series_kernel_error(kernel: Kernel, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``kernel_errors`` of one whole series."""
    a, b, c = weighted_sums(kernel, x, p)
    g, r = np.sqrt(a.sum()) or 1.0, np.sqrt(c.sum()) or 1.0
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(np.maximum(a / (g * g) - 2 * b / (g * r) + c / (r * r), 0.0))


def series_reconstruction(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``reconstruction_error`` of one whole series."""
    a, b = (np.where(np.isnan(v), 0.0, v) for v in (x, p))
    xx, xl, ll = a.T @ a, a.T @ b, b.T @ b
    g, r = np.sqrt((xx * xx).sum()) or 1.0, np.sqrt((ll * ll).sum()) or 1.0
    sq = ((x @ xx) * x).sum(1) / (g * g) - 2 * ((x @ xl) * p).sum(1) / (g * r) + ((p @ ll) * p).sum(1) / (r * r)
    return np.sqrt(np.fmax(sq, 0.0))


def series_hybrid(
    x: np.ndarray, p: np.ndarray, stats: dict[str, np.ndarray], alpha: float = 0.3, jump_scale: float = 1.2, use_union: bool = True,
    w_topo: float = 0.5, w_pulse: float = 0.3,
) -> np.ndarray:
    """``hybrid_score`` of one whole series."""
    strength = w_topo * (np.abs(stats["charge"]) + 0.5 * stats["stability"]) + w_pulse * (
        0.4 * stats["intensity"] + 0.3 * np.abs(stats["asymmetry"]) + 0.3 * stats["power"])
    dx, mean, deviation = series_steps(p)
    over = np.abs(dx) > mean + jump_scale * deviation
    jump = over.any(1) if use_union else over[:, np.abs(np.where(np.isnan(dx), 0.0, dx).sum(0)).argmax()]
    error = series_reconstruction(x, p)
    score = alpha * error + (1 - alpha) * np.where(jump, error, 0.0) + np.abs(p) @ strength
    known = score[~np.isnan(score)]
    spread = known.std() if len(known) else 0.0
    return (score - known.mean()) / spread if spread > 0 else score


def series_structure(p: np.ndarray, charge: np.ndarray) -> np.ndarray:
    """``structural_score`` of one whole series."""
    known = lambda v: np.where(np.isnan(v), 0.0, v)
    change = np.abs(np.diff(p, axis=0, prepend=np.full((1, p.shape[1]), np.nan)))
    effective = np.abs(p) @ np.abs(charge)
    sq = p * p
    share = np.fmax.reduce(sq, axis=1) / (sq.sum(1) + 1e-10)
    return known(change.std(1) * np.fmax.reduce(change, axis=1)) + known(np.abs(np.diff(effective, prepend=np.nan))) + share * share


def _kernel_errors_in_task(df: DataFrame, cols: Sequence[str], paths: Sequence[str], kernels: Sequence[Kernel]) -> DataFrame:
    def solve(group: pa.Table) -> pa.Table:
        x, p = matrix(group, cols), matrix(group, paths)
        for i, kernel in enumerate(kernels):
            group = group.append_column(f"kernel_{i}", pa.array(series_kernel_error(kernel, x, p)))
        return group

    schema = T.StructType(df.schema.fields + [T.StructField(f"kernel_{i}", T.DoubleType()) for i in range(len(kernels))])
    return per_group(df, [SERIES], [IDX], solve, schema)


def _kernel_errors_by_blocks(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], kernels: Sequence[Kernel], block: int, rows: int,
) -> DataFrame:
    d, k = len(cols), len(kernels)
    packed = df.withColumn("_b", F.floor(F.col(IDX) / block).cast("long")).groupBy(SERIES, "_b").agg(
        F.max(LEN).alias(LEN), F.collect_list(F.array(F.col(IDX).cast("double"), *cols, *paths)).alias("_x"))
    left = packed.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(LEN) - 1) / block).cast("long"))))
    right = packed.select(SERIES, F.col("_b").alias("_o"), F.col("_x").alias("_y"))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def sums(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(a, b):
            x, y = np.array(list(map(list, u)), dtype=float), np.array(list(map(list, v)), dtype=float)
            p = x[:, 1 + d:] @ y[:, 1 + d:].T
            parts = [x[:, :1]]
            for kernel in kernels:
                sq = kernel.matrix(x[:, 1:1 + d], y[:, 1:1 + d]) ** 2
                parts += [sq.sum(1, keepdims=True), (sq * p).sum(1, keepdims=True), (sq * p * p).sum(1, keepdims=True)]
            out.append(np.hstack(parts).tolist())
        return pd.Series(out)

    pairs = left.join(right, [SERIES, "_o"]).select(SERIES, F.explode(sums("_x", "_y")).alias("_s"))
    per_row = pairs.groupBy(SERIES, F.col("_s")[0].cast("long").alias(IDX)).agg(*[
        F.sum(F.col("_s")[1 + i]).alias(f"_s{i}") for i in range(3 * k)])
    norms = per_row.groupBy(SERIES).agg(
        *[F.sqrt(F.sum(f"_s{3 * i}")).alias(f"_a{i}") for i in range(k)], *[F.sqrt(F.sum(f"_s{3 * i + 2}")).alias(f"_r{i}") for i in range(k)])
    out = attach(df.join(per_row, [SERIES, IDX]), norms.join(_lengths(df), SERIES), rows)
    for i in range(k):
        a = F.when(F.col(f"_a{i}") > 0, F.col(f"_a{i}")).otherwise(num(1))
        b = F.when(F.col(f"_r{i}") > 0, F.col(f"_r{i}")).otherwise(num(1))
        sq = F.col(f"_s{3 * i}") / (a * a) - 2 * F.col(f"_s{3 * i + 1}") / (a * b) + F.col(f"_s{3 * i + 2}") / (b * b)
        out = out.withColumn(f"kernel_{i}", F.sqrt(F.greatest(sq, num(0))))
    return out.drop(*[f"_s{i}" for i in range(3 * k)], *[f"{x}{i}" for i in range(k) for x in ("_a", "_r")])


def sampled_rows(df: DataFrame, size: int = SAMPLE, seed: int = 0) -> DataFrame:
    """The ``size`` rows of each series with the lowest hash of their position."""
    hashed = df.withColumn("_h", position_hash(seed))
    local = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("_h", IDX))).filter(F.col("_r") <= size)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy(SERIES).orderBy("_h", IDX))).filter(F.col("_r") <= size).drop("_r", "_h")


def kernel_auto(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], periods: DataFrame, size: int = SAMPLE, rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``kernel`` by the best of all candidate kernels, and the choice per series.

    Candidates are compared on a fixed-size sample of rows per series by the smallest
    error; other rows take the score of the nearest sampled row.  Series of up to ``ROWS_IN_TASK`` rows take all of it
    within a task, after one shuffle; longer ones take a job per step.  Both ways take the same steps.
    """
    df = staged(df, "kernel-input")
    short = _kernel_auto_in_task(df.filter(F.col(LEN) <= ROWS_IN_TASK), cols, paths, periods, size)
    long = df.filter(F.col(LEN) > ROWS_IN_TASK)
    if long.isEmpty():
        return short
    return tuple(a.unionByName(b) for a, b in zip(short, _kernel_auto_by_jobs(long, cols, paths, periods, size, rows)))


def _described(k: Kernel) -> str:
    return {"rbf": f"gamma={k.gamma:g}", "polynomial": f"degree={k.degree},coef0={k.coef0:g}", "sigmoid": f"alpha={k.alpha:g}",
            "laplacian": f"gamma={k.gamma:g}", "periodic": f"period={k.period:g},length={k.length_scale:g}"}[k.name]


def _nearest(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Per row of ``x`` the first of the nearest rows of ``z``."""
    at = np.empty(len(x), dtype=int)
    for lo in range(0, len(x), 1024):
        at[lo:lo + 1024] = sum((x[lo:lo + 1024, None, j] - z[None, :, j]) ** 2 for j in range(x.shape[1])).argmin(1)
    return at


def series_kernel_auto(idx: np.ndarray, x: np.ndarray, p: np.ndarray, periods: Sequence[float], size: int = SAMPLE, seed: int = 0) -> tuple[np.ndarray, float, Kernel]:
    """``kernel_auto`` of one whole series: the score, the error and the kernel."""
    hashed = (idx + seed) % (HASH_MOD // 2) * HASH_STEP % HASH_MOD
    taken = np.sort(np.lexsort((idx, hashed))[:size])
    error, kernel, scores = best_kernel(x[taken], p[taken] @ p[taken].T, candidates(list(periods)))
    score = scores[_nearest(x, x[taken])]
    score[taken] = scores
    return score, error, kernel


def _kernel_auto_in_task(df: DataFrame, cols: Sequence[str], paths: Sequence[str], periods: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    choice = pa.struct([("kernel", pa.string()), ("params", pa.string()), ("error", pa.float64())])
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL("kernel double, _c struct<kernel: string, params: string, error: double>").fields)

    def solve(group: pa.Table) -> pa.Table:
        ahead = group.column(IDX).null_count  # the periods of the series
        listed = group.column("periods")[0].as_py() if ahead else []
        group = group.drop_columns("periods").slice(ahead)
        score, chosen = np.empty(0), []
        if group.num_rows:
            score, error, kernel = series_kernel_auto(group.column(IDX).to_numpy(), matrix(group, cols), matrix(group, paths), listed, size)
            chosen = [{"kernel": kernel.name, "params": _described(kernel), "error": float(error)}] + [None] * (group.num_rows - 1)
        return group.append_column("kernel", pa.array(score, pa.float64())).append_column("_c", pa.array(chosen, choice))

    found = per_group(df.unionByName(periods.select(SERIES, "periods"), allowMissingColumns=True), [SERIES], [IDX], solve, schema)
    return found.drop("_c"), found.filter("_c IS NOT NULL").select(SERIES, "_c.*")


def _kernel_auto_by_jobs(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], periods: DataFrame, size: int, rows: int,
) -> tuple[DataFrame, DataFrame]:
    d, names = len(cols), [*cols, *paths]
    sample = sampled_rows(df, size).groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.array_sort(F.collect_list(F.array(F.col(IDX).cast("double"), *names))).alias("_x"))
    ready = sample.join(periods, SERIES)

    def choose(x: pd.Series, ps: pd.Series) -> pd.DataFrame:
        out = []
        for rows_, p in zip(x, ps):
            z = np.array(list(map(list, rows_)), dtype=float)
            lam = z[:, 1 + d:] @ z[:, 1 + d:].T
            best = best_kernel(z[:, 1:1 + d], lam, candidates(list(p)))
            k = best[1]
            out.append((k.name, _described(k), float(best[0]), best[2]))
        return pd.DataFrame(out, columns=["kernel", "params", "error", "scores"])

    chooser = F.pandas_udf(choose, "struct<kernel: string, params: string, error: double, scores: array<double>>")
    chosen = ready.withColumn("_c", chooser("_x", "periods")).select(SERIES, LEN, "_x", "_c.*")
    schema = T.StructType(df.schema.fields + [T.StructField("kernel", T.DoubleType())])
    model = over_chunks(chosen, rows).select(F.col(SERIES).alias("_ks"), F.col(CHUNK).alias("_kc"), "_x", "scores")

    def nearest(key, pdf: pd.DataFrame, fit: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        z = np.array(list(map(list, fit["_x"].iloc[0])), dtype=float)
        s = np.asarray(fit["scores"].iloc[0], dtype=float)
        x = pdf[list(cols)].to_numpy(dtype=float)
        known = dict(zip(z[:, 0].astype(np.int64), s))
        pdf["kernel"] = [known.get(i, v) for i, v in zip(pdf[IDX], s[_nearest(x, z[:, 1:1 + d])])]
        return pdf

    scored = df.groupBy(*KEYS).cogroup(model.groupBy("_ks", "_kc")).applyInPandas(nearest, schema)
    return scored, chosen.select(SERIES, "kernel", "params", "error")


def explain_rows(df: DataFrame, paths: Sequence[str], stats: DataFrame, score: str = "score", flagged: Column | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """One explanation struct for every flagged row, all rows at once.

    It holds the jump state, the paths that step by more than two deviations with their
    charge, energy and entropy, and a verdict.
    """
    base = with_step_stats(df, paths, rows)
    listed = stats.groupBy(SERIES).agg(F.map_from_entries(F.collect_list(F.struct(
        "path", F.struct("charge", "energy", "shannon", F.col("class").alias("kind"))))).alias("_stats"))
    out = attach(base, listed.join(_lengths(df), SERIES), rows)
    hit = F.filter(F.array(*[
        F.when(F.abs(f"dx_{p}") > 2 * F.col(f"ds_{p}"), F.struct(
            F.lit(p).alias("path"), F.col(f"dx_{p}").alias("step"), F.col("_stats")[p].alias("stats")))
        for p in paths]), lambda s: s.isNotNull())
    verdict = F.when(F.col(score) > 2, "strong anomaly").when(F.col(score) > 1, "possible anomaly").otherwise("normal")
    keep = out if flagged is None else out.filter(flagged)
    jump = F.struct(F.col("unified").alias("is_jump"), F.col("importance")) if "unified" in df.columns else F.lit(None).cast("struct<is_jump: boolean, importance: double>")
    return keep.select(SERIES, IDX, score, F.struct(jump.alias("jump"), hit.alias("paths"), verdict.alias("verdict")).alias("explanation"))
