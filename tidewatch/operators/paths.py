"""Low-rank paths of a series and their statistics.

Paths are columns ``p0..``, one value per row.  Everything that looks like an n x n matrix
in the definitions is reduced to d x d, d x p or p x p sums per series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.numeric import num, total, wrap_angle
from tidewatch.operators.layout import (
    CHUNK, CHUNK_ROWS, IDX, KEYS, LEN, SERIES, attach, by_chunk, frame, home, with_halo,
)
from tidewatch.session import stage, staged, unstage

TWO_PI = 2 * np.pi
SEGMENTS = 10
VICINITY = 5
ENTROPIES = ("shannon", "renyi_2", "tsallis_15", "max", "min", "var")
STATIC_ROWS = 50
#: Rows of a series that one task refines; longer series take a job per step.
IN_TASK = 1 << 16
# fixed values: multiplier and modulus of the hash that orders rows for sampling
HASH_STEP, HASH_MOD = 2654435761, 4294967296


# --- small matrices ------------------------------------------------------------------

def _products(a: Sequence[str], b: Sequence[str], rows: Column | None = None) -> Column:
    """Row-major array of the sums of products of two column lists."""
    terms = []
    for x in a:
        for y in b:
            v = F.col(x) * F.col(y)
            terms.append(F.coalesce(F.sum(v if rows is None else F.when(rows, v)), num(0)))
    return F.array(*terms)


def small_matrices(df: DataFrame, cols: Sequence[str], paths: Sequence[str], rows: Column | None = None) -> DataFrame:
    """Per series: ``xx`` (d x d), ``xl`` (d x p) and ``ll`` (p x p), flattened."""
    return df.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), _products(cols, cols, rows).alias("xx"),
        _products(cols, paths, rows).alias("xl"), _products(paths, paths, rows).alias("ll"),
    )


def quadratic(a: Sequence[str], matrix: str, b: Sequence[str]) -> Column:
    terms = [
        F.col(x) * F.col(matrix)[i * len(b) + j] * F.col(y) for i, x in enumerate(a) for j, y in enumerate(b)
    ]
    return total(terms)


def frobenius_sq(matrix: str) -> Column:
    return F.aggregate(matrix, num(0), lambda s, x: s + x * x)


# --- estimation ----------------------------------------------------------------------

def _eigen(packed: pd.Series, width: pd.Series, count: pd.Series) -> pd.DataFrame:
    out = []
    for m, d, p in zip(packed, width, count):
        vectors, scale = leading(np.asarray(m, dtype=float).reshape(d, d), p)
        out.append((vectors.T.ravel(), scale))
    return pd.DataFrame(out, columns=["basis", "scale"])


def leading(gram: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The p leading eigenvectors of a Gram matrix, weakest first, and the singular values."""
    values, vectors = np.linalg.eigh(gram)
    values, vectors = values[-p:], vectors[:, -p:]
    strongest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[strongest, np.arange(p)] < 0, -1.0, 1.0)
    return vectors, np.sqrt(np.maximum(values, 0.0))


def spectral_paths(df: DataFrame, cols: Sequence[str], n_paths: int = 7, unit: bool = True, rows: int = CHUNK_ROWS) -> tuple[DataFrame, list[str]]:
    """Leading eigenvectors of the row Gram matrix, weakest first.

    They are the rows projected on the eigenvectors of the d x d matrix and divided by the
    singular value, so at most d paths exist.  The sign makes the largest loading positive.
    ``unit=False`` leaves out the division, which gives the best low-rank factor.  Series of up to ``IN_TASK`` rows are
    projected within a task.
    """
    names = [f"p{k}" for k in range(min(n_paths, len(cols)))]
    short, long = _short_and_long(df.drop(*names))
    schema = T.StructType(short.schema.fields + [T.StructField(name, T.DoubleType()) for name in names])

    def project(group: pa.Table) -> pa.Table:
        values = series_start(matrix(group, cols), n_paths, unit)
        for k, name in enumerate(names):
            group = group.append_column(name, pa.array(values[:, k], from_pandas=True))
        return group

    out = _kept_in_task(short, project, schema)
    return (out if long is None else out.unionByName(_spectral_by_jobs(long, cols, n_paths, unit, rows))), names


def _short_and_long(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of series that fit a task, and those of longer ones if there are any.  What a step within tasks has left is of the first kind."""
    if getattr(df, "fits", None) == IN_TASK:
        return df, None
    df = staged(df, "paths")
    long = df.filter(F.col(LEN) > IN_TASK)
    return (df, None) if long.isEmpty() else (df.filter(F.col(LEN) <= IN_TASK), long)


def _kept_in_task(df: DataFrame, solve, schema: T.StructType) -> DataFrame:
    """A step within tasks that keeps its rows, so that the next one needs no shuffle."""
    out = per_group(df, [SERIES], [IDX], solve, schema, keeps=True)
    out.fits = IN_TASK
    return out


def _spectral_by_jobs(df: DataFrame, cols: Sequence[str], n_paths: int, unit: bool, rows: int) -> DataFrame:
    d, p = len(cols), min(n_paths, len(cols))
    gram = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN), _products(cols, cols).alias("xx"))
    eigen = F.pandas_udf(_eigen, "struct<basis: array<double>, scale: array<double>>")
    fit = gram.select(SERIES, LEN, eigen("xx", F.lit(d), F.lit(p)).alias("_f")).select(
        SERIES, LEN, F.col("_f.basis").alias("_b"), F.col("_f.scale").alias("_s"))
    out = attach(df, fit, rows)
    names = [f"p{k}" for k in range(p)]
    for k, name in enumerate(names):
        value = total([F.col(c) * F.col("_b")[k * d + j] for j, c in enumerate(cols)])
        scale = F.col("_s")[k]
        out = out.withColumn(name, F.when(scale > 1e-12, value / scale).otherwise(num(0)) if unit else value)
    return out.drop("_b", "_s")


def emphasise_jumps(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """On jump rows scale by 1 + importance and turn the sign of odd paths."""
    for k, p in enumerate(paths):
        gain = (1 + F.col("importance")) * (1 if k % 2 == 0 else -1)
        df = df.withColumn(p, F.when(F.col("unified"), F.col(p) * gain).otherwise(F.col(p)))
    return df


def steps(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """``dx_<p>``: change from the previous row (null on the first)."""
    wide = with_halo(df, back=1, rows=rows)
    w = by_chunk()
    return home(wide.select("*", *[(F.col(p) - F.lag(p).over(w)).alias(f"dx_{p}") for p in paths]))


def step_stats(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    aggs = [F.max(LEN).alias(LEN)]
    for p in paths:
        aggs += [F.avg(F.abs(f"dx_{p}")).alias(f"dm_{p}"), F.stddev_pop(F.abs(f"dx_{p}")).alias(f"ds_{p}")]
    return df.groupBy(SERIES).agg(*aggs)


def with_step_stats(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    s = steps(df, paths, rows)
    return attach(s, step_stats(s, paths), rows)


def step_over(p: str, scale: float) -> Column:
    """Whether the step of a path exceeds mean + scale * std of its steps."""
    return F.coalesce(F.abs(f"dx_{p}") > F.col(f"dm_{p}") + num(scale) * F.col(f"ds_{p}"), F.lit(False))


def per_path(agg: DataFrame, paths: Sequence[str], fields: dict[str, str], keep: Sequence[str] = (SERIES,)) -> DataFrame:
    """``{field: prefix}`` columns ``prefix_<p>`` to one row per path."""
    return agg.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(p).alias("path"), *[F.col(f"{prefix}_{p}").alias(name) for name, prefix in fields.items()])
        for p in paths
    ])))


# --- objective -----------------------------------------------------------------------

def phases(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS, cyclic: bool = True) -> DataFrame:
    """``th_<p>`` phase between a row and the next, ``dth_<p>`` its wrapped change.

    The last row is paired with the first one when ``cyclic``.
    """
    if cyclic:
        first = df.groupBy(SERIES).agg(
            F.max(LEN).alias(LEN), *[F.max(F.when(F.col(IDX) == 0, F.col(p))).alias(f"_x0_{p}") for p in paths])
        df = attach(df, first, rows)
    wide = with_halo(df, ahead=2, rows=rows)
    w = by_chunk()
    last = F.col(IDX) == F.col(LEN) - 1
    for p in paths:
        nxt = F.when(last, F.col(f"_x0_{p}") if cyclic else F.lit(None)).otherwise(F.lead(p).over(w))
        wide = wide.withColumn(f"th_{p}", F.atan2(nxt, F.col(p)))
    wide = wide.select("*", *[wrap_angle(F.lead(f"th_{p}").over(w) - F.col(f"th_{p}")).alias(f"dth_{p}") for p in paths])
    return home(wide).drop(*[f"_x0_{p}" for p in paths])


def objective_terms(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], jumps: bool = False, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The terms of the path objective per series (weights not applied)."""
    s = with_step_stats(phases(df, paths, rows, cyclic=False), paths, rows)
    tv_time = total([F.coalesce(F.abs(f"dx_{p}"), num(0)) for p in paths])
    between = [F.abs(F.col(b) - F.col(a)) for a, b in zip(paths, paths[1:])]
    jump = total([F.when(step_over(p, 2.5), F.abs(f"dx_{p}")).otherwise(num(0)) for p in paths])
    topo = total([F.coalesce(F.pow(f"dth_{p}", 2.0), num(0)) for p in paths])
    aggs = [
        F.sum(tv_time + (total(between) if between else num(0))).alias("tv"),
        F.sum(total([F.abs(p) for p in paths])).alias("l1"), F.sum(jump).alias("jump"), F.sum(topo).alias("topology"),
    ]
    if jumps:
        step = total([F.coalesce(F.abs(f"dx_{p}"), num(0)) for p in paths])
        aggs.append(F.sum(F.when(F.col("unified"), -F.col("importance") * step).otherwise(0.1 * step)).alias("consistency"))
    smooth = s.groupBy(SERIES).agg(*aggs)
    m = small_matrices(df, cols, paths).select(
        SERIES, LEN, (frobenius_sq("xx") - 2 * frobenius_sq("xl") + frobenius_sq("ll")).alias("data_fit"))
    return m.join(smooth, SERIES)


def objective(terms: DataFrame, alpha: float = 0.05, beta: float = 0.005, jump: float = 0.5, topo: float = 0.1) -> DataFrame:
    value = F.col("data_fit") + alpha * F.col("tv") + beta * F.col("l1") + jump * F.col("jump") + topo * F.col("topology")
    if "consistency" in terms.columns:
        value = value + F.col("consistency")
    return terms.withColumn("objective", value)


def position_hash(seed: int = 0):
    """Multiplicative hash of a row's position; the position is reduced first, so the product fits a long."""
    return ((F.col(IDX) + seed) % F.lit(HASH_MOD // 2) * F.lit(HASH_STEP)) % F.lit(HASH_MOD)


def key_rows(df: DataFrame, flag: str = "unified", expand: int = VICINITY, samples: int = STATIC_ROWS, seed: int = 0, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``role``: ``jump`` near a jump, ``static`` for sampled other rows, else ``diagonal``.

    The sparse objective compares all pairs of jump and static rows, plus every row with
    itself.  That pair set is the square of these rows, so it is kept as this column and
    never written out.  Sampling takes the lowest hashes, first per chunk, then per series, or within a task for
    series of up to ``IN_TASK`` rows.
    """
    short, long = _short_and_long(df.drop("role"))

    def mark(group: pa.Table) -> pa.Table:
        role = series_roles(group.column(IDX).to_numpy(), matrix(group, [flag])[:, 0], expand, samples, seed)
        return group.append_column("role", pa.array(role, pa.string()))

    schema = T.StructType(short.schema.fields + [T.StructField("role", T.StringType())])
    out = _kept_in_task(short, mark, schema)
    return out if long is None else out.unionByName(_roles_by_jobs(long, flag, expand, samples, seed, rows))


def _roles_by_jobs(df: DataFrame, flag: str, expand: int, samples: int, seed: int, rows: int) -> DataFrame:
    wide = with_halo(df, back=expand, ahead=expand, rows=rows)
    near = home(wide.withColumn("_near", F.max(flag).over(frame(-expand, expand))))
    hashed = near.withColumn("_h", position_hash(seed))
    pool = hashed.filter(~F.col("_near")).select(*KEYS, IDX, "_h")
    local = pool.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("_h", IDX))).filter(F.col("_r") <= samples)
    chosen = (
        local.withColumn("_r", F.row_number().over(Window.partitionBy(SERIES).orderBy("_h", IDX)))
        .filter(F.col("_r") <= samples).select(*KEYS, IDX, F.lit(True).alias("_s"))
    )
    role = F.when(F.col("_near"), "jump").when(F.col("_s"), "static").otherwise("diagonal")
    return near.join(chosen, [*KEYS, IDX], "left").withColumn("role", role).drop("_near", "_s")


def pair_counts(keyed: DataFrame, flag: str = "unified") -> DataFrame:
    """Size of the pair set behind ``key_rows``, in closed form."""
    n = F.col(LEN).cast("double")
    base = keyed.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.count(F.when(F.col(flag), F.lit(1))).alias("n_jumps"),
        F.count(F.when(F.col("role") == "jump", F.lit(1))).alias("n_expanded"),
        F.count(F.when(F.col("role") == "static", F.lit(1))).alias("n_static"),
    )
    a = F.col("n_expanded") + F.col("n_static")
    return base.withColumn("n_pairs", a * a + F.col(LEN) - a).withColumn("reduction", 1 - F.col("n_pairs") / (n * n))


def sparse_fit(keyed: DataFrame, cols: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """Data fit over the pairs of ``key_rows`` only."""
    inside = F.col("role") != "diagonal"
    m = small_matrices(keyed, cols, paths, inside)
    own = total([F.col(c) * F.col(c) for c in cols]) - total([F.col(p) * F.col(p) for p in paths])
    rest = keyed.groupBy(SERIES).agg(F.coalesce(F.sum(F.when(~inside, own * own)), num(0)).alias("_rest"))
    fit = frobenius_sq("xx") - 2 * frobenius_sq("xl") + frobenius_sq("ll")
    return m.join(rest, SERIES).select(SERIES, LEN, (fit + F.col("_rest")).alias("sparse_fit"))


def path_slopes(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], weights: tuple[float, float, float, float],
    consistency: bool, sparse: bool, rows: int,
) -> DataFrame:
    """``df`` with ``slope_<p>``, the derivative of the path objective by each value of a path, and ``size``.

    ``weights`` are those of steps and levels, of magnitudes, of large steps and of turns.  The data fit needs the
    d x p and p x p sums of a series; everything else hangs on the rows next to one, so it is made of leads
    and lags.  ``size`` is the sum of squares of the series' features.  A limit on large steps counts as fixed.
    """
    level, magnitude, large, turns = weights
    inside = (F.col("role") != "diagonal") if sparse else None
    stepped = steps(df, paths, rows)
    sums = stepped.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), _products(cols, paths, inside).alias("xl"), _products(paths, paths, inside).alias("ll"),
        F.sum(total([F.col(c) * F.col(c) for c in cols])).alias("size"),
        *[(F.avg(F.abs(f"dx_{p}")) + 2.5 * F.stddev_pop(F.abs(f"dx_{p}"))).alias(f"limit_{p}") for p in paths])
    w = by_chunk()
    wide = with_halo(attach(df, sums, rows), back=3, ahead=3, rows=rows)
    wide = wide.select("*", *[(F.col(p) - F.lag(p).over(w)).alias(f"dx_{p}") for p in paths], *[F.lead(p).over(w).alias(f"nx_{p}") for p in paths])
    # the phase of a row and the next, its turn, and what a change of the phase does to the squared turns
    wide = wide.select("*", *[F.atan2(f"nx_{p}", p).alias(f"th_{p}") for p in paths])
    wide = wide.select("*", *[wrap_angle(F.col(f"th_{p}") - F.lag(f"th_{p}").over(w)).alias(f"turn_{p}") for p in paths])
    by_phase = {p: 2 * turns * (F.coalesce(f"turn_{p}", num(0)) - F.coalesce(F.lead(f"turn_{p}").over(w), num(0))) for p in paths}
    wide = wide.select("*", *[(v / (F.col(p) * F.col(p) + F.col(f"nx_{p}") * F.col(f"nx_{p}") + 1e-12)).alias(f"q_{p}") for p, v in by_phase.items()])
    moved = F.when(F.col("unified"), -F.col("importance")).otherwise(num(0.1)) if consistency else num(0)
    cost = {p: num(level) + F.when(F.abs(f"dx_{p}") > F.col(f"limit_{p}"), num(large)).otherwise(num(0)) + moved for p in paths}
    wide = wide.select("*", *[F.coalesce(c * F.signum(f"dx_{p}"), num(0)).alias(f"pull_{p}") for p, c in cost.items()])
    k, slopes = len(paths), []
    own = total([F.col(c) * F.col(c) for c in cols]) - total([F.col(p) * F.col(p) for p in paths])
    for j, p in enumerate(paths):
        fit = total([F.col(c) * F.col("xl")[i * k + j] for i, c in enumerate(cols)]) - total([F.col(x) * F.col("ll")[i * k + j] for i, x in enumerate(paths)])
        slope = -4 * (F.when(F.col("role") == "diagonal", own * F.col(p)).otherwise(fit) if sparse else fit)
        slope += magnitude * F.signum(p)
        if j:
            slope += level * F.signum(F.col(p) - F.col(paths[j - 1]))
        if j + 1 < k:
            slope -= level * F.signum(F.col(paths[j + 1]) - F.col(p))
        slope += F.col(f"pull_{p}") - F.coalesce(F.lead(f"pull_{p}").over(w), num(0))
        slope += F.coalesce(F.lag(F.col(f"q_{p}") * F.col(p)).over(w), num(0)) - F.coalesce(F.col(f"q_{p}") * F.col(f"nx_{p}"), num(0))
        slopes.append(slope.alias(f"slope_{p}"))
    return home(wide.select(*df.columns, "home", "size", *slopes))


def _gradient_step(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], weights: tuple[float, float, float, float],
    step: float, consistency: bool, sparse: bool, rows: int,
) -> DataFrame:
    """One descent step, in units of the series' size."""
    sloped = path_slopes(df, cols, paths, weights, consistency, sparse, rows)
    moved = {p: F.col(p) - step / F.greatest("size", num(1e-12)) * F.col(f"slope_{p}") for p in paths}
    return sloped.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in df.columns])


def descents(alpha: float = 0.05, beta: float = 0.005, topo: float = 0.1) -> list[tuple[float, float, float, float]]:
    """The weights of both descents, without and with topology."""
    return [(alpha, beta, 0.5, weight) for weight in (0.0, topo)]


def refine_paths(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], alpha: float = 0.05, beta: float = 0.005,
    topo: float = 0.1, n_steps: int = 5, step: float = 0.02, jumps: bool = False, sparse: bool = False, rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Descend the path objective twice (with and without topology) and combine.

    The start should be the best low-rank factor (``spectral_paths(unit=False)``), which
    already minimises the data fit; the steps trade it against the other terms.  The result is the
    element-wise larger magnitude of the two solutions, each path scaled to unit norm.  A series of up
    to ``IN_TASK`` rows takes all its steps within a task; for longer ones every step is staged, since
    rows and their sums are both read from it.  Both ways take the same steps.
    """
    rows_in_task, long = _short_and_long(df)
    weights = descents(alpha, beta, topo)
    short = _refine_in_task(rows_in_task, cols, paths, weights, n_steps, step, jumps, sparse)
    if long is None:
        return short
    return short.unionByName(_refine_by_jobs(long, cols, paths, weights, n_steps, step, jumps, sparse, rows))


def _refine_by_jobs(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], weights: Sequence[tuple[float, float, float, float]],
    n_steps: int, step: float, jumps: bool, sparse: bool, rows: int,
) -> DataFrame:
    ids = [*KEYS, IDX]
    solved = []
    for each in weights:
        now = df
        for _ in range(n_steps):
            after = stage(_gradient_step(now, cols, paths, each, step, jumps, sparse, rows), "paths")
            if now is not df:
                unstage(now)
            now = after
        solved.append(now)
    other = solved[1].select(*ids, *[F.col(p).alias(f"_o_{p}") for p in paths])
    both = solved[0].join(other, ids)
    for p in paths:
        both = both.withColumn(p, F.greatest(F.abs(p), F.abs(f"_o_{p}")))
    return unit_norm(both.select(*df.columns), paths, rows)


def slopes_in_task(
    x: np.ndarray, p: np.ndarray, weights: tuple[float, float, float, float], moved: np.ndarray | float, diagonal: np.ndarray | None,
) -> np.ndarray:
    """``path_slopes`` of one whole series; ``moved`` is the part of a step's cost that hangs on jumps, NaN is null."""
    level, magnitude, large, turns = weights
    known = lambda v: np.where(np.isnan(v), 0.0, v)  # noqa: E731  null products are left out of sums
    xs, ps = (known(x), known(p)) if diagonal is None else (known(x[~diagonal]), known(p[~diagonal]))
    fit = x @ (xs.T @ ps) - p @ (ps.T @ ps)
    if diagonal is not None:
        own = (x * x).sum(1) - (p * p).sum(1)
        fit = np.where(diagonal[:, None], own[:, None] * p, fit)
    slope = -4 * fit + magnitude * np.sign(p)
    between = level * np.sign(np.diff(p, axis=1))
    slope[:, 1:] += between
    slope[:, :-1] -= between
    if len(p) == 1:
        return slope
    dx = np.diff(p, axis=0)
    size = np.abs(dx)
    limit = np.nanmean(size, axis=0) + 2.5 * np.nanstd(size, axis=0)
    pull = known((level + np.where(size > limit, large, 0.0) + (moved[1:, None] if isinstance(moved, np.ndarray) else moved)) * np.sign(dx))
    slope[1:] += pull
    slope[:-1] -= pull
    here, after = p[:-1], p[1:]
    turn = np.diff(np.arctan2(after, here), axis=0)
    turn = known(np.where(turn > np.pi, turn - TWO_PI, np.where(turn < -np.pi, turn + TWO_PI, turn)))
    edge = np.zeros((1, p.shape[1]))
    q = 2 * turns * (np.vstack([edge, turn]) - np.vstack([turn, edge])) / (here * here + after * after + 1e-12)
    slope[1:] += known(q * here)
    slope[:-1] -= known(q * after)
    return slope


def descend(
    x: np.ndarray, start: np.ndarray, weights: Sequence[tuple[float, float, float, float]], n_steps: int, step: float,
    moved: np.ndarray | float, diagonal: np.ndarray | None,
) -> np.ndarray:
    """``refine_paths`` of one whole series."""
    size = max(float(np.nansum(x * x)), 1e-12)
    best = None
    for each in weights:
        p = start
        for _ in range(n_steps):
            p = p - step / size * slopes_in_task(x, p, each, moved, diagonal)
        best = np.abs(p) if best is None else np.fmax(best, np.abs(p))
    return best / (np.sqrt(np.nansum(best * best, axis=0)) + 1e-8)


def _refine_in_task(
    df: DataFrame, cols: Sequence[str], paths: Sequence[str], weights: Sequence[tuple[float, float, float, float]],
    n_steps: int, step: float, jumps: bool, sparse: bool,
) -> DataFrame:
    def solve(group: pa.Table) -> pa.Table:
        x, start = matrix(group, cols), matrix(group, paths)
        moved = 0.0
        if jumps:
            at, importance = (matrix(group, [c])[:, 0] for c in ("unified", "importance"))
            moved = np.where(at == 1, -importance, 0.1)
        diagonal = np.array([r == "diagonal" for r in group.column("role").to_pylist()]) if sparse else None
        best = descend(x, start, weights, n_steps, step, moved, diagonal)
        for j, name in enumerate(paths):
            group = group.set_column(group.schema.get_field_index(name), name, pa.array(best[:, j], from_pandas=True))
        return group

    return per_group(df, [SERIES], [IDX], solve, df.schema)


def unit_norm(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    norms = df.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), *[F.sqrt(F.sum(F.col(p) * F.col(p))).alias(f"_n_{p}") for p in paths])
    out = attach(df, norms, rows)
    for p in paths:
        out = out.withColumn(p, F.col(p) / (F.col(f"_n_{p}") + num(1e-8)))
    return out.drop(*[f"_n_{p}" for p in paths])


# --- topology ------------------------------------------------------------------------

def topology(df: DataFrame, paths: Sequence[str], jumps: bool = False, rows: int = CHUNK_ROWS) -> DataFrame:
    """Charge and stability per path; ``jumps`` adds the phase shift at jump rows."""
    t = phases(df, paths, rows)
    if jumps:
        wide = with_halo(t, back=2, rows=rows)
        w = by_chunk()
        for p in paths:
            before = F.lag(p).over(w)
            two_back = F.when(F.col(IDX) == 1, before).otherwise(F.lag(p, 2).over(w))
            shift = F.atan2(F.col(p), before) - F.atan2(before, two_back)
            wide = wide.withColumn(f"_sh_{p}", F.when(F.col("unified") & (F.col(IDX) >= 1), shift))
        t = home(wide)
    segment = F.ceil(SEGMENTS * (F.col(IDX) + 1) / F.col(LEN)) - 1
    last = F.floor((segment + 1) * F.col(LEN) / SEGMENTS) - 1
    t = t.withColumn("_seg", F.when(F.col(IDX) < last, segment))
    aggs = []
    for p in paths:
        d = F.col(f"dth_{p}")
        turn = F.coalesce(F.sum(d), num(0))
        if jumps:
            turn = turn + F.coalesce(F.sum(f"_sh_{p}"), num(0))
        parts = [F.coalesce(F.sum(F.when(F.col("_seg") == s, d)), num(0)) for s in range(SEGMENTS)]
        aggs += [(turn / num(TWO_PI)).alias(f"q_{p}"), F.array(*parts).alias(f"seg_{p}")]
    agg = t.groupBy(SERIES).agg(*aggs)
    for p in paths:
        agg = agg.withColumn(f"s_{p}", array_std(F.col(f"seg_{p}"), SEGMENTS))
    return per_path(agg, paths, {"charge": "q", "stability": "s"})


def array_std(col: Column, size: int) -> Column:
    mean = F.aggregate(col, num(0), lambda s, x: s + x) / num(size)
    return F.sqrt(F.aggregate(F.transform(col, lambda x: (x - mean) * (x - mean)), num(0), lambda s, x: s + x) / num(size))


def pulsation(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Intensity, asymmetry and power of the steps above mean + 2 std, and sum of squares."""
    s = with_step_stats(df, paths, rows)
    aggs = [F.max(LEN).alias(LEN)]
    for p in paths:
        over, d = step_over(p, 2.0), F.col(f"dx_{p}")
        aggs += [
            F.coalesce(F.sum(F.when(over & (d > 0), d)), num(0)).alias(f"up_{p}"),
            F.coalesce(F.sum(F.when(over & (d < 0), -d)), num(0)).alias(f"dn_{p}"),
            F.count(F.when(over, F.lit(1))).alias(f"c_{p}"),
            F.sum(F.col(p) * F.col(p)).alias(f"ss_{p}"),
        ]
    agg = s.groupBy(SERIES).agg(*aggs)
    for p in paths:
        up, dn = F.col(f"up_{p}"), F.col(f"dn_{p}")
        agg = (
            agg.withColumn(f"i_{p}", up + dn).withColumn(f"a_{p}", (up - dn) / (up + dn + num(1e-10)))
            .withColumn(f"w_{p}", (up + dn) * F.col(f"c_{p}") / F.col(LEN))
        )
    return per_path(agg, paths, {"intensity": "i", "asymmetry": "a", "power": "w", "n_jumps": "c", "sum_squares": "ss"}, (SERIES, LEN))


FIGURES = {"charge": pa.float64(), "stability": pa.float64(), LEN: pa.int64(), "intensity": pa.float64(), "asymmetry": pa.float64(), "power": pa.float64(),
           "n_jumps": pa.int64(), "sum_squares": pa.float64()}


def figures(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """``topology`` and ``pulsation`` per path.

    Series of up to ``IN_TASK`` rows take both within a task, after one shuffle of their paths; longer ones take the jobs of each.
    """
    short, long = _short_and_long(df)
    names = list(paths)

    def solve(group: pa.Table) -> pa.Table:
        p = matrix(group, names)
        with np.errstate(all="ignore"):
            found = dict(zip(("charge", "stability"), series_topology(p, np.zeros(len(p), bool))), **{LEN: np.full(len(names), len(p))}, **series_pulsation(p))
        key = pa.chunked_array([group.column(SERIES).combine_chunks().take(pa.array([0] * len(names)))])
        return pa.table([key, pa.array(names), *[pa.array(found[c], kind, from_pandas=True) for c, kind in FIGURES.items()]], names=[SERIES, "path", *FIGURES])

    schema = T.StructType([short.schema[SERIES], T.StructField("path", T.StringType()), *[
        T.StructField(c, T.LongType() if kind == pa.int64() else T.DoubleType()) for c, kind in FIGURES.items()]])
    found = per_group(short.select(SERIES, IDX, *names), [SERIES], [IDX], solve, schema)
    if long is None:
        return found
    return found.unionByName(topology(long, paths, rows=rows).join(pulsation(long, paths, rows), [SERIES, "path"]))


def energy(pulses: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Sum of squares plus 0.3 times the path's pulse power, or the features' mean power."""
    if features is None:
        return pulses.withColumn("energy", F.col("sum_squares") + 0.3 * F.col("power"))
    mean = features.groupBy(SERIES).agg(F.avg("power").alias("_fp"))
    return pulses.join(mean, SERIES, "left").withColumn(
        "energy", F.col("sum_squares") + 0.3 * F.coalesce("_fp", num(0))).drop("_fp")


def jump_positions(df: DataFrame, paths: Sequence[str], scale: float = 2.0, rows: int = CHUNK_ROWS) -> DataFrame:
    """``(series_id, path, idx)`` of the step ``idx -> idx+1`` above mean + scale * std."""
    s = with_step_stats(df, paths, rows)
    hit = F.filter(F.array(*[F.when(step_over(p, scale), F.lit(p)) for p in paths]), lambda x: x.isNotNull())
    return s.select(SERIES, (F.col(IDX) - 1).alias(IDX), F.explode(hit).alias("path"))


# --- entropies -----------------------------------------------------------------------

def entropy_parts(x: Column, weight: Column | None = None, over=None) -> dict[str, Column]:
    """Aggregates of ``a = |x| + 1e-10`` from which all six figures follow in one pass."""
    a = F.abs(x) + num(1e-10)

    def add(v):
        v = v if weight is None else v * weight
        return F.sum(v) if over is None else F.sum(v).over(over)

    used = a if weight is None else F.when(weight > 0, a)
    top, low = (F.max(used), F.min(used)) if over is None else (F.max(used).over(over), F.min(used).over(over))
    return {
        "c": add(F.when(x.isNotNull(), num(1))), "s": add(a), "l": add(a * F.log(a)), "q": add(a * a),
        "r": add(a * F.sqrt(a)), "hi": top, "lo": low,
    }


def entropy_vector(part: dict[str, Column]) -> dict[str, Column]:
    s, c = part["s"], part["c"]
    q = part["q"] / (s * s)
    return {
        "shannon": F.log(s) - part["l"] / s, "renyi_2": -F.log(q),
        "tsallis_15": (1 - part["r"] / (s * F.sqrt(s))) / 0.5,
        "max": part["hi"] / s, "min": part["lo"] / s, "var": q / c - 1 / (c * c),
    }


def entropies(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    aggs = [col.alias(f"{k}_{p}") for p in paths for k, col in entropy_parts(F.col(p)).items()]
    agg = df.groupBy(SERIES).agg(*aggs)
    keys = entropy_parts(F.lit(0.0)).keys()
    table = per_path(agg, paths, {k: k for k in keys})
    return table.select(SERIES, "path", *[v.alias(k) for k, v in entropy_vector({k: F.col(k) for k in keys}).items()])


def renyi(col: str, alpha: float) -> Column:
    """Aggregate: Renyi entropy of order ``alpha`` (Shannon at 1)."""
    a = F.abs(col) + num(1e-10)
    if alpha == 1.0:
        return F.log(F.sum(a)) - F.sum(a * F.log(a)) / F.sum(a)
    return F.log(F.sum(F.pow(a, num(alpha))) / F.pow(F.sum(a), num(alpha))) / (1 - alpha)


def tsallis(col: str, q: float) -> Column:
    a = F.abs(col) + num(1e-10)
    if q == 1.0:
        return F.log(F.sum(a)) - F.sum(a * F.log(a)) / F.sum(a)
    return (1 - F.sum(F.pow(a, num(q))) / F.pow(F.sum(a), num(q))) / (q - 1)


def conditional_entropies(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """The six figures per path and part of the series, in long form.

    Parts: all, jump, non_jump, vicinity, pre_jump and post_jump (a row counts once per
    jump it precedes or follows), remote, and locality_ratio = vicinity / remote.  How
    often a row counts is a frame over the jump mask, so no row is copied.
    """
    w = VICINITY
    wide = with_halo(df, back=w, ahead=w, rows=rows)
    u = F.col("unified").cast("int")
    tagged = home(wide.select(
        "*", (F.max(u).over(frame(-w, w)) > 0).alias("_near"),
        F.coalesce(F.sum(u).over(frame(1, w)), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(u).over(frame(-w, -1)), F.lit(0)).alias("_after"),
    ))
    weights = {
        "all": num(1), "jump": u.cast("double"), "non_jump": (1 - u).cast("double"),
        "vicinity": F.col("_near").cast("double"), "pre_jump": F.col("_before").cast("double"),
        "post_jump": F.col("_after").cast("double"), "remote": (~F.col("_near")).cast("double"),
    }
    # one row per (path, part) with its weight, then one aggregate for all of them
    parts = F.array(*[
        F.struct(F.lit(p).alias("path"), F.lit(t).alias("part"), F.col(p).alias("x"), wt.alias("wt"))
        for p in paths for t, wt in weights.items()
    ])
    long = tagged.select(SERIES, F.inline(parts)).filter("wt > 0")
    agg = long.groupBy(SERIES, "path", "part").agg(
        *[v.alias(k) for k, v in entropy_parts(F.col("x"), F.col("wt")).items()])
    keys = list(entropy_parts(F.lit(0.0)))
    table = agg.select(SERIES, "path", "part", *[v.alias(k) for k, v in entropy_vector({k: F.col(k) for k in keys}).items()])
    near = table.filter("part = 'vicinity'").select(SERIES, "path", *[F.col(e).alias(f"_n_{e}") for e in ENTROPIES])
    ratio = table.filter("part = 'remote'").join(near, [SERIES, "path"]).select(
        SERIES, "path", F.lit("locality_ratio").alias("part"),
        *[F.when(F.col(e) != 0, F.col(f"_n_{e}") / (F.col(e) + num(1e-10))).alias(e) for e in ENTROPIES])
    return table.unionByName(ratio)


def entropy_gradient(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean over jumps of the figures after minus before, five rows on each side."""
    wide = with_halo(df, back=VICINITY, ahead=VICINITY, rows=rows)
    before, after = frame(-VICINITY, -1), frame(1, VICINITY)
    new = []
    for p in paths:
        a = entropy_vector(entropy_parts(F.col(p), over=after))
        b = entropy_vector(entropy_parts(F.col(p), over=before))
        new += [(a[e] - b[e]).alias(f"{e}_{p}") for e in ENTROPIES]
    at = home(wide.select("*", *new)).filter("unified")
    agg = at.groupBy(SERIES).agg(*[F.avg(f"{e}_{p}").alias(f"{e}_{p}") for p in paths for e in ENTROPIES])
    return per_path(agg, paths, {e: e for e in ENTROPIES})


def entropy_variation(df: DataFrame, paths: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Deviation of the figures over the three-row windows around jumps.

    A window counts once for every jump whose neighbourhood contains its start.
    """
    wide = with_halo(df, back=VICINITY, ahead=VICINITY + 2, rows=rows)
    three = frame(0, 2)
    new = [F.coalesce(F.sum(F.col("unified").cast("int")).over(frame(-(VICINITY - 1), VICINITY)), F.lit(0)).alias("_wt")]
    for p in paths:
        new += [v.alias(f"{e}_{p}") for e, v in entropy_vector(entropy_parts(F.col(p), over=three)).items()]
    starts = home(wide.select("*", *new)).filter((F.col("_wt") > 0) & (F.col(IDX) <= F.col(LEN) - 3))
    names = [f"{e}_{p}" for p in paths for e in ENTROPIES]
    wt = F.col("_wt")
    mean = starts.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.sum(wt).alias("_total"), *[(F.sum(F.col(x) * wt) / F.sum(wt)).alias(f"_m_{x}") for x in names])
    out = attach(starts, mean, rows)
    agg = out.groupBy(SERIES).agg(*[
        F.sqrt(F.sum(F.pow(F.col(x) - F.col(f"_m_{x}"), 2.0) * wt) / F.sum(wt)).alias(x) for x in names])
    return per_path(agg, paths, {e: e for e in ENTROPIES})


# --- one whole series ------------------------------------------------------------------

def series_start(x: np.ndarray, n_paths: int, unit: bool = False) -> np.ndarray:
    """``spectral_paths``."""
    known = np.where(np.isnan(x), 0.0, x)
    vectors, scale = leading(known.T @ known, min(n_paths, x.shape[1]))
    return np.where(scale > 1e-12, (x @ vectors) / np.where(scale > 1e-12, scale, 1.0), 0.0) if unit else x @ vectors


def series_roles(idx: np.ndarray, unified: np.ndarray, expand: int = VICINITY, samples: int = STATIC_ROWS, seed: int = 0) -> np.ndarray:
    """``key_rows``."""
    near = np.convolve(unified, np.ones(2 * expand + 1), "full")[expand: expand + len(unified)] > 0.5
    pool = np.flatnonzero(~near)
    hashed = (idx[pool] + seed) % (HASH_MOD // 2) * HASH_STEP % HASH_MOD
    role = np.where(near, "jump", "diagonal").astype(object)
    role[pool[np.lexsort((idx[pool], hashed))[:samples]]] = "static"
    return role


def _padded(values: np.ndarray, n: int) -> np.ndarray:
    """Null on the first rows, up to n rows in all."""
    return np.vstack([np.full((n - len(values), values.shape[1]), np.nan), values])


def _summed(values: np.ndarray) -> np.ndarray:
    """Sums of each column over what is not null, 0 if there is nothing."""
    return np.where(np.isnan(values), 0.0, values).sum(0)


def series_steps(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``with_step_stats``: steps, and the mean and deviation of their sizes."""
    dx = np.diff(p, axis=0)
    size = np.abs(dx)
    there = ~np.isnan(size)
    count = np.where(there.any(0), there.sum(0), np.nan)
    mean = _summed(size) / count
    return _padded(dx, len(p)), mean, np.sqrt(_summed((size - mean) ** 2) / count)


def series_topology(p: np.ndarray, unified: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``topology`` with the phase shift at jump rows: charge and stability per path."""
    n = len(p)
    turn = np.diff(np.arctan2(np.roll(p, -1, axis=0), p), axis=0)
    turn = np.where(turn > np.pi, turn - TWO_PI, np.where(turn < -np.pi, turn + TWO_PI, turn))
    at = np.flatnonzero(unified[1:]) + 1
    before, two_back = p[at - 1], p[np.where(at == 1, 0, at - 2)]
    shift = np.arctan2(p[at], before) - np.arctan2(before, two_back)
    here = np.arange(n - 1)
    segment = (np.ceil(SEGMENTS * (here + 1) / n) - 1).astype(int)
    inside = here < np.floor((segment + 1) * n / SEGMENTS) - 1
    parts = np.array([_summed(turn[inside & (segment == s)]) for s in range(SEGMENTS)])
    return (_summed(turn) + _summed(shift)) / TWO_PI, parts.std(0)


def series_pulsation(p: np.ndarray) -> dict[str, np.ndarray]:
    """``pulsation``."""
    dx, mean, deviation = series_steps(p)
    over = np.abs(dx) > mean + 2.0 * deviation
    up, down, count = _summed(np.where(over & (dx > 0), dx, 0.0)), _summed(np.where(over & (dx < 0), -dx, 0.0)), over.sum(0)
    return {"intensity": up + down, "asymmetry": (up - down) / (up + down + 1e-10), "power": (up + down) * count / len(p), "n_jumps": count, "sum_squares": _summed(p * p)}


def series_entropies(p: np.ndarray) -> dict[str, np.ndarray]:
    """``entropies``."""
    a = np.abs(p) + 1e-10
    c, s = (~np.isnan(a)).sum(0), _summed(a)
    q = _summed(a * a) / (s * s)
    return {"shannon": np.log(s) - _summed(a * np.log(a)) / s, "renyi_2": -np.log(q), "tsallis_15": (1 - _summed(a * np.sqrt(a)) / (s * np.sqrt(s))) / 0.5,
            "max": np.fmax.reduce(a) / s, "min": np.fmin.reduce(a) / s, "var": q / c - 1 / (c * c)}


# --- classes -------------------------------------------------------------------------

def classify(stats: DataFrame) -> DataFrame:
    """English class label from charge, stability and the matching feature's pulsation.

    ``power`` and ``asymmetry`` may be null where no feature belongs to the path.
    """
    q, sd, w, a = (F.col(c) for c in ("charge", "stability", "power", "asymmetry"))
    base = F.when(q < -0.5, "absorbing").when(q > 0.5, "emitting").otherwise("neutral")
    tags = F.array(
        F.when(sd > 2.5, "unstable").when(sd < 0.5, "very stable"),
        F.when(w > 5, "strong pulsation").when(w < 0.1, "static"),
        F.when((F.abs(a) > 0.7) & (a > 0), "upward").when(F.abs(a) > 0.7, "downward"),
    )
    return stats.withColumn("class", F.concat_ws("; ", base, F.filter(tags, lambda t: t.isNotNull())))
