"""Batch analysis: jumps, paths, their statistics and the fused score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.kernels import ENSEMBLE
from tidewatch.functions.numeric import num
from tidewatch.operators import batch_scores as L, fusion as FU, jumps as I, paths as K, profile as N, scale as S
from tidewatch.operators.fusion import DEFAULT_WEIGHTS
from tidewatch.operators.layout import CHUNK_ROWS, IDX, KEYS, LEN, SERIES
from tidewatch.session import stage, unstage

#: Rows of a series that one task analyses; longer ones are analysed by chunks.
IN_TASK = 1 << 16
# fixed values: windows and percentiles of the five jump scales
JUMP_SCALES = ((3, 0.75), (5, 0.80), (10, 0.85), (20, 0.90), (40, 0.93))


@dataclass(frozen=True)
class Analysis:
    """Tables of a batch analysis."""

    rows: DataFrame
    jumps: I.Jumps
    paths: tuple[str, ...]
    path_stats: DataFrame
    windows: DataFrame
    cols: tuple[str, ...]


def analyse(
    df: DataFrame, cols: Sequence[str], n_paths: int = 7, n_steps: int = 3, sparse: bool = True,
    rows: int = CHUNK_ROWS,
) -> Analysis:
    """Windows from the data, jumps, refined paths and the figures of every path.

    Series of up to ``IN_TASK`` rows take all steps after one shuffle, many to a task; longer ones take the jobs of each
    operator.  Both ways take the same steps.
    """
    cols = tuple(cols)
    names = [f"p{k}" for k in range(min(n_paths, len(cols)))]
    df = stage(df.select(*KEYS, IDX, LEN, *cols), "batch-input")
    long = df.filter(F.col(LEN) > IN_TASK)
    all_short = long.isEmpty()
    # rows and figures are read from one table: the figures of a series are held by its first row
    found = stage(_analysed_in_task(df.filter(F.col(LEN) <= IN_TASK), cols, names, n_steps, sparse), "analysed")
    refined, held = found.drop("figures"), found.filter("figures IS NOT NULL")
    measured = I.flagged(refined.select(*KEYS, IDX, LEN, *cols), cols)
    features, figures = held.select(SERIES, LEN, F.inline("figures.features")), held.select(SERIES, LEN, F.inline("figures.paths"))
    if all_short:
        unstage(df)
    else:
        far = _analysed_by_jobs(long, cols, n_paths, n_steps, sparse, rows)
        refined, measured = refined.unionByName(far[0].select(*refined.columns)), measured.unionByName(far[1].rows.select(*measured.columns))
        features, figures = features.unionByName(far[1].features), figures.unionByName(far[2].select(*figures.columns))
    windows = N.window_sizes(N.volatility(refined, cols))
    labelled = K.classify(figures.withColumnsRenamed({"power": "p_power", "asymmetry": "p_asym"})
                          .withColumnsRenamed({"f_power": "power", "f_asym": "asymmetry"}))
    path_stats = stage(labelled.drop("power", "asymmetry").withColumnsRenamed({"p_power": "power", "p_asym": "asymmetry"}), "path-stats")
    return Analysis(refined, I.Jumps(measured, features, cols), tuple(names), path_stats, windows, cols)


def _analysed_by_jobs(df: DataFrame, cols: tuple[str, ...], n_paths: int, n_steps: int, sparse: bool, rows: int) -> tuple[DataFrame, I.Jumps, DataFrame]:
    """Rows with their paths, jumps, and the figures of every path with those of the feature of its number (``f_``)."""
    jumps = I.detect(df, cols, rows=rows)
    start, names = K.spectral_paths(jumps.rows.select(*KEYS, IDX, LEN, *cols, "unified", "importance", "hits"), cols, n_paths, unit=False, rows=rows)
    start = K.key_rows(start, rows=rows) if sparse else start
    refined = stage(K.refine_paths(start, cols, names, jumps=not sparse, sparse=sparse, n_steps=n_steps, rows=rows), "paths")
    key = [SERIES, "path"]
    pulses = K.pulsation(refined, names, rows)
    feature = jumps.features.withColumn("path", F.concat(F.lit("p"), F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")) - 1))
    stats = (
        K.topology(refined, names, jumps=True, rows=rows)
        .join(K.energy(pulses, jumps.features), key).join(K.entropies(refined, names), key)
    )
    own = feature.select(SERIES, "path", F.col("power").alias("f_power"), F.col("asymmetry").alias("f_asym"))
    return refined, jumps, stats.join(own, key, "left")


FEATURE_FIGURES = ("threshold", "n_jumps", "n_local", "intensity", "asymmetry", "power")
PATH_FIGURES = ("charge", "stability", "intensity", "asymmetry", "power", "n_jumps", "sum_squares", "energy", *K.ENTROPIES, "f_power", "f_asym")


def _kind(names: Sequence[str]) -> str:
    return ",".join(f"{n}:{'bigint' if n in ('n_jumps', 'n_local') else 'double'}" for n in names)


def _listed(name: str, own: Sequence[str], names: Sequence[str], found: dict[str, np.ndarray]) -> list[dict]:
    """A struct per feature or path; NaN is null."""
    values = {n: [None if v != v else v for v in np.asarray(found[n]).tolist()] for n in names}
    return [{name: o, **{n: v[j] for n, v in values.items()}} for j, o in enumerate(own)]


def _analysed_in_task(df: DataFrame, cols: tuple[str, ...], names: Sequence[str], n_steps: int, sparse: bool) -> DataFrame:
    role = ["role"] if sparse else []
    figures = f"struct<features:array<struct<feature:string,{_kind(FEATURE_FIGURES)}>>,paths:array<struct<path:string,{_kind(PATH_FIGURES)}>>>"
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(
        "unified boolean, importance double, hits double, " + "".join(f"{r} string, " for r in role) + "".join(f"{p} double, " for p in names) + f"figures {figures}").fields)
    kind, new = to_arrow_type(schema["figures"].dataType), schema.names[len(df.columns):]

    def solve(group: pa.Table) -> pa.Table:
        x, idx = matrix(group, cols), group.column(IDX).to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            flags = I.series_flags(I.fixed_measures(x, I.DIFF_PROB, I.LOCAL_PROB))
            unified, importance = flags["hits"] > 0, flags["hits"] / len(cols)
            roles = K.series_roles(idx, unified) if sparse else None
            moved = 0.0 if sparse else np.where(unified, -importance, 0.1)
            p = K.descend(x, K.series_start(x, len(names)), K.descents(), n_steps, 0.02, moved, roles == "diagonal" if sparse else None)
            charge, stability = K.series_topology(p, unified)
            pulse = K.series_pulsation(p)
            each = {"charge": charge, "stability": stability, **pulse, "energy": pulse["sum_squares"] + 0.3 * flags["power"].mean(), **K.series_entropies(p),
                    "f_power": flags["power"][: len(names)], "f_asym": flags["asymmetry"][: len(names)]}
        first = {"features": _listed("feature", cols, FEATURE_FIGURES, flags), "paths": _listed("path", names, PATH_FIGURES, each)}
        added = [unified, importance, flags["hits"], *([roles] if sparse else []), *p.T]
        for name, value in zip(new, added):
            group = group.append_column(name, pa.array(value, from_pandas=True))
        return group.append_column("figures", pa.array([first] + [None] * (len(x) - 1), kind))

    return per_group(df, [SERIES], [IDX], solve, schema)


def fuse(a: Analysis, rows: int = CHUNK_ROWS, adaptive: bool = False) -> DataFrame:
    """Final batch score per row, with its four components.

    ``adaptive`` lets every series learn its weights from its clear rows.

    Jump scales and kernels enter by their maximum; the weighted sum is not standardised
    first.  It is then compressed, strengthened or damped on jumps, and standardised.
    Series whose pairs fit a task take their components there, after one shuffle.
    """
    parts = _fused_in_task(a)
    long = a.rows.filter(F.col(LEN) > L.IN_TASK)
    if not long.isEmpty():
        parts = parts.unionByName(_fused_by_jobs(a, long, rows))
    if adaptive:
        parts = FU.adaptive(stage(parts, "components"), DEFAULT_WEIGHTS)
    else:
        parts = parts.withColumn("score", sum((num(w) * F.col(c) for c, w in DEFAULT_WEIGHTS.items()), num(0)))
    scored = stage(parts.withColumn("score", S.power(F.col("score"))), "fused")
    rescored = I.rescore(scored, I.clusters(I.Jumps(scored, a.jumps.features, a.cols), rows=rows), rows=rows)
    return S.adaptive(rescored, "score").select(*KEYS, IDX, LEN, *DEFAULT_WEIGHTS, "score")


#: What the last steps of ``fuse`` need of a row beside its components.
CARRIED = ("unified", "importance", "hits")


def _fused_by_jobs(a: Analysis, long: DataFrame, rows: int) -> DataFrame:
    ids = [*KEYS, IDX]
    stats = a.path_stats.filter(F.col(LEN) > L.IN_TASK)
    base = long.select(*ids, LEN, *a.cols)
    scales = None
    for i, (window, prob) in enumerate(JUMP_SCALES):
        tuned = I.detect_tuned(base, a.cols, window, prob, rows=rows)
        s = stage(I.batch_score(tuned, rows).select(*ids, F.col("jump_score").alias(f"_j{i}")), "jump-scale")
        scales = s if scales is None else scales.join(s, ids)
    jump = scales.select(*ids, F.greatest(*[f"_j{i}" for i in range(len(JUMP_SCALES))]).alias("jump"))
    hybrid = L.hybrid_score(long, a.cols, a.paths, stats, rows=rows)
    structural = L.structural_score(hybrid, a.paths, stats, rows)
    kernel = L.kernel_errors(structural, a.cols, a.paths, ENSEMBLE, rows=rows)
    kernel = kernel.withColumn("kernel", F.greatest(*[f"kernel_{i}" for i in range(len(ENSEMBLE))]))
    return kernel.join(jump, ids).select(*ids, LEN, *CARRIED, *DEFAULT_WEIGHTS)


def _fused_in_task(a: Analysis) -> DataFrame:
    used = ("charge", "stability", "intensity", "asymmetry", "power")
    ids = [*KEYS, IDX, LEN]
    # the figures of a series come to its rows as a row before the first
    figures = a.path_stats.filter(F.col(LEN) <= L.IN_TASK).groupBy(SERIES).agg(F.collect_list(F.struct("path", *used)).alias("figures"))
    own = a.rows.filter(F.col(LEN) <= L.IN_TASK).select(*ids, *CARRIED, *a.cols, *a.paths)
    a_cols, a_paths, kept = list(a.cols), list(a.paths), [*ids, *CARRIED]
    both = own.unionByName(figures.withColumn(IDX, F.lit(-1).cast("long")), allowMissingColumns=True)

    def solve(group: pa.Table) -> pa.Table:
        by_path = {f["path"]: f for f in group.column("figures")[0].as_py()}
        stats = {name: np.array([by_path[p][name] for p in a_paths], dtype=float) for name in used}
        group = group.slice(1)
        x, p = matrix(group, a_cols), matrix(group, a_paths)
        jump = np.zeros(len(x))
        with np.errstate(divide="ignore", invalid="ignore"):
            for window, prob in JUMP_SCALES:
                found = I.tuned_measures(x, *I.tuned_windows(x, window, prob))
                jump = np.maximum(jump, I.series_score(found["d"], I.series_flags(found)))
            kernel = np.maximum.reduce([L.series_kernel_error(k, x, p) for k in ENSEMBLE])
            parts = {"jump": jump, "hybrid": L.series_hybrid(x, p, stats), "structural": L.series_structure(p, stats["charge"])}
        group = group.select(kept)
        for name in DEFAULT_WEIGHTS:
            group = group.append_column(name, pa.array(kernel) if name == "kernel" else pa.array(parts[name], from_pandas=True))
        return group

    schema = T.StructType([own.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in DEFAULT_WEIGHTS])
    return per_group(both, [SERIES], [IDX], solve, schema)
