"""Calibrate on the start of every series, then score the rest causally."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.functions import trailing
from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.numeric import mean_of, num
from tidewatch.functions.quantile import percentiles
from tidewatch.operators import causal as C
from tidewatch.operators.jumps import percentile
from tidewatch.operators.layout import CHUNK_ROWS, IDX, KEYS, LEN, SERIES, attach, home, long_form, with_halo
from tidewatch.operators.scale import CAL_RATIO, MIN_CAL, calibration_end, series_stats
from tidewatch.operators.vote import or_vote
from tidewatch.session import stage

#: Rows of a series that one task scores; longer ones are scored by chunks.
IN_TASK = 1 << 16
#: Values from here on could overflow in the cubes of the kernel.
LARGEST = 1e25


@dataclass(frozen=True)
class CausalConfig:
    """Settings of the causal tier; immutable, passed along, never global."""

    scorers: tuple[str, ...] = C.SCORERS
    extra: dict[str, C.UserScorer] = field(default_factory=dict)
    ratio: float = CAL_RATIO
    min_cal: int = MIN_CAL
    prob: float = 0.99
    normalize: bool = True
    chunk_rows: int = CHUNK_ROWS
    freeze_scales: bool = False
    orientation: str = "oldest"

    def names(self) -> list[str]:
        return C.choose_scorers(self.scorers, self.extra)


@dataclass(frozen=True)
class CausalModel:
    """Frozen calibration: one row per series, plus the delay-vector subspaces."""

    stats: DataFrame
    fits: DataFrame
    subspace: DataFrame | None
    thresholds: DataFrame


MODEL_PARTS = ("stats", "fits", "subspace", "thresholds")


def normal_columns(cols: Sequence[str], normalize: bool) -> list[Column]:
    """``z_j`` (normalised features), ``k_j`` (normalised again for the kernel), ``sig``."""
    out = []
    for c in cols:
        sd = F.col(f"{c}_sd")
        z = (F.col(c) - F.col(f"{c}_mu")) / (sd + num(1e-10)) if normalize else F.col(c)
        k = z / (sd / (sd + num(1e-10)) + num(1e-10)) if normalize else (
            (F.col(c) - F.col(f"{c}_mu")) / (sd + num(1e-10)))
        out += [z.alias(f"z_{c}"), k.alias(f"k_{c}")]
    return out


def normalise(df: DataFrame, stats: DataFrame, cols: Sequence[str], cfg: CausalConfig) -> DataFrame:
    base = attach(df, stats, cfg.chunk_rows)
    out = base.select(*[c for c in df.columns], *normal_columns(cols, cfg.normalize))
    return out.withColumn("sig", mean_of([f"z_{c}" for c in cols]))


def window_features(df: DataFrame, cols: Sequence[str], cfg: CausalConfig) -> DataFrame:
    """All look-back columns that need no fitted model, in one pass over the chunks.

    A chunk's windows are taken at once within its task, value by value as by the columns of each scorer; nulls are left out.
    """
    names = cfg.names()
    zs = [f"z_{c}" for c in cols]
    wide = with_halo(df, back=C.LOOKBACK, rows=cfg.chunk_rows)
    added = [f"jump_{w}" for w in C.JUMP_WINDOWS] if "jump" in names else []
    added += [new for scorer, new in (("struct", "step"), ("drift", "local")) if scorer in names]
    added += [f"grad_{w}" for w in C.GRADUAL_WINDOWS] if "gradual" in names else []
    if not added:
        return home(wide)
    schema = T.StructType([f for f in wide.schema.fields if f.name != "home"] + [T.StructField(c, T.DoubleType()) for c in added])

    def features(group: pa.Table) -> pa.Table:
        own, idx, sig = group.column("home"), group.column(IDX).to_numpy(), matrix(group, ["sig"])[:, 0]
        known = group.column("sig").is_valid().to_numpy()
        group = group.drop_columns("home")
        with np.errstate(all="ignore"):
            found = {}
            if "jump" in names:
                for w in C.JUMP_WINDOWS:
                    value, null = C.jump_of_rows(sig, known, w)
                    found[f"jump_{w}"] = np.where(idx >= 2, value, 0.0), null & (idx >= 2)
            if "struct" in names:
                there = np.logical_and.reduce([group.column(c).is_valid().to_numpy() for c in zs])
                found["step"] = C.step_of_rows(matrix(group, zs), there, idx)
            if "drift" in names:
                count, total = trailing.sums(sig, known, C.DRIFT_WINDOW)
                found["local"] = total / count, (count == 0) | (idx + 1 < C.DRIFT_MIN)
            if "gradual" in names:
                found |= {f"grad_{w}": (v, np.isnan(v)) for w, v in C.series_gradual(sig, idx, C.GRADUAL_WINDOWS, cfg.orientation).items()}
        for c in added:
            value, null = found[c]
            group = group.append_column(c, pa.array(value, mask=null))
        return group.filter(own)

    return per_group(wide, KEYS, [IDX], features, schema)


def fit_rows(df: DataFrame, cols: Sequence[str], rows: Column, cfg: CausalConfig) -> DataFrame:
    """One grouped aggregate: everything the scorers keep from the calibration rows."""
    names = cfg.names()
    aggs = [F.max(LEN).alias(LEN), F.avg(F.when(rows, F.col("sig"))).alias("base")]
    if "kernel" in names:
        aggs += C.kernel_fit([f"k_{c}" for c in cols], rows)
    if "struct" in names:
        aggs += C.struct_fit(rows)
    return df.groupBy(SERIES).agg(*aggs)


def raw_scores(
    df: DataFrame, fits: DataFrame, subspace: DataFrame | None, cols: Sequence[str], cfg: CausalConfig,
    cal_rows: Column,
) -> DataFrame:
    """Raw score columns from the look-back columns and the fitted model.

    ``cal_rows`` is the number of calibration rows, which decides the usable scales.
    """
    names = cfg.names()
    out = attach(df, fits, cfg.chunk_rows)
    if "gradual" in names:
        length = cal_rows if cfg.freeze_scales else F.col(LEN)
        out = out.withColumn("gradual", C.gradual_score(length)).withColumn("gradual_cal", C.gradual_score(cal_rows))
    if "drift" in names:
        out = out.withColumn("drift", F.coalesce(F.abs(F.col("local") - F.col("base")), num(0)))
    if "kernel" in names:
        out = out.withColumn("kernel", C.kernel_distance([f"k_{c}" for c in cols]))
    if "struct" in names:
        out = out.withColumn("struct", C.struct_score())
    drop = ["centroid", "base", "local", "step", *[f"grad_{w}" for w in C.GRADUAL_WINDOWS]]
    out = out.drop(*[c for c in drop if c in out.columns])
    if "recon" in names:
        out = C.recon_score(out, subspace, [f"z_{c}" for c in cols], rows=cfg.chunk_rows)
    for name, scorer in sorted(cfg.extra.items()):
        if name in names:
            out = scorer(out)
    return out


def threshold_inputs(names: Sequence[str], cal_rows: Column) -> dict[str, Column]:
    """Per threshold name, the value of a calibration row or null when it does not count."""
    out: dict[str, Column] = {}
    for name in names:
        if name == "jump":
            for w in C.JUMP_WINDOWS:
                out[f"jump_{w}"] = F.when((F.col(f"jump_{w}") > 0) & (cal_rows > w), F.col(f"jump_{w}"))
        elif name == "gradual":
            out[name] = F.when(F.col("gradual_cal") > 0, F.col("gradual_cal"))
        elif name == "struct":
            out[name] = F.when((F.col(IDX) >= C.DELAY) & F.col("struct_mu").isNotNull(), F.col("struct"))
        else:
            # a trailing mean that equals the baseline differs from it by rounding only,
            # so "positive" means above 1e-12 for every scorer here
            out[name] = F.when(F.col(name) > 1e-12, F.col(name))
    return out


def fit_thresholds(scored: DataFrame, rows: Column, cfg: CausalConfig, cal_rows: Column) -> DataFrame:
    """One row per series with ``thr_<name>``; all scorers share one percentile job."""
    values = threshold_inputs(cfg.names(), cal_rows)
    wide = scored.filter(rows).select(*KEYS, LEN, *[v.alias(k) for k, v in values.items()])
    long = long_form(wide, list(values), "scorer", "raw", [*KEYS, LEN])
    q = percentiles(long, [SERIES, "scorer"], "raw", {"q": cfg.prob}, carry=LEN)
    enough = (F.col("n_values") > 5) | (F.col("scorer") == "struct")
    thresholds = [
        F.max(F.when((F.col("scorer") == k) & enough, F.col("q"))).alias(f"thr_{k}") for k in values
    ]
    return q.groupBy(SERIES, LEN).agg(*thresholds)


def vote(scored: DataFrame, thresholds: DataFrame, active: Column | None, cfg: CausalConfig) -> DataFrame:
    names = cfg.names()
    out = attach(scored, thresholds, cfg.chunk_rows)
    if "jump" in names:
        scales = {f"jump_{w}": F.col(f"thr_jump_{w}") for w in C.JUMP_WINDOWS}
        out = out.withColumn("jump", C.jump_score(scales)).withColumn("thr_jump", num(1))
    return or_vote(out, {x: f"thr_{x}" for x in names}, active)


def _score_in_task(df: DataFrame, cols: Sequence[str], cfg: CausalConfig) -> DataFrame:
    """Scores of whole series after one shuffle, with the model of a series at its first row."""
    names, scales = cfg.names(), list(threshold_inputs(cfg.names(), F.col("cal_end")))
    fitted = {"stats": [f"{c}_{s}" for c in cols for s in ("mu", "sd")], "fits": ["base"], "subspace": [], "thresholds": [f"thr_{s}" for s in scales]}
    lists = {"fits": [], "subspace": []}
    if "kernel" in names:
        lists["fits"].append("centroid")
    if "struct" in names:
        fitted["fits"] += ["struct_mu", "struct_sd"]
    if "recon" in names:
        lists["subspace"] += ["mean", "basis"]
    kind = ",".join(f"{part}:struct<n:bigint,{','.join([f'{c}:double' for c in own] + [f'{c}:array<double>' for c in lists.get(part, [])])}>"
                    for part, own in fitted.items() if own or lists.get(part))
    schema = T.StructType(df.drop(*cols).schema.fields + T.StructType.fromDDL(
        f"score double, flag int, {''.join(f'{x} double, ' for x in names)}model struct<{kind}>").fields)
    model_type = to_arrow_type(schema["model"].dataType)

    def solve(group: pa.Table) -> pa.Table:
        cal = group.column("cal_end")[0].as_py()
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            raw, score, found = series_scores(matrix(group, cols), cal, cols, cfg)
        active = np.arange(group.num_rows) >= cal
        score = np.where(active, score, 0.0)
        out = group.drop_columns(list(cols)).append_column("score", pa.array(score)).append_column("flag", pa.array((score >= 1).astype(np.int32)))
        for x in names:
            out = out.append_column(x, pa.array(np.where(active, raw[x], 0.0)))
        found = {k: None if v is None or np.ndim(v) == 0 and v != v else np.asarray(v).tolist() for k, v in found.items()}
        model = {part: {LEN: group.num_rows, **{c: found.get(c) for c in [*own, *lists.get(part, [])]}} for part, own in fitted.items()}
        return out.append_column("model", pa.array([model] + [None] * (group.num_rows - 1), model_type))

    return per_group(df, [SERIES], [IDX], solve, schema)


def series_scores(x: np.ndarray, cal: int, cols: Sequence[str], cfg: CausalConfig) -> tuple[dict, np.ndarray, dict]:
    """Raw scores of one whole series, the vote on every row, and the model; ``cal`` rows calibrate.

    A model entry that a series is too short for is left out, None or NaN.
    """
    names, n = cfg.names(), len(x)
    if not cal:  # a single row
        return {s: np.zeros(n) for s in names}, np.zeros(n), {}
    mu, sd = x[:cal].mean(0), x[:cal].std(0)
    found = {f"{c}_{s}": v[j] for s, v in (("mu", mu), ("sd", sd)) for j, c in enumerate(cols)}
    unit = (x - mu) / (sd + 1e-10)
    z, k = (unit, unit / (sd / (sd + 1e-10) + 1e-10)) if cfg.normalize else (x, unit)
    sig = sum(z.T[1:], z[:, 0]) / len(cols)
    found["base"] = sig[:cal].mean()
    raw, values, ratios = {}, {}, []
    if "jump" in names:
        jumps = {w: C.series_jump(sig, w) for w in C.JUMP_WINDOWS}
        values |= {f"jump_{w}": v[:cal][v[:cal] > 0] if cal > w else v[:0] for w, v in jumps.items()}
    if "gradual" in names:
        trends = C.series_gradual(sig, np.arange(n), C.GRADUAL_WINDOWS, cfg.orientation)

        def slope(length: int) -> np.ndarray:
            return np.maximum.reduce([np.zeros(n), *[np.nan_to_num(v, posinf=np.inf) for w, v in trends.items() if length > w]])

        raw["gradual"], ahead = slope(cal if cfg.freeze_scales else n), slope(cal)[:cal]
        values["gradual"] = ahead[ahead > 0]
    if "drift" in names:
        raw["drift"] = C.series_drift(sig, found["base"])
    if "recon" in names:
        found["mean"], found["basis"] = C.series_subspace(z[:cal])
        raw["recon"] = C.series_residual(z, found["mean"], found["basis"])
    if "kernel" in names:
        raw["kernel"] = np.zeros(n)
        if cal >= 5:
            raw["kernel"], found["centroid"] = C.series_kernel(k, cal)
    if "struct" in names:
        step = C.series_step(z)
        used = step[C.DELAY:cal][step[C.DELAY:cal] > 1e-12]
        enough = len(used) >= 5 and cal >= C.DELAY + 2
        if enough:
            found["struct_mu"], found["struct_sd"] = used.mean(), used.std() + 1e-10
        raw["struct"] = np.abs(step - found.get("struct_mu", 0.0)) / found.get("struct_sd", 1.0)
        values["struct"] = raw["struct"][C.DELAY:cal] if enough else step[:0]
    values |= {s: v[:cal][v[:cal] > 1e-12] for s, v in raw.items() if s not in values}
    for s, v in values.items():
        found[f"thr_{s}"] = percentile(v, cfg.prob) if len(v) > 5 or s == "struct" else np.nan
    if "jump" in names:
        found_scales = [(v, found[f"thr_jump_{w}"]) for w, v in jumps.items()]
        raw["jump"] = np.maximum.reduce([np.zeros(n), *[v / (t + 1e-12) for v, t in found_scales if t > 0]])
    for s, v in raw.items():
        t = 1.0 if s == "jump" else found[f"thr_{s}"]
        if t > 0:
            ratios.append(v / (t + 1e-12))
    return raw, np.maximum.reduce([np.zeros(n), *ratios]), found


def _aside(df: DataFrame, cols: Sequence[str]) -> Column:
    """Rows of series that are not scored within a task: long ones, and those with values that are missing or beyond all bounds."""
    odd = F.col(SERIES).isNull() | (F.col(LEN) > IN_TASK) | ((F.col("cal_end") < 1) & (F.col(LEN) > 1))
    for c in cols:
        odd |= ~F.coalesce(F.abs(F.col(c)) < LARGEST, F.lit(False))
    return odd


def fit_predict(df: DataFrame, cols: Sequence[str], cfg: CausalConfig = CausalConfig(), between=lambda f, name: f):
    """Scores and the frozen model for every series of an indexed frame.

    ``between`` is applied to the frames that several later steps read; pass
    ``session.stage`` to write them once instead of computing them again.  Series of up to ``IN_TASK`` rows take all
    steps within a task, after one shuffle; longer ones, and all if there are scorers of the user's own, take the jobs of
    each step.  Both ways take the same steps.
    """
    df = df.withColumn("cal_end", calibration_end(cfg.ratio, cfg.min_cal)).select(*KEYS, IDX, LEN, "cal_end", *cols)
    if any(x in cfg.names() for x in cfg.extra):
        return _fit_predict_by_jobs(df, cols, cfg, between)
    df = stage(df, "tier-input")
    aside = df.filter(_aside(df, cols)).groupBy(SERIES).agg(F.max(LEN).alias(LEN))
    if aside.isEmpty():
        return _fit_predict_in_task(df, cols, cfg, between)
    marked = stage(attach(df, aside.withColumn("_aside", F.lit(True)), cfg.chunk_rows), "tier-marked")
    far = F.col(SERIES).isNull() | F.col("_aside").isNotNull()
    a, b = (way(marked.filter(rows).drop("_aside"), cols, cfg, between) for way, rows in ((_fit_predict_in_task, ~far), (_fit_predict_by_jobs, far)))
    parts = [x if x is None else x.unionByName(y) for x, y in ((getattr(a[1], p), getattr(b[1], p)) for p in MODEL_PARTS)]
    return a[0].unionByName(b[0]), CausalModel(*parts)


def _fit_predict_in_task(df: DataFrame, cols: Sequence[str], cfg: CausalConfig, between) -> tuple[DataFrame, CausalModel]:
    found = between(_score_in_task(df, cols, cfg), "scored")
    held = found.filter("model IS NOT NULL").select(SERIES, "model")
    parts = [held.select(SERIES, f"model.{p}.*") if p != "subspace" or "recon" in cfg.names() else None for p in MODEL_PARTS]
    return found.drop("model"), CausalModel(*parts)


def _fit_predict_by_jobs(df: DataFrame, cols: Sequence[str], cfg: CausalConfig, between) -> tuple[DataFrame, CausalModel]:
    rows, cal_rows = F.col(IDX) < F.col("cal_end"), F.col("cal_end")
    stats = series_stats(df, cols, rows)
    z = normalise(df.select(*KEYS, IDX, LEN, "cal_end", *cols), stats, cols, cfg)
    feats = between(window_features(z, cols, cfg), "features")
    fits = fit_rows(feats, cols, rows, cfg)
    subspace = None
    if "recon" in cfg.names():
        subspace = C.recon_fit(feats, [f"z_{c}" for c in cols], rows, rows=cfg.chunk_rows)
    scored = between(raw_scores(feats, fits, subspace, cols, cfg, cal_rows), "raw")
    thresholds = fit_thresholds(scored, rows, cfg, cal_rows)
    voted = vote(scored, thresholds, ~rows, cfg)
    keep = [*KEYS, IDX, LEN, "cal_end", "score", "flag", *cfg.names()]
    return voted.select(*keep), CausalModel(stats, fits, subspace, thresholds)
