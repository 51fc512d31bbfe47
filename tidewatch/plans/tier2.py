"""Exclude known incidents, learn regimes of normal behaviour, vote with thresholds per regime."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.numeric import num
from tidewatch.operators import causal as C, masks as G, regimes as H, thresholds as D
from tidewatch.operators.layout import IDX, KEYS, LEN, SERIES, attach, long_form
from tidewatch.operators.scale import series_stats
from tidewatch.operators.vote import or_vote
from tidewatch.plans import tier0
from tidewatch.session import stage


@dataclass(frozen=True)
class RegimeConfig:
    causal: tier0.CausalConfig = field(default_factory=tier0.CausalConfig)
    regimes: int | None = None
    most: int = H.MAX_REGIMES
    margin: int = G.BASE_MARGIN
    adaptive_margin: bool = False
    min_frames: int = H.MIN_ROWS
    method: str = "trimmed_percentile"


@dataclass(frozen=True)
class RegimeModel:
    stats: DataFrame
    mixture: DataFrame
    bic: DataFrame
    fits: DataFrame
    subspace: DataFrame | None
    scales: DataFrame | None
    thresholds: DataFrame
    rejected: DataFrame


def _with_length(table: DataFrame, lengths: DataFrame) -> DataFrame:
    return table.drop(LEN).join(lengths, SERIES)


def with_jump(raw: DataFrame, scales: DataFrame | None, cfg: tier0.CausalConfig) -> DataFrame:
    if scales is None:
        return raw
    out = attach(raw, scales, cfg.chunk_rows)
    return out.withColumn("jump", C.jump_score({f"jump_{w}": F.col(f"thr_jump_{w}") for w in C.JUMP_WINDOWS}))


def vote_by_regime(raw: DataFrame, thresholds: DataFrame, cfg: tier0.CausalConfig) -> DataFrame:
    """Vote with the thresholds of each row's regime; there is no probation."""
    out = attach(raw, thresholds, cfg.chunk_rows, on=["regime"])
    return or_vote(out, {x: f"thr_{x}" for x in cfg.names()})


def fit_predict(df: DataFrame, cols: Sequence[str], mask: str, cfg: RegimeConfig = RegimeConfig()) -> tuple[DataFrame, RegimeModel]:
    """Scores of every row and the model.  Series with too few clean rows go to ``rejected``."""
    causal = cfg.causal
    rows, names = causal.chunk_rows, causal.names()
    base = df.select(*KEYS, IDX, LEN, mask, *cols)
    if cfg.adaptive_margin:
        marked = G.adaptive_mask(base.withColumn("_sig", sum((F.col(c) for c in cols), num(0)) / len(cols)), mask, "_sig", cfg.margin, rows=rows)[0].drop("_sig")
    else:
        marked = G.dilate(base, mask, cfg.margin, rows=rows)
    marked = stage(marked, "masked")
    guard = G.clean_counts(marked, min_frames=cfg.min_frames)
    rejected = guard.filter(~F.col("accepted"))
    usable = attach(marked, guard.select(SERIES, LEN, "accepted"), rows).filter("accepted").drop("accepted")
    stats = series_stats(usable, cols, ~F.col("masked"))
    z = stage(tier0.normalise(usable, stats, cols, causal), "normal")
    zs = [f"z_{c}" for c in cols]
    clean = stage(H.renumber(z, ~F.col("masked"), rows), "clean")
    mixture, bics = H.fit(clean, zs, cfg.regimes, cfg.most, cfg.min_frames, rows)
    lengths = guard.select(SERIES, LEN)
    clean_lengths = guard.select(SERIES, F.col("clean_rows").alias(LEN))

    feats = stage(tier0.window_features(H.predict(clean, _with_length(mixture, clean_lengths), zs, rows), cols, causal), "clean-features")
    every = F.lit(True)
    fits = stage(tier0.fit_rows(feats, cols, every, causal), "fits")
    subspace = stage(C.recon_fit(feats, zs, every, rows=rows), "subspace") if "recon" in names else None
    raw = stage(tier0.raw_scores(feats, fits, subspace, cols, causal, F.col(LEN)), "clean-raw")
    scales = None
    if "jump" in names:
        one = tier0.CausalConfig(scorers=("jump",), chunk_rows=rows, prob=causal.prob)
        scales = stage(tier0.fit_thresholds(raw, every, one, F.col(LEN)), "jump-scales")
    scored = with_jump(raw, scales, causal)
    sizes = scored.groupBy(SERIES, "regime").agg(F.max(LEN).alias(LEN), F.count(F.lit(1)).alias("regime_rows"))
    long = long_form(attach(scored, sizes, rows, on=["regime"]), names, "scorer", "raw", [*KEYS, LEN, "regime", "regime_rows"])
    per = D.regime_thresholds(long, method=cfg.method, min_frames=cfg.min_frames)
    thresholds = stage(
        per.groupBy(SERIES, "regime").agg(*[F.max(F.when(F.col("scorer") == x, F.col("threshold"))).alias(f"thr_{x}") for x in names])
        .join(lengths, SERIES), "regime-thresholds")

    full = stage(tier0.window_features(H.predict(z, _with_length(mixture, lengths), zs, rows), cols, causal), "features")
    full_raw = tier0.raw_scores(
        full, _with_length(fits, lengths), _with_length(subspace, lengths) if subspace is not None else None, cols, causal, F.col(LEN))
    full_raw = with_jump(full_raw, _with_length(scales, lengths) if scales is not None else None, causal)
    voted = vote_by_regime(full_raw, thresholds, causal)
    keep = [*KEYS, IDX, LEN, "masked", "regime", "score", "flag", *names]
    return voted.select(*keep), RegimeModel(stats, mixture, bics, fits, subspace, scales, thresholds, rejected)
