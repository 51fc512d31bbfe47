"""Result tables on disk and a summary of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.quantile import percentiles
from tidewatch.operators import jumps as I
from tidewatch.operators.layout import IDX, LEN, SERIES
from tidewatch.plans.batch import Analysis


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean, deviation, extremes and 95th percentile of the score per series."""
    base = scores.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.max(score).alias("max"), F.min(score).alias("min"))
    p95 = percentiles(scores, [SERIES], score, {"p95": 0.95}).drop("n_values")
    return base.join(p95, SERIES)


def save_analysis(a: Analysis, scores: DataFrame, path: str, full: bool = False, by: str | None = None) -> list[str]:
    """Write one parquet table per kind of result below ``path``; returns their names.

    Tables are clustered by series within files; pass ``by`` to partition folders by a
    column with few values, as one folder per series does not scale.
    """
    rows = a.jumps.rows
    tables = {
        "scores": scores,
        "jump_rows": rows.filter("unified").select(SERIES, IDX, "importance", *[c for f in a.cols for c in (f"pos_{f}", f"neg_{f}", f"d_{f}")]),
        "jump_features": a.jumps.features, "sync_pairs": I.sync_matrix(a.jumps), "jump_clusters": I.clusters(a.jumps),
        "jump_summary": I.summary(a.jumps), "path_stats": a.path_stats, "windows": a.windows,
        "score_summary": score_summary(scores),
    }
    if full:
        tables["paths"] = a.rows
        tables["jump_measures"] = rows
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by and by in df.columns else writer).parquet(f"{path}/{name}")
    return sorted(tables)
