"""Queries over regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import rounded
from tidewatch.operators import regimes as H, vote as V
from tidewatch.operators.layout import CHUNK, IDX, LEN, SERIES, attach
from tidewatch.plans import tier0, tier2
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.catalog_masks import label_windows
from tidewatch.plans.catalog_paths import GIVEN, XS, given
from tidewatch.plans.registry import query
from tidewatch.plans.sql import DAILY, r, with_
from tidewatch.operators import features as B, masks as G
from tidewatch.sources.tables import event_series


@query("renumber_clean", with_(DAILY) + "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS idx, count(*) OVER (PARTITION BY series_id) AS n, f0 FROM daily WHERE f0 <= 60")
def renumber_clean(spark, sf):
    from tidewatch.sources.tables import daily_series

    return H.renumber(daily_series(spark, sf), F.col("f0") <= 60).select(SERIES, IDX, LEN, "f0")


@query("vote_by_regime", with_(DAILY, GIVEN, """g AS (SELECT series_id, idx, CAST(CASE WHEN x0 > 0.5 THEN 2 WHEN x0 > -0.5 THEN 1 ELSE 0 END AS INTEGER) AS regime, abs(x1) AS a, abs(x2) AS b FROM given),
t AS (SELECT series_id, regime, quantile_cont(a, 0.95) AS ta, quantile_cont(b, 0.95) AS tb FROM g GROUP BY 1, 2)""")
       + f"SELECT series_id, idx, regime, {r('greatest(0, a / (ta + 1e-12), b / (tb + 1e-12))', 'score')} FROM g JOIN t USING (series_id, regime)")
def vote_by_regime(spark, sf):
    x0 = F.col("x0")
    df = given(spark, sf).withColumn("regime", F.when(x0 > 0.5, 2).when(x0 > -0.5, 1).otherwise(0)).withColumn("a", F.abs("x1")).withColumn("b", F.abs("x2"))
    t = df.groupBy(SERIES, "regime").agg(F.max(LEN).alias(LEN), F.percentile("a", F.lit(0.95)).alias("thr_a"), F.percentile("b", F.lit(0.95)).alias("thr_b"))
    return out(V.or_vote(attach(df, t, on=["regime"]), {"a": "thr_a", "b": "thr_b"}), "score", keys=(SERIES, IDX, "regime"))


@query("regime_fit")
def regime_fit(spark, sf):
    model, _ = H.fit(given(spark, sf), XS)
    return model.select(SERIES, LEN, "k", F.posexplode("weights").alias("regime", "weight"))


@query("regime_bic")
def regime_bic(spark, sf):
    return H.fit(given(spark, sf), XS)[1]


@query("regime_predict")
def regime_predict(spark, sf):
    df = given(spark, sf)
    return H.predict(df, H.fit(df, XS)[0], XS).select(SERIES, IDX, "regime")


def regime_events(spark, sf):
    series = event_series(spark, sf)
    return G.anomaly_mask(B.expand_5(series), label_windows(spark, sf))


@query("regime_tier")
def regime_tier(spark, sf):
    cfg = tier2.RegimeConfig(causal=tier0.CausalConfig(), margin=5)
    scores, _ = tier2.fit_predict(regime_events(spark, sf), [f"f{i}" for i in range(5)], "is_anomaly", cfg)
    return out(scores, "score", keys=(SERIES, IDX, "regime", "flag"))


@query("regime_tier_adaptive")
def regime_tier_adaptive(spark, sf):
    cfg = tier2.RegimeConfig(causal=tier0.CausalConfig(), adaptive_margin=True)
    scores, _ = tier2.fit_predict(regime_events(spark, sf), [f"f{i}" for i in range(5)], "is_anomaly", cfg)
    return out(scores, "score", keys=(SERIES, IDX, "regime", "flag"))
