"""Queries that run the events as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import features as B, masks as G
from tidewatch.operators.layout import IDX, SERIES
from tidewatch.plans import tier0, tier2
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.catalog_masks import label_windows
from tidewatch.plans.registry import ORACLES, query
from tidewatch.session import shared_dir, stage
from tidewatch.sources.tables import event_series, table
from tidewatch.streaming import online as R


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.col("event_type").alias(SERIES), "ts", "event_id", F.col("value").alias("f0"))


def run(spark, sf, score, lookback, carry=()):
    job = R.OnlineJob(f"{shared_dir(spark)}/tidewatch/stream-{uuid.uuid4().hex}", ["f0"], ["ts", "event_id"], score, lookback, carry)
    q = job.start(event_stream(spark, sf), available_now=True)
    q.awaitTermination()
    job.finish(spark)
    return job.results(spark)


@query("stream_jump_vote", ORACLES["jump_vote"])
def stream_jump_vote(spark, sf):
    cfg = tier0.CausalConfig(scorers=("jump",))
    _, model = tier0.fit_predict(event_series(spark, sf), ["f0"], cfg)
    return out(run(spark, sf, R.causal_score(model, ["f0"], cfg), R.CAUSAL_LOOKBACK), "score", keys=(SERIES, IDX, "flag"))


LATE_SQL = """
SELECT event_type AS series_id, event_id FROM events
WHERE event_id % 2 = 1 AND ts < (SELECT max(ts) - INTERVAL 2 DAY FROM events WHERE event_id % 2 = 0)"""


@query("stream_late_rows", LATE_SQL)
def stream_late_rows(spark, sf):
    """All events in two batches, even ids first; odd ones from before the watermark then come too late."""
    score, lookback, carry = R.cusum_score(["f0"])
    folder = f"{shared_dir(spark)}/tidewatch/stream-{uuid.uuid4().hex}"
    job = R.OnlineJob(folder, ["f0"], ["ts", "event_id"], score, lookback, carry, delay="INTERVAL 2 DAYS")
    rows = table(spark, sf, "events").select(F.col("event_type").alias(SERIES), "ts", "event_id", F.col("value").alias("f0"))
    for epoch in (0, 1):
        job.process(rows.filter(F.col("event_id") % 2 == epoch), epoch)
    job.finish(spark)
    return job.late(spark).select(SERIES, "event_id")


@query("stream_cusum", ORACLES["drift_rolling_cusum"])
def stream_cusum(spark, sf):
    return out(run(spark, sf, *R.cusum_score(["f0"])), "drift")


FIVE = [f"f{i}" for i in range(5)]


def with_five(score):
    """The score over the five features of f0; the first rows of a frame only serve as their look-back."""
    return lambda frame: score(B.expand_5(frame))


@query("stream_causal_tier")
def stream_causal_tier(spark, sf):
    cfg = tier0.CausalConfig()
    _, model = tier0.fit_predict(B.expand_5(event_series(spark, sf)), FIVE, cfg, between=stage)
    score = with_five(R.causal_score(model, FIVE, cfg))
    return out(run(spark, sf, score, R.CAUSAL_LOOKBACK + B.WINDOW), "score", keys=(SERIES, IDX, "flag"))


@query("stream_regime_tier")
def stream_regime_tier(spark, sf):
    cfg = tier2.RegimeConfig(causal=tier0.CausalConfig(), margin=5)
    rows = G.anomaly_mask(B.expand_5(event_series(spark, sf)), label_windows(spark, sf))
    _, model = tier2.fit_predict(rows, FIVE, "is_anomaly", cfg)
    score = with_five(R.regime_score(model, FIVE, cfg.causal))
    return out(run(spark, sf, score, R.CAUSAL_LOOKBACK + B.WINDOW), "score", keys=(SERIES, IDX, "regime", "flag"))
