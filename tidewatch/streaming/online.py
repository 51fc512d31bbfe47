"""Scoring of unordered, late streams with a frozen model.

Every scorer looks back a bounded number of rows, so what a stream must remember per
series is its last rows.  Each micro-batch is scored by the same column expressions as a
batch, over those rows plus the newly complete ones, and is spread over chunks like a
batch: a series that sends most of the data does not end up in one task.

Rows wait until their time is before the event-time watermark and are then numbered in
``(time, tie-break)`` order.  Rows that arrive with a time before the watermark go to a side
table; a row with exactly the watermark's time is still in time.  ``finish`` ends a stream:
it scores the rows that still wait.
State is kept per series: an epoch writes the last rows of the series that it touched and reads those of
the series that it needs, the newest of each; a series without new rows costs nothing.  Every
``compact`` epochs the newest states are written together, without series whose last row is older than
``expire`` before the watermark: such a series starts anew if it comes back.  State and results belong to
their epoch; a repeated epoch reads what was there before it and overwrites its own files, so results are
written exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields as fields_of

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import causal as C, drift as J, regimes as H
from tidewatch.operators.layout import CHUNK, CHUNK_ROWS, IDX, LEN, SERIES, attach, chunk_of, index_series
from tidewatch.plans import tier0, tier2
from tidewatch.session import stage

Score = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class OnlineJob:
    """Where a stream keeps its state, how far back it looks and how long it waits.

    ``score`` maps a frame with ``series_id, idx, n, chunk`` and the value columns to rows
    with ``idx`` and score columns.  ``order`` is the event-time column and a tie-break.
    """

    folder: str
    cols: Sequence[str]
    order: Sequence[str]
    score: Score
    lookback: int
    carry: Sequence[str] = ()
    delay: str = "INTERVAL 0 SECONDS"
    chunk_rows: int = CHUNK_ROWS
    compact: int = 32
    expire: str | None = None

    def _path(self, kind: str, epoch: int) -> str:
        return f"{self.folder}/{kind}/epoch={epoch}"

    def _state(self, spark: SparkSession, kind: str, epoch: int, schema: str) -> DataFrame:
        """State left by the epoch before, empty at the start."""
        if epoch == 0:
            return spark.createDataFrame([], schema)
        return spark.read.parquet(self._path(kind, epoch - 1))

    def _tails(self, spark: SparkSession, epoch: int, schema: str) -> DataFrame:
        """The last rows of every series before an epoch: those of its newest epoch since all were written together."""
        if epoch == 0:
            return spark.createDataFrame([], schema).withColumn("epoch", F.lit(0))
        since = max(0, (epoch - 1) // self.compact * self.compact)
        rows = spark.read.schema(schema + ", epoch int").parquet(f"{self.folder}/tail").filter(F.col("epoch").between(since, epoch - 1))
        newest = rows.groupBy(SERIES).agg(F.max("epoch").alias("epoch"))
        return rows.join(newest, [SERIES, "epoch"])

    def process(self, batch: DataFrame, epoch: int, final: bool = False) -> None:
        spark, time = batch.sparkSession, self.order[0]
        fields = [SERIES, *self.order, *self.cols]
        new = batch.select(*fields)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema.fields)
        waiting = self._state(spark, "waiting", epoch, kinds)
        tails = self._tails(spark, epoch, f"{kinds}, {IDX} long, {LEN} long" + "".join(f", {c} double" for c in self.carry)).drop("epoch")
        mark_kind = new.schema[time].dataType.simpleString()
        before = self._state(spark, "watermark", epoch, f"mark {mark_kind}").first()
        old = F.lit(before["mark"] if before else None).cast(mark_kind)
        late = F.coalesce(F.col(time) < old, F.lit(False))
        new.filter(late).write.mode("overwrite").parquet(self._path("late", epoch))
        newest = new.agg(F.max(F.col(time) - F.expr(self.delay)).cast(mark_kind).alias("m"))
        newest.select(F.greatest(F.col("m"), old).alias("mark")).write.mode("overwrite").parquet(self._path("watermark", epoch))
        row = spark.read.parquet(self._path("watermark", epoch)).first()
        mark = F.lit(row["mark"]).cast(mark_kind)
        held = waiting.unionByName(new.filter(~late))
        ready = F.lit(True) if final else F.coalesce(F.col(time) < mark, F.lit(False))
        held.filter(~ready).write.mode("overwrite").parquet(self._path("waiting", epoch))

        numbered = index_series(held.filter(ready), list(self.order), rows=self.chunk_rows)
        tail = tails.join(numbered.select(SERIES).distinct(), SERIES, "left_semi")
        seen = tail.groupBy(SERIES).agg(F.max(LEN).alias("_seen"))
        fresh = numbered.join(seen, SERIES, "left").select(
            *fields, (F.col(IDX) + F.coalesce("_seen", F.lit(0))).alias(IDX), (F.col(LEN) + F.coalesce("_seen", F.lit(0))).alias(LEN),
            *[F.lit(None).cast("double").alias(c) for c in self.carry], F.lit(True).alias("_fresh"))
        grown = fresh.groupBy(SERIES).agg(F.max(LEN).alias("_n"))
        old_rows = tail.join(grown, SERIES, "left").select(
            *fields, IDX, F.coalesce("_n", LEN).alias(LEN), *self.carry, F.lit(False).alias("_fresh"))
        frame = fresh.unionByName(old_rows).withColumn(CHUNK, chunk_of(rows=self.chunk_rows))
        frame.write.mode("overwrite").parquet(self._path("frame", epoch))
        frame = spark.read.parquet(self._path("frame", epoch)).drop("epoch")
        scored = self.score(frame.drop("_fresh"))
        own = frame.filter("_fresh").select(SERIES, IDX, *self.order)
        scored.join(own, [SERIES, IDX]).write.mode("overwrite").parquet(self._path("scores", epoch))
        last = frame.filter(F.col(IDX) >= F.col(LEN) - self.lookback)
        if self.carry:
            now = spark.read.parquet(self._path("scores", epoch)).select(SERIES, IDX, *[F.col(c).alias(f"_{c}") for c in self.carry])
            last = last.join(now, [SERIES, IDX], "left").withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in self.carry})
        last = last.select(*fields, IDX, LEN, *self.carry)
        if epoch and epoch % self.compact == 0:
            others = tails.join(frame.select(SERIES).distinct(), SERIES, "left_anti")
            if self.expire:
                alive = others.groupBy(SERIES).agg(F.max(time).alias("_t")).filter(F.col("_t") >= mark - F.expr(self.expire))
                others = others.join(alive.select(SERIES), SERIES, "left_semi")
            last = last.unionByName(others)
        last.write.mode("overwrite").parquet(self._path("tail", epoch))

    def start(self, stream: DataFrame, available_now: bool = False, **trigger):
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(availableNow=True).start() if available_now else writer.trigger(**trigger).start()

    def finish(self, spark: SparkSession) -> None:
        """One more epoch without new rows, in which no row waits any longer."""
        last = spark.read.parquet(f"{self.folder}/watermark").agg(F.max("epoch")).first()[0]
        nothing = spark.read.parquet(self._path("waiting", last)).limit(0)
        self.process(nothing, last + 1, final=True)

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/scores").drop("epoch")

    def late(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/late").drop("epoch")


def frozen(model):
    """The model with its frames written as tables: a micro-batch reads these, never the rows they were fitted on."""
    parts = {f.name: getattr(model, f.name) for f in fields_of(model)}
    return type(model)(**{k: stage(v, f"model-{k}") if isinstance(v, DataFrame) else v for k, v in parts.items()})


def _lengths(frame: DataFrame) -> DataFrame:
    return frame.groupBy(SERIES).agg(F.max(LEN).alias(LEN))


def causal_score(model: tier0.CausalModel, cols: Sequence[str], cfg: tier0.CausalConfig) -> Score:
    """The causal tier with a frozen model; the usable scales are those of calibration."""
    cfg = tier0.CausalConfig(**{**cfg.__dict__, "freeze_scales": True})
    model = frozen(model)

    def score(frame: DataFrame) -> DataFrame:
        lengths = _lengths(frame)

        def known(table):
            return table.drop(LEN).join(lengths, SERIES)

        cal = known(model.stats.select(SERIES, F.col(LEN).alias("_fitted"))).select(SERIES, LEN, F.col("_fitted").alias("fitted_rows"))
        sized = attach(frame, cal, cfg.chunk_rows)
        least = F.least(F.greatest(F.lit(cfg.min_cal), F.floor(F.col("fitted_rows") * cfg.ratio)), F.col("fitted_rows") - 1)
        sized = sized.withColumn("cal_end", least.cast("long")).drop("fitted_rows")
        z = tier0.normalise(sized, known(model.stats), cols, cfg)
        feats = tier0.window_features(z, cols, cfg)
        subspace = known(model.subspace) if model.subspace is not None else None
        raw = tier0.raw_scores(feats, known(model.fits), subspace, cols, cfg, F.col("cal_end"))
        voted = tier0.vote(raw, known(model.thresholds), F.col(IDX) >= F.col("cal_end"), cfg)
        return voted.select(SERIES, IDX, "score", "flag", *cfg.names())

    return score


def regime_score(model: tier2.RegimeModel, cols: Sequence[str], cfg: tier0.CausalConfig) -> Score:
    """The regime tier with a frozen mixture and thresholds."""
    model = frozen(model)

    def score(frame: DataFrame) -> DataFrame:
        lengths = _lengths(frame)

        def known(table):
            return table.drop(LEN).join(lengths, SERIES)

        z = tier0.normalise(frame, known(model.stats), cols, cfg)
        labelled = H.predict(z, known(model.mixture), [f"z_{c}" for c in cols], cfg.chunk_rows)
        feats = tier0.window_features(labelled, cols, cfg)
        subspace = known(model.subspace) if model.subspace is not None else None
        raw = tier0.raw_scores(feats, known(model.fits), subspace, cols, cfg, F.col(LEN))
        raw = tier2.with_jump(raw, known(model.scales) if model.scales is not None else None, cfg)
        voted = tier2.vote_by_regime(raw, known(model.thresholds), cfg)
        return voted.select(SERIES, IDX, "regime", "score", "flag")

    return score


CAUSAL_LOOKBACK = C.LOOKBACK


def cusum_score(cols: Sequence[str], ref_window: int = J.REF_WINDOW, k: float = J.SLACK, decay: float = J.DECAY) -> tuple[Score, int, list[str]]:
    """Decayed CUSUM, the rows it needs to remember and the states that it carries on."""
    carry = [f"state_{c}" for c in cols]

    def score(frame: DataFrame) -> DataFrame:
        return J.rolling_cusum(frame, cols, ref_window, k, decay, carried=carry).select(SERIES, IDX, "drift", *carry)

    return score, ref_window, carry
