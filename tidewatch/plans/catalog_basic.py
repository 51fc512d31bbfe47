"""Queries over features, normalisation and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import rounded
from tidewatch.operators import features as B, scale as S, thresholds as D
from tidewatch.operators.layout import CHUNK, IDX, KEYS, LEN, SERIES, by_chunk, home, long_form, with_halo
from tidewatch.plans.registry import query
from tidewatch.plans.sql import DAILY, EV, FIVE, r, with_
from tidewatch.sources.tables import DAILY_COLS, daily_series, event_series


def out(df, *cols, keys=(SERIES, IDX)):
    return df.select(*keys, *[rounded(F.col(c)).alias(c) for c in cols])


@query("series_scan", with_(EV) + "SELECT series_id, idx, n, f0 FROM ev")
def series_scan(spark, sf):
    return event_series(spark, sf).select(SERIES, IDX, LEN, "f0")


@query("series_scan_daily", with_(DAILY) + f"SELECT series_id, idx, n, {r('f0', 'f0')}, {r('f1', 'f1')}, {r('f2', 'f2')}, {r('f3', 'f3')} FROM daily")
def series_scan_daily(spark, sf):
    return out(daily_series(spark, sf), *DAILY_COLS, keys=(SERIES, IDX, LEN))


@query("rolling_mean", with_(EV, FIVE) + f"SELECT series_id, idx, {r('f1', 'rolling_mean')} FROM five")
def rolling_mean(spark, sf):
    df = with_halo(event_series(spark, sf), back=29)
    return out(home(df.withColumn("rolling_mean", B.rolling_mean())), "rolling_mean")


@query("rolling_std", with_(EV, FIVE) + f"SELECT series_id, idx, {r('f2', 'rolling_std')} FROM five")
def rolling_std(spark, sf):
    df = with_halo(event_series(spark, sf), back=29)
    return out(home(df.withColumn("rolling_std", B.rolling_std())), "rolling_std")


@query("second_difference", with_(EV, FIVE) + f"SELECT series_id, idx, {r('f3', 'second_difference')} FROM five")
def second_difference(spark, sf):
    df = with_halo(event_series(spark, sf), back=2)
    return out(home(df.withColumn("second_difference", B.second_difference())), "second_difference")


@query("rolling_autocorr", with_(EV, FIVE) + f"SELECT series_id, idx, {r('f4', 'rolling_autocorr')} FROM five")
def rolling_autocorr(spark, sf):
    df = with_halo(event_series(spark, sf), back=31).withColumn("_lag", F.lag("f0").over(by_chunk()))
    return out(home(df.withColumn("rolling_autocorr", B.rolling_autocorr())), "rolling_autocorr")


@query("expand_5", with_(EV, FIVE) + "SELECT series_id, idx, " + ", ".join(r(f"f{i}", f"f{i}") for i in range(5)) + " FROM five WHERE n >= 2")
def expand_5(spark, sf):
    return out(B.expand_5(event_series(spark, sf)), *[f"f{i}" for i in range(5)])


@query("expand_6", with_(EV, FIVE, """med AS (SELECT series_id, median(f2) AS m FROM five GROUP BY 1),
dev AS (SELECT five.*, abs(f2 - m) AS d FROM five JOIN med USING (series_id)),
mad AS (SELECT series_id, median(d) AS q FROM dev GROUP BY 1)""")
       + "SELECT series_id, idx, " + ", ".join(r(f"f{i}", f"f{i}") for i in range(5)) + ", "
       + r("least(50, d / (q + 1e-12))", "f5") + " FROM dev JOIN mad USING (series_id)")
def expand_6(spark, sf):
    return out(B.expand_6(event_series(spark, sf)), *[f"f{i}" for i in range(6)])


@query("channel_mean", with_(DAILY) + f"SELECT series_id, idx, {r('(f0 + f1 + f2 + f3) / 4', 'sig')} FROM daily")
def channel_mean(spark, sf):
    return out(daily_series(spark, sf).withColumn("sig", B.channel_mean(DAILY_COLS)), "sig")


@query("row_feature_stats", with_(DAILY, """m AS (SELECT *, (f0 + f1 + f2 + f3) / 4 AS m FROM daily)""")
       + f"SELECT series_id, idx, {r('m', 'row_mean')}, "
       + r("sqrt(((f0-m)*(f0-m) + (f1-m)*(f1-m) + (f2-m)*(f2-m) + (f3-m)*(f3-m)) / 4)", "row_std") + " FROM m")
def row_feature_stats(spark, sf):
    return out(daily_series(spark, sf).select("*", *B.row_stats(DAILY_COLS)), "row_mean", "row_std")


@query("delay_embedding", with_(EV, """pos AS (SELECT unnest(range(20)) AS p)""")
       + "SELECT e.series_id, e.idx, p AS pos, x.f0 AS z FROM ev e, pos JOIN ev x "
         "ON x.series_id = e.series_id AND x.idx = e.idx - 19 + p WHERE e.idx >= 19")
def delay_embedding(spark, sf):
    df = B.delay_embedding(event_series(spark, sf), ["f0"])
    return df.filter("z is not null").select(SERIES, IDX, F.posexplode("z").alias("pos", "z")).select(
        SERIES, IDX, F.col("pos").cast("long").alias("pos"), "z")


@query("calibration_split", with_(EV) + "SELECT DISTINCT series_id, n, cal_end FROM evc")
def calibration_split(spark, sf):
    return event_series(spark, sf).groupBy(SERIES).agg(F.max(LEN).alias(LEN)).withColumn("cal_end", S.calibration_end())


def _sql_znorm(cond, eps, prefix=""):
    cols = ["f0", "f1", "f2", "f3"]
    agg = ", ".join(f"avg({c}) FILTER ({cond}) AS m{c}, stddev_pop({c}) FILTER ({cond}) AS s{c}" for c in cols)
    sel = ", ".join(r(f"{prefix}(({c} - m{c}) / (s{c} + {eps}))", c) for c in cols)
    return with_(DAILY, f"st AS (SELECT series_id, {agg} FROM daily GROUP BY 1)") + f"SELECT series_id, idx, {sel} FROM daily JOIN st USING (series_id)"


CAL = "WHERE idx < least(greatest(50, CAST(floor(n * 0.15) AS BIGINT)), n - 1)"


@query("calibration_znorm", _sql_znorm(CAL, "1e-10"))
def calibration_znorm(spark, sf):
    return out(S.calibration_znorm(daily_series(spark, sf), DAILY_COLS), *DAILY_COLS)


@query("clean_znorm", _sql_znorm("WHERE idx % 7 <> 3", "1e-10"))
def clean_znorm(spark, sf):
    df = daily_series(spark, sf).withColumn("masked", F.col(IDX) % 7 == 3)
    return out(S.clean_znorm(df, DAILY_COLS), *DAILY_COLS)


@query("zscore_safe", with_(DAILY, "st AS (SELECT series_id, " + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(4)) + " FROM daily GROUP BY 1)")
       + "SELECT series_id, idx, " + ", ".join(r(f"CASE WHEN s{i} < 1e-10 THEN f{i} - m{i} ELSE (f{i} - m{i}) / s{i} END", f"f{i}") for i in range(4))
       + " FROM daily JOIN st USING (series_id)")
def zscore_safe(spark, sf):
    return out(S.zscore_safe(daily_series(spark, sf), DAILY_COLS), *DAILY_COLS)


@query("symmetric_zscore", _sql_znorm("WHERE idx < 100", "1e-8", "abs"))
def symmetric_zscore(spark, sf):
    return out(S.symmetric(daily_series(spark, sf), DAILY_COLS, 100), *DAILY_COLS)


@query("calibration_score_z", _sql_znorm(CAL, "1e-12"))
def calibration_score_z(spark, sf):
    return out(S.calibration_score_z(daily_series(spark, sf), DAILY_COLS), *DAILY_COLS)


@query("adaptive_standardise", with_(EV, """med AS (SELECT series_id, median(f0) AS m, avg(f0) AS mu, stddev_pop(f0) AS sd FROM ev GROUP BY 1),
dev AS (SELECT ev.*, m, mu, sd, abs(f0 - m) AS d FROM ev JOIN med USING (series_id)),
mad AS (SELECT series_id, median(d) AS q FROM dev GROUP BY 1),
zz AS (SELECT series_id, idx, CASE WHEN q > 0 THEN 0.6745 * (f0 - m) / q ELSE (f0 - mu) / (sd + 1e-10) END AS z FROM dev JOIN mad USING (series_id))""")
       + f"SELECT series_id, idx, {r('CASE WHEN abs(z) < 2 THEN z ELSE sign(z) * (2 + 3 * ln(1 + abs(z) - 2)) END', 'f0')} FROM zz")
def adaptive_standardise(spark, sf):
    return out(S.adaptive(event_series(spark, sf), "f0"), "f0")


@query("iqr_standardise", with_(EV, """q AS (SELECT series_id, quantile_cont(f0, 0.25) AS a, median(f0) AS m, quantile_cont(f0, 0.75) AS b,
  avg(f0) AS mu, stddev_pop(f0) AS sd FROM ev GROUP BY 1)""")
       + "SELECT series_id, idx, " + r("CASE WHEN b > a THEN (f0 - m) / (1.5 * (b - a)) WHEN sd > 0 THEN (f0 - mu) / sd ELSE f0 END", "f0")
       + " FROM ev JOIN q USING (series_id)")
def iqr_standardise(spark, sf):
    return out(S.iqr_scale(event_series(spark, sf), "f0"), "f0")


@query("power_transform", with_(EV) + f"SELECT series_id, idx, {r('sign(z) * pow(abs(z), 0.8)', 'f0')} FROM evz")
def power_transform(spark, sf):
    df = S.calibration_znorm(event_series(spark, sf), ["f0"])
    return out(df.withColumn("f0", S.power(F.col("f0"))), "f0")


@query("minmax_unit", with_(EV, "mm AS (SELECT series_id, min(f0) AS lo, max(f0) AS hi FROM ev GROUP BY 1)")
       + "SELECT series_id, idx, " + r("CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (f0 - lo) / (hi - lo) END", "f0") + " FROM ev JOIN mm USING (series_id)")
def minmax_unit(spark, sf):
    return out(S.minmax(event_series(spark, sf), "f0"), "f0")


@query("length_align", with_(EV, "sc AS (SELECT series_id, idx + 3 AS idx, f0 AS s FROM ev)")
       + "SELECT ev.series_id, ev.idx, coalesce(s, 0) AS score FROM ev LEFT JOIN sc USING (series_id, idx)")
def length_align(spark, sf):
    base = event_series(spark, sf)
    moved = base.select(SERIES, (F.col(IDX) + 3).alias(IDX), F.col("f0").alias("score"))
    moved = moved.withColumn(CHUNK, F.floor(F.col(IDX) / 8192).cast("long"))
    return S.align(base.select(*KEYS, IDX), moved, "score").select(SERIES, IDX, "score")


# thresholds over |z| of the calibration rows, all four daily features as scorers
ABSZ = """dz AS (
  SELECT d.series_id, d.idx, d.n, d.feature, (value - mu) / (sd + 1e-10) AS z
  FROM dlong d JOIN (SELECT series_id, feature, avg(value) AS mu, stddev_pop(value) AS sd FROM dlong GROUP BY 1, 2)
  USING (series_id, feature)),
az AS (SELECT series_id, feature, idx, n, abs(z) AS v FROM dz)"""


def _absz(spark, sf):
    df = daily_series(spark, sf)
    z = S.znorm(df, DAILY_COLS)
    return long_form(z, DAILY_COLS, "feature", "z", [*KEYS, IDX, LEN]).withColumn("v", F.abs("z"))


@query("positive_percentile", with_(DAILY, ABSZ) + "SELECT series_id, feature, count(*) AS n_positive, "
       + r("CASE WHEN count(*) > 5 THEN quantile_cont(v, 0.99) END", "threshold") + " FROM az WHERE v > 0 GROUP BY 1, 2")
def positive_percentile(spark, sf):
    t = D.positive_percentile(_absz(spark, sf), [SERIES, "feature"], "v")
    return out(t, "threshold", keys=(SERIES, "feature", "n_positive"))


def _robust(method):
    def run(spark, sf):
        t = D.robust_threshold(_absz(spark, sf), [SERIES, "feature"], "v", method)
        return out(t, "threshold", keys=(SERIES, "feature", "n_values"))

    return run


Q = """q AS (SELECT series_id, feature, count(*) AS n_values, quantile_cont(v, 0.99) AS p, quantile_cont(v, 0.25) AS q1,
  median(v) AS q2, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.9) AS p90 FROM az GROUP BY 1, 2)"""
FROM_Q = " FROM q"
query("threshold_percentile", with_(DAILY, ABSZ, Q) + f"SELECT series_id, feature, n_values, {r('p', 'threshold')} FROM q WHERE n_values >= 5")(_robust("percentile"))
query("threshold_trimmed", with_(DAILY, ABSZ, Q, "t AS (SELECT series_id, feature, quantile_cont(v, 0.99) AS t, count(*) AS c FROM az JOIN q USING (series_id, feature) WHERE v <= p GROUP BY 1, 2)")
      + f"SELECT series_id, feature, n_values, {r('CASE WHEN c < 5 THEN p ELSE t END', 'threshold')} FROM q JOIN t USING (series_id, feature)")(_robust("trimmed_percentile"))
query("threshold_iqr", with_(DAILY, ABSZ, Q) + f"SELECT series_id, feature, n_values, {r('CASE WHEN q3 - q1 <= 0 THEN p ELSE q3 + 3 * (q3 - q1) END', 'threshold')} FROM q")(_robust("iqr"))
query("threshold_mad", with_(DAILY, ABSZ, Q, "d AS (SELECT series_id, feature, median(abs(v - q2)) AS mad FROM az JOIN q USING (series_id, feature) GROUP BY 1, 2)")
      + f"SELECT series_id, feature, n_values, {r('CASE WHEN mad <= 0 THEN p ELSE q2 + 2.5 * 1.4826 * mad END', 'threshold')} FROM q JOIN d USING (series_id, feature)")(_robust("mad"))
query("threshold_capped", with_(DAILY, ABSZ, Q) + f"SELECT series_id, feature, n_values, {r('CASE WHEN p90 <= 0 THEN p ELSE least(p, 5 * p90) END', 'threshold')} FROM q")(_robust("capped"))


REGIMED = """rz AS (SELECT *, CAST(idx % 3 AS INTEGER) AS regime FROM az WHERE idx % 7 <> 3),
sized AS (SELECT *, feature AS scorer, count(*) OVER (PARTITION BY series_id, regime, feature) AS rows_ FROM rz),
used AS (SELECT * FROM sized WHERE rows_ >= 50 AND v > 1e-12),
p AS (SELECT series_id, regime, scorer, rows_, quantile_cont(v, 0.99) AS p, quantile_cont(v, 0.9) AS p90, count(*) AS n_values
  FROM used GROUP BY 1, 2, 3, 4)"""


def _regimed(spark, sf):
    df = _absz(spark, sf).filter(F.col(IDX) % 7 != 3).withColumn("regime", (F.col(IDX) % 3).cast("int"))
    sizes = df.groupBy(SERIES, "feature", "regime").agg(F.count(F.lit(1)).alias("regime_rows"))
    return df.join(sizes, [SERIES, "feature", "regime"]).withColumnRenamed("feature", "scorer")


@query("threshold_by_regime", with_(DAILY, ABSZ, REGIMED, """t AS (SELECT series_id, regime, scorer, quantile_cont(v, 0.99) AS t, count(*) AS c
  FROM used JOIN p USING (series_id, regime, scorer) WHERE v <= p GROUP BY 1, 2, 3)""")
       + "SELECT series_id, regime, scorer, n_values, " + r("CASE WHEN n_values >= 5 THEN CASE WHEN c < 5 THEN p ELSE t END END", "threshold") + " FROM p LEFT JOIN t USING (series_id, regime, scorer)")
def threshold_by_regime(spark, sf):
    return out(D.regime_thresholds(_regimed(spark, sf), value="v"), "threshold", keys=(SERIES, "regime", "scorer", "n_values"))


@query("threshold_by_regime_capped", with_(DAILY, ABSZ, REGIMED)
       + "SELECT series_id, regime, scorer, n_values, " + r("CASE WHEN n_values >= 5 THEN CASE WHEN p90 <= 0 OR rows_ < 300 THEN p ELSE least(p, 5 * p90) END END", "threshold") + " FROM p")
def threshold_by_regime_capped(spark, sf):
    t = D.regime_thresholds(_regimed(spark, sf), value="v", method="capped")
    return out(t, "threshold", keys=(SERIES, "regime", "scorer", "n_values"))


@query("threshold_sigma", with_(DAILY, ABSZ) + f"SELECT series_id, feature, {r('avg(v) + 3 * (stddev_pop(v) + 1e-12)', 'threshold')} FROM az WHERE idx < 100 GROUP BY 1, 2")
def threshold_sigma(spark, sf):
    return out(D.sigma_threshold(_absz(spark, sf), [SERIES, "feature"], "v", F.col(IDX) < 100), "threshold", keys=(SERIES, "feature"))
