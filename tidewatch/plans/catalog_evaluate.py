"""Queries over fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import rounded
from tidewatch.operators import evaluate as Q, fusion as FU, masks as G
from tidewatch.operators.layout import IDX, LEN, SERIES, long_form
from tidewatch.operators.scale import zscore_safe
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.catalog_masks import POS_SQL, WINDOWS_SQL, label_windows
from tidewatch.plans.catalog_paths import GIVEN, PATHS, XS, given
from tidewatch.plans.registry import query
from tidewatch.plans.sql import DAILY, EV, r, with_
from tidewatch.sources.tables import event_series

PARTS = ["jump", "hybrid", "kernel", "structural"]
COMP = """comp AS (SELECT series_id, idx, n, abs(x0) AS jump, abs(x1) AS hybrid, abs(x2) AS kernel, abs(x3) AS structural, round(x0 + x1, 6) AS drift,
  CASE WHEN x0 + x2 > 2 THEN 1 ELSE 0 END AS label FROM given)"""
C = (DAILY, GIVEN, COMP)


def components(spark, sf):
    df = given(spark, sf)
    parts = {n: F.abs(x) for n, x in zip(PARTS, XS)}
    return df.select(SERIES, "chunk", IDX, LEN, *[v.alias(k) for k, v in parts.items()], F.round(F.col("x0") + F.col("x1"), 6).alias("drift"),
                     F.when(F.col("x0") + F.col("x2") > 2, 1).otherwise(0).alias("label"))


def zs(cols, src="comp"):
    return ("zs AS (SELECT series_id, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols) + f" FROM {src} GROUP BY 1),\nzz AS (SELECT series_id, idx, label, "
            + ", ".join(f"CASE WHEN s_{c} > 1e-10 THEN ({c} - m_{c}) / s_{c} ELSE {c} END AS {c}" for c in cols) + f" FROM {src} JOIN zs USING (series_id))")


W = FU.DEFAULT_WEIGHTS
WSUM = " + ".join(f"{W[c]} * {c}" for c in PARTS)


@query("fuse_weighted", with_(*C, zs(PARTS)) + f"SELECT series_id, idx, {r(WSUM, 'score')} FROM zz")
def fuse_weighted(spark, sf):
    return out(FU.integrate(components(spark, sf), W), "score")


CALZ = "sy AS (SELECT series_id, avg(jump) AS m, stddev_pop(jump) AS s FROM comp WHERE idx < 100 GROUP BY 1),\ncomp2 AS (SELECT series_id, idx, label, abs((jump - m) / (s + 1e-8)) AS jump, hybrid, kernel, structural FROM comp JOIN sy USING (series_id))"


@query("fuse_combine", with_(*C, CALZ, zs(PARTS, "comp2")) + f"SELECT series_id, idx, {r(WSUM, 'score')} FROM zz")
def fuse_combine(spark, sf):
    return out(FU.combine(components(spark, sf), symmetric_parts=["jump"], frames=100), "score")


@query("fuse_subset", with_(*C, zs(PARTS)) + f"SELECT series_id, idx, {r('(0.2 * jump + 0.3 * kernel) / 0.5', 'score')} FROM zz")
def fuse_subset(spark, sf):
    return out(FU.integrate(components(spark, sf), FU.renormalise(W, ["jump", "kernel"])), "score")


@query("fuse_ensemble_max", with_(*C, "es AS (SELECT series_id, avg(jump) AS ma, stddev_pop(jump) AS sa, avg(kernel) AS mb, stddev_pop(kernel) AS sb FROM comp WHERE idx < least(greatest(50, floor(n * 0.15)), n - 1) GROUP BY 1)")
       + f"SELECT series_id, idx, {r('greatest((jump - ma) / (sa + 1e-12), (kernel - mb) / (sb + 1e-12))', 'score')} FROM comp JOIN es USING (series_id)")
def fuse_ensemble_max(spark, sf):
    return out(FU.ensemble_max(components(spark, sf), "jump", "kernel"), "score")


DUAL = [*PARTS, "drift"]


@query("fuse_dual_track", with_(*C, zs(DUAL), "tr AS (SELECT series_id, idx, 0.4 * jump + 0.6 * hybrid AS a, (structural + kernel + drift) / 3 AS c FROM zz)",
       "ts AS (SELECT series_id, avg(a) AS ma, stddev_pop(a) AS sa, avg(c) AS mc, stddev_pop(c) AS sc FROM tr GROUP BY 1)")
       + f"SELECT series_id, idx, {r('greatest((a - ma) / sa, (c - mc) / sc)', 'score')} FROM tr JOIN ts USING (series_id)")
def fuse_dual_track(spark, sf):
    return out(FU.dual_track(components(spark, sf)), "score")


CLEAR = "cq AS (SELECT series_id, quantile_cont(jump, 0.1) AS lo, quantile_cont(jump, 0.9) AS hi FROM comp GROUP BY 1),\ncl AS (SELECT comp.* EXCLUDE (label), CASE WHEN jump > hi THEN 1 WHEN jump < lo THEN 0 END AS label FROM comp JOIN cq USING (series_id) WHERE jump > hi OR jump < lo)"


@query("fuse_clear_rows", with_(*C, CLEAR) + "SELECT series_id, idx, label FROM cl")
def fuse_clear_rows(spark, sf):
    return FU.clear_rows(components(spark, sf), "jump").select(SERIES, IDX, "label")


FOUR = ["jump", "hybrid", "kernel", "structural"]


def search_sql(src):
    """Best weights ``pick`` of each series over the rows ``src`` with labels."""
    return [f"cx AS (SELECT series_id, idx, label, {', '.join(FOUR)} FROM {src})", zs(FOUR, "cx"),
       "lat AS (SELECT 0.05 + 0.1 * a AS w1, 0.05 + 0.1 * b AS w2, 0.05 + 0.1 * c AS w3, 0.05 + 0.1 * (8 - a - b - c) AS w4 FROM range(9) t(a), range(9) u(b), range(9) v(c) WHERE a + b + c <= 8)",
       "cnt AS (SELECT series_id, count(*) AS c, sum(label) AS p FROM cx GROUP BY 1)",
       "sc AS (SELECT zz.series_id, label, greatest(0.1, least(10, pow(c / (2 * CASE WHEN label = 1 THEN p ELSE c - p END), 1.5))) AS w, w1, w2, w3, w4, round(w1 * jump + w2 * hybrid + w3 * kernel + w4 * structural, 9) AS s FROM zz JOIN cnt USING (series_id), lat)",
       "ag AS (SELECT series_id, w1, w2, w3, w4, s, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS q FROM sc GROUP BY ALL)",
       "rk AS (SELECT *, sum(q) OVER (PARTITION BY series_id, w1, w2, w3, w4 ORDER BY s) - q AS below FROM ag)",
       "au AS (SELECT series_id, w1, w2, w3, w4, round(sum(p * (below + 0.5 * q)) / (sum(p) * sum(q)), 9) AS auc, round(-(w1 * w1 + w2 * w2 + w3 * w3 + w4 * w4), 9) AS even FROM rk GROUP BY ALL)",
       "pick AS (SELECT * FROM au QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY auc DESC, even DESC, w1 DESC, w2 DESC, w3 DESC, w4 DESC) = 1)"]


@query("fuse_search_weights", with_(*C, CLEAR, *search_sql("cl"))
       + f"SELECT series_id, {r('w1', 'w_jump')}, {r('w2', 'w_hybrid')}, {r('w3', 'w_kernel')}, {r('w4', 'w_structural')}, {r('auc', 'auc')} FROM pick")
def fuse_search_weights(spark, sf):
    clear = FU.clear_rows(components(spark, sf).drop("label"), "jump")
    return out(FU.search_weights(clear, FOUR), *[f"w_{n}" for n in FOUR], "auc", keys=(SERIES,))


ENDS = f"""bs AS (SELECT * EXCLUDE (label), round({WSUM}, 9) AS base FROM comp), bq AS (SELECT series_id, quantile_cont(base, 0.1) AS lo, quantile_cont(base, 0.9) AS hi FROM bs GROUP BY 1),
be AS (SELECT bs.*, CASE WHEN base > hi THEN 1 ELSE 0 END AS label FROM bs JOIN bq USING (series_id) WHERE base > hi OR base < lo
  QUALIFY sum(label) OVER (PARTITION BY series_id) > 5 AND sum(1 - label) OVER (PARTITION BY series_id) > 5)"""


@query("fuse_adaptive", with_(*C, ENDS, *search_sql("be")) + "SELECT series_id, idx, " + r(
    " + ".join(f"coalesce(w{i + 1}, {W[n]}) * {n}" for i, n in enumerate(FOUR)), "score", 9) + " FROM comp LEFT JOIN pick USING (series_id)")
def fuse_adaptive(spark, sf):
    scored = FU.adaptive(components(spark, sf).drop("label"), {n: W[n] for n in FOUR})
    return scored.select(SERIES, IDX, rounded(F.col("score"), 9).alias("score"))


@query("fuse_weak_anomalies")
def fuse_weak_anomalies(spark, sf):
    df = given(spark, sf, jumps=True).withColumn("score", F.abs("x0"))
    return FU.weak_anomalies(df, XS, "score").select(SERIES, IDX, "weak", "label")


# --- evaluation --------------------------------------------------------------------------------

def auc_sql(src, keys, s, extra=""):
    k = ", ".join(keys)
    return (f"au0{extra} AS (SELECT {k}, {s} AS s, sum(label) AS p, sum(1 - label) AS q FROM {src} GROUP BY {k}, {s}),\n"
            f"au1{extra} AS (SELECT *, sum(q) OVER (PARTITION BY {k} ORDER BY s) - q AS below FROM au0{extra}),\n"
            f"au{extra} AS (SELECT {k}, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (below + 0.5 * q)) / (sum(p) * sum(q)) END AS auc FROM au1{extra} GROUP BY {k})")


@query("eval_auc", with_(*C, auc_sql("comp", ["series_id"], "structural")) + f"SELECT series_id, {r('auc', 'auc')} FROM au")
def eval_auc(spark, sf):
    return out(Q.auc(components(spark, sf), [SERIES], "structural", "label"), "auc", keys=(SERIES,))


@query("eval_top_precision", with_(*C, "t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY jump DESC, idx) AS rn FROM comp)")
       + f"SELECT series_id, {r('avg(label)', 'precision')} FROM t WHERE rn <= 10 GROUP BY 1")
def eval_top_precision(spark, sf):
    return out(Q.top_precision(components(spark, sf), "jump", "label"), "precision", keys=(SERIES,))


CP = """tru AS (SELECT series_id, any_value(n) // 2 AS st, any_value(n) // 2 + 60 AS en, any_value(n) // 2 AS npre FROM comp GROUP BY 1),
cpx AS (SELECT comp.* EXCLUDE (label), st, en, least(greatest(10, npre // 2), st - 1) AS cal, CASE WHEN idx >= st AND idx < en THEN 1 ELSE 0 END AS label FROM comp JOIN tru USING (series_id)),
cpt AS (SELECT series_id, {thr} AS thr, avg(hybrid) AS m, stddev_pop(hybrid) + 1e-12 AS sd FROM cpx WHERE idx < cal GROUP BY 1),
cpa AS (SELECT cpx.*, thr, m, sd, hybrid > thr AS above FROM cpx JOIN cpt USING (series_id)),
cpm AS (SELECT series_id, any_value(thr) AS threshold, any_value(m) AS cal_mean, any_value(sd) AS cal_std, any_value(st) AS st, min(idx) FILTER (WHERE above AND idx >= cal) AS fd,
  count(*) FILTER (WHERE above AND idx >= cal AND idx < st) AS fpre, count(*) FILTER (WHERE above AND idx >= en) AS fpost,
  fpre / greatest(1, count(*) FILTER (WHERE idx >= cal AND idx < st)) AS rpre, fpost / greatest(1, count(*) FILTER (WHERE idx >= en)) AS rpost,
  avg(above::INT) FILTER (WHERE label = 1) AS recall, bool_or(above AND label = 1) AS detected FROM cpa GROUP BY 1)"""
CPSEL = (f"SELECT series_id, {r('threshold', 'threshold')}, {r('cal_mean', 'cal_mean')}, {r('cal_std', 'cal_std')}, coalesce(fd, -1) AS first_detection, coalesce(greatest(fd - st, 0), -1) AS ttd, coalesce(greatest(st - fd, 0), -1) AS overshoot, "
         f"fpre AS false_alarms_pre, fpost AS false_alarms_post, {r('rpre', 'rate_pre')}, {r('rpost', 'rate_post')}, {r('recall', 'recall')}, detected, {r('auc', 'auc')} FROM cpm JOIN au USING (series_id)")


def _change_point(method):
    def run(spark, sf):
        df = components(spark, sf)
        half = F.floor(F.max(LEN) / 2)
        truth = df.groupBy(SERIES).agg(half.alias("true_start"), (half + 60).alias("true_end"), half.alias("n_pre"))
        m = Q.change_point(df, truth, "hybrid", method=method).fillna(-1, ["first_detection", "ttd", "overshoot"])
        return out(m, "threshold", "cal_mean", "cal_std", "rate_pre", "rate_post", "recall", "auc",
                   keys=(SERIES, "first_detection", "ttd", "overshoot", "false_alarms_pre", "false_alarms_post", "detected"))
    return run


AUC_CP = auc_sql("cpx", ["series_id"], "hybrid")
query("eval_change_point", with_(*C, CP.format(thr="quantile_cont(hybrid, 0.99)"), AUC_CP) + CPSEL)(_change_point("percentile"))
query("eval_change_point_sigma", with_(*C, CP.format(thr="avg(hybrid) + 3 * (stddev_pop(hybrid) + 1e-12)"), AUC_CP) + CPSEL)(_change_point("mean_plus_sigma"))


@query("eval_calibration_rows", with_(EV, WINDOWS_SQL, POS_SQL) + "SELECT series_id, n, greatest(5, least(greatest(50, CAST(floor(n * 0.15) AS BIGINT)), s - 1)) AS calibration_rows, s AS true_start, e + 1 AS true_end "
       "FROM (SELECT series_id, any_value(n) AS n, min(start_) AS s, min_by(end_, start_ * 1000000 + end_) AS e FROM rng GROUP BY 1)")
def eval_calibration_rows(spark, sf):
    df = event_series(spark, sf)
    positions = G.window_positions(df, label_windows(spark, sf))
    return Q.labelled_calibration(df.groupBy(SERIES).agg(F.max(LEN).alias(LEN)), positions)


SIG = "CASE WHEN {x} > 3 THEN -1 ELSE 2 / (1 + exp(5 * ({x}))) - 1 END"
SWEEP = f"""prof AS (SELECT * FROM (VALUES ('standard', 1.0::DOUBLE, 0.11::DOUBLE, 1.0::DOUBLE), ('reward_low_FP_rate', 1.0, 0.22, 1.0), ('reward_low_FN_rate', 1.0, 0.11, 2.0)) t(profile, tp, fp, fn)),
sw AS (SELECT ev.series_id, idx, f0 AS s, (SELECT min({{pair}}) FROM rng w WHERE w.series_id = ev.series_id AND idx BETWEEN start_ AND end_) AS cur,
  (SELECT max({{pair}}) FROM rng w WHERE w.series_id = ev.series_id AND end_ < idx) AS prev FROM ev WHERE idx >= least(floor(n * 0.15), 750)),
sp AS (SELECT series_id, idx, s, cur, CASE WHEN cur IS NOT NULL THEN 2 / (1 + exp(-5.0 * (cur % 100000 - idx + 1) / (cur % 100000 - cur // 100000 + 1))) - 1
  WHEN prev IS NULL THEN -1 ELSE {SIG.format(x='(idx - prev % 100000) / greatest(1, prev % 100000 - prev // 100000)')} END AS v FROM sw),
thr AS (SELECT DISTINCT series_id, s FROM sp),
wn AS (SELECT series_id, count(*) AS k FROM rng GROUP BY 1),
bw AS (SELECT t.series_id, t.s, cur, max(v) AS best FROM thr t JOIN sp ON sp.series_id = t.series_id AND sp.s >= t.s WHERE cur IS NOT NULL GROUP BY 1, 2, 3),
bs AS (SELECT series_id, s, profile, sum(greatest(best * tp / (2 / (1 + exp(-5.0)) - 1), -fn)) AS g, count(*) AS c FROM bw, prof GROUP BY 1, 2, 3),
fa AS (SELECT t.series_id, t.s, sum(v) AS f FROM thr t JOIN sp ON sp.series_id = t.series_id AND sp.s >= t.s WHERE cur IS NULL GROUP BY 1, 2),
tot AS (SELECT t.series_id, t.s, p.profile, k, tp, fn, coalesce(g, 0) - fn * (k - coalesce(c, 0)) + coalesce(f, 0) * fp AS sc FROM thr t CROSS JOIN prof p JOIN wn USING (series_id)
  LEFT JOIN bs ON bs.series_id = t.series_id AND bs.s = t.s AND bs.profile = p.profile LEFT JOIN fa ON fa.series_id = t.series_id AND fa.s = t.s)""".replace("{pair}", "start_ * 100000 + end_")


@query("eval_benchmark_sweep", with_(EV, WINDOWS_SQL, POS_SQL, SWEEP)
       + f"SELECT series_id, profile, {r('greatest(max(sc), -any_value(k * fn))', 'best_raw')}, {r('-any_value(k * fn)', 'null_score')}, {r('any_value(k * tp)', 'perfect')}, "
       + r("100 * (greatest(max(sc), -any_value(k * fn)) + any_value(k * fn)) / (any_value(k * tp) + any_value(k * fn))", "normalized") + " FROM tot GROUP BY 1, 2")
def eval_benchmark_sweep(spark, sf):
    df = event_series(spark, sf)
    positions = G.window_positions(df, label_windows(spark, sf))
    s = Q.sweep(df, positions, "f0")
    return out(s, "best_raw", "null_score", "perfect", "normalized", keys=(SERIES, "profile"))


RES = "res AS (SELECT series_id, ln(1 + avg(abs(f0))) * 10 AS normalized, CASE WHEN series_id IN ('click', 'view') THEN 'standard' ELSE 'reward_low_FP_rate' END AS profile, count(*) AS files FROM ev GROUP BY 1)"


def _results(spark, sf):
    return event_series(spark, sf).groupBy(SERIES).agg((F.log1p(F.avg(F.abs("f0"))) * 10).alias("normalized"), F.count(F.lit(1)).alias("files")).withColumn(
        "profile", F.when(F.col(SERIES).isin("click", "view"), "standard").otherwise("reward_low_FP_rate"))


@query("eval_profile_summary", with_(EV, RES) + f"SELECT profile, {r('avg(normalized)', 'mean')}, {r('min(normalized)', 'min')}, {r('max(normalized)', 'max')} FROM res GROUP BY 1")
def eval_profile_summary(spark, sf):
    return out(Q.summarise_profiles(_results(spark, sf)), "mean", "min", "max", keys=("profile",))


@query("eval_weighted_mean", with_(EV, RES) + f"SELECT {r('sum(normalized * files) / sum(files)', 'weighted')} FROM res")
def eval_weighted_mean(spark, sf):
    return out(Q.weighted_mean(_results(spark, sf), "normalized", "files"), "weighted", keys=())


PAIRS = [(a, b) for i, a in enumerate(PARTS) for b in PARTS[i + 1:]]


@query("eval_score_pearson", with_(*C) + " UNION ALL ".join(f"SELECT series_id, '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'corr')} FROM comp GROUP BY 1" for a, b in PAIRS))
def eval_score_pearson(spark, sf):
    return out(Q.correlations(components(spark, sf), PARTS), "corr", keys=(SERIES, "a", "b"))


RANKS = "rks AS (SELECT series_id, " + ", ".join(f"rank() OVER (PARTITION BY series_id ORDER BY {c}) + (count(*) OVER (PARTITION BY series_id, {c}) - 1) / 2.0 AS {c}" for c in PARTS) + " FROM comp)"


@query("eval_score_spearman", with_(*C, RANKS) + " UNION ALL ".join(f"SELECT series_id, '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 'corr')} FROM rks GROUP BY 1" for a, b in PAIRS))
def eval_score_spearman(spark, sf):
    return out(Q.rank_correlations(components(spark, sf), PARTS), "corr", keys=(SERIES, "a", "b"))


CONFIGS = {**Q.subsets(PARTS), **Q.leave_one_out(W), **Q.sweep_weight(W, "drift", [0.0, 0.05, 0.1, 0.2])}
ABL = "abl AS (" + " UNION ALL ".join(
    f"SELECT series_id, label, '{name}' AS config, round({' + '.join(f'{v!r}::DOUBLE * {c}' for c, v in w.items())}, 9) AS s FROM zz" for name, w in CONFIGS.items()) + ")"


@query("eval_ablation", with_(*C, zs(DUAL), ABL, auc_sql("abl", ["series_id", "config"], "s")) + f"SELECT series_id, config, {r('auc', 'auc', 4)} FROM au")
def eval_ablation(spark, sf):
    z = zscore_safe(components(spark, sf), DUAL)
    a = Q.ablation(z, CONFIGS, "label")
    return a.select(SERIES, "config", rounded(F.col("auc"), 4).alias("auc"))


@query("eval_path_agreement", with_(DAILY, GIVEN) + f"SELECT series_id, {r('(corr(abs(p0), abs(p2)) + corr(abs(p1), abs(p3))) / 2', 'mean_corr')}, {r('least(corr(abs(p0), abs(p2)), corr(abs(p1), abs(p3)))', 'min_corr')} FROM given GROUP BY 1")
def eval_path_agreement(spark, sf):
    return out(Q.path_agreement(given(spark, sf), PATHS[:2], PATHS[2:]), "mean_corr", "min_corr", keys=(SERIES,))


@query("eval_robustness", with_(*C, "cl0 AS (SELECT series_id, label, part, v FROM comp UNPIVOT (v FOR part IN (jump, hybrid, kernel, structural)))", auc_sql("cl0", ["series_id", "part"], "v"))
       + f"SELECT part, count(auc) AS runs, {r('avg(auc)', 'mean')}, {r('stddev_pop(auc)', 'std')}, {r('min(auc)', 'min')}, {r('max(auc)', 'max')} FROM au GROUP BY 1")
def eval_robustness(spark, sf):
    long = long_form(components(spark, sf), PARTS, "part", "v", [SERIES, "label"])
    a = Q.auc(long, [SERIES, "part"], "v", "label")
    return out(Q.robustness(a, ["part"]), "mean", "std", "min", "max", keys=("part", "runs"))
