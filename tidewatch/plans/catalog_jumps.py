"""Queries over jumps, drift and slow trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import rounded
from tidewatch.operators import drift as J, features as B, jumps as I, scale as S
from tidewatch.operators.layout import IDX, LEN, SERIES, home, with_halo
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.registry import query
from tidewatch.plans.sql import DAILY, EV, r, with_
from tidewatch.sources.tables import DAILY_COLS, daily_series, event_series

# --- SQL: jumps of the daily series in long form --------------------------------------------
DIFF = """jd AS (SELECT series_id, idx, n, feature, value, coalesce(value - lag(value) OVER w, 0) AS d
  FROM dlong WINDOW w AS (PARTITION BY series_id, feature ORDER BY idx))"""
MEAS = """jm AS (SELECT *, stddev_pop(value) OVER (PARTITION BY series_id, feature ORDER BY idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS ls,
  stddev_pop(value) OVER (PARTITION BY series_id, feature ORDER BY idx ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS rho FROM jd),
jq AS (SELECT series_id, feature, quantile_cont(abs(d), 0.94) AS thr, quantile_cont(abs(d) / (ls + 1e-8), 0.91) AS lthr,
  quantile_cont(abs(d), 0.98) AS p98 FROM jm GROUP BY 1, 2),
jf AS (SELECT jm.*, thr, p98, d > thr AS pos, d < -thr AS neg, abs(d) / (ls + 1e-8) > lthr AS loc FROM jm JOIN jq USING (series_id, feature)),
js AS (SELECT series_id, feature, any_value(n) AS n, any_value(thr) AS threshold, count(*) FILTER (WHERE pos OR neg) AS n_jumps,
  count(*) FILTER (WHERE loc) AS n_local, coalesce(sum(d) FILTER (WHERE pos), 0) AS up, coalesce(-sum(d) FILTER (WHERE neg), 0) AS down,
  coalesce(avg(rho) FILTER (WHERE pos OR neg), 0) AS strain FROM jf GROUP BY 1, 2),
jstat AS (SELECT *, up + down AS intensity, (up - down) / (up + down + 1e-10) AS asymmetry, (up + down) * n_jumps * (1 + strain) / n AS power FROM js)"""
INTEG = """ji AS (SELECT series_id, idx, any_value(n) AS n, bool_or(pos OR neg) AS unified, count(*) FILTER (WHERE pos OR neg) AS hits,
  count(*) FILTER (WHERE pos OR neg) / 4.0 AS importance FROM jf GROUP BY 1, 2)"""
SYNC = """sy AS (SELECT a.series_id, a.feature AS f1, b.feature AS f2, b.idx - a.idx AS lag, count(*) / (any_value(a.n) - abs(b.idx - a.idx)) AS rate
  FROM jf a JOIN jf b ON a.series_id = b.series_id AND a.feature < b.feature AND abs(b.idx - a.idx) <= 5
  WHERE (a.pos OR a.neg) AND (b.pos OR b.neg) GROUP BY 1, 2, 3, 4),
sb AS (SELECT series_id, f1, f2, max(rate) AS max_sync, arg_max(lag, rate * 1e6 - lag * 1e-3) AS lag0 FROM sy GROUP BY 1, 2, 3),
sx AS (SELECT s.series_id, s.f1, s.f2, s.max_sync, min(sy.lag) AS lag FROM sb s JOIN sy ON sy.series_id = s.series_id AND sy.f1 = s.f1 AND sy.f2 = s.f2 AND sy.rate = s.max_sync GROUP BY 1, 2, 3, 4),
pairs AS (SELECT a.series_id, a.feature AS f1, b.feature AS f2 FROM jq a JOIN jq b ON a.series_id = b.series_id AND a.feature < b.feature),
sm AS (SELECT series_id, f1, f2, coalesce(max_sync, 0) AS max_sync, coalesce(lag, 0) AS lag FROM pairs LEFT JOIN sx USING (series_id, f1, f2))"""
CLUST = """cl AS (SELECT series_id, min(idx) AS s, max(idx) + 1 AS e, count(*) AS size, avg(hits) AS density, sum(hits) AS total FROM (
    SELECT *, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM ji WHERE unified) GROUP BY series_id, g HAVING count(*) >= 3)"""
BASE = (DAILY, DIFF, MEAS)


def detected(spark, sf):
    return I.detect(daily_series(spark, sf), DAILY_COLS)


def long_rows(jumps, *names):
    """Per-feature columns back to (series, idx, feature) rows, for comparison."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}_{c}").alias(n) for n in names]) for c in jumps.cols
    ])
    return jumps.rows.select(SERIES, IDX, F.inline(pairs))


@query("jump_difference", with_(DAILY, DIFF) + f"SELECT series_id, idx, feature, {r('d', 'd', 4)} FROM jd")
def jump_difference(spark, sf):
    wide = with_halo(daily_series(spark, sf), back=1)
    rows = home(wide.select("*", *[I.difference(c).alias(f"d_{c}") for c in DAILY_COLS]))
    return long_rows(I.Jumps(rows, rows, tuple(DAILY_COLS)), "d").select(SERIES, IDX, "feature", rounded(F.col("d"), 4).alias("d"))


@query("jump_local_std", with_(*BASE) + f"SELECT series_id, idx, feature, {r('ls', 'ls', 4)}, {r('rho', 'rho', 4)} FROM jm")
def jump_local_std(spark, sf):
    rows = I.measures(daily_series(spark, sf), DAILY_COLS)
    return long_rows(I.Jumps(rows, rows, tuple(DAILY_COLS)), "ls", "rho").select(
        SERIES, IDX, "feature", *[rounded(F.col(c), 4).alias(c) for c in ("ls", "rho")])


@query("jump_flags", with_(*BASE) + "SELECT series_id, idx, feature, CAST(pos AS INTEGER) AS pos, CAST(neg AS INTEGER) AS neg, CAST(loc AS INTEGER) AS loc FROM jf")
def jump_flags(spark, sf):
    return long_rows(detected(spark, sf), "pos", "neg", "loc").select(
        SERIES, IDX, "feature", *[F.col(c).cast("int").alias(c) for c in ("pos", "neg", "loc")])


@query("jump_pulsation", with_(*BASE) + f"SELECT series_id, feature, n_jumps, n_local, {r('threshold', 'threshold', 4)}, {r('intensity', 'intensity', 4)}, {r('asymmetry', 'asymmetry')}, {r('ln(1 + power)', 'log_power')} FROM jstat")
def jump_pulsation(spark, sf):
    f = detected(spark, sf).features.withColumn("log_power", F.log1p("power"))
    return f.select(SERIES, "feature", "n_jumps", "n_local", *[
        rounded(F.col(c), p).alias(c) for c, p in (("threshold", 4), ("intensity", 4), ("asymmetry", 6), ("log_power", 6))])


@query("jump_integrate", with_(*BASE, INTEG) + f"SELECT series_id, idx, CAST(unified AS INTEGER) AS unified, {r('importance', 'importance')} FROM ji")
def jump_integrate(spark, sf):
    rows = detected(spark, sf).rows
    return rows.select(SERIES, IDX, F.col("unified").cast("int").alias("unified"), rounded(F.col("importance")).alias("importance"))


@query("jump_sync_profile", with_(*BASE, SYNC) + f"SELECT series_id, f1, f2, lag, {r('rate', 'rate')} FROM sy")
def jump_sync_profile(spark, sf):
    return out(I.sync_profile(detected(spark, sf)), "rate", keys=(SERIES, "f1", "f2", "lag"))


@query("jump_sync_matrix", with_(*BASE, SYNC) + f"SELECT series_id, f1, f2, lag, {r('max_sync', 'max_sync')} FROM sm")
def jump_sync_matrix(spark, sf):
    return out(I.sync_matrix(detected(spark, sf)), "max_sync", keys=(SERIES, "f1", "f2", "lag"))


@query("jump_clusters", with_(*BASE, INTEG, CLUST) + f'SELECT series_id, s AS "start", e AS "end", size, {r("density", "density")}, {r("total", "total_importance")} FROM cl')
def jump_clusters(spark, sf):
    return out(I.clusters(detected(spark, sf)), "density", "total_importance", keys=(SERIES, "start", "end", "size"))


@query("jump_summary", with_(*BASE, INTEG, SYNC, CLUST) + f"""SELECT series_id, n, n_total_jumps, coalesce(c, 0) AS n_clusters, {r('max_sync', 'max_sync')}
  FROM (SELECT series_id, any_value(n) AS n, count(*) FILTER (WHERE unified) AS n_total_jumps FROM ji GROUP BY 1)
  LEFT JOIN (SELECT series_id, count(*) AS c FROM cl GROUP BY 1) USING (series_id) LEFT JOIN (SELECT series_id, max(max_sync) AS max_sync FROM sm GROUP BY 1) USING (series_id)""")
def jump_summary(spark, sf):
    return out(I.summary(detected(spark, sf)), "max_sync", keys=(SERIES, LEN, "n_total_jumps", "n_clusters"))


@query("jump_batch_score", with_(*BASE, INTEG, """iq AS (SELECT series_id, quantile_cont(importance, 0.75) AS t FROM ji WHERE importance > 0 GROUP BY 1),
fc AS (SELECT f.series_id, idx, max(CASE WHEN (pos OR neg) AND abs(d) > p98 THEN intensity * CASE WHEN abs(asymmetry) > 0.8 THEN 1 + abs(asymmetry) ELSE 1 END ELSE 0 END) AS best
  FROM jf f JOIN jstat USING (series_id, feature) GROUP BY 1, 2)""")
       + f"SELECT ji.series_id, ji.idx, {r('CASE WHEN unified AND importance >= coalesce(t, 0.5) THEN importance ELSE 0 END + 0.5 * best', 'jump_score', 4)} FROM ji JOIN fc USING (series_id, idx) LEFT JOIN iq USING (series_id)")
def jump_batch_score(spark, sf):
    return I.batch_score(detected(spark, sf)).select(SERIES, IDX, rounded(F.col("jump_score"), 4).alias("jump_score"))


@query("jump_consistency", with_(*BASE, INTEG, "st AS (SELECT series_id, idx, sum(abs(d)) AS s FROM jd GROUP BY 1, 2)")
       + f"SELECT series_id, {r('sum(CASE WHEN unified THEN -importance * s ELSE 0.1 * s END)', 'consistency', 3)} FROM ji JOIN st USING (series_id, idx) GROUP BY 1")
def jump_consistency(spark, sf):
    j = detected(spark, sf)
    return I.consistency(j.rows, j.cols).select(SERIES, rounded(F.col("consistency"), 3).alias("consistency"))


@query("jump_rescore", with_(*BASE, INTEG, CLUST) + "SELECT ji.series_id, ji.idx, " + r("""CASE WHEN unified THEN f2 * (1 + importance) * (CASE WHEN importance > 0.8 THEN sqrt(importance) ELSE importance * importance END)
  * CASE WHEN EXISTS (SELECT 1 FROM cl WHERE cl.series_id = ji.series_id AND ji.idx >= s AND ji.idx < e) THEN 1.2 ELSE 1 END ELSE f2 END""", "score") + " FROM ji JOIN daily USING (series_id, idx)")
def jump_rescore(spark, sf):
    j = detected(spark, sf)
    return out(I.rescore(j.rows.withColumn("score", F.col("f2")), I.clusters(j)), "score")


@query("jump_sync_score", with_(*BASE, INTEG, SYNC, """fs AS (SELECT series_id, feature, avg(max_sync) AS sync FROM (SELECT series_id, f1 AS feature, max_sync FROM sm UNION ALL SELECT series_id, f2, max_sync FROM sm) GROUP BY 1, 2)""")
       + f"SELECT jf.series_id, jf.idx, {r('sum(CASE WHEN sync > 0.04 AND (pos OR neg) THEN sync ELSE 0 END) / 4', 'sync_score')} FROM jf JOIN fs USING (series_id, feature) GROUP BY 1, 2")
def jump_sync_score(spark, sf):
    return out(I.sync_score(detected(spark, sf), above=0.04), "sync_score")


@query("jump_tuned", with_(DAILY, DIFF, """par AS (SELECT series_id, feature, any_value(n) AS n, stddev_pop(value) / (avg(abs(value)) + 1e-10) AS v FROM dlong GROUP BY 1, 2),
pw AS (SELECT *, CAST(greatest(5, least(floor(20 / (1 + v)), 50)) AS BIGINT) AS w, greatest(0.80, least(0.94 - v * 0.015, 0.98)) AS p FROM par),
px AS (SELECT *, CAST(floor(w * 0.8) AS BIGINT) AS tw FROM pw),
ls AS (SELECT a.series_id, a.feature, a.idx, any_value(a.n) AS n, any_value(a.d) AS d, any_value(p) AS p, any_value(w) AS w, any_value(tw) AS tw, any_value(v) AS v,
  sqrt(CAST(count(*) * sum(b.value::HUGEINT * b.value::HUGEINT) - sum(b.value::HUGEINT) * sum(b.value::HUGEINT) AS DOUBLE)) / count(*) AS ls,
  stddev_pop(b.value) FILTER (WHERE b.idx <= a.idx AND b.idx >= a.idx - tw) AS rho
  FROM jd a JOIN px USING (series_id, feature) JOIN dlong b ON b.series_id = a.series_id AND b.feature = a.feature AND b.idx BETWEEN a.idx - w AND a.idx + w GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, feature ORDER BY abs(d)) - 1 AS rk FROM ls),
ratio AS (SELECT *, row_number() OVER (PARTITION BY series_id, feature ORDER BY q) - 1 AS rk, count(*) OVER (PARTITION BY series_id, feature) AS c FROM (SELECT *, abs(d) / (ls + 1e-8) AS q FROM ls) WHERE q > 0),
t1 AS (SELECT series_id, feature, max(abs(d)) FILTER (WHERE rk = floor(p * (n - 1))) AS a, max(abs(d)) FILTER (WHERE rk = ceil(p * (n - 1))) AS b, any_value(p * (n - 1)) AS rr FROM ranked GROUP BY 1, 2),
t2 AS (SELECT series_id, feature, max(q) FILTER (WHERE rk = floor((p - 0.02) * (c - 1))) AS a, max(q) FILTER (WHERE rk = ceil((p - 0.02) * (c - 1))) AS b, any_value((p - 0.02) * (c - 1)) AS rr FROM ratio GROUP BY 1, 2),
thr AS (SELECT t1.series_id, t1.feature, t1.a + (t1.b - t1.a) * (t1.rr - floor(t1.rr)) AS thr, t2.a + (t2.b - t2.a) * (t2.rr - floor(t2.rr)) AS lthr FROM t1 JOIN t2 USING (series_id, feature))""")
       + "SELECT series_id, feature, CAST(any_value(w) AS INTEGER) AS w, CAST(any_value(tw) AS INTEGER) AS tw, " + r("any_value(v)", "v") + ", " + r("any_value(p)", "p") + ", " + r("any_value(thr)", "threshold", 4)
       + ", count(*) FILTER (WHERE abs(d) > thr) AS n_jumps, count(*) FILTER (WHERE abs(d) / (ls + 1e-8) > lthr) AS n_local, "
       + r("coalesce(avg(rho) FILTER (WHERE abs(d) > thr), 0)", "strain", 3) + " FROM ls JOIN thr USING (series_id, feature) GROUP BY 1, 2")
def jump_tuned(spark, sf):
    f = I.detect_tuned(daily_series(spark, sf), DAILY_COLS, 20, 0.94).features
    strain = F.col("power") * F.col(LEN) / F.col("n_jumps") / F.col("intensity") - 1
    return f.select(SERIES, "feature", "w", "tw", "n_jumps", "n_local", rounded(F.col("v")).alias("v"), rounded(F.col("p")).alias("p"),
                    rounded(F.col("threshold"), 4).alias("threshold"), rounded(strain, 3).alias("strain"))


# --- drift -----------------------------------------------------------------------------------

@query("drift_rolling_cusum", with_(EV, """z AS (SELECT series_id, idx, CASE WHEN count(*) OVER w = 50 THEN abs(f0 - avg(f0) OVER w) / (stddev_pop(f0) OVER w + 1e-8) - 1 END AS x
  FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
p AS (SELECT series_id, idx, x, sum(x * pow(0.95, -idx)) OVER (PARTITION BY series_id ORDER BY idx) AS s FROM z),
g AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY series_id ORDER BY idx)) AS up FROM p)""")
       + f"SELECT series_id, idx, {r('CASE WHEN x IS NULL THEN 0 ELSE up * pow(0.95, idx) END', 'drift')} FROM g")
def drift_rolling_cusum(spark, sf):
    return out(J.drift(event_series(spark, sf), ["f0"], mode="rolling"), "drift")


@query("drift_static_cusum", with_(EV, """m1 AS (SELECT series_id, median(f0) AS mu FROM ev GROUP BY 1),
a1 AS (SELECT series_id, idx, f0 - mu AS dev, abs(f0 - mu) AS a FROM ev JOIN m1 USING (series_id)),
m2 AS (SELECT series_id, median(a) AS mad FROM a1 GROUP BY 1),
a2 AS (SELECT a1.*, mad, a - mad AS sp FROM a1 JOIN m2 USING (series_id)),
m3 AS (SELECT series_id, median(abs(sp)) AS mb FROM a2 GROUP BY 1),
a3 AS (SELECT series_id, idx, dev, sp, 0.5 * 1.4826 * (mad + 1e-8) AS k, 0.5 * 1.4826 * (mb + 1e-8) AS ks FROM a2 JOIN m3 USING (series_id)),
s AS (SELECT series_id, idx, sum(dev - k) OVER w AS s0, sum(-dev - k) OVER w AS s1, sum(sp - ks) OVER w AS s2, sum(-sp - ks) OVER w AS s3 FROM a3 WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
g AS (SELECT series_id, idx, """ + ", ".join(f"s{i} - least(0, min(s{i}) OVER w) AS g{i}" for i in range(4)) + """ FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx))""")
       + f"SELECT series_id, idx, {r('greatest(g0, g1) + greatest(g2, g3)', 'drift', 4)} FROM g")
def drift_static_cusum(spark, sf):
    d = J.drift(event_series(spark, sf), ["f0"], mode="static")
    return d.select(SERIES, IDX, rounded(F.col("drift"), 4).alias("drift"))


def smooth_sql(src, dst, col, res, sigma):
    """Smoothing by a join of rows with taps over the mirrored series."""
    rad = int(4 * sigma + 0.5)
    m = "((j % (2 * n) + 2 * n) % (2 * n))"
    return f"""{dst}_e AS (SELECT e.series_id, e.j, b.{col} AS v FROM (
    SELECT series_id, n, unnest(range(-{rad}, n + {rad})) AS j FROM (SELECT DISTINCT series_id, n FROM {src})) e
  JOIN {src} b ON b.series_id = e.series_id AND b.idx = CASE WHEN {m.replace("n)", "e.n)")} >= e.n THEN 2 * e.n - 1 - {m.replace("n)", "e.n)")} ELSE {m.replace("n)", "e.n)")} END),
{dst}_l AS (SELECT series_id, min(j) AS j0, list(v ORDER BY j) AS vs FROM {dst}_e GROUP BY 1),
{dst}_w AS (SELECT [x / list_sum(gs) FOR x IN gs] AS gs FROM (SELECT list(exp(-0.5 * pow(k / {sigma}, 2)) ORDER BY k) AS gs FROM range(-{rad}, {rad + 1}) t(k))),
{dst} AS (SELECT a.series_id, a.idx, a.n, list_dot_product(vs[a.idx + 1 : a.idx + {2 * rad + 1}], gs) AS {res}
  FROM {src} a JOIN {dst}_l USING (series_id), {dst}_w)"""


def trend_sql(w):
    return ",\n".join([
        smooth_sql("ev", f"t{w}", "f0", "t", w / 3.0),
        f"""g{w} AS (SELECT series_id, idx, n, abs(CASE WHEN idx = 0 THEN lead(t) OVER w - t WHEN idx = n - 1 THEN t - lag(t) OVER w ELSE (lead(t) OVER w - lag(t) OVER w) / 2 END) AS g
  FROM t{w} WINDOW w AS (PARTITION BY series_id ORDER BY idx))""",
        smooth_sql(f"g{w}", f"u{w}", "g", "u", w / 6.0),
        f"z{w} AS (SELECT series_id, idx, CASE WHEN n > {w} THEN (u - avg(u) OVER (PARTITION BY series_id)) / stddev_pop(u) OVER (PARTITION BY series_id) END AS z FROM u{w})",
    ])


@query("trend_gradual", with_(EV, *[trend_sql(w) for w in J.TREND_WINDOWS]) + "SELECT series_id, idx, " + r(
    "CASE WHEN {n} > 0 THEN ({s}) / {n} ELSE 0 END".format(
        s=" + ".join(f"coalesce(z{w}.z, 0)" for w in J.TREND_WINDOWS), n="(" + " + ".join(f"(z{w}.z IS NOT NULL)::INT" for w in J.TREND_WINDOWS) + ")"), "gradual")
    + " FROM z500 JOIN z1000 USING (series_id, idx) JOIN z2000 USING (series_id, idx)")
def trend_gradual(spark, sf):
    return out(J.gradual_transition(event_series(spark, sf), "f0"), "gradual")


@query("trend_state_drift", with_(EV, """rf AS (SELECT series_id, any_value(n) AS n, greatest(10, least(1000, greatest(10, n // 4))) AS wr FROM ev GROUP BY series_id, n),
rm AS (SELECT series_id, wr, greatest(1, wr // 2) AS half, avg(f0) AS ref FROM ev JOIN rf USING (series_id) WHERE idx < wr GROUP BY 1, 2, 3),
lo AS (SELECT a.series_id, a.idx, any_value(a.n) AS n, abs(avg(b.f0) - any_value(ref)) / (abs(any_value(ref)) + 1e-10) AS d FROM ev a JOIN rm USING (series_id)
  JOIN ev b ON b.series_id = a.series_id AND b.idx >= a.idx - half AND b.idx < a.idx + half GROUP BY 1, 2)""", smooth_sql("lo", "sm", "d", "s", 100.0))
       + f"SELECT series_id, idx, {r('s', 'state_drift')} FROM sm")
def trend_state_drift(spark, sf):
    return out(J.structural_drift(event_series(spark, sf), "f0"), "state_drift")
