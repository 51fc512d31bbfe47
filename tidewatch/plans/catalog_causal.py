"""Queries over the causal scorers and voting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numeric import rounded
from tidewatch.operators import causal as C, features as B, scale as S
from tidewatch.operators.layout import IDX, LEN, SERIES, attach, by_chunk, frame, home, with_halo
from tidewatch.plans import tier0
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.registry import query
from tidewatch.plans.sql import DAILY, EV, r, with_
from tidewatch.session import stage
from tidewatch.sources.tables import DAILY_COLS, daily_series, event_series

JW = (5, 20, 50, 200)


def _win(w):
    return f"(PARTITION BY series_id ORDER BY idx ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


# --- SQL of the scorers over a CTE ``base(series_id, idx, n, cal_end, sig, z...)`` ----------

JUMP_SQL = "jr AS (SELECT series_id, idx, n, cal_end, " + ", ".join(
    f"CASE WHEN idx >= 2 AND count(sig) OVER w{w} >= 2 THEN abs(sig - avg(sig) OVER w{w}) / (stddev_pop(sig) OVER w{w} + 1e-12) ELSE 0 END AS j{w}" for w in JW
) + " FROM base WINDOW " + ", ".join(f"w{w} AS {_win(w)}" for w in JW) + ")"

JUMP_THR = "jt AS (SELECT series_id, " + ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE idx < cal_end AND j{w} > 0 AND {w} < cal_end) > 5 THEN quantile_cont(j{w}, 0.99) FILTER (WHERE idx < cal_end AND j{w} > 0 AND {w} < cal_end) END AS t{w}" for w in JW
) + " FROM jr GROUP BY 1)"

JUMP_SCORE = "js AS (SELECT series_id, idx, n, cal_end, greatest(0, " + ", ".join(
    f"coalesce(CASE WHEN t{w} > 0 THEN j{w} / (t{w} + 1e-12) END, 0)" for w in JW
) + ") AS jump FROM jr JOIN jt USING (series_id))"

BASE_EV = "base AS (SELECT series_id, idx, n, cal_end, z AS sig FROM evz)"
BASE_DAILY = """dcal AS (SELECT *, least(greatest(50, CAST(floor(n * 0.15) AS BIGINT)), n - 1) AS cal_end FROM daily),
dst AS (SELECT series_id, """ + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(4)) + """ FROM dcal WHERE idx < cal_end GROUP BY 1),
zall AS (SELECT series_id, idx, n, cal_end, """ + ", ".join(f"(f{i} - m{i}) / (s{i} + 1e-10) AS z{i}" for i in range(4)) + """ FROM dcal JOIN dst USING (series_id)),
base AS (SELECT *, (z0 + z1 + z2 + z3) / 4 AS sig FROM zall)"""

DRIFT_SQL = """dr AS (SELECT b.series_id, b.idx, b.n, b.cal_end,
  CASE WHEN count(sig) OVER w >= 20 THEN abs(avg(sig) OVER w - m) ELSE 0 END AS drift
  FROM base b JOIN (SELECT series_id, avg(sig) AS m FROM base WHERE idx < cal_end GROUP BY 1) USING (series_id)
  WINDOW w AS (PARTITION BY b.series_id ORDER BY idx ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"""


def step_sql(cols):
    sq = " + ".join(f"({c} - lag({c}) OVER w) * ({c} - lag({c}) OVER w)" for c in cols)
    return f"""st0 AS (SELECT series_id, idx, n, cal_end, {sq} AS q FROM base WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
st1 AS (SELECT *, CASE WHEN idx >= 20 THEN sqrt(sum(q) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) ELSE 0 END AS step FROM st0),
stf AS (SELECT series_id, avg(step) FILTER (WHERE step > 1e-12) AS m, stddev_pop(step) FILTER (WHERE step > 1e-12) + 1e-10 AS s,
  count(*) FILTER (WHERE step > 1e-12) AS c, max(cal_end) AS nc FROM st1 WHERE idx < cal_end AND idx >= 20 GROUP BY 1),
ss AS (SELECT st1.series_id, idx, n, cal_end, c >= 5 AND nc >= 22 AS fitted,
  CASE WHEN c >= 5 AND nc >= 22 THEN abs((step - m) / s) ELSE step END AS struct FROM st1 LEFT JOIN stf USING (series_id))"""


def kernel_sql(cols):
    ks = ", ".join(f"({c} - m_{c}) / (s_{c} + 1e-10) AS k_{c}" for c in cols)
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    inner = " + ".join(f"a.k_{c} * b.k_{c}" for c in cols)
    own = " + ".join(f"k_{c} * k_{c}" for c in cols)
    return f"""kst AS (SELECT series_id, {st} FROM base WHERE idx < cal_end GROUP BY 1),
kx AS (SELECT series_id, idx, n, cal_end, {ks} FROM base JOIN kst USING (series_id)),
kc AS (SELECT a.series_id, a.idx, any_value(a.cal_end) AS cal_end, avg(pow({inner} + 1, 3)) AS cm
  FROM kx a JOIN kx b ON a.series_id = b.series_id AND b.idx < b.cal_end GROUP BY 1, 2),
km AS (SELECT series_id, avg(cm) AS mm FROM kc WHERE idx < cal_end GROUP BY 1),
kr AS (SELECT kx.series_id, kx.idx, kx.n, kx.cal_end, sqrt(greatest(pow({own} + 1, 3) - 2 * cm + mm, 0)) AS kernel
  FROM kx JOIN kc USING (series_id, idx) JOIN km USING (series_id))"""


GRAD = (50, 200, 500)
GRAD_SQL = ",\n".join(
    f"""tr{w} AS (SELECT a.series_id, a.idx, sum(b.sig * g) / sum(g) AS trend FROM base a
  JOIN base b ON a.series_id = b.series_id AND b.idx > a.idx - {w} AND b.idx <= a.idx
  JOIN (SELECT k, exp(-(({w} - 1 - k) * ({w} - 1 - k)) / (2.0 * pow({w} / 3.0, 2))) AS g FROM range({w}) t(k)) ON k = a.idx - b.idx
  GROUP BY 1, 2),
gr{w} AS (SELECT series_id, idx, abs(trend - lag(trend) OVER (PARTITION BY series_id ORDER BY idx)) AS g FROM tr{w}),
su{w} AS (SELECT series_id, idx, CASE WHEN idx >= {max(1, w // 2)} THEN avg(g) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN {max(2, w // 4) - 1} PRECEDING AND CURRENT ROW) ELSE 0 END AS s{w} FROM gr{w})"""
    for w in GRAD
) + """,
gg AS (SELECT base.series_id, base.idx, n, cal_end,
  greatest(0, """ + ", ".join(f"CASE WHEN {w} < n THEN s{w} ELSE 0 END" for w in GRAD) + """) AS gradual,
  greatest(0, """ + ", ".join(f"CASE WHEN {w} < cal_end THEN s{w} ELSE 0 END" for w in GRAD) + """) AS gradual_cal
  FROM base """ + " ".join(f"JOIN su{w} USING (series_id, idx)" for w in GRAD) + ")"


def thr(cte, col, floor, src):
    return (f"{cte} AS (SELECT series_id, CASE WHEN count(*) FILTER (WHERE {col} > {floor}) > 5 THEN quantile_cont({col}, 0.99) "
            f"FILTER (WHERE {col} > {floor}) END AS thr FROM {src} WHERE idx < cal_end GROUP BY 1)")


# --- registered queries ------------------------------------------------------------------

def _base(spark, sf, daily=False):
    df = daily_series(spark, sf) if daily else event_series(spark, sf)
    cols = DAILY_COLS if daily else ["f0"]
    return S.calibration_znorm(df, cols).withColumn("sig", B.channel_mean(cols)), cols


@query("causal_jump", with_(EV, BASE_EV, JUMP_SQL, JUMP_THR, JUMP_SCORE)
       + "SELECT js.series_id, js.idx, " + ", ".join(r(f"j{w}", f"jump_{w}") for w in JW) + f", {r('jump', 'jump')} FROM js JOIN jr USING (series_id, idx)")
def causal_jump(spark, sf):
    cfg = tier0.CausalConfig(scorers=("jump",))
    df, _ = _base(spark, sf)
    raw = home(with_halo(df, back=200).select("*", *[c.alias(k) for k, c in C.jump_columns().items()]))
    rows = F.col(IDX) < F.col("cal_end")
    out_df = attach(raw, tier0.fit_thresholds(raw, rows, cfg, F.col("cal_end")))
    scales = {f"jump_{w}": F.col(f"thr_jump_{w}") for w in JW}
    return out(out_df.withColumn("jump", C.jump_score(scales)), *scales, "jump")


@query("causal_gradual", with_(EV, BASE_EV, GRAD_SQL) + f"SELECT series_id, idx, {r('gradual', 'gradual')}, {r('gradual_cal', 'gradual_cal')} FROM gg")
def causal_gradual(spark, sf):
    df, _ = _base(spark, sf)
    g = C.gradual_columns(with_halo(df.select(SERIES, "chunk", IDX, LEN, "cal_end", "sig"), back=C.LOOKBACK))
    g = g.withColumn("gradual", C.gradual_score(F.col(LEN))).withColumn("gradual_cal", C.gradual_score(F.col("cal_end")))
    return out(g, "gradual", "gradual_cal")


@query("causal_drift", with_(EV, BASE_EV, DRIFT_SQL) + f"SELECT series_id, idx, {r('drift', 'drift')} FROM dr")
def causal_drift(spark, sf):
    df, _ = _base(spark, sf)
    base = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN), F.avg(F.when(F.col(IDX) < F.col("cal_end"), F.col("sig"))).alias("base"))
    wide = with_halo(attach(df, base), back=C.DRIFT_WINDOW - 1)
    return out(home(wide.withColumn("drift", C.drift_raw(F.col("base")))), "drift")


@query("causal_structural", with_(DAILY, BASE_DAILY, step_sql(["z0", "z1", "z2", "z3"])) + f"SELECT series_id, idx, {r('struct', 'struct')} FROM ss")
def causal_structural(spark, sf):
    df, cols = _base(spark, sf, daily=True)
    wide = with_halo(df, back=C.DELAY).withColumn("_step", C.step_sq(cols))
    steps = home(wide.withColumn("step", C.step_distance()))
    fit = steps.groupBy(SERIES).agg(F.max(LEN).alias(LEN), *C.struct_fit(F.col(IDX) < F.col("cal_end")))
    return out(attach(steps, fit).withColumn("struct", C.struct_score()), "struct")


@query("causal_kernel", with_(DAILY, BASE_DAILY, kernel_sql(["z0", "z1", "z2", "z3"])) + f"SELECT series_id, idx, {r('kernel', 'kernel')} FROM kr")
def causal_kernel(spark, sf):
    df, cols = _base(spark, sf, daily=True)
    rows = F.col(IDX) < F.col("cal_end")
    x = S.znorm(df, cols, rows)
    fit = x.groupBy(SERIES).agg(F.max(LEN).alias(LEN), *C.kernel_fit(cols, rows))
    return out(attach(x, fit).withColumn("kernel", C.kernel_distance(cols)), "kernel")


@query("causal_kernel_rbf", with_(EV, BASE_EV, """kst AS (SELECT series_id, avg(sig) AS m, stddev_pop(sig) AS s FROM base WHERE idx < cal_end GROUP BY 1),
kx AS (SELECT series_id, idx, cal_end, (sig - m) / (s + 1e-10) AS k FROM base JOIN kst USING (series_id)),
kc AS (SELECT a.series_id, a.idx, any_value(a.cal_end) AS cal_end, avg(exp(-0.5 * pow(a.k - b.k, 2))) AS cm
  FROM kx a JOIN kx b ON a.series_id = b.series_id AND b.idx < b.cal_end GROUP BY 1, 2),
km AS (SELECT series_id, avg(cm) AS mm FROM kc WHERE idx < cal_end GROUP BY 1)""")
       + f"SELECT series_id, idx, {r('sqrt(greatest(1 - 2 * cm + mm, 0))', 'kernel')} FROM kc JOIN km USING (series_id)")
def causal_kernel_rbf(spark, sf):
    df, _ = _base(spark, sf)
    x = S.znorm(df, ["sig"], F.col(IDX) < F.col("cal_end"))
    return out(C.rbf_distance(x, ["sig"], 0.5), "kernel")


@query("causal_reconstruction")
def causal_reconstruction(spark, sf):
    df, cols = _base(spark, sf, daily=True)
    fit = C.recon_fit(df, cols, F.col(IDX) < F.col("cal_end"))
    return out(C.recon_score(df, fit, cols), "recon")


VOTE_TAIL = " FROM js "


@query("jump_vote", with_(EV, BASE_EV, JUMP_SQL, JUMP_THR, JUMP_SCORE)
       + f"SELECT series_id, idx, {r('CASE WHEN idx >= cal_end THEN jump / (1 + 1e-12) ELSE 0 END', 'score')}, "
         "CAST(idx >= cal_end AND jump / (1 + 1e-12) >= 1 AS INTEGER) AS flag FROM js")
def jump_vote(spark, sf):
    cfg = tier0.CausalConfig(scorers=("jump",))
    scores, _ = tier0.fit_predict(event_series(spark, sf), ["f0"], cfg)
    return out(scores, "score", keys=(SERIES, IDX, "flag"))


@query("vote_user_scorer", with_(EV, BASE_EV, JUMP_SQL, JUMP_THR, JUMP_SCORE, "lv AS (SELECT series_id, idx, cal_end, abs(sig) AS level FROM base)", thr("tl", "level", "1e-12", "lv"),
       "v AS (SELECT js.series_id, js.idx, js.cal_end, level, greatest(jump / (1 + 1e-12), coalesce(CASE WHEN tl.thr > 0 THEN level / (tl.thr + 1e-12) END, 0)) AS s FROM js JOIN lv USING (series_id, idx) LEFT JOIN tl USING (series_id))")
       + f"SELECT series_id, idx, {r('CASE WHEN idx >= cal_end THEN s ELSE 0 END', 'score')}, {r('CASE WHEN idx >= cal_end THEN level ELSE 0 END', 'level')}, CAST(idx >= cal_end AND s >= 1 AS INTEGER) AS flag FROM v")
def vote_user_scorer(spark, sf):
    """A scorer of the user's own, a function from frame to frame, votes beside a built-in one."""
    cfg = tier0.CausalConfig(scorers=("jump", "level"), extra={"level": lambda df: df.withColumn("level", F.abs("sig"))})
    scores, _ = tier0.fit_predict(event_series(spark, sf), ["f0"], cfg)
    return out(scores, "score", "level", keys=(SERIES, IDX, "flag"))


FIVE_Z = ["z0", "z1", "z2", "z3"]
VOTE5 = [DAILY, BASE_DAILY, JUMP_SQL, JUMP_THR, JUMP_SCORE, GRAD_SQL, DRIFT_SQL, step_sql(FIVE_Z), kernel_sql(FIVE_Z),
         thr("tg", "gradual_cal", "0", "gg"), thr("td", "drift", "1e-12", "dr"), thr("tk", "kernel", "1e-12", "kr"),
         "tss AS (SELECT series_id, quantile_cont(struct, 0.99) AS thr FROM ss WHERE idx < cal_end AND idx >= 20 AND fitted GROUP BY 1)",
         """v AS (SELECT js.series_id, js.idx, js.cal_end, jump, gradual, drift, kernel, struct,
  greatest(jump / (1 + 1e-12), coalesce(CASE WHEN tg.thr > 0 THEN gradual / (tg.thr + 1e-12) END, 0),
    coalesce(CASE WHEN td.thr > 0 THEN drift / (td.thr + 1e-12) END, 0),
    coalesce(CASE WHEN tk.thr > 0 THEN kernel / (tk.thr + 1e-12) END, 0),
    coalesce(CASE WHEN tss.thr > 0 THEN struct / (tss.thr + 1e-12) END, 0)) AS s
  FROM js JOIN gg USING (series_id, idx) JOIN dr USING (series_id, idx) JOIN kr USING (series_id, idx) JOIN ss USING (series_id, idx)
  LEFT JOIN tg USING (series_id) LEFT JOIN td USING (series_id) LEFT JOIN tk USING (series_id) LEFT JOIN tss USING (series_id))"""]


@query("vote_five_scorers", with_(*VOTE5) + "SELECT series_id, idx, " + ", ".join(
    r(f"CASE WHEN idx >= cal_end THEN {a} ELSE 0 END", b, 5) for a, b in
    [("s", "score"), ("jump", "jump"), ("gradual", "gradual"), ("drift", "drift"), ("kernel", "kernel"), ("struct", "struct")]) + " FROM v")
def vote_five_scorers(spark, sf):
    cfg = tier0.CausalConfig(scorers=("jump", "gradual", "drift", "kernel", "struct"))
    scores, _ = tier0.fit_predict(daily_series(spark, sf), DAILY_COLS, cfg, between=stage)
    names = ["score", "jump", "gradual", "drift", "kernel", "struct"]
    return scores.select(SERIES, IDX, *[rounded(F.col(c), 5).alias(c) for c in names])


@query("causal_tier")
def causal_tier(spark, sf):
    """All six scorers on the five-column expansion of the event series."""
    cfg = tier0.CausalConfig()
    scores, _ = tier0.fit_predict(B.expand_5(event_series(spark, sf)), [f"f{i}" for i in range(5)], cfg, between=stage)
    return out(scores, "score", *cfg.names(), keys=(SERIES, IDX, "flag"))


@query("causal_tier_daily")
def causal_tier_daily(spark, sf):
    cfg = tier0.CausalConfig()
    scores, _ = tier0.fit_predict(daily_series(spark, sf), DAILY_COLS, cfg, between=stage)
    return out(scores, "score", *cfg.names(), keys=(SERIES, IDX, "flag"))
