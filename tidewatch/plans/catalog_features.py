"""Queries over spectra, path features and data profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import spectrum as SP
from tidewatch.functions.numeric import rounded
from tidewatch.operators import causal as C, features as B, path_features as M, profile as N, scale as S
from tidewatch.operators.layout import IDX, LEN, SERIES, attach, long_form
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.catalog_evaluate import auc_sql
from tidewatch.plans.catalog_paths import GIVEN, PATHS, STEP, PHASE, PULSE, XS, ent_sql, given
from tidewatch.plans.registry import query
from tidewatch.plans.sql import DAILY, EV, r, with_
from tidewatch.sources.tables import DAILY_COLS, daily_series, event_series

TAU = "6.283185307179586"


def dft(src, dst, key, value, top="n // 2"):
    return f"""{dst} AS (SELECT series_id, {key}, n AS m, k, sqrt(pow(sum({value} * cos({TAU} * ((k * idx) % n) / n)), 2) + pow(sum({value} * sin({TAU} * ((k * idx) % n) / n)), 2)) AS amp
  FROM (SELECT *, unnest(range(0, {top} + 1)) AS k FROM {src}) GROUP BY 1, 2, 3, 4)"""


PERIOD_SQL = """cal AS (SELECT series_id, 'sig' AS feature, idx, cal_end AS n, z FROM evz WHERE idx < cal_end)""", dft("cal", "sp", "feature", "z"), """
pd AS (SELECT series_id, any_value(m) AS m, arg_max(k, amp) AS k FROM sp WHERE m >= 24 AND m // 3 > 12 AND k / m > 1.0 / (m // 3) AND k / m < 1.0 / 12 GROUP BY 1),
per AS (SELECT DISTINCT evc.series_id, cal_end AS m, CASE WHEN pd.k IS NOT NULL THEN greatest(12, CAST(round_even(pd.m / pd.k, 0) AS INTEGER)) END AS period FROM evc LEFT JOIN pd USING (series_id))"""


def _periods(spark, sf):
    df = S.calibration_znorm(event_series(spark, sf), ["f0"]).withColumnRenamed("f0", "sig")
    cal = df.filter(F.col(IDX) < F.col("cal_end"))
    return df, SP.dominant_period(cal, "sig")


@query("period_dominant", with_(EV, *PERIOD_SQL) + "SELECT series_id, m, period FROM per")
def period_dominant(spark, sf):
    return _periods(spark, sf)[1]


@query("causal_periodic", with_(EV, *PERIOD_SQL) + f"SELECT a.series_id, a.idx, {r('coalesce(abs(a.z - b.z), 0)', 'periodic')} FROM evz a JOIN per USING (series_id) LEFT JOIN evz b ON b.series_id = a.series_id AND b.idx = a.idx - period")
def causal_periodic(spark, sf):
    df, p = _periods(spark, sf)
    fitted = p.join(df.groupBy(SERIES).agg(F.max(LEN).alias(LEN)), SERIES)
    return out(C.periodic_residual(df, fitted), "periodic")


@query("period_candidates")
def period_candidates(spark, sf):
    df = given(spark, sf)
    s = SP.spectrum(long_form(df, XS, "feature", "x", [SERIES, IDX]), [SERIES, "feature"], "x")
    return SP.period_candidates(s, [SERIES, "feature"]).select(SERIES, F.posexplode("periods").alias("rank", "period"))


SHAPE_SQL = """pb AS (SELECT * FROM sp WHERE k >= 1 AND k <= (m - 1) // 2),
sh AS (SELECT series_id, path, any_value(m) AS m, arg_max(k, amp) AS pk, max(amp) AS freq_peak_amp, sum(amp * amp) AS freq_energy, sum(k / m * amp) / sum(amp) AS freq_centroid,
  sum(amp * amp) FILTER (WHERE k > ((m - 1) // 2) // 2) / (sum(amp * amp) FILTER (WHERE k <= ((m - 1) // 2) // 2) + 1e-10) AS freq_hf_lf_ratio FROM pb GROUP BY 1, 2),
se AS (SELECT series_id, path, -sum(q * ln(q + 1e-10)) AS freq_entropy FROM (SELECT series_id, path, amp / sum(amp) OVER (PARTITION BY series_id, path) AS q FROM pb) GROUP BY 1, 2)"""
SHAPES = ["freq_peak", "freq_peak_amp", "freq_energy", "freq_centroid", "freq_entropy", "freq_hf_lf_ratio"]


@query("path_spectrum", with_(DAILY, GIVEN, dft("pl", "sp", "path", "x"), SHAPE_SQL) + f"SELECT series_id, path, {r('pk / m', 'freq_peak')}, " + ", ".join(r(c, c) for c in SHAPES[1:4])
       + f", {r('freq_entropy', 'freq_entropy')}, {r('freq_hf_lf_ratio', 'freq_hf_lf_ratio')} FROM sh JOIN se USING (series_id, path)")
def path_spectrum(spark, sf):
    return out(M.path_spectrum(given(spark, sf), PATHS), *SHAPES, keys=(SERIES, "path"))


@query("path_basic_features", with_(DAILY, GIVEN, STEP, PHASE, PULSE, dft("pl", "sp", "path", "x"), SHAPE_SQL, "ea AS (SELECT series_id, path, abs(x) + 1e-10 AS a FROM pl)", f"en AS (SELECT series_id, path, {ent_sql('a')} FROM ea GROUP BY 1, 2)")
       + f"SELECT series_id, path, {r('charge', 'charge')}, {r('stability', 'stability')}, {r('ss + 0.3 * power', 'energy')}, {r('shannon', 'shannon')}, {r('intensity', 'intensity')}, {r('freq_centroid', 'freq_centroid')} "
         "FROM ch JOIN tp USING (series_id, path) JOIN pz USING (series_id, path) JOIN sh USING (series_id, path) JOIN en USING (series_id, path)")
def path_basic_features(spark, sf):
    b = M.basic_features(given(spark, sf), PATHS)
    return out(b, "charge", "stability", "energy", "shannon", "intensity", "freq_centroid", keys=(SERIES, "path"))


@query("path_shape", with_(DAILY, GIVEN, """mo AS (SELECT series_id, path, avg(x) AS mu, stddev_pop(x) AS sd, any_value(n) AS n FROM pl GROUP BY 1, 2),
ce AS (SELECT pl.series_id, path, idx, pl.n, x - mu AS c, sd FROM pl JOIN mo USING (series_id, path)),
lg AS (SELECT *, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3, lag(c, 4) OVER w AS c4 FROM ce WINDOW w AS (PARTITION BY series_id, path ORDER BY idx)),
sm AS (SELECT series_id, path, any_value(n) AS n, any_value(sd) AS sd, sum(c * c * c) AS m3, sum(c * c * c * c) AS m4, sum(c * c) AS a0, sum(c * c1) AS a1, sum(c * c2) AS a2, sum(c * c3) AS a3, sum(c * c4) AS a4 FROM lg GROUP BY 1, 2)""")
       + f"SELECT series_id, path, {r('m3 / (n * pow(sd, 3))', 'skew')}, {r('m4 / (n * pow(sd, 4)) - 3', 'kurtosis')}, "
       + r("CASE WHEN sd * sd > 1e-10 THEN (a0 / n + a1 / (n - 1) + a2 / (n - 2) + a3 / (n - 3) + a4 / (n - 4)) / (5 * sd * sd) ELSE 0 END", "autocorr") + " FROM sm")
def path_shape(spark, sf):
    return out(M.path_shape(given(spark, sf), PATHS), "skew", "kurtosis", "autocorr", keys=(SERIES, "path"))


XL = "xl AS (SELECT series_id, idx, n, feature, x FROM given UNPIVOT (x FOR feature IN (x0, x1, x2, x3)))"
PAIRS4 = [(i, j) for i in range(4) for j in range(i + 1, 4)]


@query("event_spectrum", with_(DAILY, GIVEN, XL, dft("xl", "sp", "feature", "x", "n - 1"), """pf AS (SELECT series_id, feature, any_value(m) AS m, max(amp) FILTER (WHERE k >= 1 AND k < m // 2) AS pk,
  arg_max(k, amp) FILTER (WHERE k >= 1 AND k < m // 2) AS kk, sum(amp * amp) AS en, sum(amp * amp) FILTER (WHERE k >= 1 AND k < m // 2) AS ea, sum(amp * amp) FILTER (WHERE k >= 1 AND k < m // 10) AS el FROM sp GROUP BY 1, 2),
pa AS (SELECT series_id, avg(pk) AS freq_peak_amp, avg(en) AS freq_energy, stddev_pop((kk - 1) / (m // 2 - 1)) AS freq_dispersion, sum(el) / (sum(ea) + 1e-10) AS low_freq_ratio FROM pf GROUP BY 1),
wd AS (PIVOT sp ON feature IN ('x0', 'x1', 'x2', 'x3') USING max(amp) GROUP BY series_id, k),
co AS (SELECT series_id, (""" + " + ".join(f"corr(x{i}, x{j})" for i, j in PAIRS4) + ") / 6 AS freq_correlation FROM wd GROUP BY 1)")
       + f"SELECT series_id, {r('freq_peak_amp', 'freq_peak_amp')}, {r('freq_energy', 'freq_energy', 3)}, {r('freq_dispersion', 'freq_dispersion')}, {r('low_freq_ratio', 'low_freq_ratio')}, {r('freq_correlation', 'freq_correlation')} FROM pa JOIN co USING (series_id)")
def event_spectrum(spark, sf):
    e = M.event_spectrum(given(spark, sf), XS).withColumn("freq_energy", rounded(F.col("freq_energy"), 3))
    return e.select(SERIES, "freq_energy", *[rounded(F.col(c)).alias(c) for c in ("freq_peak_amp", "freq_dispersion", "low_freq_ratio", "freq_correlation")])


QSE = "qse AS (SELECT series_id, path, charge, stability, ss + 0.3 * power AS energy FROM ch JOIN tp USING (series_id, path) JOIN pz USING (series_id, path))"
PHYS = {"q_over_s": "charge / (stability + 1e-8)", "q_times_e": "charge * energy", "sq_q": "charge * charge", "e_times_s": "energy * stability", "sqrt_s": "sqrt(stability + 1e-8)",
        "log_s": "ln(stability + 1e-8)", "sqrt_q": "sqrt(abs(charge) + 1e-8)", "log_q": "ln(abs(charge) + 1e-8)", "q_x_s": "charge * stability", "q_div_s": "charge / (stability + 1e-10)",
        "q_x_e": "charge * energy", "q_div_e": "charge / (energy + 1e-10)", "s_x_e": "stability * energy", "s_div_e": "stability / (energy + 1e-10)"}


def _qse(spark, sf):
    df = given(spark, sf)
    return M.topology(df, PATHS).join(M.energy(M.pulsation(df, PATHS)), [SERIES, "path"]).select(SERIES, "path", "charge", "stability", "energy")


@query("feature_combinations", with_(DAILY, GIVEN, STEP, PHASE, PULSE, QSE) + "SELECT series_id, path, " + ", ".join(r(v, k, 4) for k, v in PHYS.items()) + " FROM qse")
def feature_combinations(spark, sf):
    return _qse(spark, sf).select(SERIES, "path", *[rounded(v, 4).alias(k) for k, v in M.physical_features().items()])


NL = {}
for _c in ("charge", "energy"):
    NL |= {f"log_{_c}": f"ln(1 + abs({_c}))", f"sqrt_{_c}": f"sqrt(abs({_c}))", f"sq_{_c}": f"{_c} * {_c}", f"sig_{_c}": f"1 / (1 + exp(-{_c}))"}


@query("feature_nonlinear", with_(DAILY, GIVEN, STEP, PHASE, PULSE, QSE) + "SELECT series_id, path, " + ", ".join(r(v, k) for k, v in NL.items()) + " FROM qse")
def feature_nonlinear(spark, sf):
    return _qse(spark, sf).select(SERIES, "path", *[rounded(v).alias(k) for k, v in M.nonlinear(["charge", "energy", "freq_peak"]).items()])


INTER = {"q_x_freq_amplitude": "q * a", "s_x_freq_amplitude": "s * a", "e_x_freq_amplitude": "e * a", "q_x_freq_energy": "q * w", "q_div_freq_energy": "q / (w + 1e-10)"}


@query("feature_spectral_interactions", with_(DAILY, GIVEN, XL, STEP, PHASE, PULSE, QSE, dft("xl", "sp", "feature", "x"), """ag AS (SELECT series_id, avg(pk) AS a FROM (SELECT series_id, feature, max(amp) FILTER (WHERE k >= 1 AND k < m // 2) AS pk FROM sp GROUP BY 1, 2) GROUP BY 1),
wg AS (SELECT series_id, any_value(n) * sum(x * x) / 4 AS w FROM xl GROUP BY 1), qg AS (SELECT series_id, avg(charge) AS q, avg(stability) AS s, avg(energy) AS e FROM qse GROUP BY 1)""")
       + "SELECT series_id, " + ", ".join(r(v, k, 3) for k, v in INTER.items()) + " FROM ag JOIN wg USING (series_id) JOIN qg USING (series_id)")
def feature_spectral_interactions(spark, sf):
    means = _qse(spark, sf).groupBy(SERIES).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("charge", "stability", "energy")])
    e = M.event_spectrum(given(spark, sf), XS).join(means, SERIES)
    return e.select(SERIES, *[rounded(v, 3).alias(k) for k, v in M.spectral_interactions().items()])


@query("feature_projection", with_(DAILY, GIVEN, STEP, PHASE) + "SELECT series_id, idx, " + r("sum(abs(x) * charge)", "charge") + ", " + r("sum(abs(x) * stability)", "stability")
       + " FROM pl JOIN ch USING (series_id, path) JOIN tp USING (series_id, path) GROUP BY 1, 2")
def feature_projection(spark, sf):
    df = given(spark, sf)
    return out(M.project(df, PATHS, M.topology(df, PATHS), ["charge", "stability"]), "charge", "stability")


LAB = "lab AS (SELECT *, CASE WHEN x0 + x2 > 2 THEN 1 ELSE 0 END AS label FROM given)"


def labelled(spark, sf):
    return given(spark, sf).withColumn("label", F.when(F.col("x0") + F.col("x2") > 2, 1).otherwise(0))


SEL = (DAILY, GIVEN, LAB, "cr AS (" + " UNION ALL ".join(f"SELECT series_id, 'x{i}' AS feature, abs(corr(x{i}, label)) AS corr FROM lab GROUP BY 1" for i in range(4)) + ")",
       "tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY corr DESC, feature) AS rn FROM cr) WHERE rn <= 2)")


@query("feature_select_fast", with_(*SEL) + f"SELECT series_id, feature, {r('corr', 'corr')} FROM tk")
def feature_select_fast(spark, sf):
    return out(M.select_by_correlation(labelled(spark, sf), XS, "label", top=2)[0], "corr", keys=(SERIES, "feature"))


@query("feature_select_fast_auc", with_(*SEL, "lx AS (SELECT series_id, idx, label, feature, x FROM lab UNPIVOT (x FOR feature IN (x0, x1, x2, x3)))",
       "su AS (SELECT series_id, label, round(sum(x), 9) AS s FROM lx JOIN tk USING (series_id, feature) GROUP BY series_id, idx, label)", auc_sql("su", ["series_id"], "s")) + f"SELECT series_id, {r('auc', 'auc', 3)} FROM au")
def feature_select_fast_auc(spark, sf):
    return M.select_by_correlation(labelled(spark, sf), XS, "label", top=2)[1].select(SERIES, rounded(F.col("auc"), 3).alias("auc"))


@query("feature_select_robust")
def feature_select_robust(spark, sf):
    return out(M.select_by_lasso(labelled(spark, sf), XS, "label")[0], "weight", "corr", keys=(SERIES, "feature"))


@query("feature_score", with_(DAILY, GIVEN, STEP, PHASE, "pr AS (SELECT series_id, idx, sum(abs(x) * charge) AS a, sum(abs(x) * stability) AS b FROM pl JOIN ch USING (series_id, path) JOIN tp USING (series_id, path) GROUP BY 1, 2)",
       "ps2 AS (SELECT series_id, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM pr GROUP BY 1)")
       + f"SELECT series_id, idx, {r('0.7 * CASE WHEN sa > 1e-10 THEN (a - ma) / sa ELSE a END + 0.3 * CASE WHEN sb > 1e-10 THEN (b - mb) / sb ELSE b END', 'score')} FROM pr JOIN ps2 USING (series_id)")
def feature_score(spark, sf):
    from tidewatch.operators.fusion import integrate

    df = given(spark, sf)
    rows = M.project(df, PATHS, M.topology(df, PATHS), ["charge", "stability"])
    return out(integrate(rows, {"charge": 0.7, "stability": 0.3}), "score")


PROFILE = (DAILY, GIVEN, XL, dft("xl", "sp", "feature", "x"), """gl AS (SELECT series_id, any_value(n) AS n, stddev_pop(x) AS gs, avg(abs(x)) AS ma FROM xl GROUP BY 1),
df0 AS (SELECT series_id, feature, x - lag(x) OVER (PARTITION BY series_id, feature ORDER BY idx) AS d FROM xl),
tv AS (SELECT series_id, avg(s) AS tv FROM (SELECT series_id, feature, stddev_pop(d) AS s FROM df0 GROUP BY 1, 2) GROUP BY 1),
cc AS (SELECT series_id, 1 - (""" + " + ".join(f"abs(corr(x{i}, x{j}))" for i, j in PAIRS4) + """) / 6 AS cc FROM given GROUP BY 1),
lw AS (SELECT a.series_id, a.idx, stddev_pop(b.x) AS s FROM given a JOIN xl b ON b.series_id = a.series_id AND b.idx >= a.idx AND b.idx < a.idx + 30 WHERE a.idx % 15 = 0 AND a.idx < a.n - 30 GROUP BY 1, 2),
lv AS (SELECT series_id, stddev_pop(s) / (avg(s) + 1e-10) AS lv FROM lw GROUP BY 1),
lf AS (SELECT series_id, sum(amp) FILTER (WHERE k < m // 10) / sum(amp) FILTER (WHERE k < m // 2) AS lf FROM sp GROUP BY 1),
pr AS (SELECT *, gs / (ma + 1e-10) AS gv FROM gl JOIN tv USING (series_id) JOIN cc USING (series_id) JOIN lv USING (series_id) JOIN lf USING (series_id)),
sc AS (SELECT *, CASE WHEN gv > 2.0 THEN 0.8::DOUBLE WHEN gv < 0.3 THEN 1.5 ELSE 1 END * CASE WHEN tv > gs * 2 THEN 0.9::DOUBLE WHEN tv < gs * 0.3 THEN 1.4 ELSE 1 END * CASE WHEN cc > 0.7 THEN 1.2::DOUBLE WHEN cc < 0.3 THEN 0.9 ELSE 1 END
  * CASE WHEN lv > 1.0 THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN lf > 0.8 THEN 1.4::DOUBLE WHEN lf < 0.3 THEN 0.8 ELSE 1 END AS f, greatest(100, least(n // 10, 2000)) AS top,
  greatest(CASE WHEN n > 300 THEN 30 WHEN n > 100 THEN 24 ELSE 18 END, n // 20) AS base FROM pr),
wl AS (SELECT *, least(greatest(floor(base * f), 10), top) AS w FROM sc)""")


@query("profile_volatility", with_(*PROFILE) + f"SELECT series_id, n, {r('gv', 'global_volatility')}, {r('tv', 'temporal_volatility')}, {r('cc', 'correlation_complexity')}, {r('lv', 'local_variation')}, {r('lf', 'low_freq_ratio')} FROM pr")
def profile_volatility(spark, sf):
    v = N.volatility(given(spark, sf), XS)
    return out(v, "global_volatility", "temporal_volatility", "correlation_complexity", "local_variation", "low_freq_ratio", keys=(SERIES, LEN))


def _i(expr, name):
    return f"CAST({expr} AS INTEGER) AS {name}"


@query("profile_windows", with_(*PROFILE) + f"SELECT series_id, {r('f', 'scale_factor')}, {_i('w', 'w_local')}, {_i('least(greatest(floor(w * 0.5), 5), top // 3)', 'w_jump')}, {_i('least(greatest(floor(w * 1.3), 20), top)', 'w_entropy')}, "
       f"{_i('least(greatest(floor(w * 1.5), 10), top)', 'w_tension')}, " + ", ".join(_i(f"least(greatest(floor(w * {s}), 10), top)", f"w_scale_{i}") for i, s in enumerate(N.SCALES)) + " FROM wl")
def profile_windows(spark, sf):
    w = N.window_sizes(N.volatility(given(spark, sf), XS))
    return out(w, "scale_factor", keys=(SERIES, "w_local", "w_jump", "w_entropy", "w_tension", *[f"w_scale_{i}" for i in range(5)]))


@query("profile_refine", with_(*PROFILE, "st AS (SELECT series_id, avg(abs(x0)) * 2.5 AS ms, avg(CASE WHEN x1 > 0.8 THEN 1 ELSE 0 END) AS jd FROM given GROUP BY 1)",
       "rf AS (SELECT wl.*, jd, least(greatest(floor(w * 0.5), 5), top // 3) AS j0, CASE WHEN ms > 2.0 THEN floor(w * 0.8) ELSE w END AS w2, ms FROM wl JOIN st USING (series_id))",
       "rj AS (SELECT *, CASE WHEN ms > 2.0 THEN floor(j0 * 0.7) ELSE j0 END AS j1 FROM rf)")
       + f"SELECT series_id, {_i('w2', 'w_local')}, {_i('CASE WHEN jd > 0.2 THEN greatest(5, floor(j1 * 0.6)) ELSE j1 END', 'w_jump')}, {r('CASE WHEN gv > 1.5 THEN 92 WHEN gv < 0.5 THEN 96 ELSE 94 END', 'delta_percentile')}, "
         f"{r('CASE WHEN tv > gv THEN 89 ELSE 91 END', 'local_percentile')}, {r('greatest(80, least(91 - (gv - 1) * 5, 98))', 'p_scale_2')}, {r('1.5 / f', 'jump_scale')}, {r('0.05 * f', 'alpha')}, {r('0.3 + 0.2 * cc', 'w_topo')}, lv > 0.8 AS use_union FROM rj")
def profile_refine(spark, sf):
    df = given(spark, sf)
    result = df.groupBy(SERIES).agg((F.avg(F.abs("x0")) * 2.5).alias("mean_stability"), F.avg(F.when(F.col("x1") > 0.8, 1.0).otherwise(0.0)).alias("jump_density"))
    t = N.refine(N.window_sizes(N.volatility(df, XS)), result)
    return out(t, "delta_percentile", "local_percentile", "p_scale_2", "jump_scale", "alpha", "w_topo", keys=(SERIES, "w_local", "w_jump", "use_union"))
