"""Queries over batch scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions.kernels import Kernel
from tidewatch.functions import spectrum as SP
from tidewatch.functions.numeric import rounded
from tidewatch.operators import batch_scores as L, paths as K, profile as N
from tidewatch.operators.layout import IDX, LEN, SERIES, by_chunk, home, long_form, with_halo
from tidewatch.plans import batch
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.catalog_jumps import BASE, INTEG, detected
from tidewatch.plans.catalog_paths import GIVEN, PATHS, PHASE, PULSE, STEP, XS, given
from tidewatch.plans.registry import query
from tidewatch.plans.sql import DAILY, EV, r, with_
from tidewatch.session import shared_dir, stage
from tidewatch.sources.sinks import save_analysis, score_summary
from tidewatch.sources.tables import event_series

XDOT = " + ".join(f"a.x{i} * b.x{i}" for i in range(4))
PDOT = " + ".join(f"a.p{i} * b.p{i}" for i in range(4))
RECON = f"""gp AS (SELECT a.series_id, a.idx, sum(pow({XDOT}, 2)) AS gg, sum(({XDOT}) * ({PDOT})) AS gr, sum(pow({PDOT}, 2)) AS rr
  FROM given a JOIN given b USING (series_id) GROUP BY 1, 2),
gn AS (SELECT series_id, sqrt(sum(gg)) AS g, sqrt(sum(rr)) AS q FROM gp GROUP BY 1),
er AS (SELECT series_id, idx, sqrt(greatest(gg / (g * g) - 2 * gr / (g * q) + rr / (q * q), 0)) AS err FROM gp JOIN gn USING (series_id))"""


@query("reconstruction_error", with_(DAILY, GIVEN, RECON) + f"SELECT series_id, idx, {r('err', 'recon_error')} FROM er")
def reconstruction_error(spark, sf):
    return out(L.reconstruction_error(given(spark, sf), XS, PATHS), "recon_error")


def path_figures(df):
    return K.figures(df, PATHS)


def _hybrid(union):
    def run(spark, sf):
        df = stage(given(spark, sf), "given")
        h = L.hybrid_score(df, XS, PATHS, path_figures(df), use_union=union)
        return h.select(SERIES, IDX, rounded(F.col("hybrid"), 4).alias("hybrid"))
    return run


HYB = (DAILY, GIVEN, STEP, PHASE, PULSE, RECON,
       "pv AS (SELECT series_id, path, 0.5 * (abs(charge) + 0.5 * stability) + 0.3 * (0.4 * intensity + 0.3 * abs(asymmetry) + 0.3 * power) AS v FROM ch JOIN tp USING (series_id, path) JOIN pz USING (series_id, path))",
       "mp AS (SELECT series_id, path, abs(sum(dx)) AS t FROM pd GROUP BY 1, 2)",
       "main AS (SELECT series_id, path FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC, path) AS rn FROM mp) WHERE rn = 1)")
HYB_TAIL = """st AS (SELECT pj.series_id, idx, sum(abs(x) * v) AS s, coalesce(bool_or({cond}), false) AS j FROM pj JOIN pv USING (series_id, path) GROUP BY 1, 2),
hy AS (SELECT series_id, idx, 0.3 * err + 0.7 * CASE WHEN j THEN err ELSE 0 END + s AS h FROM st JOIN er USING (series_id, idx)),
hs AS (SELECT series_id, avg(h) AS m, stddev_pop(h) AS sd FROM hy GROUP BY 1)"""
HYB_SEL = f"SELECT series_id, idx, {r('(h - m) / sd', 'hybrid', 4)} FROM hy JOIN hs USING (series_id)"
query("hybrid_score", with_(*HYB, HYB_TAIL.format(cond="abs(dx) > dm + 1.2 * ds")) + HYB_SEL)(_hybrid(True))
query("hybrid_score_main_path", with_(*HYB, HYB_TAIL.format(cond="abs(dx) > dm + 1.2 * ds AND path = (SELECT path FROM main WHERE main.series_id = pj.series_id)")) + HYB_SEL)(_hybrid(False))


@query("structural_score", with_(DAILY, GIVEN, STEP, PHASE, """sc AS (SELECT series_id, idx, stddev_pop(abs(dx)) * max(abs(dx)) AS a, sum(abs(x) * abs(charge)) AS eff, max(x * x) / (sum(x * x) + 1e-10) AS sh
  FROM pd JOIN ch USING (series_id, path) GROUP BY 1, 2)""")
       + f"SELECT series_id, idx, {r('coalesce(a, 0) + coalesce(abs(eff - lag(eff) OVER (PARTITION BY series_id ORDER BY idx)), 0) + sh * sh', 'structural')} FROM sc")
def structural_score(spark, sf):
    df = given(spark, sf)
    return out(L.structural_score(df, PATHS, K.topology(df, PATHS)), "structural")


KS = {"rbf": Kernel("rbf", gamma=0.5), "polynomial": Kernel("polynomial"), "sigmoid": Kernel("sigmoid", alpha=0.1, coef0=0.0),
      "laplacian": Kernel("laplacian", gamma=0.5), "periodic": Kernel("periodic", period=7.0)}
L2 = " + ".join(f"pow(a.x{i} - b.x{i}, 2)" for i in range(4))
L1 = " + ".join(f"abs(a.x{i} - b.x{i})" for i in range(4))
SN = " + ".join(f"pow(sin(pi() * abs(a.x{i} - b.x{i}) / 7.0), 2)" for i in range(4))
KSQL = {"rbf": f"exp(-0.5 * ({L2}))", "polynomial": f"pow({XDOT} + 1, 3)", "sigmoid": f"tanh(0.1 * ({XDOT}))", "laplacian": f"exp(-0.5 * ({L1}))", "periodic": f"exp(-2 * ({SN}))"}


@query("kernel_functions", with_(DAILY, GIVEN) + "SELECT a.series_id, a.idx, " + ", ".join(r(v, k) for k, v in KSQL.items()) + " FROM given a JOIN given b ON a.series_id = b.series_id AND b.idx = a.idx - 1")
def kernel_functions(spark, sf):
    """Every kernel between a row and the one before it."""
    df = with_halo(given(spark, sf), back=1).withColumn("x", F.array(*XS))
    df = home(df.withColumn("y", F.lag("x").over(by_chunk()))).filter("y is not null")
    return df.select(SERIES, IDX, *[rounded(k.column(F.col("x"), F.col("y"))).alias(n) for n, k in KS.items()])


def _kerr(k):
    return f"""kp AS (SELECT series_id, idx, sum(k * k) AS a, sum(k * k * p) AS b, sum(k * k * p * p) AS c FROM (
    SELECT a.series_id, a.idx, {KSQL[k]} AS k, {PDOT} AS p FROM given a JOIN given b USING (series_id)) GROUP BY 1, 2),
kn AS (SELECT series_id, sqrt(sum(a)) AS g, sqrt(sum(c)) AS q FROM kp GROUP BY 1)"""


for _k in ("rbf", "polynomial", "laplacian"):
    def _run(spark, sf, _k=_k):
        return out(L.kernel_errors(given(spark, sf), XS, PATHS, [KS[_k]]).withColumnRenamed("kernel_0", "kernel"), "kernel")

    query(f"kernel_error_{_k}", with_(DAILY, GIVEN, _kerr(_k)) + f"SELECT series_id, idx, {r('sqrt(greatest(a / (g * g) - 2 * b / (g * q) + c / (q * q), 0))', 'kernel')} FROM kp JOIN kn USING (series_id)")(_run)


@query("kernel_auto")
def kernel_auto(spark, sf):
    df = stage(given(spark, sf), "given")
    s = SP.spectrum(long_form(df, XS, "feature", "x", [SERIES, IDX]), [SERIES, "feature"], "x")
    scored, _ = L.kernel_auto(df, XS, PATHS, SP.period_candidates(s, [SERIES, "feature"]))
    return out(scored, "kernel")


@query("score_summary", with_(EV) + f"SELECT series_id, n, {r('avg(f0)', 'mean')}, {r('stddev_pop(f0)', 'std')}, {r('max(f0)', 'max')}, {r('min(f0)', 'min')}, {r('quantile_cont(f0, 0.95)', 'p95')} FROM ev GROUP BY 1, 2")
def summary_of_scores(spark, sf):
    return out(score_summary(event_series(spark, sf), "f0"), "mean", "std", "max", "min", "p95", keys=(SERIES, LEN))


@query("batch_analysis")
def batch_analysis(spark, sf):
    a = batch.analyse(given(spark, sf), XS)
    return a.path_stats.select(SERIES, "path", "charge", "stability", "energy", "shannon", "class")


@query("batch_score")
def batch_score(spark, sf):
    a = batch.analyse(given(spark, sf), XS)
    return batch.fuse(a)


@query("explain_flagged")
def explain_flagged(spark, sf):
    df = given(spark, sf, jumps=True)
    df = df.withColumn("score", F.abs("x0"))
    stats = K.classify(path_figures(df)).join(K.energy(K.pulsation(df, PATHS)).select(SERIES, "path", "energy"), [SERIES, "path"]).join(
        K.entropies(df, PATHS).select(SERIES, "path", "shannon"), [SERIES, "path"])
    e = L.explain_rows(df, PATHS, stats, flagged=F.col("score") > 2)
    return e.select(SERIES, IDX, rounded(F.col("score")).alias("score"), F.to_json("explanation").alias("explanation"))


@query("result_tables", with_(*BASE, INTEG) + f"SELECT 'jump_rows' AS kind, series_id, idx, {r('importance', 'value')} FROM ji WHERE unified UNION ALL SELECT 'scores', series_id, idx, {r('f2', 'value')} FROM daily")
def result_tables(spark, sf):
    """Tables of an analysis written to a folder and read back."""
    jumps, df = detected(spark, sf), given(spark, sf)
    stats = K.entropies(df, PATHS)
    a = batch.Analysis(df, jumps, tuple(PATHS), stats, N.window_sizes(N.volatility(df, XS)), jumps.cols)
    path = f"{shared_dir(spark)}/tidewatch/results-{uuid.uuid4().hex}"
    save_analysis(a, jumps.rows.select(SERIES, "chunk", IDX, LEN, F.col("f2").alias("score")), path)
    back = lambda name, value: spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("kind"), SERIES, IDX, rounded(F.col(value)).alias("value"))
    return back("jump_rows", "importance").unionByName(back("scores", "score"))
