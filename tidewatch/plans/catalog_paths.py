"""Queries over paths and their statistics.

Comparison with SQL uses given paths: the daily features, centred and scaled to unit norm.
The estimated paths themselves are checked by tests, since their sign is arbitrary.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewatch.functions.numeric import rounded
from tidewatch.operators import jumps as I, paths as K
from tidewatch.operators.layout import IDX, LEN, SERIES, attach, home, long_form, with_halo
from tidewatch.operators.scale import series_stats
from tidewatch.plans.catalog_basic import out
from tidewatch.plans.catalog_jumps import BASE, INTEG, detected
from tidewatch.plans.registry import query
from tidewatch.plans.sql import DAILY, r, with_
from tidewatch.sources.tables import DAILY_COLS, daily_series

PATHS = ["p0", "p1", "p2", "p3"]
XS = ["x0", "x1", "x2", "x3"]
GIVEN = """gm AS (SELECT series_id, """ + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in range(4)) + """ FROM daily GROUP BY 1),
given AS (SELECT series_id, idx, n, """ + ", ".join(f"round((f{i} - m{i}) / s{i}, 6) AS x{i}, round((f{i} - m{i}) / (s{i} * sqrt(n)), 9) AS p{i}" for i in range(4)) + """ FROM daily JOIN gm USING (series_id)),
pl AS (SELECT series_id, idx, n, path, x FROM given UNPIVOT (x FOR path IN (p0, p1, p2, p3)))"""
STEP = """pd AS (SELECT *, x - lag(x) OVER w AS dx, lead(x) OVER w AS nx, lag(x) OVER w AS b1, lag(x, 2) OVER w AS b2, first(x) OVER w AS x0
  FROM pl WINDOW w AS (PARTITION BY series_id, path ORDER BY idx)),
ps AS (SELECT series_id, path, avg(abs(dx)) AS dm, stddev_pop(dx) AS unused, stddev_pop(abs(dx)) AS ds FROM pd GROUP BY 1, 2),
pj AS (SELECT pd.*, dm, ds FROM pd JOIN ps USING (series_id, path))"""
PI = "3.141592653589793"
WRAP = f"CASE WHEN dd > {PI} THEN dd - 2 * {PI} WHEN dd < -{PI} THEN dd + 2 * {PI} ELSE dd END"
PHASE = f"""ph AS (SELECT *, atan2(CASE WHEN idx = n - 1 THEN x0 ELSE nx END, x) AS th FROM pd),
pw AS (SELECT *, lead(th) OVER (PARTITION BY series_id, path ORDER BY idx) - th AS dd FROM ph),
pq AS (SELECT *, {WRAP} AS dth, CAST(ceil(10 * (idx + 1) / n) - 1 AS BIGINT) AS seg FROM pw),
sg AS (SELECT series_id, path, seg, sum(dth) FILTER (WHERE idx < floor((seg + 1) * n / 10) - 1) AS q FROM pq GROUP BY 1, 2, 3),
tp AS (SELECT series_id, path, sqrt(avg(coalesce(q, 0) * coalesce(q, 0)) - pow(avg(coalesce(q, 0)), 2)) AS stability FROM sg GROUP BY 1, 2),
ch AS (SELECT series_id, path, sum(dth) / (2 * {PI}) AS charge FROM pq GROUP BY 1, 2)"""
PULSE = """pu AS (SELECT series_id, path, any_value(n) AS n, coalesce(sum(dx) FILTER (WHERE dx > dm + 2 * ds), 0) AS up, coalesce(-sum(dx) FILTER (WHERE -dx > dm + 2 * ds), 0) AS dn,
  count(*) FILTER (WHERE abs(dx) > dm + 2 * ds) AS n_jumps, sum(x * x) AS ss FROM pj GROUP BY 1, 2),
pz AS (SELECT *, up + dn AS intensity, (up - dn) / (up + dn + 1e-10) AS asymmetry, (up + dn) * n_jumps / n AS power FROM pu)"""


def ent_sql(a, w="1", group=True):
    """Six figures over rows with weight w; ``a`` is |x| + 1e-10."""
    return (f"ln(sum({w} * {a})) - sum({w} * {a} * ln({a})) / sum({w} * {a}) AS shannon, -ln(sum({w} * {a} * {a}) / pow(sum({w} * {a}), 2)) AS renyi_2, "
            f"(1 - sum({w} * pow({a}, 1.5)) / pow(sum({w} * {a}), 1.5)) / 0.5 AS tsallis_15, max({a}) / sum({w} * {a}) AS \"max\", min({a}) / sum({w} * {a}) AS \"min\", "
            f"sum({w} * {a} * {a}) / pow(sum({w} * {a}), 2) / sum({w}) - 1 / (sum({w}) * sum({w})) AS \"var\"")


E6 = [("shannon", 6), ("renyi_2", 6), ("tsallis_15", 6), ("max", 6), ("min", 8), ("var", 8)]
ESEL = ", ".join(r(f'"{e}"', f'"{e}"', p) for e, p in E6)


def eout(df, *keys):
    return df.select(*keys, *[rounded(F.col(e), p).alias(e) for e, p in E6])


def given(spark, sf, jumps=False):
    """The daily rows with ``x0..`` (z-scores) and ``p0..`` (unit-norm paths)."""
    if jumps:
        base = detected(spark, sf).rows
        df = attach(base, series_stats(base, DAILY_COLS))
    else:  # the figures of a series come from the shuffle that numbers its rows, of which there is at most one a day
        whole = Window.partitionBy(SERIES)
        df = daily_series(spark, sf).select("*", *[f(c).over(whole).alias(f"{c}_{s}") for c in DAILY_COLS for f, s in ((F.avg, "mu"), (F.stddev_pop, "sd"))])
    for i, c in enumerate(DAILY_COLS):
        centred = (F.col(c) - F.col(f"{c}_mu"))
        df = df.withColumn(f"x{i}", F.round(centred / F.col(f"{c}_sd"), 6)).withColumn(
            f"p{i}", F.round(centred / (F.col(f"{c}_sd") * F.sqrt(LEN)), 9))
    keep = [SERIES, "chunk", IDX, LEN, *XS, *PATHS] + (["unified", "importance"] if jumps else [])
    return df.select(*keep)


@query("path_spectral")
def path_spectral(spark, sf):
    df, names = K.spectral_paths(given(spark, sf), XS)
    return out(df, *names)


@query("path_jump_start", with_(*BASE, INTEG, GIVEN) + "SELECT series_id, idx, " + ", ".join(
    r(f"CASE WHEN unified THEN p{k} * (1 + importance) * {1 if k % 2 == 0 else -1} ELSE p{k} END", f"p{k}", 12) for k in range(4)) + " FROM given JOIN ji USING (series_id, idx)")
def path_jump_start(spark, sf):
    df = K.emphasise_jumps(given(spark, sf, jumps=True), PATHS)
    return df.select(SERIES, IDX, *[rounded(F.col(p), 12).alias(p) for p in PATHS])


@query("path_refine")
def path_refine(spark, sf):
    df, names = K.spectral_paths(given(spark, sf, jumps=True), XS, unit=False)
    return out(K.refine_paths(df, XS, names, jumps=True), *names)


@query("path_refine_sparse")
def path_refine_sparse(spark, sf):
    df, names = K.spectral_paths(given(spark, sf, jumps=True), XS, unit=False)
    return out(K.refine_paths(K.key_rows(df), XS, names, sparse=True), *names)


GRAM = ", ".join([f"pow(sum(x{i} * x{j}), 2) AS a{i}{j}, pow(sum(x{i} * p{j}), 2) AS b{i}{j}, pow(sum(p{i} * p{j}), 2) AS c{i}{j}" for i in range(4) for j in range(4)])
FIT = " + ".join(f"a{i}{j} - 2 * b{i}{j} + c{i}{j}" for i in range(4) for j in range(4))


@query("path_objective", with_(DAILY, GIVEN, STEP, PHASE.replace("CASE WHEN idx = n - 1 THEN x0 ELSE nx END", "nx"), f"gr AS (SELECT series_id, {GRAM} FROM given GROUP BY 1)",
       "t1 AS (SELECT series_id, sum(abs(dx)) AS tvt, sum(abs(x)) AS l1, sum(abs(dx)) FILTER (WHERE abs(dx) > dm + 2.5 * ds) AS jump FROM pj GROUP BY 1)",
       "t2 AS (SELECT series_id, sum(abs(p1 - p0) + abs(p2 - p1) + abs(p3 - p2)) AS tvp FROM given GROUP BY 1)", "t3 AS (SELECT series_id, sum(dth * dth) AS topo FROM pq GROUP BY 1)")
       + f"SELECT series_id, {r(FIT, 'data_fit', 2)}, {r('tvt + tvp', 'tv', 9)}, {r('l1', 'l1', 9)}, {r('coalesce(jump, 0)', 'jump', 9)}, {r('topo', 'topology', 4)} FROM gr JOIN t1 USING (series_id) JOIN t2 USING (series_id) JOIN t3 USING (series_id)")
def path_objective(spark, sf):
    t = K.objective_terms(given(spark, sf), XS, PATHS)
    return t.select(SERIES, rounded(F.col("data_fit"), 2).alias("data_fit"), *[rounded(F.col(c), 9).alias(c) for c in ("tv", "l1", "jump")],
                    rounded(F.col("topology"), 4).alias("topology"))


KEYED = """nr AS (SELECT series_id, idx, n, unified, bool_or(unified) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near, (idx * 2654435761) % 4294967296 AS h FROM ji),
rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, near ORDER BY h, idx) AS rn FROM nr),
kr AS (SELECT *, CASE WHEN near THEN 'jump' WHEN rn <= 50 THEN 'static' ELSE 'diagonal' END AS role FROM rk)"""


@query("path_key_rows", with_(*BASE, INTEG, KEYED) + "SELECT series_id, idx, role FROM kr")
def path_key_rows(spark, sf):
    return K.key_rows(given(spark, sf, jumps=True)).select(SERIES, IDX, "role")


@query("path_pair_counts", with_(*BASE, INTEG, KEYED, "a AS (SELECT series_id, any_value(n) AS n, count(*) FILTER (WHERE unified) AS n_jumps, count(*) FILTER (WHERE role = 'jump') AS n_expanded, count(*) FILTER (WHERE role = 'static') AS n_static FROM kr GROUP BY 1)",
       "p AS (SELECT a.series_id, count(*) AS c FROM kr a JOIN kr b ON a.series_id = b.series_id AND ((a.role <> 'diagonal' AND b.role <> 'diagonal') OR a.idx = b.idx) GROUP BY 1)")
       + f"SELECT series_id, n, n_jumps, n_expanded, n_static, c AS n_pairs, {r('1 - c / (n * n)', 'reduction')} FROM a JOIN p USING (series_id)")
def path_pair_counts(spark, sf):
    c = K.pair_counts(K.key_rows(given(spark, sf, jumps=True)))
    return out(c, "reduction", keys=(SERIES, LEN, "n_jumps", "n_expanded", "n_static", "n_pairs"))


@query("path_sparse_fit", with_(*BASE, INTEG, KEYED, GIVEN, "kg AS (SELECT given.*, role FROM given JOIN kr USING (series_id, idx))")
       + "SELECT a.series_id, " + r("sum(pow(" + " + ".join(f"a.x{i} * b.x{i} - a.p{i} * b.p{i}" for i in range(4)) + ", 2))", "sparse_fit", 2)
       + " FROM kg a JOIN kg b ON a.series_id = b.series_id AND ((a.role <> 'diagonal' AND b.role <> 'diagonal') OR a.idx = b.idx) GROUP BY 1")
def path_sparse_fit(spark, sf):
    f = K.sparse_fit(K.key_rows(given(spark, sf, jumps=True)), XS, PATHS)
    return f.select(SERIES, rounded(F.col("sparse_fit"), 2).alias("sparse_fit"))


@query("path_topology", with_(DAILY, GIVEN, STEP, PHASE) + f"SELECT series_id, path, {r('charge', 'charge')}, {r('stability', 'stability')} FROM ch JOIN tp USING (series_id, path)")
def path_topology(spark, sf):
    return out(K.topology(given(spark, sf), PATHS), "charge", "stability", keys=(SERIES, "path"))


@query("path_topology_jumps", with_(*BASE, INTEG, GIVEN, STEP, PHASE, f"""jp AS (SELECT pd.series_id, path, sum(atan2(x, b1) - atan2(b1, CASE WHEN idx = 1 THEN b1 ELSE b2 END)) / (2 * {PI}) AS shift
  FROM pd JOIN ji USING (series_id, idx) WHERE unified AND idx >= 1 GROUP BY 1, 2)""")
       + f"SELECT series_id, path, {r('charge + coalesce(shift, 0)', 'charge')}, {r('stability', 'stability')} FROM ch JOIN tp USING (series_id, path) LEFT JOIN jp USING (series_id, path)")
def path_topology_jumps(spark, sf):
    return out(K.topology(given(spark, sf, jumps=True), PATHS, jumps=True), "charge", "stability", keys=(SERIES, "path"))


@query("path_pulsation", with_(DAILY, GIVEN, STEP, PULSE) + f"SELECT series_id, path, n_jumps, {r('intensity', 'intensity')}, {r('asymmetry', 'asymmetry')}, {r('power', 'power')}, {r('ss + 0.3 * power', 'energy')} FROM pz")
def path_pulsation(spark, sf):
    e = K.energy(K.pulsation(given(spark, sf), PATHS))
    return out(e, "intensity", "asymmetry", "power", "energy", keys=(SERIES, "path", "n_jumps"))


@query("path_energy_jumps", with_(*BASE, GIVEN, "e AS (SELECT series_id, path, sum(x * x) AS ss FROM pl GROUP BY 1, 2)", "fp AS (SELECT series_id, avg(power) AS w FROM jstat GROUP BY 1)")
       + f"SELECT series_id, path, {r('ss + 0.3 * w', 'energy', -3)} FROM e JOIN fp USING (series_id)")
def path_energy_jumps(spark, sf):
    e = K.energy(K.pulsation(given(spark, sf), PATHS), detected(spark, sf).features)
    return e.select(SERIES, "path", rounded(F.col("energy"), -3).alias("energy"))


@query("path_jump_positions", with_(DAILY, GIVEN, STEP) + "SELECT series_id, path, idx - 1 AS idx FROM pj WHERE abs(dx) > dm + 1.2 * ds")
def path_jump_positions(spark, sf):
    return K.jump_positions(given(spark, sf), PATHS, 1.2)


@query("path_entropies", with_(DAILY, GIVEN, "a AS (SELECT series_id, path, abs(x) + 1e-10 AS a FROM pl)", f"e AS (SELECT series_id, path, {ent_sql('a')} FROM a GROUP BY 1, 2)") + f"SELECT series_id, path, {ESEL} FROM e")
def path_entropies(spark, sf):
    return eout(K.entropies(given(spark, sf), PATHS), SERIES, "path")


@query("path_entropy_orders", with_(DAILY, GIVEN, "a AS (SELECT series_id, path, abs(x) + 1e-10 AS a FROM pl)", "b AS (SELECT series_id, path, a / sum(a) OVER (PARTITION BY series_id, path) AS q FROM a)")
       + f"SELECT series_id, path, {r('-sum(q * ln(q))', 'renyi_1')}, {r('ln(sum(pow(q, 3))) / -2', 'renyi_3')}, {r('-sum(q * ln(q))', 'tsallis_1')}, {r('(1 - sum(q * q)) / 1', 'tsallis_2')} FROM b GROUP BY 1, 2")
def path_entropy_orders(spark, sf):
    long = long_form(given(spark, sf), PATHS, "path", "x", [SERIES])
    agg = long.groupBy(SERIES, "path").agg(
        K.renyi("x", 1.0).alias("renyi_1"), K.renyi("x", 3.0).alias("renyi_3"), K.tsallis("x", 1.0).alias("tsallis_1"), K.tsallis("x", 2.0).alias("tsallis_2"))
    return out(agg, "renyi_1", "renyi_3", "tsallis_1", "tsallis_2", keys=(SERIES, "path"))


COND = """cw AS (SELECT pl.series_id, path, idx, abs(x) + 1e-10 AS a, unified,
  bool_or(unified) OVER (PARTITION BY pl.series_id, path ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near,
  count(*) FILTER (WHERE unified) OVER (PARTITION BY pl.series_id, path ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS bef,
  count(*) FILTER (WHERE unified) OVER (PARTITION BY pl.series_id, path ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS aft
  FROM pl JOIN ji USING (series_id, idx)),
cp AS (SELECT series_id, path, 'all' AS part, a, 1 AS w FROM cw UNION ALL SELECT series_id, path, 'jump', a, 1 FROM cw WHERE unified UNION ALL
  SELECT series_id, path, 'non_jump', a, 1 FROM cw WHERE NOT unified UNION ALL SELECT series_id, path, 'vicinity', a, 1 FROM cw WHERE near UNION ALL
  SELECT series_id, path, 'remote', a, 1 FROM cw WHERE NOT near UNION ALL SELECT series_id, path, 'pre_jump', a, bef FROM cw WHERE bef > 0 UNION ALL
  SELECT series_id, path, 'post_jump', a, aft FROM cw WHERE aft > 0),
ce AS (SELECT series_id, path, part, """ + ent_sql("a", "w") + """ FROM cp GROUP BY 1, 2, 3)"""


@query("path_entropy_parts", with_(*BASE, INTEG, GIVEN, COND) + f"SELECT series_id, path, part, {ESEL} FROM ce UNION ALL SELECT v.series_id, v.path, 'locality_ratio', "
       + ", ".join(r(f'CASE WHEN q."{e}" <> 0 THEN v."{e}" / (q."{e}" + 1e-10) END', f'"{e}"', 4) for e, _ in E6)
       + " FROM ce v JOIN ce q ON v.series_id = q.series_id AND v.path = q.path WHERE v.part = 'vicinity' AND q.part = 'remote'")
def path_entropy_parts(spark, sf):
    t = K.conditional_entropies(given(spark, sf, jumps=True), PATHS)
    ratio = F.col("part") == "locality_ratio"
    return t.select(SERIES, "path", "part", *[F.when(ratio, rounded(F.col(e), 4)).otherwise(rounded(F.col(e), p)).alias(e) for e, p in E6])


SIDE = """sd AS (SELECT j.series_id, p.path, j.idx AS j, p.idx > j.idx AS aft, {e} FROM ji j
  JOIN (SELECT *, abs(x) + 1e-10 AS a FROM pl) p ON p.series_id = j.series_id AND p.idx <> j.idx AND abs(p.idx - j.idx) <= 5 WHERE unified GROUP BY 1, 2, 3, 4)"""


@query("path_entropy_gradient", with_(*BASE, INTEG, GIVEN, SIDE.format(e=ent_sql("a"))) + "SELECT b.series_id, b.path, " + ", ".join(
    r(f'avg(a."{e}" - b."{e}")', f'"{e}"', p) for e, p in E6) + " FROM sd b JOIN sd a ON a.series_id = b.series_id AND a.path = b.path AND a.j = b.j WHERE a.aft AND NOT b.aft GROUP BY 1, 2")
def path_entropy_gradient(spark, sf):
    return eout(K.entropy_gradient(given(spark, sf, jumps=True), PATHS), SERIES, "path")


@query("path_entropy_variation", with_(*BASE, INTEG, GIVEN, f"""w3 AS (SELECT s.series_id, s.path, s.idx AS st, {ent_sql('a')} FROM pl s JOIN (SELECT *, abs(x) + 1e-10 AS a FROM pl) p
  ON p.series_id = s.series_id AND p.path = s.path AND p.idx BETWEEN s.idx AND s.idx + 2 WHERE s.idx <= s.n - 3 GROUP BY 1, 2, 3)""")
       + "SELECT w3.series_id, path, " + ", ".join(r(f'stddev_pop("{e}")', f'"{e}"', 6) for e, _ in E6)
       + " FROM w3 JOIN ji j ON j.series_id = w3.series_id AND unified AND st >= greatest(0, j.idx - 5) AND st < least(j.n - 2, j.idx + 5) GROUP BY 1, 2")
def path_entropy_variation(spark, sf):
    t = K.entropy_variation(given(spark, sf, jumps=True), PATHS)
    return out(t, *K.ENTROPIES, keys=(SERIES, "path"))


CLASS = """concat_ws('; ', CASE WHEN charge < -0.5 THEN 'absorbing' WHEN charge > 0.5 THEN 'emitting' ELSE 'neutral' END,
  CASE WHEN stability > 2.5 THEN 'unstable' WHEN stability < 0.5 THEN 'very stable' END,
  CASE WHEN power > 5 THEN 'strong pulsation' WHEN power < 0.1 THEN 'static' END,
  CASE WHEN abs(asymmetry) > 0.7 AND asymmetry > 0 THEN 'upward' WHEN abs(asymmetry) > 0.7 THEN 'downward' END)"""


@query("path_classes", with_(*BASE, GIVEN, STEP, PHASE) + f'SELECT series_id, path, {CLASS} AS "class" FROM ch JOIN tp USING (series_id, path) '
       "JOIN (SELECT series_id, replace(feature, 'f', 'p') AS path, power, asymmetry FROM jstat) USING (series_id, path)")
def path_classes(spark, sf):
    f = detected(spark, sf).features.select(SERIES, F.replace("feature", F.lit("f"), F.lit("p")).alias("path"), "power", "asymmetry")
    t = K.topology(given(spark, sf), PATHS).join(f, [SERIES, "path"], "left")
    return K.classify(t).select(SERIES, "path", "class")
