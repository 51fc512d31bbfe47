"""Steps that short series take within a task: the same results as by jobs for all series, and no copied rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.grouped import groups_of, per_group
from tidewatch.functions.kernels import Kernel, best_kernel, candidates, path_error, squares as kernel_squares, triangles, weighted_sums
from conftest import local
from tidewatch.operators import batch_scores as L, causal as C, evaluate as Q, fusion as FU, jumps as I, path_features as M, paths as K, regimes as H
from tidewatch.operators.layout import IDX, SERIES
from tidewatch.plans import batch, tier0


def test_groups_over_batches():
    rows = pa.table({"a": ["x"] * 5 + ["y"] * 2 + [None] * 3, "b": range(10)})
    for size in (1, 2, 3, 10):
        got = [g.column("b").to_pylist() for g in groups_of(iter(rows.to_batches(max_chunksize=size)), ["a"])]
        assert got == [[0, 1, 2, 3, 4], [5, 6], [7, 8, 9]]


def test_per_group_sorts(spark):
    df = spark.createDataFrame([(f"s{i % 7}", (i * 37) % 100) for i in range(100)], "k string, v long")
    last = per_group(df, ["k"], ["v"], lambda t: t.slice(t.num_rows - 1), "k string, v long").collect()
    assert dict(map(tuple, last)) == {r.k: r.m for r in df.groupBy("k").agg(F.max("v").alias("m")).collect()}


def labelled_parts(spark):
    rng = np.random.default_rng(4)
    frames = []
    for name, n in (("a", 60), ("b", 31), ("flat", 12), ("one", 8)):
        x = rng.integers(0, 5, (n, 4)).astype(float)  # many ties
        f = pd.DataFrame(x if name != "flat" else 1.0, columns=list("pqrs"), index=range(n))
        f["label"] = (x[:, 0] + rng.normal(size=n) > 2).astype(int) if name != "one" else 1
        f[SERIES], f["idx"], f["n"], f["chunk"] = name, range(n), n, 0
        frames.append(f)
    return spark.createDataFrame(pd.concat(frames))


def test_weights_are_the_same_by_both_ways(spark, monkeypatch):
    df = labelled_parts(spark)
    got = {r.series_id: r.asDict() for r in FU.search_weights(df, list("pqrs")).collect()}
    monkeypatch.setattr(FU, "IN_TASK", 0)
    want = {r.series_id: r.asDict() for r in FU.search_weights(df, list("pqrs")).collect()}
    assert got == want and len(got) == 4 and got["one"]["auc"] is None


def test_rows_are_not_copied_for_the_lattice(spark):
    df = labelled_parts(spark)
    z = df.select(SERIES, "label", F.lit(1.0).alias("_w"), *"pqrs")
    found = FU._search_in_task(z, list("pqrs"), "label", FU.weight_lattice(list("pqrs")))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["plain", "jumps", "sparse"])
def test_paths_are_refined_the_same_by_both_ways(indexed, kind, monkeypatch):
    cols = ["f0", "f1", "f2"]
    rows = indexed(64).withColumn("unified", F.col(IDX) % 37 == 5).withColumn("importance", F.col(IDX) % 3 * 0.4)
    df, names = K.spectral_paths(rows, cols, unit=False, rows=64)
    if kind == "sparse":
        df = K.key_rows(df, rows=64)
    options = {"jumps": kind == "jumps", "sparse": kind == "sparse", "n_steps": 2, "rows": 64}
    steps = []
    real = K._gradient_step
    monkeypatch.setattr(K, "_gradient_step", lambda *a: steps.append(1) or real(*a))
    got = local(K.refine_paths(df, cols, names, **options))
    assert not steps  # no job per step
    monkeypatch.setattr(K, "IN_TASK", 100)  # one series each way
    want = local(K.refine_paths(df, cols, names, **options))
    assert len(steps) == 4 and list(got.columns) == list(want.columns) and len(got) == len(want) == 490
    for c in got.columns:
        if c in names:
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-12)
        else:
            assert (got[c] == want[c]).all()


@pytest.mark.parametrize("tuned", [False, True])
def test_jumps_are_the_same_by_both_ways(indexed, tuned, monkeypatch):
    cols = ["f0", "f1", "f2"]

    def found():
        jumps = I.detect_tuned(indexed(64), cols, 10, 0.85, rows=64) if tuned else I.detect(indexed(64), cols, rows=64)
        return local(jumps.rows), local(jumps.features, SERIES, "feature")

    ordered = []
    real = I.percentiles_by if tuned else I.percentiles
    monkeypatch.setattr(I, "percentiles_by" if tuned else "percentiles", lambda *a, **k: ordered.append(1) or real(*a, **k))
    short = found()
    assert not ordered  # no row per feature was sorted
    monkeypatch.setattr(I, "IN_TASK", 100)  # one series each way
    for a, b in zip(short, found()):
        pd.testing.assert_frame_equal(a, b, rtol=1e-12)
    assert len(ordered) == 2


def test_models_are_the_same_by_both_ways(indexed, monkeypatch):
    cols = ["f0", "f1", "f2"]
    df = indexed(64).withColumn("label", F.when(F.col("f0") + F.sin(F.col(IDX)) > 1, 1).otherwise(0))
    steps = []
    real = M._advance
    monkeypatch.setattr(M, "_advance", lambda *a: steps.append(1) or real(*a))
    got = local(M.select_by_lasso(df, cols, "label", chunk_rows=64)[0], SERIES, "feature")
    assert not steps  # no job per step
    monkeypatch.setattr(M, "IN_TASK", 100)  # one series each way
    pd.testing.assert_frame_equal(got, local(M.select_by_lasso(df, cols, "label", chunk_rows=64)[0], SERIES, "feature"), rtol=1e-7)
    assert steps and got[SERIES].nunique() == 2


def test_kernel_choice_is_that_of_full_matrices():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 90):
        x, p = rng.normal(size=(n, 3)).round(2), rng.normal(size=(n, 2))
        tried = candidates([7.3, 20.0])
        upper = np.triu_indices(n)
        for kernel, half in zip(tried, triangles(x, tried)):
            np.testing.assert_allclose(half, kernel.matrix(x, x)[upper], rtol=1e-7, atol=1e-12)
        errors = [path_error(k.matrix(x, x), p @ p.T)[0] for k in tried]
        found = best_kernel(x, p @ p.T, tried)
        assert found[1] == tried[int(np.argmin(errors))] and found[0] == min(errors)


def test_kernel_errors_are_the_same_by_both_ways(indexed, monkeypatch):
    cols = ["f0", "f1", "f2"]
    df = indexed(64).withColumns({f"p{i}": F.col(c) / (7 + F.col(IDX) % 3) for i, c in enumerate(cols)})
    kernels = [Kernel("rbf", gamma=0.5), Kernel("polynomial"), Kernel("laplacian", gamma=0.5), Kernel("periodic", period=7.0)]
    blocks = []
    real = L._kernel_errors_by_blocks
    monkeypatch.setattr(L, "_kernel_errors_by_blocks", lambda *a: blocks.append(1) or real(*a))
    got = local(L.kernel_errors(df, cols, ["p0", "p1"], kernels, block=50, rows=64))
    assert not blocks  # no row was collected into a block
    monkeypatch.setattr(L, "IN_TASK", 100)  # one series each way
    want = local(L.kernel_errors(df, cols, ["p0", "p1"], kernels, block=50, rows=64))
    assert blocks and len(got) == 490
    pd.testing.assert_frame_equal(got, want[got.columns], rtol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_weighted_sums_are_those_of_full_matrices(n):
    rng = np.random.default_rng(n)
    x, p = rng.normal(size=(n, 3)), rng.normal(size=(n, 2))
    for kernel in (Kernel("polynomial"), Kernel("rbf", gamma=0.3), Kernel("sigmoid", alpha=0.2)):
        sq, weight = kernel.matrix(x, x) ** 2, p @ p.T
        for cells in (1, 60, 1 << 16):
            np.testing.assert_allclose(weighted_sums(kernel, x, p, cells), [(sq * weight**i).sum(1) for i in range(3)], rtol=1e-10, atol=1e-12)


def test_ablation_is_the_same_by_both_ways(spark, monkeypatch):
    df = labelled_parts(spark).withColumn("q", F.when(F.col("idx") % 9 != 2, F.col("q")))  # some are null
    configs = {**Q.subsets(list("pqr")), **Q.sweep_weight({"p": 0.4, "q": 0.6}, "s", [0.0, 0.2])}
    sorts = []
    real = Q._ablation_in_one_sort
    monkeypatch.setattr(Q, "_ablation_in_one_sort", lambda *a: sorts.append(1) or real(*a))
    got = local(Q.ablation(df, configs, "label"), SERIES, "config")
    assert not sorts  # no row was copied for every weighting
    monkeypatch.setattr(Q, "IN_TASK", 10)
    want = local(Q.ablation(df, configs, "label"), SERIES, "config")
    assert sorts and len(got) == 4 * len(configs) and got["auc"].isna().any()
    pd.testing.assert_frame_equal(got, want, rtol=1e-12)


def test_subspaces_are_the_same_by_both_ways(indexed, monkeypatch):
    cols = ["f0", "f1", "f2"]
    df = indexed(64)
    chunked = []
    real = C._recon_fit_by_chunks
    monkeypatch.setattr(C, "_recon_fit_by_chunks", lambda *a: chunked.append(1) or real(*a))

    def distances():
        fit = C.recon_fit(df, cols, F.col(IDX) < 60, rows=64)
        return local(C.recon_score(df, fit, cols, rows=64).select(SERIES, IDX, "recon"))

    got = distances()
    assert not chunked  # no second moments were sent
    monkeypatch.setattr(C, "IN_TASK", 100)  # one series each way
    pd.testing.assert_frame_equal(got, distances(), rtol=1e-7, atol=1e-9)
    assert chunked and len(got) == 490


@pytest.mark.parametrize("cols", [["f0"], ["f0", "f1"]])
def test_rbf_distance_is_that_of_all_pairs(indexed, wave, cols):
    df = indexed(64).withColumn("cal_end", F.when(F.col(SERIES) == "a", 150).otherwise(40).cast("long"))
    df = df.withColumn("f0", F.col("f0") * F.when(F.col(IDX) % 50 == 7, 40).otherwise(1))  # some rows are far from all others
    got = local(C.rbf_distance(df, cols, 0.7, rows=64))
    plan = C.rbf_distance(df, cols, 0.7, rows=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # no chunk is one value
    assert len(got) == 490
    for name, part in got.groupby(SERIES):
        x, cal = part[cols].to_numpy(), int(part["cal_end"].iloc[0])
        k = np.exp(-0.7 * ((x[:, None] - x[None, :cal]) ** 2).sum(2))
        np.testing.assert_allclose(part["kernel"], np.sqrt(np.maximum(1 - 2 * k.mean(1) + k[:cal].mean(), 0)), rtol=1e-11)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_mixture_sums_are_those_of_densities(k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(300, 4)) * [1, 3, 0.2, 2] + (np.arange(300) % 3)[:, None]
    x -= x.mean(0)
    params = H.start(len(x), x.sum(0), x.T @ x, k, 4)
    for _ in range(6):
        sums = H.expected_sums(x, *params)
        np.testing.assert_allclose(H.short_sums(H.features(x), 4, *params), sums, rtol=1e-9, atol=1e-9)
        params = H.updated(sums, k, 4)


def _close(got, want, keys):
    got, want = (f.toPandas().sort_values(keys).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want[got.columns], rtol=1e-6, atol=1e-8, check_dtype=False)


@pytest.mark.parametrize("sparse", [True, False])
def test_batch_analysis_is_the_same_by_both_ways(indexed, sparse, monkeypatch):
    df, cols = indexed(64), ["f0", "f1", "f2"]
    a = batch.analyse(df, cols, sparse=sparse, rows=64)
    scores = batch.fuse(a, rows=64)
    monkeypatch.setattr(batch, "IN_TASK", 0)
    monkeypatch.setattr(L, "IN_TASK", 0)
    b = batch.analyse(df, cols, sparse=sparse, rows=64)
    _close(a.path_stats, b.path_stats, [SERIES, "path"])
    _close(a.jumps.features, b.jumps.features, [SERIES, "feature"])
    assert set(a.jumps.rows.columns) == set(b.jumps.rows.columns)
    _close(a.rows, b.rows, [SERIES, IDX])
    _close(scores, batch.fuse(b, rows=64), [SERIES, IDX])


def test_batch_of_short_series_plans_no_jobs_of_long_ones(indexed, monkeypatch):
    def planned(*args, **kwargs):
        raise AssertionError("short series are analysed within tasks")

    for module, name in ((I, "detect"), (I, "detect_tuned"), (K, "topology"), (K, "pulsation"), (L, "hybrid_score"), (L, "kernel_errors")):
        monkeypatch.setattr(module, name, planned)
    df = indexed()
    assert batch.fuse(batch.analyse(df, ["f0", "f1", "f2"])).count() == df.count()


@pytest.mark.parametrize("options", [{}, {"scorers": ("jump", "gradual", "drift", "kernel", "struct"), "normalize": False}, {"scorers": ("jump",), "freeze_scales": True}])
def test_the_causal_tier_is_the_same_by_both_ways(indexed, options, monkeypatch):
    cols, cfg, jobs = ["f0", "f1", "f2"], tier0.CausalConfig(chunk_rows=64, **options), []
    real = tier0.window_features
    monkeypatch.setattr(tier0, "window_features", lambda *a: jobs.append(1) or real(*a))

    def found():
        scores, model = tier0.fit_predict(indexed(64), cols, cfg)
        return [local(scores), *[local(getattr(model, p), SERIES) for p in tier0.MODEL_PARTS if getattr(model, p) is not None]]

    got = found()
    assert not jobs  # no row was joined with a model
    monkeypatch.setattr(tier0, "IN_TASK", 100)  # one series each way
    for a, b in zip(got, found(), strict=True):
        assert set(a.columns) == set(b.columns) and len(a) == len(b)
        if "basis" in a:  # directions are found up to their sign
            a, b = (x.assign(basis=x["basis"].map(lambda v: np.abs(v).tolist())) for x in (a, b))
        for c in a.columns:
            x, y = ([v for v in f[c]] for f in (a, b))
            if c == SERIES:
                assert x == y
            else:
                np.testing.assert_allclose(np.array(x, dtype=float), np.array(y, dtype=float), rtol=1e-6, atol=1e-8, err_msg=c)
    assert len(jobs) == 1


def test_the_causal_tier_takes_one_shuffle(spark, indexed):
    scores = tier0.fit_predict(indexed(64), ["f0", "f1", "f2"])[0]
    assert scores._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_missing_values_are_scored_by_jobs(spark, indexed, monkeypatch):
    cols = ["f0", "f1", "f2"]
    df = indexed(64).withColumn("f1", F.when((F.col(SERIES) == "a") & (F.col(IDX) == 7), None).otherwise(F.col("f1"))).localCheckpoint()
    cfg = tier0.CausalConfig(scorers=("jump", "drift", "kernel", "struct"), chunk_rows=64)
    got = local(tier0.fit_predict(df, cols, cfg)[0])
    monkeypatch.setattr(tier0, "IN_TASK", 0)
    pd.testing.assert_frame_equal(got, local(tier0.fit_predict(df, cols, cfg)[0]), rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("n", [1, 3, 30, 5000])
def test_trailing_windows(n):
    x = np.random.default_rng(n).normal(size=n).round(1)
    for w in (5, 200):
        want = [0.0 if t < 2 else abs(x[t] - x[max(0, t - w):t].mean()) / (x[max(0, t - w):t].std() + 1e-12) for t in range(n)]
        got = C.series_jump(x, w)
        far = np.array([t < 2 or x[max(0, t - w):t].std() > 1e-9 for t in range(n)])
        np.testing.assert_allclose(got[far], np.array(want)[far], rtol=1e-9, atol=1e-12)
    want = [0.0 if t < 19 else abs(x[max(0, t - 199):t + 1].mean() - 0.25) for t in range(n)]
    np.testing.assert_allclose(C.series_drift(x, 0.25), want, rtol=1e-9, atol=1e-12)


def test_steps_of_long_mixtures_shuffle_no_rows(spark, monkeypatch):
    """Every iteration reads packed chunks; the models of several chunks are those fitted within a task."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(50, 1, (300, 2)), rng.normal(56, 0.5, (260, 2))])
    f = pd.DataFrame(x, columns=["f0", "f1"]).assign(series_id="a", chunk=np.arange(560) // 64, idx=range(560), n=560)
    df = spark.createDataFrame(f)
    plans, staged = [], H.stage
    monkeypatch.setattr(H, "stage", lambda t, name: (plans.append((name, t._jdf.queryExecution().optimizedPlan().toString())), staged(t, name))[1])
    long = {r.k: r for r in H.fit_long(df, ["f0", "f1"], rows=64).collect()}
    short = {r.k: r for r in H.fit_short(df, ["f0", "f1"]).collect()}
    steps = [p for name, p in plans if name == "regimes"][1:]
    assert len(steps) > 1 and not any("CoGroup" in p or "Repartition" in p for p in steps)
    assert long.keys() == short.keys()
    for k in long:
        for c in ("weights", "means", "covs", "bic", "smallest"):
            np.testing.assert_allclose(long[k][c], short[k][c], rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("union", [True, False])
def test_hybrid_is_the_same_by_both_ways(indexed, union, monkeypatch):
    cols = ["f0", "f1", "f2"]
    paths = [f"p{i}" for i in range(3)]
    df = indexed(64).withColumns({p: F.round(F.col(c) / (i + 2), 6) for i, (p, c) in enumerate(zip(paths, cols))})
    df = df.withColumn("p1", F.when(F.col(IDX) % 41 != 9, F.col("p1")))
    calls = []
    by_jobs = L._hybrid_by_jobs
    monkeypatch.setattr(L, "_hybrid_by_jobs", lambda *a, **b: (calls.append(1), by_jobs(*a, **b))[1])

    def run():
        figures = K.figures(df, paths, rows=64)
        return local(figures, SERIES, "path"), local(L.hybrid_score(df, cols, paths, figures, use_union=union, rows=64))

    got = run()
    assert not calls
    monkeypatch.setattr(K, "IN_TASK", 0)
    monkeypatch.setattr(L, "ROWS_IN_TASK", 0)
    want = run()
    assert calls
    for a, b in zip(got, want):
        assert sorted(a.columns) == sorted(b.columns) and (a[SERIES] == b[SERIES]).all() and len(a)
        for c in a.select_dtypes("number"):
            np.testing.assert_allclose(a[c], b[c], rtol=1e-8, atol=1e-10, err_msg=c)


def test_weak_anomalies_are_the_same_by_both_ways(indexed, monkeypatch):
    """Also of rows that are flat across features, which have no correlation with their neighbours."""
    cols = ["f0", "f1", "f2"]
    df = indexed().withColumn("importance", F.col(IDX) % 10 * 0.1).withColumn("score", F.round(F.abs("f0"), 6))
    df = df.withColumn("f1", F.when(F.col(IDX) % 50 == 20, F.col("f0")).when(F.col(IDX) % 71 != 9, F.col("f1"))).withColumn(
        "f2", F.when(F.col(IDX) % 50 == 20, F.col("f0")).when(F.col(IDX) > 300, F.sin(F.col(IDX) * 2.2) * 40).otherwise(F.col("f2")))
    calls, by_jobs = [], FU._weak_by_jobs
    monkeypatch.setattr(FU, "_weak_by_jobs", lambda *a: (calls.append(1), by_jobs(*a))[1])
    got = local(FU.weak_anomalies(df, cols, "score"))
    assert not calls
    monkeypatch.setattr(FU, "IN_TASK", 0)
    want = local(FU.weak_anomalies(df, cols, "score"))
    assert calls and len(got) > 50 and got["weak"].any() and set(got["label"]) == {0, 1}
    pd.testing.assert_frame_equal(got, want[got.columns])


@pytest.mark.parametrize("unit", [True, False])
def test_paths_start_the_same_by_both_ways(indexed, unit, monkeypatch):
    """Start, roles and refinement of short series share one shuffle."""
    cols = ["f0", "f1", "f2"]
    rows = indexed(64).withColumn("unified", F.col(IDX) % 37 == 5).withColumn("importance", F.col(IDX) % 3 * 0.4)

    def run():
        df, names = K.spectral_paths(rows, cols, unit=unit, rows=64)
        return K.key_rows(df, rows=64), names

    got, names = run()
    plan = K.refine_paths(got, cols, names, sparse=True, rows=64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Join" not in plan
    got = local(got)
    monkeypatch.setattr(K, "IN_TASK", 0)
    want = local(run()[0])
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(got, want[got.columns], rtol=1e-8)


def test_kernel_choice_is_the_same_by_both_ways(indexed, monkeypatch):
    cols = ["f0", "f1", "f2"]
    df = indexed(64).withColumns({f"p{i}": F.col(c) / (i + 9) for i, c in enumerate(cols)})
    periods = df.select(SERIES).distinct().withColumn("periods", F.array(F.lit(7.5), F.lit(20.0)))
    calls, by_jobs = [], L._kernel_auto_by_jobs
    monkeypatch.setattr(L, "_kernel_auto_by_jobs", lambda *a: (calls.append(1), by_jobs(*a))[1])

    def run():
        scored, chosen = L.kernel_auto(df, cols, ["p0", "p1", "p2"], periods, size=40, rows=64)
        return local(scored), local(chosen, SERIES)

    got = run()
    assert not calls
    monkeypatch.setattr(L, "ROWS_IN_TASK", 0)
    for a, b in zip(got, run()):
        assert len(a)
        pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)
    assert calls


def test_kernel_squares_are_those_of_matrices():
    x = np.random.default_rng(8).normal(size=(40, 3))
    tried = candidates([7.3, 20.0])
    upper = np.triu_indices(40)
    seen = []
    for i, sq in kernel_squares(x, tried):
        seen.append(i)
        np.testing.assert_allclose(sq, tried[i].matrix(x, x)[upper] ** 2, rtol=1e-7, atol=1e-12)
    assert sorted(seen) == list(range(len(tried)))


def test_shrunk_steps_are_minima_in_few_sweeps(monkeypatch):
    """Correlated features, for which single coordinates need thousands of sweeps, constant ones and copies."""
    rng = np.random.default_rng(6)
    tried, on_support = [], M._on_support
    monkeypatch.setattr(M, "_on_support", lambda *a: (tried.append(1), on_support(*a))[1])
    for kind in range(30):
        x = rng.normal(size=(200, 4))
        x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
        x[:, 3] *= kind % 3 != 1
        x[:, 2] = x[:, 0] if kind % 5 == 4 else x[:, 2]
        h, g, b = x.T @ x / 50, x.T @ rng.normal(size=200) / 10, rng.normal(size=4) * (kind % 2)
        tried.clear()
        new = M._shrunk_step(b, g, h, 10.0)
        slope = 10 * (g - h @ (new - b))
        assert (np.where(new != 0, np.abs(slope - np.sign(new)), np.maximum(np.abs(slope) - 1, 0)) < 1e-5).all()
        assert kind % 5 == 4 or (tried and len(tried) < 10)
