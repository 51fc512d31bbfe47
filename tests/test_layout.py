"""Chunked and two-level plans give the same as plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import local
from tidewatch.functions.quantile import percentiles, percentiles_by
from tidewatch.functions.spectrum import _short, spectrum_long
from tidewatch.operators import causal as C, drift as J, features as B, jumps as I, masks as G, paths as K
from tidewatch.operators.evaluate import auc, below
from tidewatch.operators.layout import IDX, SERIES, by_chunk, frame, home, index_series, running, runs, with_halo
from tidewatch.plans import tier0
from tidewatch.session import stage

COLS = ["f0", "f1", "f2"]


def test_two_level_index_equals_row_order(spark, wave):
    df = spark.createDataFrame(wave.sample(frac=1.0, random_state=1))
    for bins in (1, 7, 500):
        got = local(index_series(df, ["t"], rows=50, bins=bins))
        assert (got["idx"] == got["t"]).all()
        assert got.groupby("series_id")["n"].first().to_dict() == {"a": 400, "b": 90}
        assert (got["chunk"] == got["idx"] // 50).all()


def test_chunk_size_does_not_change_results(indexed):
    for make in (
        lambda r: J.rolling_cusum(indexed(r), COLS, rows=r).select("series_id", "idx", "drift"),
        lambda r: J.static_cusum(indexed(r), COLS, rows=r).select("series_id", "idx", "drift"),
        lambda r: J.gradual_transition(indexed(r), "f0", windows=(40, 120), rows=r).select("series_id", "idx", "gradual"),
        lambda r: J.structural_drift(indexed(r), "f0", reference=60, sigma=5.0, rows=r).select("series_id", "idx", "state_drift"),
        lambda r: I.sync_matrix(I.detect(indexed(r), COLS, rows=r), rows=r),
        lambda r: I.clusters(I.detect(indexed(r), COLS, rows=r), least=1, rows=r),
        lambda r: K.topology(indexed(r), COLS, rows=r),
        lambda r: K.entropy_gradient(indexed(r).withColumn("unified", F.col("f0") > 2), COLS, rows=r),
    ):
        small, large = make(37).toPandas(), make(8192).toPandas()
        keys = [c for c in small.columns if small[c].dtype.kind not in "f"]
        small, large = (x.sort_values(keys).reset_index(drop=True) for x in (small, large))
        pd.testing.assert_frame_equal(small, large, rtol=1e-8, atol=1e-10)


def test_causal_tier_is_the_same_in_chunks(indexed):
    def scores(rows):
        cfg = tier0.CausalConfig(chunk_rows=rows)
        return local(tier0.fit_predict(indexed(rows), COLS, cfg)[0].drop("chunk"))

    pd.testing.assert_frame_equal(scores(64), scores(8192), rtol=1e-7, atol=1e-9)


def test_runs_merge_over_chunk_edges(indexed):
    df = indexed(10).withColumn("m", (F.col("idx") >= 5) & (F.col("idx") < 47))
    got = runs(df, "m", rows=10).toPandas()
    assert sorted(zip(got["series_id"], got["start"], got["end"])) == [("a", 5, 46), ("b", 5, 46)]


def test_running_total_and_minimum(indexed, wave):
    got = local(running(indexed(16), {"s": F.col("f0")}))
    low = local(running(indexed(16), {"m": F.col("f0")}, F.min))
    for name, part in wave.groupby("series_id"):
        np.testing.assert_allclose(got.loc[got["series_id"] == name, "s"], part["f0"].cumsum(), atol=1e-9)
        np.testing.assert_allclose(low.loc[low["series_id"] == name, "m"], part["f0"].cummin(), atol=1e-12)


def test_bracketed_percentiles_are_exact(spark):
    rng = np.random.default_rng(0)
    hot = np.concatenate([rng.exponential(size=45_000), np.zeros(5_000), np.full(10_000, 0.7)])
    frame = pd.DataFrame({"k": "hot", "chunk": np.arange(60_000) // 1000, "v": hot})
    frame = pd.concat([frame, pd.DataFrame({"k": "cold", "chunk": 0, "v": [3.0, 1.0, 2.0]})])
    probs = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.99, "e": 1.0, "f": 0.2345}
    df = spark.createDataFrame(frame)
    for part in ("chunk", None):
        got = percentiles(df, ["k"], "v", probs, part=part).toPandas().set_index("k")
        for name, p in probs.items():
            assert got.loc["hot", name] == pytest.approx(np.percentile(hot, 100 * p), abs=1e-12)
            assert got.loc["cold", name] == pytest.approx(np.percentile([3, 1, 2], 100 * p))
    wanted = spark.createDataFrame([("hot", 0.8123), ("cold", 0.5)], "k string, p double")
    by = percentiles_by(df, ["k"], "v", wanted, ["p"]).toPandas().set_index("k")["p"]
    assert by["hot"] == pytest.approx(np.percentile(hot, 81.23), abs=1e-12)
    assert by["cold"] == 2.0


def test_ranges_below_equal_one_window(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"k": rng.choice(["x", "y"], 3000, p=[0.9, 0.1]), "v": np.round(rng.normal(size=3000), 2), "label": rng.integers(0, 2, 3000)})
    df = spark.createDataFrame(frame)
    a = below(df, ["k"], "v", {"c": F.lit(1)}).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    b = frame.groupby(["k", "v"]).size().rename("c").reset_index()
    b["c_below"] = b.groupby("k")["c"].cumsum() - b["c"]
    pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False)
    area = auc(df, ["k"], "v", "label").toPandas().set_index("k")["auc"]
    for k, part in frame.groupby("k"):
        p, q = part[part["label"] == 1]["v"].to_numpy(), part[part["label"] == 0]["v"].to_numpy()
        want = ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))
        assert area[k] == pytest.approx(want)


def test_distributed_spectrum(spark):
    rng = np.random.default_rng(2)
    parts = [pd.DataFrame({"series_id": s, "idx": np.arange(n), "v": rng.normal(size=n), "m": n}) for s, n in (("p", 97), ("q", 60))]
    frame = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(frame)
    got = spectrum_long(df, ["series_id"], "v", "m").toPandas()
    near = _short(df, ["series_id"], "v").toPandas()
    for s, part in frame.groupby("series_id"):
        want = np.abs(np.fft.rfft(part["v"].to_numpy()))
        for g in (got, near):
            mine = g[g["series_id"] == s].sort_values("k")
            np.testing.assert_allclose(mine["amp"], want, atol=1e-8)


def test_cusum_states_across_chunks(indexed, wave):
    """Against one loop over each series, for decays that forget at once or hardly at all, and a state that goes on."""
    for decay, rows in ((0.5, 37), (0.95, 64), (0.99999, 16), (1e-3, 8192)):
        got = local(J.rolling_cusum(indexed(rows), COLS, 10, 0.2, decay, rows=rows))
        for name, part in wave.groupby("series_id"):
            x = part.sort_values("t")[COLS].to_numpy()
            state, want = np.zeros(3), []
            for i in range(len(x)):
                w = x[max(0, i - 10): i]
                if i >= 10:
                    state = np.maximum(0, decay * state + np.abs(x[i] - w.mean(axis=0)) / (w.std(axis=0) + 1e-8) - 0.2)
                want.append(state.mean())
            np.testing.assert_allclose(got[got["series_id"] == name]["drift"], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rows", [1, 37, 8192])
def test_windows_and_margins_whatever_the_chunks(spark, wave, rows):
    """Many overlapping windows, empty ones and ones beyond both ends; alternating masks."""
    rng = np.random.default_rng(5)
    start = pd.Timestamp("2024-01-01")
    part = wave[wave["series_id"] == "a"].assign(ts=lambda f: start + pd.to_timedelta(f["t"] // 2 * 2, unit="min"))
    df = index_series(spark.createDataFrame(part.sample(frac=1.0, random_state=2)), ["ts", "t"], rows=rows)
    at = rng.integers(-20, 430, 300)
    windows = pd.DataFrame({"series_id": "a", "window_id": np.arange(300), "start_ts": start + pd.to_timedelta(at, unit="min")})
    windows["end_ts"] = windows["start_ts"] + pd.to_timedelta(rng.integers(0, 30, 300), unit="min")
    got = G.window_positions(df, spark.createDataFrame(windows)).toPandas().set_index("window_id")
    ts = part.sort_values("t")["ts"].to_numpy()
    for w in windows.itertuples():
        s = min(np.searchsorted(ts, np.datetime64(w.start_ts), "left"), 399)
        e = max(min(np.searchsorted(ts, np.datetime64(w.end_ts), "right") - 1, 399), s)
        assert (got.loc[w.window_id, "start"], got.loc[w.window_id, "end"]) == (s, e)
    few = windows.head(12)
    mask = np.zeros(400, bool)
    for w in got.loc[few["window_id"]].itertuples():
        mask[w.start: w.end + 1] = True
    marked = G.anomaly_mask(df, spark.createDataFrame(few), rows=rows)
    assert (local(marked)["is_anomaly"] == mask).all()
    striped = df.withColumn("sig", F.col("f0")).withColumn("flag", F.col("idx").isin(3, 50, 57, 210, 399) | ((F.col("idx") > 300) & (F.col("idx") % 9 == 0)))
    out, info = G.adaptive_mask(striped, "flag", base_margin=5, max_margin=40, recovery=6, ratio=1.0, rows=rows)
    x, masked, flags = part.sort_values("t")["f0"].to_numpy(), local(out)["masked"].to_numpy(), local(striped)["flag"].to_numpy()
    grown = np.flatnonzero(masked)
    assert masked[flags].all() and len(grown) < 400
    # calm as defined: the deviation of seven rows, at most that of the rows far from any flag
    spread = [x[max(0, i - 3): i + 4].std() if min(i + 4, 400) - max(0, i - 3) >= 5 else np.inf for i in range(400)]
    far = np.array([not flags[max(0, i - 40): i + 41].any() for i in range(400)])
    if far.sum() >= 100:
        calm = np.array(spread) <= x[far].std(ddof=0)
        want = np.zeros(400, bool)
        for i in np.flatnonzero(flags):
            want[max(0, i - 5): i + 6] = True
            for step in (1, -1):
                for off in range(1, 41):
                    j = i + step * off
                    if not 0 <= j < 400 or (off >= 5 and calm[j]):
                        break
                    want[j] = True
        if want.mean() <= 0.4:
            assert (masked == want).all()


def test_sweep_with_overlapping_windows(spark):
    from tidewatch.operators.evaluate import PROFILES, sweep

    rng = np.random.default_rng(3)
    score = np.round(rng.random(300), 2)
    spans = [(60, 80), (70, 75), (78, 100), (150, 150), (200, 260), (200, 230)]
    frame = pd.DataFrame({"series_id": "a", "idx": np.arange(300), "n": 300, "chunk": 0, "s": score})
    df = spark.createDataFrame(frame)
    positions = spark.createDataFrame(pd.DataFrame(spans, columns=["start", "end"]).assign(series_id="a"))
    got = sweep(df, positions, "s").toPandas().set_index("profile")
    sig = lambda x: -1.0 if x > 3 else 2 / (1 + np.exp(5 * x)) - 1
    for name, (tp, fp, fn) in PROFILES.items():
        best = -len(spans) * fn
        for cut in np.unique(score):
            total, hit = 0.0, {}
            for i in range(45, 300):
                if score[i] < cut:
                    continue
                inside = sorted(w for w in spans if w[0] <= i <= w[1])
                past = sorted(w for w in spans if w[1] < i)
                if inside:
                    w = inside[0]
                    value = sig(-(w[1] - i + 1) / (w[1] - w[0] + 1)) * tp / sig(-1.0)
                    hit[w[0]] = max(hit.get(w[0], -fn), value)
                else:
                    total += fp * (sig((i - past[-1][1]) / max(past[-1][1] - past[-1][0], 1)) if past else -1.0)
            best = max(best, total + sum(v + fn for v in hit.values()) - len(spans) * fn)
        assert got.loc[name, "best_raw"] == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize("rows, consistency, sparse", [(16, False, False), (37, True, False), (8192, False, True)])
def test_path_slopes_are_derivatives(spark, rows, consistency, sparse):
    """Against differences of the objective written out over the full matrix, the limits held fixed."""
    rng = np.random.default_rng(12)
    n, names = 60, ["p0", "p1", "p2"]
    x, lam = rng.normal(size=(n, 3)), rng.normal(size=(n, 3))
    jump, weight = rng.random(n) < 0.3, rng.random(n)
    frame = pd.DataFrame(np.hstack([x, lam]), columns=COLS + names).assign(
        series_id="a", idx=np.arange(n), n=n, chunk=np.arange(n) // rows, unified=jump, importance=weight, role=np.where(rng.random(n) < 0.5, "jump", "diagonal"))
    weights = (0.05, 0.005, 0.5, 0.1)
    got = local(K.path_slopes(spark.createDataFrame(frame), COLS, names, weights, consistency, sparse, rows))
    inside = (frame["role"] != "diagonal").to_numpy()
    pairs = np.outer(inside, inside) | np.eye(n, dtype=bool) if sparse else np.ones((n, n), bool)
    d0 = np.abs(np.diff(lam, axis=0))
    limit = d0.mean(axis=0) + 2.5 * d0.std(axis=0)

    def objective(v):
        d = np.abs(np.diff(v, axis=0))
        turn = np.diff(np.arctan2(v[1:], v[:-1]), axis=0)
        turn = (turn + np.pi) % (2 * np.pi) - np.pi
        out = ((x @ x.T - v @ v.T)[pairs] ** 2).sum() + 0.05 * (d.sum() + np.abs(np.diff(v, axis=1)).sum()) + 0.005 * np.abs(v).sum()
        out += 0.5 * d[d0 > limit].sum() + 0.1 * (turn**2).sum()
        if consistency:
            out += (np.where(jump[1:], -weight[1:], 0.1)[:, None] * d).sum()
        return out

    for i in rng.choice(n, 12, replace=False):
        for j, name in enumerate(names):
            up, down = lam.copy(), lam.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert got[f"slope_{name}"][i] == pytest.approx((objective(up) - objective(down)) / 2e-6, rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("rows", [37, 8192])
def test_lasso_meets_its_optimality_conditions(spark, rows):
    """Per series: noise, a clear signal, one class only, a constant feature; slopes recomputed in numpy."""
    from tidewatch.operators.path_features import fit_lasso, select_by_lasso, violation

    rng = np.random.default_rng(4)
    frames = []
    for name, n in (("noise", 200), ("signal", 300), ("one", 60), ("apart", 120)):
        x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + 2
        x[:, 2] = 7 if name == "signal" else x[:, 2]
        y = {"noise": rng.random(n) < 0.5, "signal": x[:, 0] + rng.normal(size=n) > 2, "one": np.zeros(n, bool), "apart": x[:, 1] > 2}[name]
        frames.append(pd.DataFrame(x, columns=COLS).assign(series_id=name, idx=np.arange(n), n=n, chunk=np.arange(n) // rows, label=y.astype(int)))
    frame = pd.concat(frames)
    df = spark.createDataFrame(frame)
    model, _ = fit_lasso(df, COLS, "label", c=10.0, chunk_rows=rows)
    for r in model.collect():
        part = frame[frame["series_id"] == r.series_id]
        x, y = part[COLS].to_numpy(), part["label"].to_numpy()
        sd = x.std(axis=0)
        z = np.hstack([np.where(sd > 1e-12, (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), 0), np.ones((len(x), 1))])
        b = np.array(r.b)
        g = z.T @ (y - 1 / (1 + np.exp(-z @ b)))
        assert r.done and violation(b, g, 10.0) <= 1e-3, (r.series_id, b)
    chosen, areas = select_by_lasso(df, COLS, "label", chunk_rows=rows)
    shares = chosen.groupBy("series_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).toPandas().set_index("series_id")
    np.testing.assert_allclose(shares["w"], 1.0)
    top = chosen.toPandas().sort_values("weight").groupby("series_id").last()["feature"]
    assert top["signal"] == "f0" and top["apart"] == "f1" and shares.loc["one", "n"] == 1
    areas = areas.toPandas().set_index("series_id")["auc"]
    assert areas["apart"] == 1.0 and areas["signal"] > 0.8 and np.isnan(areas["one"])


def test_windows_within_tasks_are_those_of_frames(spark):
    """Trailing figures of a chunk's rows at once, missing values and flat stretches included, in chunks of any size."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=900)
    x[300:380] = 2.5
    f = pd.DataFrame({SERIES: "a", "t": np.arange(900), "f0": x, "sig": x, "z_a": x, "z_b": np.roll(x, 3)})
    raw = spark.createDataFrame(f).withColumn("f0", F.when(F.col("t") % 97 != 13, F.col("f0"))).withColumn("sig", F.when(F.col("t") % 89 != 7, F.col("sig"))).withColumn(
        "z_b", F.when(F.col("t") % 150 != 1, F.col("z_b"))).withColumn("z_b", F.when((F.col("t") < 600) | (F.col("t") > 640), F.col("z_b")))
    df = stage(index_series(raw, ["t"], rows=128), "rows")
    wide = with_halo(df, back=C.LOOKBACK, rows=128).withColumn("_lag", F.lag("f0").over(by_chunk())).withColumn("_step", C.step_sq(["z_a", "z_b"]))
    want = local(home(wide.select(
        SERIES, IDX, "home", B.rolling_mean().alias("f1"), B.rolling_std().alias("f2"), B.second_difference().alias("f3"), B.rolling_autocorr().alias("f4"),
        *[c.alias(k) for k, c in C.jump_columns().items()], C.step_distance().alias("step"),
        F.when(F.col(IDX) + 1 >= C.DRIFT_MIN, F.avg("sig").over(frame(-(C.DRIFT_WINDOW - 1), 0))).alias("local"))))
    cfg = tier0.CausalConfig(scorers=("jump", "drift", "struct"), chunk_rows=128)
    got = tier0.window_features(df, ["a", "b"], cfg)
    assert not any("Window [" in t._jdf.queryExecution().optimizedPlan().toString() for t in (got, B.expand_5(df)))
    five, got = local(B.expand_5(df)), local(got)
    for name, table in [*[(c, five) for c in ("f1", "f2", "f3", "f4")], *[(c, got) for c in (*C.jump_columns(), "step", "local")]]:
        np.testing.assert_allclose(table[name], want[name], rtol=1e-9, atol=1e-9, err_msg=name)
    assert want["step"].isna().any()


def test_local_deviations_within_tasks_are_those_of_frames(spark, wave):
    """The rows of a chunk at once, missing values and series ends included; the rows are staged for all steps of a mask."""
    raw = spark.createDataFrame(wave).withColumn("f0", F.when(F.col("t") % 53 > 9, F.col("f0")))
    df = index_series(raw, ["t"], rows=64).withColumn("m", F.coalesce(F.col("f0") > 5, F.lit(False)))
    want = local(home(with_halo(df, back=7, ahead=7, rows=64).withColumn("_local", G.local_std("f0", 7))))
    got = G.with_local_std(df, "f0", 7, "_local", 64)
    assert "Window [" not in G.with_local_std(stage(df, "rows"), "f0", 7, "_local", 64)._jdf.queryExecution().optimizedPlan().toString()
    got = local(got)
    assert np.isinf(want["_local"]).any()
    np.testing.assert_allclose(got["_local"], want["_local"], rtol=1e-9)
    marked, _ = G.adaptive_mask(df, "m", "f0", base_margin=3, max_margin=20, recovery=14, rows=64)
    assert "_span" not in marked._jdf.queryExecution().optimizedPlan().toString()


def test_running_back_takes_no_frame_to_the_end(indexed, wave):
    got = running(stage(indexed(64), "rows"), {"low": F.col("f0")}, F.min, back=True)
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    for name, part in local(got).groupby("series_id"):
        want = wave[wave["series_id"] == name].sort_values("t")["f0"].to_numpy()
        assert (part["low"].to_numpy() == np.minimum.accumulate(want[::-1])[::-1]).all()
