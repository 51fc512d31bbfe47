"""The tiers against plain array formulas, causality, streams and regimes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import local
from tidewatch.operators import causal as C, evaluate as Q, features as B, paths as K, regimes as H
from tidewatch.operators.layout import IDX, LEN, SERIES, index_series
from tidewatch.plans import tier0, tier2
from tidewatch.session import shared_dir, stage
from tidewatch.streaming import online as R

COLS = ["f0", "f1", "f2"]


def p99(v):
    v = v[v > 1e-12]
    return np.percentile(v, 99) if len(v) > 5 else np.inf


def expected_tier0(x):
    """Six scorers on one series, row by row, from their definitions."""
    n = len(x)
    cal = min(max(50, int(0.15 * n)), n - 1)
    z = (x - x[:cal].mean(0)) / (x[:cal].std(0) + 1e-10)
    sig = z.mean(1)
    raw, thr = {}, {}
    best = np.zeros(n)
    for w in (5, 20, 50, 200):
        r = np.array([0.0 if t < 2 else abs(sig[t] - sig[max(0, t - w):t].mean()) / (sig[max(0, t - w):t].std() + 1e-12) for t in range(n)])
        if w < cal and np.isfinite(p99(r[:cal])):
            best = np.maximum(best, r / (p99(r[:cal]) + 1e-12))
    raw["jump"], thr["jump"] = best, 1.0

    def gradual(length):
        out = np.zeros(n)
        for w in (50, 200, 500):
            if w >= length:
                continue
            g = np.exp(-np.arange(w) ** 2 / (2 * (w / 3) ** 2))
            trend = np.array([np.dot(sig[max(0, t - w + 1):t + 1], g[-min(w, t + 1):]) / g[-min(w, t + 1):].sum() for t in range(n)])
            step = np.abs(np.diff(trend, prepend=np.nan))
            for t in range(max(1, w // 2), n):
                out[t] = max(out[t], step[max(1, t - max(2, w // 4) + 1):t + 1].mean())
        return out

    raw["gradual"], thr["gradual"] = gradual(n), p99(gradual(cal)[:cal])
    raw["drift"] = np.array([0.0 if t < 19 else abs(sig[max(0, t - 199):t + 1].mean() - sig[:cal].mean()) for t in range(n)])
    thr["drift"] = p99(raw["drift"][:cal])
    d = np.array([np.r_[np.zeros(0)] if t < 19 else z[t - 19:t + 1].ravel() for t in range(n)], dtype=object)
    m = np.stack(d[19:cal])
    centre = m.mean(0)
    v = np.linalg.svd(m - centre, full_matrices=False)[2]
    v = v[:max(1, min(5, v.shape[0] - 1))]
    raw["recon"] = np.array([0.0 if t < 19 else np.linalg.norm((d[t] - centre) - ((d[t] - centre) @ v.T) @ v) for t in range(n)])
    thr["recon"] = p99(raw["recon"][:cal])
    k = (z - z[:cal].mean(0)) / (z[:cal].std(0) + 1e-10)
    gram = (k @ k[:cal].T + 1) ** 3
    raw["kernel"] = np.sqrt(np.maximum((np.sum(k * k, 1) + 1) ** 3 - 2 * gram.mean(1) + gram[:cal].mean(), 0))
    thr["kernel"] = p99(raw["kernel"][:cal])
    step = np.array([0.0 if t < 20 else np.linalg.norm(d[t] - d[t - 1]) for t in range(n)])
    base = step[20:cal][step[20:cal] > 1e-12]
    raw["struct"] = np.abs((step - base.mean()) / (base.std() + 1e-10))
    thr["struct"] = np.percentile(raw["struct"][20:cal], 99)
    score = np.max([raw[s] / (thr[s] + 1e-12) if np.isfinite(thr[s]) else np.zeros(n) for s in raw], axis=0)
    score[:cal] = 0
    return {s: np.where(np.arange(n) >= cal, raw[s], 0) for s in raw}, score


def test_causal_tier_matches_definitions(indexed, wave):
    got = local(tier0.fit_predict(indexed(128), COLS, tier0.CausalConfig(chunk_rows=128))[0])
    for name, part in wave.groupby("series_id"):
        raw, score = expected_tier0(part[COLS].to_numpy())
        mine = got[got["series_id"] == name]
        for s in C.SCORERS:
            np.testing.assert_allclose(mine[s], raw[s], rtol=1e-6, atol=1e-7, err_msg=s)
        np.testing.assert_allclose(mine["score"], score, rtol=1e-6, atol=1e-7)
        assert (mine["flag"] == (mine["score"] >= 1)).all()


def test_later_rows_do_not_change_scores(spark, wave):
    """With frozen scales and the same calibration rows, a cut series scores the same."""
    cfg = tier0.CausalConfig(freeze_scales=True, ratio=0.0)
    whole = wave[wave["series_id"] == "a"]

    def scores(part):
        return local(tier0.fit_predict(index_series(spark.createDataFrame(part), ["t"]), COLS, cfg)[0])

    long, short = scores(whole), scores(whole[whole["t"] < 250])
    for c in ("score", *C.SCORERS):
        np.testing.assert_allclose(long[c][:250], short[c], rtol=1e-9, atol=1e-10)


def test_flat_and_short_series(spark):
    frames = [pd.DataFrame({"series_id": f"n{n}", "t": np.arange(n), "f0": 1.0}) for n in (1, 2, 19, 20, 21, 50, 51, 120)]
    df = index_series(spark.createDataFrame(pd.concat(frames)), ["t"])
    got = tier0.fit_predict(df, ["f0"], tier0.CausalConfig(scorers=("jump", "drift", "kernel", "struct")))[0].toPandas()
    assert len(got) == sum(len(f) for f in frames)
    assert (got["flag"] == 0).all() and np.isfinite(got["score"]).all()


def test_scorer_names():
    assert C.choose_scorers(["struct", "jump"]) == ["jump", "struct"]
    for bad in ([], ["nope"]):
        with pytest.raises(ValueError):
            C.choose_scorers(bad)


def test_user_scorer_joins_the_vote(indexed):
    cfg = tier0.CausalConfig(scorers=("jump", "level"), extra={"level": lambda df: df.withColumn("level", F.abs("sig"))})
    got = tier0.fit_predict(indexed(), COLS, cfg)[0].toPandas()
    assert got["level"].max() > 1 and got["flag"].sum() > 0


# --- regimes ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def two_regimes(spark):
    rng = np.random.default_rng(5)
    frames = []
    for name, n in (("a", 300), ("b", 260)):
        low = (np.arange(n) // 40) % 2 == 0
        x = np.where(low[:, None], rng.normal(0, 0.5, (n, 2)), rng.normal(5, 1.0, (n, 2)))
        frames.append(pd.DataFrame({"series_id": name, "t": np.arange(n), "f0": x[:, 0], "f1": x[:, 1], "low": low}))
    return index_series(spark.createDataFrame(pd.concat(frames)), ["t"], rows=64)


def test_regimes_are_found_by_both_ways_of_fitting(two_regimes):
    cols = ["f0", "f1"]
    short = H.fit_short(two_regimes, cols, most=2).toPandas().sort_values(["series_id", "k"]).reset_index(drop=True)
    long = H.fit_long(two_regimes, cols, most=2, rows=64).toPandas().sort_values(["series_id", "k"]).reset_index(drop=True)
    assert list(short["k"]) == list(long["k"]) == [1, 2, 1, 2]
    for name in ("weights", "means", "covs"):
        for a, b in zip(short[name], long[name]):
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(short["bic"], long["bic"], rtol=1e-9)
    model, bic = H.fit(two_regimes, cols)
    assert set(model.toPandas()["k"]) == {2}
    labelled = H.predict(two_regimes, model, cols, rows=64).toPandas()
    assert (labelled["regime"] == np.where(labelled["low"], 0, 1)).mean() > 0.98


def test_regime_tier(two_regimes):
    cfg = tier2.RegimeConfig(causal=tier0.CausalConfig(scorers=("jump", "kernel", "drift"), chunk_rows=64), margin=3)
    df = two_regimes.withColumn("bad", (F.col(IDX) >= 100) & (F.col(IDX) < 104))
    scores, model = tier2.fit_predict(df, ["f0", "f1"], "bad", cfg)
    got = scores.toPandas()
    assert len(got) == 560 and got["masked"].sum() == 20 and set(got["regime"]) == {0, 1}
    thr = model.thresholds.toPandas()
    assert len(thr) == 4 and (thr[["thr_jump", "thr_kernel", "thr_drift"]] > 0).all().all()
    assert model.rejected.count() == 0


# --- paths -----------------------------------------------------------------------------------

def test_spectral_paths_and_refinement(indexed, wave):
    df, names = K.spectral_paths(indexed(64), COLS, rows=64)
    got = local(df)
    for name, part in wave.groupby("series_id"):
        x = part[COLS].to_numpy()
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        mine = got[got["series_id"] == name][names].to_numpy()
        np.testing.assert_allclose(np.abs((mine * u[:, ::-1]).sum(0)), 1.0, atol=1e-6)
    start, names = K.spectral_paths(indexed(64), COLS, unit=False, rows=64)
    start = stage(start, "t")

    def cost(d):
        return K.objective(K.objective_terms(d, COLS, names, rows=64)).toPandas().set_index("series_id")["objective"]

    moved = start
    for _ in range(3):
        moved = stage(K._gradient_step(moved, COLS, names, (0.05, 0.005, 0.5, 0.1), 0.02, False, False, 64), "t")
    assert (cost(moved) < cost(start)).all()
    final = local(K.refine_paths(start, COLS, names, n_steps=1, rows=64))
    norms = final.groupby("series_id")[names].apply(lambda f: np.sqrt((f ** 2).sum()))
    np.testing.assert_allclose(norms, 1.0, atol=1e-6)


# --- streams ---------------------------------------------------------------------------------

def test_stream_of_late_unordered_batches_equals_batch(spark, wave):
    cfg = tier0.CausalConfig(chunk_rows=128, freeze_scales=True)
    start = pd.Timestamp("2024-01-01")
    rows = wave.assign(ts=start + pd.to_timedelta(wave["t"], unit="min"))[["series_id", "ts", "t", *COLS]]
    table = spark.createDataFrame(rows)
    batch, model = tier0.fit_predict(index_series(table, ["ts", "t"], rows=128), COLS, cfg)
    folder = f"{shared_dir(spark)}/stream-test-{np.random.default_rng().integers(1 << 40)}"
    job = R.OnlineJob(folder, COLS, ["ts", "t"], R.causal_score(model, COLS, cfg), R.CAUSAL_LOOKBACK, (), "INTERVAL 10 MINUTES", 128)
    rng = np.random.default_rng(9)
    arrival = rows.assign(at=rows["t"] + rng.integers(0, 9, len(rows))).sort_values("at")
    pieces = [arrival[arrival["at"] < 120], arrival[(arrival["at"] >= 120) & (arrival["at"] < 260)], arrival[arrival["at"] >= 260]]
    end = pd.DataFrame({"series_id": ["end"], "ts": [start + pd.Timedelta(days=9)], "t": [0], "f0": [0.0], "f1": [0.0], "f2": [0.0]})
    late = rows.head(1).assign(t=-1)
    for epoch, piece in enumerate([*pieces, end, late]):
        job.process(spark.createDataFrame(piece.drop(columns="at", errors="ignore")), epoch)
    job.process(spark.createDataFrame(pieces[1].drop(columns="at")), 1)  # a repeated epoch
    got = local(job.results(spark).filter("series_id <> 'end'"))
    want = local(batch)
    assert len(got) == len(want)
    np.testing.assert_allclose(got["score"], want["score"], rtol=1e-7, atol=1e-9)
    assert job.late(spark).count() == 1


def test_regime_stream_equals_one_frame(spark, wave):
    """Series that come and go: the newest state of each is read, also after states were written together."""
    from tidewatch.plans import tier2

    cfg = tier2.RegimeConfig(causal=tier0.CausalConfig(scorers=("jump", "drift", "kernel"), chunk_rows=128), margin=2, min_frames=10)
    start = pd.Timestamp("2024-01-01")
    rows = wave[wave["series_id"] == "a"].assign(ts=start + pd.to_timedelta(wave["t"], unit="min"))[["series_id", "ts", "t", *COLS]]
    table = index_series(spark.createDataFrame(rows), ["ts", "t"], rows=128)
    _, model = tier2.fit_predict(table.withColumn("bad", F.lit(False)), COLS, "bad", cfg)
    score = R.regime_score(model, COLS, cfg.causal)
    want = local(score(table.select("series_id", "chunk", "idx", "n", *COLS)))
    job = R.OnlineJob(f"{shared_dir(spark)}/stream-regime-{np.random.default_rng().integers(1 << 40)}", COLS, ["ts", "t"], score, R.CAUSAL_LOOKBACK, chunk_rows=128, compact=3)
    other = lambda t: rows.iloc[[t]].assign(series_id="other")
    pieces = [rows.head(100), other(100), rows.iloc[100:250], other(249), other(250), rows.iloc[250:]]
    for epoch, piece in enumerate(pieces):
        job.process(spark.createDataFrame(piece.sample(frac=1.0, random_state=epoch)), epoch)
    job.finish(spark)
    got = local(job.results(spark).filter("series_id = 'a'"))
    assert len(got) == len(want) and (got["regime"] == want["regime"]).all()
    np.testing.assert_allclose(got["score"], want["score"], rtol=1e-7, atol=1e-9)
    written = {e: {r[0] for r in spark.read.parquet(f"{job.folder}/tail/epoch={e}").select("series_id").distinct().collect()} for e in range(len(pieces) + 1)}
    assert written[1] == {"a"} and written[5] <= {"a", "other"} and written[3] == {"a", "other"}


def test_states_expire(spark):
    start = pd.Timestamp("2024-01-01")
    score, lookback, carry = R.cusum_score(["f0"])
    job = R.OnlineJob(f"{shared_dir(spark)}/stream-expire-{np.random.default_rng().integers(1 << 40)}", ["f0"], ["ts", "t"], score, lookback, carry, compact=2, expire="INTERVAL 1 HOUR")
    row = lambda name, minute: pd.DataFrame([{"series_id": name, "ts": start + pd.Timedelta(minutes=minute), "t": minute, "f0": 1.0}])
    for epoch, piece in enumerate([row("old", 0), row("a", 1), row("a", 200), row("a", 201), row("old", 202), row("a", 203)]):
        job.process(spark.createDataFrame(piece), epoch)
    job.finish(spark)
    got = [(r.series_id, r.t, r.idx) for r in job.results(spark).orderBy("ts").collect()]
    assert got == [("old", 0, 0), ("a", 1, 0), ("a", 200, 1), ("a", 201, 2), ("old", 202, 0), ("a", 203, 3)]


def test_stream_ties_at_the_watermark(spark):
    start = pd.Timestamp("2024-01-01")
    score, lookback, carry = R.cusum_score(["f0"])
    job = R.OnlineJob(f"{shared_dir(spark)}/stream-ties-{np.random.default_rng().integers(1 << 40)}", ["f0"], ["ts", "t"], score, lookback, carry)
    row = lambda t, minute: {"series_id": "a", "ts": start + pd.Timedelta(minutes=minute), "t": t, "f0": float(t)}
    job.process(spark.createDataFrame(pd.DataFrame([row(0, 0), row(1, 5)])), 0)
    job.process(spark.createDataFrame(pd.DataFrame([row(2, 5), row(3, 4)])), 1)  # a tie in time, and a late row
    assert job.results(spark).count() == 1
    job.finish(spark)
    assert [r.t for r in job.results(spark).orderBy("idx").collect()] == [0, 1, 2]
    assert [r.t for r in job.late(spark).collect()] == [3]


def test_position_hash_at_large_positions(spark):
    from tidewatch.operators.paths import position_hash

    at = [0, 7, 3_470_000_000, 1 << 40]
    got = [r.h for r in spark.createDataFrame([(i,) for i in at], "idx long").select(position_hash().alias("h")).collect()]
    assert got == [(i % (1 << 31)) * 2654435761 % (1 << 32) for i in at]


def test_flat_windows_do_not_correlate(spark):
    """A window in which a value does not change has no correlation, and is no error."""
    x = np.r_[np.full(70, 3.0), np.random.default_rng(2).normal(size=50), np.full(40, -1.0)]
    raw = spark.createDataFrame(pd.DataFrame({SERIES: "a", "t": np.arange(len(x)), "f0": x}))
    got = local(B.expand_5(index_series(raw, ["t"])))["f4"].to_numpy()
    want = np.zeros(len(x))
    for t in range(2, len(x)):
        a, b = x[max(1, t - 29):t + 1], x[max(1, t - 29) - 1:t]
        if np.ptp(a) and np.ptp(b):
            want[t] = np.corrcoef(a, b)[0, 1]
    assert np.allclose(got, want, atol=1e-9) and (got[2:70] == 0).all()


def test_flat_columns_do_not_correlate(spark):
    rows = spark.createDataFrame(pd.DataFrame({SERIES: "a", "p": [1.0, 2, 4, 3], "q": 5.0, "r": [2.0, 4, 8, 6]}))
    got = {(r.a, r.b): r["corr"] for r in Q.correlations(rows, ["p", "q", "r"]).collect()}
    assert got[("p", "q")] is None and got[("q", "r")] is None and np.isclose(got[("p", "r")], 1)
