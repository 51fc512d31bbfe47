"""Regimes of normal behaviour: a Gaussian mixture per series with the number of regimes chosen by BIC.

All series and all candidate sizes are fitted together.  Short series (a checked bound)
are fitted within one task each.  For longer ones every iteration is one job: each chunk
adds up its responsibilities, the sums are added per series, and one row per series is
updated.  Both ways share the same start and the same updates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tidewatch.functions.grouped import matrix, per_group
from tidewatch.operators.layout import CHUNK, CHUNK_ROWS, IDX, KEYS, LEN, SERIES, attach, chunk_of, over_chunks, running
from tidewatch.session import stage

MAX_REGIMES = 5
MIN_ROWS = 50
RIDGE = 1e-6
MAX_STEPS = 200
#: Rows of a series that one task solves; longer series take one job per step.
IN_TASK = 200_000
TOLERANCE = 1e-3
MODEL = "k int, weights array<double>, means array<double>, covs array<double>"


# --- the mixture, on arrays ------------------------------------------------------------

def log_parts(x, weights, means, covs):
    """Log of weight times density per row and component."""
    d = x.shape[1]
    out = np.empty((len(x), len(weights)))
    for k, (w, m, c) in enumerate(zip(weights, means, covs)):
        low = np.linalg.cholesky(c)
        y = np.linalg.solve(low, (x - m).T)
        out[:, k] = np.log(w) - 0.5 * (y * y).sum(0) - np.log(np.diag(low)).sum() - 0.5 * d * np.log(2 * np.pi)
    return out


def expected_sums(x, weights, means, covs):
    """Log-likelihood, then per component the hard count, soft count, sum and squares."""
    parts = log_parts(x, weights, means, covs)
    top = parts.max(1)
    total = top + np.log(np.exp(parts - top[:, None]).sum(1))
    r = np.exp(parts - total[:, None])
    hard = np.bincount(parts.argmax(1), minlength=len(weights))
    square = np.einsum("nk,ni,nj->kij", r, x, x)
    return np.concatenate([[total.sum()], hard, r.sum(0), (r.T @ x).ravel(), square.ravel()])


def updated(sums, k, d):
    soft = sums[1 + k:1 + 2 * k] + 1e-12
    means = sums[1 + 2 * k:1 + 2 * k + k * d].reshape(k, d) / soft[:, None]
    square = sums[1 + 2 * k + k * d:].reshape(k, d, d) / soft[:, None, None]
    covs = square - np.einsum("ki,kj->kij", means, means) + RIDGE * np.eye(d)
    return soft / soft.sum(), means, covs


def features(x):
    """Per row 1, its values, and the products of every pair of them: a log density is linear in these."""
    n, d = x.shape
    i, j = np.triu_indices(d)
    return np.ascontiguousarray(np.hstack([np.ones((n, 1)), x, x[:, i] * x[:, j]]))


def short_sums(phi, d, weights, means, covs):
    """As ``expected_sums``, from the ``features`` of centred rows by two products of matrices."""
    i, j = np.triu_indices(d)
    inverse = np.linalg.inv(covs)
    pull = np.einsum("kij,kj->ki", inverse, means)
    fixed = np.log(weights) - 0.5 * ((pull * means).sum(1) + np.linalg.slogdet(covs)[1] + d * np.log(2 * np.pi))
    square = np.where(i == j, -0.5, -1.0) * inverse[:, i, j]
    parts = phi @ np.hstack([fixed[:, None], pull, square]).T
    hard = np.bincount(parts.argmax(1), minlength=len(weights))
    top = parts.max(1)
    r = np.exp(parts - top[:, None])
    norm = r.sum(1)
    r /= norm[:, None]
    sums = r.T @ phi
    whole = np.empty((len(weights), d, d))
    whole[:, i, j] = whole[:, j, i] = sums[:, 1 + d:]
    return np.concatenate([[(top + np.log(norm)).sum()], hard, sums[:, 0], sums[:, 1:1 + d].ravel(), whole.ravel()])


def start(count, total, square, k, d):
    """Equal weights, the common covariance, and means spread along its main axis."""
    mean = total / count
    cov = square / count - np.outer(mean, mean) + RIDGE * np.eye(d)
    values, vectors = np.linalg.eigh(cov)
    axis = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    at = np.linspace(-1.2, 1.2, k) if k > 1 else np.zeros(1)
    means = mean + at[:, None] * np.sqrt(values[-1]) * axis
    return np.full(k, 1.0 / k), means, np.repeat(cov[None], k, axis=0)


def bic(loglik, count, k, d):
    free = k * d + k * d * (d + 1) / 2 + k - 1
    return -2.0 * loglik + free * np.log(count)


def ordered(weights, means, covs):
    o = np.argsort(means[:, 0], kind="stable")
    return weights[o], means[o], covs[o]


# --- fitting ---------------------------------------------------------------------------

def choose(fits: DataFrame, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """Lowest BIC among sizes whose smallest regime is large enough; one regime if none.

    Returns the model per series and the BIC of every candidate.
    """
    rank = F.struct((F.col("smallest") >= min_rows).cast("int").alias("ok"),
                    F.when(F.col("smallest") >= min_rows, -F.col("bic")).otherwise(-F.col("k").cast("double")).alias("v"))
    best = fits.groupBy(SERIES, LEN).agg(F.max_by(F.struct("k", "weights", "means", "covs"), rank).alias("_m"))
    return best.select(SERIES, LEN, "_m.*"), fits.select(SERIES, "k", "bic", "smallest")


def candidate_sizes(count, fixed: int | None, most: int, min_rows: int):
    bound = max(1, int(count) // min_rows)
    if fixed is not None:
        return sorted({1, max(1, min(fixed, bound))})
    return range(1, min(most, bound) + 1)


def fit_short(df: DataFrame, cols: Sequence[str], fixed: int | None = None, most: int = MAX_REGIMES, min_rows: int = MIN_ROWS) -> DataFrame:
    d, names = len(cols), list(cols)
    schema = f"{SERIES} string, {LEN} long, {MODEL}, bic double, smallest long"

    def solve(group: pa.Table) -> pa.Table:
        x = matrix(group, names)
        centre = x.mean(0)
        x = x - centre  # so that products of values lose no digits
        phi, out = features(x), []
        for k in candidate_sizes(len(x), fixed, most, min_rows):
            params = start(len(x), x.sum(0), x.T @ x, k, d)
            before = None
            for _ in range(MAX_STEPS):
                sums = short_sums(phi, d, *params)
                if before is not None and abs(sums[0] - before) / len(x) < TOLERANCE:
                    break
                before = sums[0]
                params = updated(sums, k, d)
            final = short_sums(phi, d, *params)
            w, m, c = ordered(*params)
            out.append((len(x), k, w, (m + centre).ravel(), c.ravel(), bic(final[0], len(x), k, d), int(final[1:1 + k].min())))
        key = pa.concat_arrays([group.column(SERIES).combine_chunks().slice(0, 1)] * len(out))
        kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.float64())] * 3, pa.float64(), pa.int64()]
        return pa.table([key, *[pa.array(list(v), t) for v, t in zip(zip(*out), kinds)]], names=[SERIES, LEN, "k", "weights", "means", "covs", "bic", "smallest"])

    return per_group(df.select(SERIES, IDX, *names), [SERIES], [IDX], solve, schema)


def fit_long(
    df: DataFrame, cols: Sequence[str], fixed: int | None = None, most: int = MAX_REGIMES, min_rows: int = MIN_ROWS,
    rows: int = CHUNK_ROWS, max_steps: int = MAX_STEPS,
) -> DataFrame:
    """As ``fit_short`` with one job per iteration; converged candidates drop out.

    Rows are centred and packed once, a row per chunk, and meet the small table of open models in every iteration, so no
    iteration shuffles or sorts rows; what leaves a chunk is one array of sums per model.
    """
    d, names = len(cols), list(cols)
    df = stage(df.select(*KEYS, IDX, LEN, *names), "regime-rows")
    centres = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN), F.array(*[F.avg(c) for c in names]).alias("centre"))
    centred = attach(df, centres, rows).select(*KEYS, IDX, "centre", *[(F.col(c) - F.col("centre")[i]).alias(c) for i, c in enumerate(names)])

    def pack(group: pa.Table) -> pa.Table:
        x = matrix(group, names)
        first = group.select([SERIES, CHUNK, "centre"]).slice(0, 1)
        packed = [pa.array([v], kind) for v, kind in ((len(x), pa.int64()), (x.sum(0), pa.list_(pa.float64())), ((x.T @ x).ravel(), pa.list_(pa.float64())), (x.tobytes(), pa.binary()))]
        return pa.table([*first.columns, *packed], names=[SERIES, CHUNK, "centre", "c", "t", "q", "x"])

    kind = df.schema[SERIES].dataType.simpleString()
    packed = stage(per_group(centred, KEYS, [IDX], pack, f"{SERIES} {kind}, {CHUNK} long, centre array<double>, c long, t array<double>, q array<double>, x binary"), "regime-chunks")
    base = packed.groupBy(SERIES).agg(
        F.sum("c").alias(LEN), F.array(*[F.sum(F.col("t")[i]) for i in range(d)]).alias("_t"), F.array(*[F.sum(F.col("q")[i]) for i in range(d * d)]).alias("_q"))

    def begin(batches):
        for pdf in batches:
            out = []
            for series, count, t, q in zip(pdf[SERIES], pdf[LEN], pdf["_t"], pdf["_q"]):
                for k in candidate_sizes(count, fixed, most, min_rows):
                    w, m, c = start(count, np.asarray(t, dtype=float), np.reshape(q, (d, d)), k, d)
                    out.append((series, int(count), k, w, m.ravel(), c.ravel()))
            yield pd.DataFrame(out, columns=[SERIES, LEN, "k", "weights", "means", "covs"])

    model_schema = f"{SERIES} {kind}, {LEN} long, {MODEL}"
    active = stage(base.mapInPandas(begin, model_schema).withColumn("loglik", F.lit(None).cast("double")), "regimes")
    finished = active.select("*", F.lit(None).cast("long").alias("smallest")).limit(0)

    def accumulate(batches):
        for batch in batches:
            out = []
            for series, x, models in zip(*[batch.column(c) for c in (SERIES, "x", "models")]):
                phi = features(np.frombuffer(x.as_buffer()).reshape(-1, d))
                for f in models.as_py():
                    k = f["k"]
                    sums = short_sums(phi, d, np.asarray(f["weights"]), np.reshape(f["means"], (k, d)), np.reshape(f["covs"], (k, d, d)))
                    out.append((series.as_py(), k, sums))
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], t) for i, t in enumerate((batch.schema.field(SERIES).type, pa.int32(), pa.list_(pa.float64())))], [SERIES, "k", "s"])

    def advance(k: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for kk, v in zip(k, s):
            w, m, c = updated(np.asarray(v, dtype=float), int(kk), d)
            out.append((w, m.ravel(), c.ravel(), float(v[0]), int(min(v[1:1 + kk]))))
        return pd.DataFrame(out, columns=["weights", "means", "covs", "loglik", "smallest"])

    move = F.pandas_udf(advance, "struct<weights: array<double>, means: array<double>, covs: array<double>, loglik: double, smallest: long>")
    # as many updates as within a task, and one more pass for the likelihood of the last
    for i in range(0 if active.isEmpty() else max_steps + 1):
        models = active.groupBy(SERIES).agg(F.collect_list(F.struct("k", "weights", "means", "covs")).alias("models"))
        part = packed.select(SERIES, "x").join(F.broadcast(models), SERIES).mapInArrow(accumulate, f"{SERIES} {kind}, k int, s array<double>")
        sums = (
            part.select(SERIES, "k", F.posexplode("s").alias("_p", "_x")).groupBy(SERIES, "k", "_p").agg(F.sum("_x").alias("_x"))
            .groupBy(SERIES, "k").agg(F.array_sort(F.collect_list(F.struct("_p", "_x"))).alias("_l"))
            .select(SERIES, "k", move("k", F.transform("_l", lambda e: e["_x"])).alias("_n"))
        )
        joined = active.join(sums, [SERIES, "k"])
        still = F.col("loglik").isNull() | (F.abs(F.col("_n.loglik") - F.col("loglik")) / F.col(LEN) >= TOLERANCE)
        last = i == max_steps
        step = stage(joined.withColumn("_on", still & F.lit(not last)), "regimes")
        done = step.filter(~F.col("_on")).select(
            SERIES, LEN, "k", "weights", "means", "covs", F.col("_n.loglik").alias("loglik"), F.col("_n.smallest").alias("smallest"))
        finished = finished.unionByName(done)
        active = step.filter("_on").select(SERIES, LEN, "k", "_n.weights", "_n.means", "_n.covs", "_n.loglik")
        if active.isEmpty():
            break
    k = F.col("k")
    free = k * d + k * d * (d + 1) / 2 + k - 1

    def arrange(k: pd.Series, w: pd.Series, m: pd.Series, c: pd.Series, centre: pd.Series) -> pd.DataFrame:
        out = []
        for kk, a, b, e, o in zip(k, w, m, c, centre):
            a, b, e = ordered(np.asarray(a), np.reshape(b, (kk, d)) + o, np.reshape(e, (kk, d, d)))
            out.append((a, b.ravel(), e.ravel()))
        return pd.DataFrame(out, columns=["weights", "means", "covs"])

    sort = F.pandas_udf(arrange, "struct<weights: array<double>, means: array<double>, covs: array<double>>")
    finished = finished.join(packed.groupBy(SERIES).agg(F.first("centre").alias("centre")), SERIES)
    return finished.withColumn("_o", sort("k", "weights", "means", "covs", "centre")).select(
        SERIES, LEN, "k", "_o.*", (-2 * F.col("loglik") + free * F.log(LEN)).alias("bic"), "smallest")


def fit(df: DataFrame, cols: Sequence[str], fixed: int | None = None, most: int = MAX_REGIMES, min_rows: int = MIN_ROWS, rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Model per series (``n`` is its number of fitted rows) and BIC per candidate.

    Series of up to ``IN_TASK`` rows are solved many to a task, longer ones by one job per step; the
    steps are the same, so the split does not show in the result.
    """
    df = stage(df.select(*KEYS, IDX, LEN, *cols), "regime-rows")
    fits = fit_short(df.filter(F.col(LEN) <= IN_TASK), cols, fixed, most, min_rows)
    long = df.filter(F.col(LEN) > IN_TASK)
    if not long.isEmpty():
        fits = fits.unionByName(fit_long(long, cols, fixed, most, min_rows, rows))
    if fixed is not None:
        fits = fits.withColumn("_most", F.least(F.lit(fixed), F.greatest(F.lit(1), F.floor(F.col(LEN) / min_rows))).cast("int"))
        wanted = (F.col("k") == F.col("_most")) | (F.col("k") == 1)
        fits = fits.filter(wanted).withColumn("bic", F.when(F.col("k") == F.col("_most"), F.col("bic")).otherwise(F.lit(float("inf")))).drop("_most")
    return choose(stage(fits, "regime-fits"), min_rows)


def predict(df: DataFrame, model: DataFrame, cols: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``regime``: the most likely component of every row.  ``model.n`` must be the length of the series in ``df``."""
    d, names = len(cols), list(cols)
    schema = T.StructType(df.schema.fields + [T.StructField("regime", T.IntegerType())])
    fitted = over_chunks(model, rows).select(*KEYS, F.struct("k", "weights", "means", "covs").alias("_fit"))

    def label(group: pa.Table) -> pa.Table:
        ahead = group.column(IDX).null_count  # the model, if there is one
        fit_ = group.column("_fit")[0].as_py() if ahead else None
        group = group.drop_columns("_fit").slice(ahead)
        if fit_ is None or not group.num_rows:
            return group.slice(0, 0).append_column("regime", pa.array([], pa.int32()))
        k = fit_["k"]
        parts = log_parts(matrix(group, names), np.asarray(fit_["weights"]), np.reshape(fit_["means"], (k, d)), np.reshape(fit_["covs"], (k, d, d)))
        return group.append_column("regime", pa.array(parts.argmax(1).astype(np.int32)))

    return per_group(df.unionByName(fitted, allowMissingColumns=True), KEYS, [IDX], label, schema)


def renumber(df: DataFrame, keep, rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows where ``keep`` holds, with positions counted over these rows only."""
    counted = running(df, {"_at": F.when(keep, 1).otherwise(0)})
    kept = counted.filter(keep)
    sizes = df.groupBy(SERIES).agg(F.count(F.when(keep, F.lit(1))).alias("_n"))
    lengths = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN)).join(sizes, SERIES)
    out = attach(kept, lengths, rows)
    return out.withColumn(IDX, F.col("_at") - 1).withColumn(LEN, F.col("_n")).withColumn(CHUNK, chunk_of(rows=rows)).drop("_at", "_n")
