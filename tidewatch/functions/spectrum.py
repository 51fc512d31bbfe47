"""Fourier spectra of series, as rows.

``spectrum`` gives one row per series and frequency, so peaks, shares and entropies are
plain aggregates.  A series that fits a task is transformed there.  A longer one is
transformed by the four-step method over two shuffles, where no group is larger than the
square root of the padded length; lengths that are no power of two go through the chirp
(Bluestein) form, which turns the transform into a convolution.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.numeric import num
from tidewatch.session import stage

SERIES, IDX = "series_id", "idx"
#: Rows of one key that one task transforms; both ways give the same numbers.
IN_TASK = 1 << 20


def spectrum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, m, k, amp`` for frequencies ``k = 0..m//2`` of the ``m`` rows of each key.

    Rows must be dense in ``idx`` from 0.  Keys are split by their counted lengths; where all fit a task, the way for
    longer ones is not planned.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    long_keys = stage(sizes.filter(F.col("_m") > IN_TASK), "spectrum-long")
    if long_keys.isEmpty():
        return _short(df, keys, value)
    short = df.join(long_keys.select(*keys), keys, "left_anti")
    return _short(short, keys, value).unionByName(spectrum_long(df.join(long_keys, keys), keys, value, "_m"))


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _short(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    def transform(group: pa.Table) -> pa.Table:
        x = matrix(group, [value])[:, 0]
        amp = np.abs(np.fft.rfft(x))
        own = group.select(keys).take(pa.array(np.zeros(len(amp), np.int64)))
        return own.append_column("m", pa.array(np.full(len(amp), len(x)))).append_column("k", pa.array(np.arange(len(amp)))).append_column("amp", pa.array(amp))

    rows = df.select(*keys, IDX, F.col(value).alias(value))
    return per_group(rows, keys, [IDX], transform, f"{_types(df, keys)}, m long, k long, amp double")


def _chirp(i: np.ndarray, m: int) -> np.ndarray:
    """exp(-i pi i^2 / m), with the square reduced exactly (in two steps of 20 bits, for m below 2**40)."""
    i = np.asarray(i, dtype=np.int64)
    r = (((i * (i >> 20)) % (2 * m) << 20) + i * (i & ((1 << 20) - 1))) % (2 * m)
    return np.exp(-1j * np.pi * (r / m))


def _fft_rows(df: DataFrame, keys: list[str], inverse: bool) -> DataFrame:
    """Four-step FFT of ``keys, size, i, re, im`` rows; ``size`` is a power of two."""
    kinds = f"{_types(df, keys)}, size long, i long, re double, im double"
    sign = 1 if inverse else -1

    def halves(size):
        first = 1 << (int(size).bit_length() // 2)
        return first, int(size) // first

    def emit(key, size, at, z):
        out = pd.DataFrame({"size": size, "i": at, "re": z.real, "im": z.imag})
        for name, v in zip(keys, key):
            out[name] = v
        return out

    def dense(pdf, places, length):
        z = np.zeros(length, dtype=complex)
        z[places] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        return np.fft.ifft(z) * length if inverse else np.fft.fft(z)

    def columns(key, pdf):
        size, low = int(pdf["size"].iloc[0]), int(key[-1])
        first, second = halves(size)
        z = dense(pdf, pdf["i"].to_numpy() // second, first)
        k1 = np.arange(first, dtype=np.int64)
        z = z * np.exp(sign * 2j * np.pi * ((k1 * low) % size) / size)
        return emit(key[:-1], size, k1 * second + low, z)

    def rows(key, pdf):
        size, k1 = int(pdf["size"].iloc[0]), int(key[-1])
        first, second = halves(size)
        z = dense(pdf, pdf["i"].to_numpy() % second, second)
        return emit(key[:-1], size, k1 + first * np.arange(second, dtype=np.int64), z / size if inverse else z)

    bits = F.length(F.bin("size"))
    second = F.col("size") / F.pow(num(2), F.floor(bits / 2))
    by_low = df.withColumn("_g", (F.col("i") % second).cast("long"))
    a = by_low.groupBy(*keys, "_g").applyInPandas(lambda k, p: columns(k, p), kinds)
    by_high = a.withColumn("_g", F.floor(F.col("i") / second).cast("long"))
    return by_high.groupBy(*keys, "_g").applyInPandas(lambda k, p: rows(k, p), kinds)


def spectrum_long(df: DataFrame, keys: Sequence[str], value: str, length: str) -> DataFrame:
    """Spectrum of series of any length by distributed chirp transforms."""
    keys = list(keys)
    size = F.pow(num(2), F.ceil(F.log2(2.0 * F.col(length)))).cast("long")
    base = df.select(*keys, F.col(IDX).alias("i"), F.col(length).alias("m"), F.col(value).cast("double").alias("re"), size.alias("size"))
    kinds = _types(df, keys)

    def twist(batches):
        for pdf in batches:
            if len(pdf):
                for m, part in pdf.groupby("m"):
                    z = (part["re"].to_numpy() + 1j * part["im"].to_numpy()) * _chirp(part["i"].to_numpy(), int(m))
                    yield part.assign(re=z.real, im=z.imag)

    def taps(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                i = np.arange(int(row["lo"]), int(row["hi"]), dtype=np.int64)
                z = np.conj(_chirp(i, int(row["m"])))
                for at in (i, (int(row["size"]) - i)[i > 0]):
                    part = z if len(at) == len(z) else z[i > 0]
                    out = pd.DataFrame({"size": int(row["size"]), "i": at, "re": part.real, "im": part.imag})
                    for k in keys:
                        out[k] = row[k]
                    yield out

    fields = f"{kinds}, m long, size long, i long, re double, im double"
    signal = base.withColumn("im", num(0)).select(*keys, "m", "size", "i", "re", "im").mapInPandas(twist, fields)
    known = base.select(*keys, "m", "size").distinct()
    step = 1 << 18
    blocks = known.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(step).cast("long")))).withColumn(
        "hi", F.least(F.col("lo") + step, F.col("m")))
    chirps = blocks.mapInPandas(taps, f"{kinds}, size long, i long, re double, im double")
    a = _fft_rows(signal.drop("m"), keys, False)
    b = _fft_rows(chirps, keys, False).select(*keys, "i", F.col("re").alias("r2"), F.col("im").alias("i2"))
    product = a.join(b, [*keys, "i"]).select(
        *keys, "size", "i", (F.col("re") * F.col("r2") - F.col("im") * F.col("i2")).alias("re"),
        (F.col("re") * F.col("i2") + F.col("im") * F.col("r2")).alias("im"))
    back = _fft_rows(stage(product, "spectrum"), keys, True)
    # the last factor has magnitude 1, so amplitudes do not need it
    amp = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return back.join(known.select(*keys, "m"), keys).filter(F.col("i") <= F.floor(F.col("m") / 2)).select(
        *keys, "m", F.col("i").alias("k"), amp.alias("amp"))


def dominant_period(df: DataFrame, sig: str, least: int = 12, most: int | None = None) -> DataFrame:
    """``series_id, m, period``: strongest period strictly between ``least`` and ``most`` rows.

    ``most`` is a third of the rows unless given.  Null when the series is too short or
    flat or has no frequency in the band.
    """
    s = spectrum(df, [SERIES], sig)
    flat = df.groupBy(SERIES).agg(F.stddev_pop(sig).alias("_sd"))
    m = F.col("m")
    top = F.floor(m / 3) if most is None else F.lit(most)
    freq = F.col("k") / m
    usable = (m >= 2 * least) & (top > least) & (freq > 1.0 / top) & (freq < 1.0 / least)
    ok = s.join(flat, SERIES)
    best = ok.groupBy(SERIES, "m", "_sd").agg(
        F.max(F.when(usable, F.struct(F.col("amp"), (-F.col("k")).alias("_k")))).alias("_b"))
    found = F.col("_b").isNotNull() & (F.col("_sd") >= 1e-10)
    period = F.greatest(F.lit(least), F.bround(F.col("m") / -F.col("_b._k")).cast("int"))
    return best.select(SERIES, "m", F.when(found, period).alias("period"))


def period_candidates(s: DataFrame, keys: Sequence[str], most: int = 5) -> DataFrame:
    """Periods of up to three strong bins per feature, merged within two rows.

    ``s`` is a spectrum keyed by (series, feature).  Series without any get 10, 20, 50.
    """
    from pyspark.sql import Window

    half = F.floor(F.col("m") / 2)
    inner = s.filter((F.col("k") >= 1) & (F.col("k") < half))
    mean = inner.groupBy(*keys).agg(F.avg("amp").alias("_mean"), F.count(F.lit(1)).alias("_bins"))
    # the best three overall are among the best three of each block of bins
    block = inner.withColumn("_blk", F.floor(F.col("k") / 65536))
    order = [F.col("amp").desc(), F.col("k")]
    local = block.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(*order))).filter("_r <= 3")
    top = local.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r <= 3")
    period = F.col("m") / F.col("k")
    strong = top.join(mean, list(keys)).filter((F.col("_bins") > 3) & (F.col("amp") > 2 * F.col("_mean"))).select(
        SERIES, period.alias("p"), "m").filter((F.col("p") >= 5) & (F.col("p") <= F.col("m") / 2))
    listed = strong.groupBy(SERIES).agg(F.array_sort(F.collect_set("p")).alias("_p"))

    def keep(acc, p):
        return F.when(F.exists(acc, lambda u: F.abs(u - p) < 2), acc).otherwise(F.concat(acc, F.array(p)))

    merged = F.aggregate("_p", F.array().cast("array<double>"), keep)
    return s.select(SERIES).distinct().join(listed, SERIES, "left").select(
        SERIES, F.coalesce(F.slice(merged, 1, most), F.array(num(10), num(20), num(50))).alias("periods"))


def shape(s: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak, energy, centroid, entropy and high/low ratio over positive frequencies."""
    pos = s.filter((F.col("k") >= 1) & (F.col("k") <= F.floor((F.col("m") - 1) / 2)))
    count = F.floor((F.col("m") - 1) / 2)
    low = F.col("k") <= F.floor(count / 2)
    freq, amp = F.col("k") / F.col("m"), F.col("amp")
    first = pos.groupBy(*keys).agg(
        F.max(F.struct(amp, (-F.col("k")).alias("_k"))).alias("_b"), F.max("m").alias("m"), F.count(amp).alias("_bins"), F.sum(amp * amp).alias("freq_energy"),
        F.sum(freq * amp).alias("_fa"), F.sum(amp).alias("_a"), F.sum(F.when(amp > 0, amp * F.log(amp)).otherwise(num(0))).alias("_al"),
        F.sum(F.when(low, amp * amp)).alias("_lo"), F.sum(F.when(~low, amp * amp)).alias("_hi"),
    )
    a = F.col("_a")
    return first.select(
        *keys, (-F.col("_b._k") / F.col("m")).alias("freq_peak"), F.col("_b.amp").alias("freq_peak_amp"), "freq_energy",
        F.when(a > 0, F.col("_fa") / a).otherwise(num(0)).alias("freq_centroid"),
        F.when(a > 0, F.log(a) - F.col("_al") / a - 1e-10 * F.col("_bins")).otherwise(num(0)).alias("freq_entropy"),
        F.when(F.col("_lo").isNotNull(), F.col("_hi") / (F.col("_lo") + num(1e-10))).otherwise(num(0)).alias("freq_hf_lf_ratio"),
    )
