"""Label windows, anomaly masks and safety margins around them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tidewatch.functions import trailing
from tidewatch.functions.grouped import matrix, per_group
from tidewatch.functions.numeric import num
from tidewatch.functions.order import positions
from tidewatch.operators.layout import (
    CHUNK, CHUNK_ROWS, IDX, KEYS, LEN, SERIES, chunk_of, frame, home, running, runs, with_halo,
)
from tidewatch.session import stage, staged

BASE_MARGIN = 50
MAX_MARGIN = 300
EXCLUSION_CAP = 0.4
RECOVERY = 30
STD_RATIO = 2.0
MARGIN_STEP = 5
FEW_ROWS = 100


def window_positions(series: DataFrame, windows: DataFrame) -> DataFrame:
    """Time windows to position ranges ``start, end`` (inclusive).

    Both window ends are inclusive.  A window without rows marks the first row after its
    start, or the last row of the series.  Window edges and rows are merged in one order.
    """
    edges = windows.select(
        SERIES, "window_id", F.inline(F.array(
            F.struct(F.lit(False).alias("inclusive"), F.col("start_ts").alias("ts")),
            F.struct(F.lit(True).alias("inclusive"), F.col("end_ts").alias("ts")),
        ))
    )
    at = positions(series, [SERIES], "ts", CHUNK, edges, "_c")
    counts = at.groupBy(SERIES, "window_id").agg(
        F.max(F.when(~F.col("inclusive"), F.col("_c"))).alias("_s"), F.max(F.when(F.col("inclusive"), F.col("_c"))).alias("_e"),
    ).join(series.groupBy(SERIES).agg(F.max(LEN).alias(LEN)), SERIES)
    start = F.least(F.col("_s"), F.col(LEN) - 1)
    end = F.greatest(F.least(F.col("_e") - 1, F.col(LEN) - 1), start)
    return counts.select(SERIES, "window_id", LEN, start.alias("start"), end.alias("end"))


def ranges_by_chunk(ranges: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Position ranges cut at chunk edges, one row per range and chunk."""
    first = F.col(CHUNK) * rows
    return (
        ranges.withColumn(CHUNK, F.explode(F.sequence(chunk_of("start", rows), chunk_of("end", rows))))
        .withColumn("start", F.greatest("start", first))
        .withColumn("end", F.least("end", first + (rows - 1)))
    )


def fresh_rows(ranges: DataFrame, keys: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Ranges per chunk, cut down to the rows that no earlier range covers."""
    w = Window.partitionBy(*keys, CHUNK).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    cut = ranges_by_chunk(ranges, rows).withColumn("_reach", reach)
    return cut.withColumn("start", F.greatest("start", F.col("_reach") + 1)).filter("start <= end").drop("_reach")


def mark_ranges(df: DataFrame, ranges: DataFrame, name: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add boolean ``name``: the row lies in at least one of the ranges.

    What is new in each range meets its first row, and the end is carried on within the chunk.
    """
    pieces = fresh_rows(ranges.select(SERIES, "start", "end"), [SERIES], rows).select(*KEYS, F.col("start").alias(IDX), F.col("end").alias("_to"))
    last = F.last("_to", ignorenulls=True).over(frame(Window.unboundedPreceding, 0))
    return df.join(pieces, [*KEYS, IDX], "left").withColumn(name, F.coalesce(last >= F.col(IDX), F.lit(False))).drop("_to")


def anomaly_mask(series: DataFrame, windows: DataFrame, name: str = "is_anomaly", rows: int = CHUNK_ROWS) -> DataFrame:
    return mark_ranges(series, window_positions(series, windows), name, rows)


def widen(ranges: DataFrame, margin: Column | int) -> DataFrame:
    """Ranges grown on both sides and cut at the ends of the series (needs ``n``)."""
    margin = F.lit(margin) if isinstance(margin, int) else margin
    return ranges.select(
        *[c for c in ranges.columns if c not in ("start", "end")],
        F.greatest(F.lit(0).cast("long"), F.col("start") - margin).alias("start"),
        F.least(F.col(LEN) - 1, F.col("end") + margin).alias("end"),
    )


def dilate(df: DataFrame, flag: str, margin: int, name: str = "masked", rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows within ``margin`` of a flagged row; a margin of 0 or less copies the mask."""
    if margin <= 0:
        return df.withColumn(name, F.col(flag))
    wide = with_halo(df, back=margin, ahead=margin, rows=rows)
    return home(wide.withColumn(name, F.max(flag).over(frame(-margin, margin))))


def local_std(sig: str = "sig", half: int = RECOVERY // 2) -> Column:
    """Centred deviation; infinite where fewer than five rows are in the window."""
    w = frame(-half, half)
    return F.when(F.count(sig).over(w) >= 5, F.stddev_pop(sig).over(w)).otherwise(num(float("inf")))


def with_local_std(df: DataFrame, sig: str, half: int, name: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``local_std``; the windows of a chunk are taken at once within its task."""
    wide = with_halo(df, back=half, ahead=half, rows=rows)
    schema = T.StructType([f for f in wide.schema.fields if f.name != "home"] + [T.StructField(name, T.DoubleType())])

    def deviations(group: pa.Table) -> pa.Table:
        own, gap = group.column("home"), np.zeros(half)
        x, known = matrix(group, [sig])[:, 0], group.column(sig).is_valid().to_numpy()
        with np.errstate(all="ignore"):
            count, _, square = trailing.moments(np.append(x, gap), np.append(known, gap > 0), 2 * half + 1)
            value = np.where(count >= 5, np.sqrt(square / count), np.inf)[half:]
        return group.drop_columns("home").append_column(name, pa.array(value)).filter(own)

    return per_group(wide, KEYS, [IDX], deviations, schema)


def covered(ranges: DataFrame, keys: list[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows covered by the union of ranges per ``keys``."""
    return fresh_rows(ranges, keys, rows).groupBy(*keys).agg(
        F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("covered")
    )


def adaptive_mask(
    df: DataFrame, flag: str, sig: str = "sig", base_margin: int = BASE_MARGIN, max_margin: int = MAX_MARGIN,
    cap: float = EXCLUSION_CAP, recovery: int = RECOVERY, ratio: float = STD_RATIO, rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Margins that last until the signal has calmed down again.

    Returns the rows with boolean ``masked`` and one info row per series.  Margins work on
    runs of the mask, and only rows within ``max_margin`` of a run edge are looked at.
    The rows and the tables of runs and margins are staged, as several steps read them.
    """
    df = staged(df, "margin-rows")
    n_rows = df.groupBy(SERIES).agg(F.max(LEN).alias(LEN))
    islands = stage(runs(df, flag, rows).join(n_rows, SERIES).select(SERIES, LEN, "start", "end"), "islands")
    far = mark_ranges(df, widen(islands, max_margin), "_near", rows)
    calm = F.when(~F.col("_near"), F.col(sig))
    base = far.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.stddev_pop(calm).alias("_sd"), F.count(calm).alias("_calm")
    )
    stats = stage(base.withColumn("fallback", F.col("_calm") < FEW_ROWS).withColumn(
        "baseline_std", F.when(~F.col("fallback"), F.col("_sd"))
    ), "calm")
    half = recovery // 2
    noise = with_local_std(df.select(*KEYS, IDX, LEN, sig), sig, half, "_local", rows)
    # the nearest calm row before and after each row, carried over chunks
    quiet = noise.join(stats.select(SERIES, "baseline_std"), SERIES)
    calm_at = F.when(F.col("_local") <= ratio * F.col("baseline_std"), F.col(IDX))
    nearest = running(running(quiet, {"_calm_before": calm_at}, F.max), {"_calm_after": calm_at}, F.min, back=True)
    sides = islands.select(SERIES, LEN, F.inline(F.array(
        F.struct(F.lit("post").alias("side"), F.col("end").alias("edge"), F.least(F.lit(max_margin), F.col(LEN) - 1 - F.col("end")).alias("_room")),
        F.struct(F.lit("pre").alias("side"), F.col("start").alias("edge"), F.least(F.lit(max_margin), F.col("start")).alias("_room")),
    )))
    # a margin ends at the first calm row from base_margin on, looked up at that row
    ahead = F.when(F.col("side") == "post", F.lit(1)).otherwise(F.lit(-1))
    first = F.greatest(F.lit(base_margin), F.lit(1))
    looked = sides.filter(F.col("_room") >= first).withColumn(IDX, F.col("edge") + ahead * first).withColumn(CHUNK, chunk_of(rows=rows))
    looked = looked.join(nearest.select(*KEYS, IDX, "_calm_before", "_calm_after"), [*KEYS, IDX])
    off = F.when(F.col("side") == "post", F.col("_calm_after") - F.col("edge")).otherwise(F.col("edge") - F.col("_calm_before"))
    stops = looked.select(SERIES, "side", "edge", F.when(off <= F.col("_room"), off).alias("_stop"))
    reach = sides.filter("_room > 0").join(stops, [SERIES, "side", "edge"], "left").select(SERIES, "side", "edge", "_stop", F.col("_room").alias("_last"))
    margins = stage(sides.select(SERIES, LEN, "side", "edge").join(reach, [SERIES, "side", "edge"], "left").select(
        SERIES, LEN, "side", "edge",
        F.coalesce("_stop", "_last", F.lit(0)).alias("margin"),
        F.coalesce(F.col("_stop") - 1, F.col("_last"), F.lit(0)).alias("marked"),
    ), "margins")
    grown = margins.select(
        SERIES, LEN,
        F.when(F.col("side") == "post", F.col("edge")).otherwise(F.col("edge") - F.col("marked")).alias("start"),
        F.when(F.col("side") == "post", F.col("edge") + F.col("marked")).otherwise(F.col("edge")).alias("end"),
    )
    fixed = widen(islands, base_margin)
    adaptive = grown.unionByName(islands).unionByName(fixed)
    share = covered(adaptive, [SERIES]).withColumnRenamed("covered", "_adaptive")
    tries = islands.withColumn("margin", F.explode(F.sequence(F.lit(0), F.lit(base_margin), F.lit(MARGIN_STEP))))
    tries = tries.withColumn("margin", F.lit(base_margin) - F.col("margin"))
    fits = (
        covered(widen(tries, F.col("margin")), [SERIES, "margin", LEN])
        .filter(F.col("covered") / F.col(LEN) <= cap)
        .groupBy(SERIES).agg(F.max("margin").alias("_fit"))
    )
    spare = covered(widen(islands, max_margin), [SERIES]).withColumnRenamed("covered", "_safe")
    chosen = (
        stats.join(share, SERIES, "left").join(fits, SERIES, "left").join(spare, SERIES, "left")
        .withColumn("_pre", F.coalesce(F.col("_adaptive"), F.lit(0)) / F.col(LEN))
        .withColumn("mode", F.when(F.col("fallback"), F.lit(base_margin))
                    .when(F.col("_pre") <= cap, F.lit(-1)).otherwise(F.coalesce("_fit", F.lit(0))).cast("int"))
    )
    chosen = stage(chosen, "margin-mode")
    pick = chosen.select(SERIES, "mode")
    final = (
        adaptive.join(pick.filter("mode = -1"), SERIES, "left_semi")
        .unionByName(
            widen(islands.join(pick.filter("mode >= 0"), SERIES), F.col("mode")).drop("mode")
        )
    )
    out = mark_ranges(df, final, "masked", rows)
    sizes = covered(final, [SERIES]).withColumnRenamed("covered", "_final")
    avg = margins.groupBy(SERIES).agg(
        F.avg(F.when(F.col("side") == "pre", F.col("margin"))).alias("_mpre"),
        F.avg(F.when(F.col("side") == "post", F.col("margin"))).alias("_mpost"),
    )
    fallback = F.col("fallback")
    info = chosen.join(sizes, SERIES, "left").join(avg, SERIES, "left").select(
        SERIES, "baseline_std",
        F.when(fallback, num(base_margin)).otherwise(F.coalesce("_mpre", num(base_margin))).alias("avg_margin_pre"),
        F.when(fallback, num(base_margin)).otherwise(F.coalesce("_mpost", num(base_margin))).alias("avg_margin_post"),
        F.when(fallback, F.coalesce("_safe", F.lit(0)) / F.col(LEN)).otherwise(F.col("_pre")).alias("exclusion_before_cap"),
        (F.coalesce("_final", F.lit(0)) / F.col(LEN)).alias("exclusion_final"),
        F.when(F.col("mode") == -1, F.lit(max_margin)).otherwise(F.col("mode")).cast("int").alias("margin_after_cap"),
        "fallback",
    )
    return out, info


def clean_counts(df: DataFrame, masked: str = "masked", min_frames: int = 50) -> DataFrame:
    """Clean rows per series and whether there are enough to fit regimes on."""
    need = max(2 * min_frames, FEW_ROWS)
    return df.groupBy(SERIES).agg(
        F.max(LEN).alias(LEN), F.count(F.when(~F.col(masked), F.lit(1))).alias("clean_rows")
    ).withColumn("accepted", F.col("clean_rows") >= need)
