"""How series are laid out over a cluster.

Every operator reads frames keyed by ``(series_id, idx)`` where ``idx`` is the dense
0-based position of a row in its series, ``n`` the length of the series and ``chunk``
the fixed-length piece the row is processed in.  One series may hold any share of all
rows, so no window, group or join is ever partitioned by ``series_id`` alone; row-level
work is partitioned by ``(series_id, chunk)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

SERIES = "series_id"
IDX = "idx"
LEN = "n"
CHUNK = "chunk"
KEYS = [SERIES, CHUNK]

CHUNK_ROWS = 8192
TIME_BINS = 4096
SECONDS_PER_DAY = 86400


def _as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col) / F.lit(1e6)
    if isinstance(kind, T.TimestampNTZType):
        # wall-clock fields: monotone in the value and independent of the session zone
        return (
            F.unix_date(F.to_date(col)) * F.lit(SECONDS_PER_DAY)
            + F.hour(col) * 3600 + F.minute(col) * 60 + F.second(col)
        ).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    return col.cast("double")


def chunk_of(idx: Column | str = IDX, rows: int = CHUNK_ROWS) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(idx / F.lit(rows)).cast("long")


def index_series(
    df: DataFrame,
    order: Sequence[str],
    rows: int = CHUNK_ROWS,
    bins: int = TIME_BINS,
    short: bool = False,
) -> DataFrame:
    """Add ``idx``, ``n`` and ``chunk`` to a frame with a ``series_id`` column.

    ``order`` must be unique within a series.  Positions come from two levels: the first
    order column is cut into ``bins`` equal spans over the whole table, rows are numbered
    inside ``(series_id, span)``, and the counts of earlier spans are added.  So the
    largest sort group is one series within one span, not one series.  ``short`` says
    that series are bounded by construction (one row per day, say) and uses one level.
    """
    if short:
        whole = Window.partitionBy(SERIES)
        out = df.select(
            "*",
            (F.row_number().over(whole.orderBy(*order)) - 1).cast("long").alias(IDX),
            F.count(F.lit(1)).over(whole).alias(LEN),
        )
        return out.withColumn(CHUNK, chunk_of(rows=rows))
    num = _as_number(df, order[0])
    bounds = df.agg(F.struct(F.min(num).alias("lo"), F.max(num).alias("hi")).alias("b")).scalar()
    width = (bounds.getField("hi") - bounds.getField("lo")) / F.lit(float(bins))
    span = F.when(width > 0, F.floor((num - bounds.getField("lo")) / width)).otherwise(F.lit(0)).cast("long")
    binned = df.withColumn("_span", span)
    per_span = binned.groupBy(SERIES, "_span").agg(F.count(F.lit(1)).alias("_c"))
    by_span = Window.partitionBy(SERIES).orderBy("_span")
    offsets = per_span.select(
        SERIES, "_span",
        (F.sum("_c").over(by_span) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy(SERIES)).alias(LEN),
    )
    numbered = binned.withColumn(
        "_pos", F.row_number().over(Window.partitionBy(SERIES, "_span").orderBy(*order)) - 1
    )
    return (
        numbered.join(offsets, [SERIES, "_span"])
        .withColumn(IDX, (F.col("_before") + F.col("_pos")).cast("long"))
        .withColumn(CHUNK, chunk_of(rows=rows))
        .drop("_span", "_before", "_pos")
    )


def with_halo(df: DataFrame, back: int = 0, ahead: int = 0, rows: int = CHUNK_ROWS) -> DataFrame:
    """Copy rows near a chunk edge into the neighbouring chunk; ``home`` marks originals.

    After this a frame of at most ``back`` preceding and ``ahead`` following rows over
    ``(series_id, chunk)`` sees the same rows as one over the whole series.
    """
    first = chunk_of(F.greatest(F.lit(0), F.col(IDX) - ahead), rows)
    last = chunk_of(F.least(F.col(LEN) - 1, F.col(IDX) + back), rows)
    return (
        df.withColumn(CHUNK, F.explode(F.sequence(first, last)))
        .withColumn("home", chunk_of(rows=rows) == F.col(CHUNK))
    )


def home(df: DataFrame) -> DataFrame:
    return df.filter("home").drop("home")


def by_chunk() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy(IDX)


def frame(start: int, end: int) -> WindowSpec:
    return by_chunk().rowsBetween(start, end)


def over_chunks(stats: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """One copy of each per-series row for every chunk of the series (needs ``n``)."""
    last = chunk_of(F.col(LEN) - 1, rows)
    return stats.withColumn(CHUNK, F.explode(F.sequence(F.lit(0).cast("long"), last)))


def attach(df: DataFrame, stats: DataFrame, rows: int = CHUNK_ROWS, on: Sequence[str] = ()) -> DataFrame:
    """Left join per-series ``stats`` (with ``n``) on ``(series_id, chunk)``.

    The join key is the one the rows are partitioned by already, so a long series is
    spread over its chunks and the size of ``stats`` does not matter.
    """
    return df.join(over_chunks(stats, rows).drop(LEN), [*KEYS, *on], "left")


def running(df: DataFrame, values: dict[str, Column], how=F.sum, back: bool = False) -> DataFrame:
    """Inclusive running sums (or minima, maxima) along each series; ``back`` runs from its end.

    Inside the chunk by a frame, and from earlier chunks by one value per chunk, so no
    task walks a whole series.  All columns share one sort and one small join.
    """
    tmp = {name: f"_in_{name}" for name in values}
    df = df.select("*", *[v.alias(tmp[k]) for k, v in values.items()])
    per_chunk = df.groupBy(*KEYS).agg(*[how(t).alias(t) for t in tmp.values()])
    past = Window.partitionBy(SERIES).orderBy(F.desc(CHUNK) if back else CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.select(*KEYS, *[how(t).over(past).alias(f"_before_{k}") for k, t in tmp.items()])
    # a frame to the end would be taken anew for every row
    inside = Window.partitionBy(*KEYS).orderBy(F.desc(IDX)).rowsBetween(Window.unboundedPreceding, 0) if back else frame(Window.unboundedPreceding, 0)
    out = df.select("*", *[how(t).over(inside).alias(k) for k, t in tmp.items()]).drop(*tmp.values())
    out = out.join(before, KEYS, "left")
    for k in values:
        earlier = F.col(f"_before_{k}")
        joined = F.col(k) + F.coalesce(earlier, F.lit(0)) if how is F.sum else (
            F.least(k, earlier) if how is F.min else F.greatest(k, earlier))
        out = out.withColumn(k, joined)
    return out.drop(*[f"_before_{k}" for k in values])


def runs(df: DataFrame, flag: str, rows: int = CHUNK_ROWS, total: str | None = None) -> DataFrame:
    """Maximal runs of true ``flag``: ``series_id, start, end`` (both inclusive).

    ``total`` names a column whose sum over the run is added.

    Runs are found inside chunks; only those touching a chunk edge, at most two per
    chunk, are put in order per series and merged.
    """
    w = by_chunk()
    extra = [total] if total else []
    marked = df.filter(F.col(flag)).select(*KEYS, IDX, *extra).withColumn(
        "_new", (F.col(IDX) - F.coalesce(F.lag(IDX).over(w), F.lit(-2)) > 1).cast("int")
    ).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = [F.sum(c).alias(c) for c in extra]
    pieces = marked.groupBy(*KEYS, "_g").agg(F.min(IDX).alias("start"), F.max(IDX).alias("end"), *sums)
    pieces = pieces.withColumn(
        "_edge",
        (F.col("start") == F.col(CHUNK) * rows) | (F.col("end") == (F.col(CHUNK) + 1) * rows - 1),
    )
    whole = pieces.filter(~F.col("_edge")).select(SERIES, "start", "end", *extra)
    ws = Window.partitionBy(SERIES).orderBy("start")
    edges = (
        pieces.filter("_edge")
        .withColumn("_new", (F.col("start") - F.coalesce(F.lag("end").over(ws), F.lit(-2)) > 1).cast("int"))
        .withColumn("_g", F.sum("_new").over(ws.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(SERIES, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), *sums)
    )
    return whole.unionByName(edges.select(SERIES, "start", "end", *extra))


def long_form(df: DataFrame, cols: Sequence[str], name: str, value: str, keep: Sequence[str]) -> DataFrame:
    """Wide columns to ``(keep..., name, value)`` rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols])
    return df.select(*keep, F.inline(pairs))
