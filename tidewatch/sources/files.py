"""Series and label windows from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tidewatch.operators.layout import CHUNK_ROWS, SERIES, index_series

POINT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])
WINDOWS_TYPE = T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.StringType())))


def csv_series(spark: SparkSession, root: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Every ``timestamp,value`` CSV below ``root``; the relative path names the series.

    File order breaks ties between equal timestamps.
    """
    path = F.col("_metadata.file_path")
    base = root.rstrip("/") + "/"
    raw = (
        spark.read.schema(POINT_SCHEMA).option("header", True).option("recursiveFileLookup", True).csv(root)
        .select(
            F.element_at(F.split(path, F.concat(F.lit(r"\Q"), F.lit(base), F.lit(r"\E"))), -1).alias(SERIES),
            F.col("timestamp").alias("ts"), F.col("value").alias("f0"),
            F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"),
        )
    )
    # a split file is read in blocks; lines ascend within one
    return index_series(raw, ["ts", "_block", "_line"], rows=rows).drop("_block", "_line")


def parse_windows(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON maps ``{series: [[start, end], ...]}`` to one row per window.

    A series with an empty list gives one row with null bounds, so that it stays known.
    """
    per_series = texts.select(F.explode(F.from_json(column, WINDOWS_TYPE)).alias(SERIES, "_w"))
    return per_series.select(SERIES, F.posexplode_outer("_w").alias("window_id", "_p")).select(
        SERIES, "window_id",
        F.to_timestamp(F.col("_p")[0]).alias("start_ts"), F.to_timestamp(F.col("_p")[1]).alias("end_ts"),
    )


def json_windows(spark: SparkSession, path: str) -> DataFrame:
    return parse_windows(spark.read.text(path, wholetext=True))


def in_category(series: DataFrame, windows: DataFrame, category: str, include_empty: bool = False) -> DataFrame:
    """Rows of the series whose name starts with ``category/`` and that have windows."""
    named = windows if include_empty else windows.filter(F.col("start_ts").isNotNull())
    listed = named.filter(F.col(SERIES).startswith(f"{category}/")).select(SERIES).distinct()
    return series.filter(F.col(SERIES).startswith(f"{category}/")).join(listed, SERIES, "left_semi")
