"""Series built from the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators.layout import CHUNK_ROWS, index_series

DAILY_COLS = ["f0", "f1", "f2", "f3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str, key: str = "event_type", rows: int = CHUNK_ROWS) -> DataFrame:
    """``events`` as one series per ``key``, in time order; ``f0`` is the value."""
    raw = table(spark, sf_dir, "events").select(
        F.col(key).cast("string").alias("series_id"), "ts", "event_id", F.col("value").alias("f0")
    )
    return index_series(raw, ["ts", "event_id"], rows=rows).drop("event_id")


def daily_series(spark: SparkSession, sf_dir: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """``lineitem`` as one series per supplier with one row per shipping day, d = 4.

    Money is in cents and rates are in percent points, so sums are whole numbers and do
    not depend on the order of addition.  A series has at most one row per calendar day,
    so its length is bounded.
    """
    raw = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").cast("string").alias("series_id"),
            F.to_date("l_shipdate").alias("day"),
        )
        .agg(
            F.sum("l_quantity").alias("f0"),
            F.round(F.sum("l_extendedprice") * 100).alias("f1"),
            F.round(F.sum("l_discount") * 100).alias("f2"),
            F.round(F.sum("l_tax") * 100).alias("f3"),
        )
    )
    return index_series(raw, ["day"], rows=rows, short=True)
