"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts of at most about 8 MB, unless the session asks for another size than Spark's own.

    Ten thousand texts are tens of megabytes, which executors and their Python workers hold several times.
    """
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH)


#: Ids up to this many (tens of megabytes) are sent to all tasks instead of moving texts to them.
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """Rows of an id and little else: to be broadcast if they have been counted to be few, else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def id_hash(doc_id: Column, salt: str = "") -> Column:
    """32 hex digits that depend on the id alone; SQL engines share this function."""
    return F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def unused(columns: Iterable[str], name: str) -> str:
    """``name`` with as many underscores in front as it takes to be no column (names differ in case only are equal)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
