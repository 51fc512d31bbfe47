"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and for ``bench.py``; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewatch")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        # frames cost far more time than bytes, so small shuffles should stay spread out
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session
    without that setting gets a temporary folder; on a cluster this is an error.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several later steps need the same expensive frame: it cuts the
    lineage, survives lost executors and lets each reader prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it is a staged table already, else the table that it is staged as."""
    return df if hasattr(df, "staged_at") else stage(df, name)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more.

    Spark frees the shuffles behind them when the driver collects its garbage, so that is asked for.
    """
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
