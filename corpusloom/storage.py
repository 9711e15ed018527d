"""Shared-folder helpers: every written intermediate goes where all executors can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only where it is unset on a single machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` gave, once what was made of them is written; others are left alone."""
    for df in tables:
        path = df.__dict__.pop("written_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it has fewer partitions than there are, as one small file has; else as it is, without a shuffle.

    For scans: to count the partitions of a frame with shuffles, adaptive execution would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: What a Python worker is sent at a time, about.
BATCH_BYTES = 2_000_000


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is, to be sent to Python in batches of about BATCH_BYTES, however long its rows are: Spark reads the setting when a plan runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than it must to know."""
    return df.limit(rows + 1).count() <= rows
