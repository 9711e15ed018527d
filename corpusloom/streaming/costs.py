"""Extensions over the append-only call log as a stream: windowed costs, late data, repeated calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def call_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def windowed(calls: DataFrame, key: str, value: str, every: str = "10 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Calls and cost of each key and window; rows later than ``late`` are left out."""
    w = F.window(ts, every)
    return calls.withWatermark(ts, late).groupBy(w.alias("window"), key).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col(value).cast("decimal(18,2)")).alias("cost"))


def sessions(calls: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return calls.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("calls"))


def once(calls: DataFrame, key: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Each call once, though it was delivered again within ``late``."""
    return calls.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
