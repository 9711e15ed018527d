"""Tables on storage: append-only logs, keyed stage caches, the lexical and the vector store, JDBC reads."""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = "call_id string, correlation_id string, run_id string, ts timestamp, kind string, purpose string, billable boolean, model string, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, local_cache string, cost_usd decimal(18,8), latency_ms double, error string"


def append(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Add rows to an append-only log."""
    rows.write.mode("append").format(fmt).save(path)


def read_log(spark: SparkSession, path: str, schema: str = CALLS) -> DataFrame:
    """A JSON Lines log with the run it came from."""
    return spark.read.schema(schema).json(path).withColumn("source_run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def write_decisions(decisions: DataFrame, path: str) -> None:
    """The decision log, sorted by file name; one row a file."""
    decisions.orderBy("filename").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def stage_key(stage: str, version: str, params: dict, before: str) -> str:
    """Chained key: a change upstream changes every key after it."""
    return sha256(json.dumps({"stage": stage, "version": version, "params": params, "input": before}, sort_keys=True, default=str).encode()).hexdigest()


def corpus_fingerprint(files: DataFrame) -> str:
    """Hash of all names and contents, whatever order they come in: a sum of row hashes, so no list is gathered."""
    row = files.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\0", "filename", "sha256"), 256), 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(5)]).first()
    return sha256("|".join(map(str, row)).encode()).hexdigest()


def cached_stage(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table under its key, made if it isn't there."""
    path = f"{root.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def responses(requests: DataFrame, cache: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(requests answered from the cache, those it lacks) by the hash of their sorted parts."""
    keyed = requests.withColumn("cache_key", F.sha2(F.to_json(F.struct(*sorted(parts))), 256))
    return keyed.join(cache, "cache_key"), keyed.join(cache, "cache_key", "left_anti")


class VectorStore:
    """Vectors by parser, chunker and model revision; opening another revision than was written is an error."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def add(self, chunks: DataFrame, parser: str, chunker: str, revision: str) -> None:
        keyed = chunks.withColumn("parser", F.lit(parser)).withColumn("chunker", F.lit(chunker)).withColumn("revision", F.lit(revision))
        keyed.write.mode("append").partitionBy("parser", "chunker", "revision").parquet(self.root)

    def open(self, parser: str, chunker: str, revision: str) -> DataFrame:
        rows = self.spark.read.parquet(self.root).where((F.col("parser") == parser) & (F.col("chunker") == chunker))
        found = [r.revision for r in rows.select("revision").distinct().limit(2).collect()]
        if found != [revision]:
            raise ValueError(f"index revision {found}, wanted {revision}")
        return rows


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A read-only query against a database; filters in it run there."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
