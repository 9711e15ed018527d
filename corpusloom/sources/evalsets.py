"""Evaluation sets from YAML files: small tables that people write, read on the driver."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx
from corpusloom.sources import schemas


def read_yaml(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The list under ``key`` as a table; absent fields are null. Any path that Spark can read."""
    raw = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])
    wanted = T.StructType.fromDDL(schema)

    def value(x, kind):
        if x is None:
            return [] if isinstance(kind, T.ArrayType) else None
        if isinstance(kind, T.ArrayType):
            return [tuple(v.get(f.name) for f in kind.elementType) if isinstance(kind.elementType, T.StructType) else str(v) for v in x]
        return str(x)

    return spark.createDataFrame([tuple(value(r.get(f.name), f.dataType) for f in wanted) for r in raw.get(key) or []], wanted)


def golden_items(golden: DataFrame) -> DataFrame:
    """query_id, item, doc_id, quote, match: locations with the same normalised quote are one relevant item."""
    each = golden.select(F.col("id").alias("query_id"), F.explode("expected").alias("e")).select("query_id", "e.*")
    return each.select("query_id", tx.normalise(F.col("quote")).alias("item"), "doc_id", "quote", "match")


def outcome_of(golden: DataFrame) -> DataFrame:
    """Evaluation items of a golden set with the outcome to expect: unanswerable and restricted questions are to be declined."""
    declined = (F.size("expected") == 0) | F.coalesce(F.col("access") == "restricted", F.lit(False))
    return golden.select("id", F.lit("golden").alias("set"), F.col("query").alias("question"), "tenant", F.lit("retrieve").alias("expected_gate"), F.when(declined, "not_in_corpus").otherwise("answered").alias("expected_outcome"), F.col("type").alias("category"))


def no_retrieval_items(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.lit("no_retrieval").alias("set"), F.col("query").alias("question"), "tenant", "expected_gate", F.lit("answered_direct").alias("expected_outcome"), "category")


def probe_items(probes: DataFrame, golden: DataFrame) -> DataFrame:
    """Probes with their source question's tenant where they name none."""
    source = golden.select(F.col("id").alias("source_id"), F.col("tenant").alias("source_tenant"))
    j = probes.join(source, "source_id")
    return j.select("id", F.lit("repeat_traffic").alias("set"), F.col("query").alias("question"), F.coalesce("tenant", "source_tenant").alias("tenant"), F.lit("retrieve").alias("expected_gate"), F.lit(None).cast("string").alias("expected_outcome"), F.col("variant").alias("category"), "expect_cache", "corpus_version", "source_id")


def all_items(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
