"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.calls import USD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as call records: a user's events are one interaction, the value is cost and latency."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("correlation_id"),
        "ts",
        F.when(F.col("event_type").isin("click", "view"), "llm").otherwise("local_model").alias("kind"),
        F.col("event_type").alias("purpose"),
        (F.col("event_type") != "error").alias("billable"),
        F.when(k % 3 == 0, "hit").otherwise("miss").alias("local_cache"),
        F.col("value").cast(USD).alias("cost_usd"),
        F.col("value").alias("latency_ms"),
        k.alias("input_tokens"),
        (k * 2).alias("output_tokens"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("error"),
    )


def catalogued_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with access labels: the source names the tenant, the language the sensitivity, every seventh is superseded."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        "text",
        F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0, "retail").otherwise("business").alias("tenant"),
        F.when(F.col("lang") == "de", "restricted").otherwise("public").alias("sensitivity"),
        (F.col("doc_id") % 7 != 0).alias("is_current"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts of their nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("member_id"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions: those whose priority is low are outflows."""
    o = table(spark, sf_dir, "orders")
    amount = F.col("o_totalprice").cast("decimal(12,2)")
    return o.select(F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("posted_on"), F.when(F.col("o_orderpriority") == "5-LOW", -amount).otherwise(amount).cast("decimal(12,2)").alias("amount"))
