"""Record lookups: accounts, transactions, policies, and the check that reported money traces back to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.storage import materialize

#: Nested results are opened so many levels at a time.
LEVELS = 5


def by_owner(owners: DataFrame, accounts: DataFrame, owner: str) -> DataFrame:
    """Accounts of each asked owner; an owner without accounts gives none."""
    return owners.select(owner).distinct().join(accounts, owner)


def lookup(asked: DataFrame, table: DataFrame, key: str | list[str]) -> DataFrame:
    """Each asked key (of one or several columns) with its row; ``outcome`` is ok or not_found."""
    there = table.withColumn("_there", F.lit(True))
    return asked.join(there, key, "left").withColumn("outcome", F.when(F.col("_there"), "ok").otherwise("not_found")).drop("_there")


def newest(accounts: DataFrame, transactions: DataFrame, key: str, date: str, item: str, n: int, most: int = 50) -> DataFrame:
    """Up to n (1 to ``most``) newest transactions of each account; an account without any stays as one row without a transaction."""
    if not 1 <= n <= most:
        raise ValueError(f"limit {n} is not in 1..{most}")
    order = Window.partitionBy(key).orderBy(F.desc(date), F.desc(item))
    last = transactions.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return accounts.select(key).join(last, key, "left")


def policy_limit(asked: DataFrame, policies: DataFrame) -> DataFrame:
    """Status and limit for a peril: an absent peril gives a null limit, an absent policy found = false.

    ``policies``: policy_number, status, coverage_limits (map or JSON text).
    """
    limits = F.col("coverage_limits")
    if dict(policies.dtypes)["coverage_limits"] == "string":
        policies = policies.withColumn("coverage_limits", F.from_json(limits, "map<string,double>"))
    j = asked.join(policies.withColumn("_there", F.lit(True)), "policy_number", "left")
    return j.select(*asked.columns, F.coalesce("_there", F.lit(False)).alias("found"), "status", F.try_element_at("coverage_limits", F.col("peril")).alias("limit"))


def cited_records(fields: DataFrame, cited: DataFrame) -> DataFrame:
    """All fields (call_id, record, name, value) of the records in which any field equals a cited id (call_id, id)."""
    hit = fields.join(cited.select("call_id", F.col("id").alias("value")), ["call_id", "value"], "left_semi").select("call_id", "record").distinct()
    return fields.join(hit, ["call_id", "record"], "left_semi")


def allowed_figures(fields: DataFrame, *keys: str) -> DataFrame:
    """figure set of each key: the size of every money value, of the amounts' sum, of their outflow, and their inflow."""
    value = tx.money(F.col("value"))
    amount = F.when(F.col("name") == "amount", value)
    agg = fields.groupBy(*keys).agg(
        F.collect_set(F.abs(value)).alias("each"), F.abs(F.sum(amount)).alias("net"), F.abs(F.sum(F.when(amount < 0, amount).when(amount.isNotNull(), 0))).alias("out"), F.sum(F.when(amount > 0, amount).when(amount.isNotNull(), 0)).alias("in")
    )
    cast = lambda c: F.col(c).cast("decimal(18,2)")
    return agg.select(*keys, F.array_distinct(F.filter(F.concat(F.col("each").cast("array<decimal(18,2)>"), F.array(cast("net"), cast("out"), cast("in"))), lambda x: x.isNotNull())).alias("allowed"))


def unverified(answer: Column, allowed: Column) -> Column:
    """Dollar figures of an answer that no cited record accounts for; repeats stay."""
    return F.filter(tx.figures(answer), lambda f: ~F.array_contains(F.coalesce(allowed, F.array().cast("array<decimal(18,2)>")), f))


def latest_source(calls: DataFrame, *keys: str) -> DataFrame:
    """The latest successful call that returned or looked up an id."""
    return calls.where(F.col("status") == "ok").groupBy(*keys).agg(F.max_by(F.struct(*calls.columns), F.col("i")).alias("call"))


def _inner(value: Column) -> Column:
    """True of objects and lists. Casts that leave the contents out: the schema of a variant walks all of them."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull() | F.try_variant_get(value, "$", "array<struct<>>").isNotNull()


def _cites(ids: Column, value: Column) -> Column:
    """True of objects with a scalar that equals one of the ids."""
    members = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.coalesce(F.exists(members, lambda v: F.array_contains(ids, F.when(~_inner(v), F.try_variant_get(v, "$", "string")))), F.lit(False))


def _opened(level: DataFrame) -> DataFrame:
    """Each object or list (``_v``) as its elements; scalars (``_text``) stay as they are. ``record``: of an object or list its own path, of a scalar that of its object.

    With ``_ids``, only scalars of objects that cite one of them are listed.
    """
    spark = level.sparkSession
    kept = [c for c in level.columns if c == "_ids"]
    if kept:
        level = level.withColumn("_cites", _cites(F.col("_ids"), F.col("_v")))
    parts = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer())).drop("_v")
    path = F.when(F.col("key").isNotNull(), F.concat("record", F.lit("."), "key")).otherwise(F.concat("record", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    old = F.col("pos").isNull()
    parts = parts.withColumn("inner", _inner(F.col("value")))
    if kept:
        parts = parts.where(F.col("inner") | F.col("_cites") | (old & F.col("_text").isNotNull()))
    return parts.select(
        "_key",
        *kept,
        F.when(F.col("inner"), path).otherwise(F.col("record")).alias("record"),
        F.when(old, F.col("_name")).otherwise(F.col("key")).alias("_name"),
        F.when(old, F.col("_text")).when(~F.col("inner") & F.col("key").isNotNull(), F.variant_get("value", "$", "string")).alias("_text"),
        F.when(F.col("inner"), F.col("value")).alias("_v"),
    )


def flatten_json(results: DataFrame, key: str, data: str, cited: DataFrame | None = None) -> DataFrame:
    """Scalar fields of nested tool results as (key, record, name, value): of every object at any depth, ``record`` being its path.

    LEVELS levels at a time: a variant is exploded into its elements, scalars of objects are fields, objects and lists go on to the next level. Only what these levels
    give is written, and what lies deeper is opened in further rounds until none is left. Texts that aren't JSON, and null values, give nothing.

    With ``cited`` (key, id), only the records in which any field equals an id cited for their result: objects are judged before they are opened, so the fields of
    others are never listed. The distinct ids of a result are held in its row.
    """
    none = F.lit(None).cast("string")
    kept = []
    if cited is not None:
        results, kept = results.join(cited.groupBy(key).agg(F.collect_set(F.col("id").cast("string")).alias("_ids")), key), ["_ids"]
    level = results.select(F.col(key).alias("_key"), *kept, F.lit("$").alias("record"), none.alias("_name"), none.alias("_text"), F.try_parse_json(F.col(data)).alias("_v"))
    out = None
    while True:
        for _ in range(LEVELS):
            level = _opened(level)
        deep = F.col("_v").isNotNull()
        level = level.withColumns({c: F.when(deep, F.col(c)) for c in kept})  # of no more use to fields
        level = materialize(level.withColumn("_deep", deep), "json-levels")
        found = level.where(F.col("_text").isNotNull()).select(F.col("_key").alias(key), "record", F.col("_name").alias("name"), F.col("_text").alias("value"))
        out = found if out is None else out.unionByName(found)
        level = level.where("_deep").select("_key", *kept, "record", none.alias("_name"), none.alias("_text"), "_v")
        if not level.limit(1).count():
            return out
