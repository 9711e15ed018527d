"""Queries over nested results, constraints and streams, each beside its SQL in ``TRAIL_SQL``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import cleaning, constraints, records
from corpusloom.plans import tables as t
from corpusloom.plans.sql import SQL, _norm
from corpusloom.storage import shared_dir
from corpusloom.streaming import sinks


def _results(spark, sf_dir):
    """Orders as tool results in JSON: the owner's balance two levels below, taxes of lines three."""
    text = lambda c: c.cast("decimal(12,2)").cast("string")
    line = lambda x: F.struct(F.concat(F.lit("P"), x["l_partkey"].cast("string")).alias("part"), text(x["l_extendedprice"]).alias("amount"), F.array(F.struct(text(x["l_tax"]).alias("amount"))).alias("taxes"))
    # numbers are gathered, and made texts in the order's row: nested texts cost more to move
    lines = t.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_tax")).alias("lines"))
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    j = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    lines = F.sort_array(F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), line(x).alias("line"))))
    owner = F.struct(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("id"), F.struct(text(F.col("o_totalprice")).alias("amount"), F.when(F.col("o_orderstatus") == "F", "final").alias("note")).alias("balance"))
    data = F.to_json(F.struct(F.col("o_orderkey").alias("id"), owner.alias("owner"), F.transform(lines, lambda x: x["line"]).alias("lines")))
    return j.select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 50 == 0, "not json").otherwise(data).alias("data"))


def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of orders as nested results, with the path of its record."""
    return records.flatten_json(_results(spark, sf_dir), "call_id", "data")


def nested_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the records, at any depth, that hold the part of the order's first line."""
    asked = t.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("call_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("id"))
    return records.flatten_json(_results(spark, sf_dir), "call_id", "data", asked)


def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with planted breaks: unknown states, lost and unknown customers, negative prices, repeated keys; and customers without orders."""
    k = F.col("o_orderkey")
    o = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    o = o.withColumn("o_orderstatus", F.when(k % 101 == 0, "?").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(k % 113 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")))
    o = o.withColumn("o_custkey", F.when(k % 103 == 0, None).when(k % 107 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")))
    o = o.unionByName(o.where(k % 109 == 0))
    customers = t.table(spark, sf_dir, "customer").select("c_custkey")
    checks = {"status": F.col("o_orderstatus").isin("F", "O", "P"), "customer": F.col("o_custkey").isNotNull(), "price": F.col("o_totalprice") >= 0}
    found = constraints.audit(
        constraints.broken(o, checks, "o_orderkey"),
        constraints.repeated(o, "unique order", "o_orderkey"),
        constraints.dangling(o, "known customer", "o_custkey", "o_orderkey", customers, "c_custkey"),
        constraints.childless(customers, "has orders", "c_custkey", o, "o_custkey"),
    )
    return found.groupBy("rule", "id").agg(F.count(F.lit(1)).alias("n"))


def streamed_budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user that a cap would have stopped, from a stream of files into a table."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    calls = t.calls(spark, sf_dir).select("call_id", "correlation_id", "ts", "cost_usd")
    calls.repartition(4, "correlation_id").write.parquet(f"{root}/in")  # a user's calls come in one file
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    guarded = sinks.budget_guard(stream, 500.0, "correlation_id")
    sinks.append_once(guarded, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return sinks.appended(spark, f"{root}/out", "call_id long, correlation_id long, spent_before double, stopped boolean").drop("batch")


def mail_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as mails, with quoted lines, header lines and blank lines by the lengths of their lines: the paragraphs that are left."""
    n, line = F.length, lambda x: F.when(F.length(x) % 7 == 0, F.concat(F.lit("Subject: "), x)).when(F.length(x) % 3 == 0, F.concat(F.lit("> "), x)).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(n(x) % 4 == 0, F.concat(line(x), F.lit("\n"))).otherwise(line(x))), "\n")
    mails = t.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.lit("paragraph").alias("type"), text.alias("text"))
    return cleaning.clean_email(mails).select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2("text", 256).alias("sha256"))


def repaired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with planted deletions, wrongly decoded words and odd spaces, as cleaning leaves them."""
    lines = t.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("type", F.lit("paragraph"))
    k = F.col("pos") % 4
    planted = F.when(k == 1, F.concat("text", F.lit(" [DELETED: old]"))).when(k == 2, F.concat("text", F.lit("  ñcafÃ© â€œnaÃ¯veâ€\u009d"))).when(k == 3, F.concat(F.lit("\t"), "text", F.lit("\u00a0 end\r\n"))).otherwise(F.col("text"))
    out = cleaning.fix_blocks(lines.withColumn("text", planted))
    return out.select("doc_id", "pos", F.sha2("text", 256).alias("sha256"))


_NESTED = """
made AS (SELECT o_orderkey AS call_id, json_object('id', o_orderkey, 'owner', json_object('id', 'C' || o_custkey, 'balance',
    CASE WHEN o_orderstatus = 'F' THEN json_object('amount', cast(cast(o_totalprice AS DECIMAL(12,2)) AS VARCHAR), 'note', 'final') ELSE json_object('amount', cast(cast(o_totalprice AS DECIMAL(12,2)) AS VARCHAR)) END),
    'lines', to_json(list(json_object('part', 'P' || l_partkey, 'amount', cast(cast(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), 'taxes', json_array(json_object('amount', cast(cast(l_tax AS DECIMAL(12,2)) AS VARCHAR)))) ORDER BY l_linenumber, 'P' || l_partkey, cast(cast(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), cast(cast(l_tax AS DECIMAL(12,2)) AS VARCHAR)))) AS data
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 50 <> 0 GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice),
fields AS (SELECT call_id, path AS record, key AS name, json_extract_string(value, '$') AS value FROM made, json_tree(made.data) WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND fullkey NOT LIKE '%]')
"""

TRAIL_SQL: dict[str, str] = {
    "nested_fields": f"WITH {_NESTED} SELECT call_id, record, name, value FROM fields",
    "nested_cited": f"""WITH {_NESTED}, asked AS (SELECT l_orderkey AS call_id, 'P' || l_partkey AS value FROM lineitem WHERE l_linenumber = 1), hit AS (SELECT DISTINCT call_id, record FROM fields SEMI JOIN asked USING (call_id, value))
      SELECT call_id, record, name, value FROM fields SEMI JOIN hit USING (call_id, record)""",
    "broken_rules": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 107 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS c, CASE WHEN o_orderkey % 101 = 0 THEN '?' ELSE o_orderstatus END AS s,
        CASE WHEN o_orderkey % 113 = 0 THEN -o_totalprice ELSE o_totalprice END AS p FROM orders), every AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE k % 109 = 0),
      found AS (SELECT 'status' AS rule, k AS id FROM every WHERE s NOT IN ('F', 'O', 'P') UNION ALL SELECT 'customer', k FROM every WHERE c IS NULL UNION ALL SELECT 'price', k FROM every WHERE p < 0
        UNION ALL SELECT 'unique order', k FROM every GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'known customer', k FROM every WHERE c NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'has orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c FROM every WHERE c IS NOT NULL))
      SELECT rule, cast(id AS VARCHAR) AS id, count(*) AS n FROM found GROUP BY ALL""",
    "mail_paragraphs": rf"""WITH m AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) % 7 = 0 THEN 'Subject: ' || x WHEN length(x) % 3 = 0 THEN '> ' || x ELSE x END || CASE WHEN length(x) % 4 = 0 THEN chr(10) ELSE '' END), chr(10)) AS t FROM documents WHERE text IS NOT NULL),
      own AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s*(>\s?)+', '')), lambda x: NOT regexp_matches(trim(x), '(?i)^(From|Sent|To|Cc|Subject):.*$') AND NOT starts_with(trim(x), 'CONFIDENTIALITY NOTICE')), chr(10)) AS t FROM m),
      cut AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\n\s*\n')) AS p, generate_subscripts(regexp_split_to_array(t, '\n\s*\n'), 1) AS part FROM own),
      para AS (SELECT doc_id, part, array_to_string(list_filter(string_split(p, chr(10)), lambda x: trim(x) <> ''), chr(10)) AS p FROM cut),
      kept AS (SELECT doc_id, part, p FROM para WHERE p <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, {_norm('p')} ORDER BY part) = 1)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS pos, sha256(p) AS sha256 FROM kept""",
    "repaired_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
      r AS (SELECT doc_id, pos, CASE pos % 4 WHEN 2 THEN x || ' ñcafé “naïve”' WHEN 3 THEN x || ' end' ELSE x END AS x FROM l),
      c AS (SELECT doc_id, pos, trim(regexp_replace(translate(x, chr(9) || chr(160) || chr(8239), '   '), ' {2,}', ' ', 'g')) AS x FROM r)
      SELECT doc_id, cast(pos AS INT) AS pos, sha256(x) AS sha256 FROM c WHERE x <> ''""",
    "streamed_budget_guard": SQL["budget_guard"],
}
