"""Queries of hybrid search, personal data, contracts, audits and gradings over the driver's tables, each beside its SQL in ``CONTROL_SQL``.

Events stand for calls, rounds and answers: a number in their props (0 to 99) sets what they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import params
from corpusloom.operators import calls as ca
from corpusloom.operators import conversation, filters, metrics, pii, retrieval, validation
from corpusloom.plans import tables as t
from corpusloom.plans.evaluations import _E, _events, _pick
from corpusloom.plans.queries import _docs, _index, _label_hits, _vector_hits
from corpusloom.plans.sql import _BM25, _CATALOG, _FORMATS, _LAB, _REDACTED, _VEC
from corpusloom.storage import spread


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents that a retail reader may see, by words and by vectors, with their citations. A vector has its document's (or benchmark text's) id."""
    docs = t.catalogued_documents(spark, sf_dir)
    vectors = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = t.table(spark, sf_dir, "benchmark").join(vectors.withColumnRenamed("doc_id", "item_id"), "item_id").select(F.col("item_id").alias("query_id"), "text", "embedding")
    hits = retrieval.search(docs, vectors, asked, keep=filters.where(filters.access("retail")), index=_index(spark, sf_dir))
    n = F.col("doc_id")
    named = retrieval.citation(F.concat(F.lit("Doc "), n.cast("string")), F.when(n % 2 == 0, "3.0").otherwise(""), n % 4, n % 4 + n % 3, F.lit("Rates > Fees"))
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"), named.alias("citation"))


def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 30 fused hits in the order of another score."""
    n = params.RETRIEVAL["candidates"]
    fused = retrieval.rrf(_vector_hits(spark, sf_dir, n), _label_hits(spark, sf_dir, n), item="vec_id")
    out = retrieval.rerank(fused, lambda hits: hits.withColumn("score", (-F.abs(F.col("vec_id") - 2 * F.col("query_id"))).cast("double")), item="vec_id")
    return out.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def over_limit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than 512 words by language."""
    return retrieval.over_limit(_docs(spark, sf_dir), 512, "lang")


def stage_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and high latency by run and kind of event."""
    timings = _events(spark, sf_dir).select((F.col("user_id") % 5).alias("row"), F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return metrics.latency(timings, "row", "stage")


def _scrubbed(spark, sf_dir):
    return pii.scrub(spread(_docs(spark, sf_dir).select("doc_id", "text")))


def pii_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions of each kind in each document, from their log."""
    return pii.counts(_scrubbed(spark, sf_dir))


def _first_words(docs):
    return docs.select("doc_id", F.lit("START").alias("pii_type"), F.substring("text", 1, 12).alias("value"))


def pii_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted values that are still there: each document's first e-mail address and its first twelve characters."""
    docs = _docs(spark, sf_dir)
    mail = docs.select("doc_id", F.lit("EMAIL").alias("pii_type"), F.regexp_extract("text", pii.PATTERNS["EMAIL"][0], 0).alias("value"))
    return pii.leaked(mail.unionByName(_first_words(docs)).where("value <> ''"), _scrubbed(spark, sf_dir))


def pii_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redactions by document and kind that an inventory, of first e-mail addresses of one host, doesn't hold."""
    listed = _docs(spark, sf_dir).select(F.regexp_extract("text", pii.PATTERNS["EMAIL"][0], 0).alias("value")).where("value LIKE '%@mail1.%'")
    found = pii.false_positives(listed, _scrubbed(spark, sf_dir))
    return found.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def claim_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which stage events, as a model's claim answers, fail."""
    k = F.col("k") % 7
    good = '{"loss_date": "2024-01-02", "peril": "fire", "estimated_severity": "minor", "coverage_flag": true}'
    text = F.when(k == 0, " ").when(k == 1, "not json").when(k == 2, good.replace("fire", "meteor")).otherwise(good)
    tool = F.when(k == 3, F.lit(None)).when(k == 4, "other").otherwise("lookup")
    asked = F.when(k == 5, '{"policy_number": "POL-1", "peril": "fire"}').otherwise('{"policy_number": "POL-000001", "peril": "fire"}')
    return _events(spark, sf_dir).select("event_id", validation.claim_stage(text, tool, asked, "lookup").alias("stage"))


def action_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with events as planner actions."""
    k = F.col("k") % 7
    tools = spark.createDataFrame([("read", ["id"])], "tool string, required array<string>")
    actions = _events(spark, sf_dir).select(
        "event_id",
        F.when(k < 4, "call_tool").when(k < 6, "terminate").otherwise("dance").alias("action"),
        F.when(k == 1, "zap").when(k < 4, "read").alias("tool"),
        F.when(k.isin(0, 1), F.create_map(F.lit("id"), F.lit("1"))).when(k == 3, F.create_map(F.lit("x"), F.lit("1"))).alias("args"),
        F.when(k == 4, "maybe").when(k == 5, "approve").alias("decision"),
        F.lit(None).cast("string").alias("reasoning"),
    )
    return validation.action_error(actions, tools, ("approve", "deny")).select("event_id", "error")


def turn_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with events as conversation decisions."""
    k = F.col("k") % 6
    tools = spark.createDataFrame([("balance", "account"), ("rates", "all")], "tool string, scope string")
    turns = _events(spark, sf_dir).select(
        "event_id",
        F.when(k < 2, "answer_directly").when(k < 5, "call_tool").otherwise("dance").alias("action"),
        F.when(k == 2, "zap").when(k == 3, "balance").when(k == 4, "rates").alias("tool"),
        F.lit("nowhere").alias("account_reference"),
        F.when(k != 1, "because").alias("reasoning"),
    )
    return validation.turn_error(turns, tools, ("explicit", "last", "other")).select("event_id", "error")


def caption_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to events as figures, and whether they, as observations, have a result or an error but not both."""
    k = F.col("k")
    act = validation.caption_action(_pick(k, "public", "public", "restricted"), _pick(k, "Figure 1", "", None, "Figure 2"), _pick(k, "a.png", "b.png", "c.png", "d.png", None))
    one = validation.exactly_one(_pick(k, "found", None), _pick(k, None, "timeout", "timeout"))
    return _events(spark, sf_dir).select("event_id", act.alias("act"), one.alias("valid"))


def round_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of events as answers that cite chunks they were given, or others, or none."""
    k = F.col("k")
    cited = F.when(k % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 3))
    kept = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return _events(spark, sf_dir).select("event_id", conversation.round_verdict(_pick(k, "answered", "answered", "answered", "not_in_corpus", "refused"), cited, kept).alias("verdict"))


def _tool_calls(spark, sf_dir):
    e = _events(spark, sf_dir)
    args = F.create_map(F.when(F.col("event_id") % 5 == 0, "extra").otherwise("k"), F.col("k").cast("string"))
    made = e.select(F.col("event_id").alias("call_id"), (F.col("user_id") % 2).cast("string").alias("caller"), F.col("event_type").alias("tool"), args.alias("arguments"), F.lit(None).cast("string").alias("run_outcome"))
    grants = spark.createDataFrame([("0", "view"), ("0", "click"), ("1", "view"), ("1", "signup")], "caller string, tool string")
    tools = spark.createDataFrame([(x, ["k"], ["k"]) for x in ("view", "click")], "tool string, declared array<string>, required array<string>")
    return made, grants, tools


def redacted_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of calls as the audit keeps them: values of undeclared ones are hidden."""
    pairs = F.transform(F.map_entries("arguments"), lambda a: F.concat_ws("=", a["key"], a["value"]))
    return filters.enforce(*_tool_calls(spark, sf_dir)).select("call_id", F.array_join(pairs, ",").alias("kept"))


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on calls, and errors as requests without a valid token."""
    made, grants, tools = _tool_calls(spark, sf_dir)
    return filters.audit(filters.enforce(made.where("tool <> 'error'"), grants, tools), made.where("tool = 'error'"))


def visible_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events, as tools, that a client's list lets it see."""
    return filters.visible_tools(_events(spark, sf_dir).select(F.col("event_type").alias("tool")).distinct(), ["click", "signup", "view"])


def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's answers by stated labels and by relabels; those that need a tool nobody advertises don't count."""
    k = F.col("k")
    e = _events(spark, sf_dir)
    actual = F.when(k % 8 == 0, "tools").when(k % 9 == 0, "direct").otherwise(_pick(k, "search", "direct"))
    items = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("set"), _pick(k, "search", "direct").alias("expected"), actual.alias("actual"))
    relabels = e.where("k % 4 = 0").select(F.col("event_id").alias("id"), F.lit("tools").alias("expected"), F.when(F.col("event_id") % 2 == 0, "read").otherwise("gone").alias("requires_tool"))
    return ca.gate_scores(items, relabels, spark.createDataFrame([("read",)], "tool string"), "set")


def grade_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of events that a second grading changes."""
    e = _events(spark, sf_dir)
    old = e.select("event_id", _pick(F.col("k"), "correct", "incorrect", None).alias("verdict"))
    new = e.select("event_id", _pick(F.col("k") + F.when(F.col("user_id") % 10 == 0, 1).otherwise(0), "correct", "incorrect", None).alias("verdict"))
    return ca.grade_changes(old, new, "event_id", "verdict")


def calls_without_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every ninth user, whose interaction wasn't recorded, or only as an empty name."""
    named = t.calls(spark, sf_dir).withColumn("correlation_id", F.when(F.col("correlation_id") % 9 == 0, _pick(F.col("input_tokens"), None, "")).otherwise(F.col("correlation_id").cast("string")))
    return ca.without_interaction(named).groupBy("purpose").agg(F.count(F.lit(1)).alias("n"))


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the judge is asked about events as answers."""
    rows = _events(spark, sf_dir).select("event_id", "event_type", "props", _pick(F.col("k"), "answered", "answered", "not_in_corpus").alias("outcome_expected"), _pick(F.col("k"), "answered", "error").alias("outcome"))
    return ca.to_judge(rows, "event_id", "event_type", "props")


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of the latest day on which there were any."""
    rows = _events(spark, sf_dir).select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("run_id"))
    return ca.latest_run(rows, "run_id", "user_id").select("event_id", "user_id", "run_id")


def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a kind as attempts at one call, of which few succeed."""
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    good = F.col("value") > 60
    tries = _events(spark, sf_dir).select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("call_id"),
        n.alias("attempt"),
        F.when(good, F.col("event_id")).alias("result"),
        F.when(~good, F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"),
    )
    return conversation.observations(tries).withColumn("attempts", F.col("attempts").cast("long"))


def turn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four turns before each turn, as the next prompt shows them."""
    c = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")
    return conversation.history(c, 4).select("session_id", "turn", F.sha2("history", 256).alias("sha256"), F.length("history").cast("long").alias("n_chars"))


def attempt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first events as the planner's account of its rounds."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rounds = _events(spark, sf_dir).select(F.col("user_id").alias("correlation_id"), n.alias("n"), F.col("event_type").alias("query"), _pick(F.col("k"), "poor", "declined", "answered").alias("verdict"))
    return conversation.attempts_text(rounds)


_KINDS = ", ".join(f"'{k}'" for k in sorted([*_FORMATS, "DOB"]))
_LOG = rf"r AS (SELECT doc_id, text, {_REDACTED} AS t FROM documents), log AS (SELECT doc_id, kind, (length(t) - length(replace(t, '[REDACTED-' || kind || ']', ''))) // (length(kind) + 11) AS n FROM r, (SELECT unnest([{_KINDS}]) AS kind))"
_TOOL_CALLS = f"""
{_E}, c AS (SELECT event_id AS call_id, cast(user_id % 2 AS VARCHAR) AS caller, event_type AS tool, event_id % 5 = 0 AS extra, k,
  event_type = 'view' OR (user_id % 2 = 0 AND event_type = 'click') OR (user_id % 2 = 1 AND event_type = 'signup') AS granted FROM e)
"""

CONTROL_SQL: dict[str, str] = {
    "hybrid_search": f"""WITH {_BM25}, {_CATALOG}, ok AS (SELECT doc_id FROM catalog WHERE tenant = 'retail' AND sensitivity <> 'restricted' AND is_current),
      lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores SEMI JOIN ok USING (doc_id) WHERE score > 0 AND query_id IN (SELECT vec_id FROM embeddings)),
      {_VEC.split('sim AS')[0]} near AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM ok)),
      vec AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near),
      fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM lex WHERE rank <= 50 UNION ALL SELECT * FROM vec WHERE rank <= 50) GROUP BY ALL),
      top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)
      SELECT *, 'Doc ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ', 3.0' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 3 = 0 THEN ', p.' || (doc_id % 4) ELSE ', p.' || (doc_id % 4) || '-' || (doc_id % 4 + doc_id % 3) END || ', Fees' AS citation FROM top WHERE rank <= 10""",
    "reranked_hits": f"""WITH {_VEC}, {_LAB}, fused AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM
      (SELECT query_id, vec_id, rank FROM vtop WHERE rank <= 50 UNION ALL SELECT query_id, vec_id, rank FROM ltop WHERE rank <= 50) GROUP BY ALL),
      best AS (SELECT query_id, vec_id, cast(-abs(vec_id - 2 * query_id) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS p FROM fused) WHERE p <= 30)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM best""",
    "over_limit_texts": r"SELECT lang, count(*) AS texts, count(*) FILTER (len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) > 512) AS over FROM documents GROUP BY lang",
    "stage_latency": 'SELECT user_id % 5 AS "row", event_type AS stage, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY ALL',
    "pii_type_counts": f"WITH {_LOG} SELECT doc_id, lower(kind) AS type, n FROM log WHERE n > 0",
    "pii_leaked": f"""WITH {_LOG}, i AS (SELECT doc_id, 'EMAIL' AS pii_type, regexp_extract(text, '{_FORMATS['EMAIL']}') AS value FROM documents UNION ALL SELECT doc_id, 'START', substr(text, 1, 12) FROM documents)
      SELECT doc_id, pii_type, value FROM i JOIN r USING (doc_id) WHERE value <> '' AND contains(t, value)""",
    "pii_false_positives": f"""WITH {_LOG}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_FORMATS['EMAIL']}')) AS value FROM documents), i AS (SELECT DISTINCT regexp_extract(text, '{_FORMATS['EMAIL']}') AS value FROM documents)
      SELECT doc_id, kind AS type, n FROM log WHERE n > 0 AND kind <> 'EMAIL' UNION ALL SELECT doc_id, 'EMAIL', count(*) FROM m WHERE value NOT IN (SELECT value FROM i WHERE value LIKE '%@mail1.%') GROUP BY doc_id""",
    "claim_stages": f"WITH {_E} SELECT event_id, CASE k % 7 WHEN 0 THEN 'no_text_block' WHEN 1 THEN 'json_parse' WHEN 2 THEN 'claim_schema' WHEN 3 THEN 'no_tool_call' WHEN 4 THEN 'wrong_tool_name' WHEN 5 THEN 'tool_schema' END AS stage FROM e",
    "action_errors": f"WITH {_E} SELECT event_id, CASE k % 7 WHEN 1 THEN 'unregistered tool' WHEN 2 THEN 'missing args' WHEN 3 THEN 'missing required args' WHEN 4 THEN 'invalid decision' WHEN 5 THEN 'missing reasoning' WHEN 6 THEN 'unknown action' END AS error FROM e",
    "turn_errors": f"WITH {_E} SELECT event_id, CASE k % 6 WHEN 1 THEN 'missing reasoning' WHEN 2 THEN 'unregistered tool' WHEN 3 THEN 'invalid account_reference' WHEN 5 THEN 'unknown action' END AS error FROM e",
    "caption_actions": f"""WITH {_E} SELECT event_id, CASE WHEN k % 3 = 2 THEN 'placeholder' WHEN k % 4 IN (1, 2) OR k % 5 = 4 THEN 'skip' ELSE 'caption' END AS act, (k % 2 = 0) <> (k % 3 <> 0) AS valid FROM e""",
    "round_verdicts": f"WITH {_E} SELECT event_id, CASE WHEN k % 5 < 3 THEN CASE WHEN k % 7 <> 0 AND k % 3 < 2 THEN 'answered' ELSE 'ungrounded' END WHEN k % 5 = 3 THEN 'declined' ELSE 'error' END AS verdict FROM e",
    "redacted_arguments": f"WITH {_TOOL_CALLS} SELECT call_id, CASE WHEN extra AND tool IN ('view', 'click') THEN 'extra=[REDACTED]' WHEN extra THEN 'extra=' || k ELSE 'k=' || k END AS kept FROM c",
    "audit_trail": f"""WITH {_TOOL_CALLS}, o AS (SELECT *, CASE WHEN tool = 'error' THEN 'unauthenticated' WHEN NOT granted THEN 'forbidden' WHEN tool = 'signup' OR extra THEN 'invalid_arguments' ELSE 'ok' END AS outcome FROM c)
      SELECT call_id, caller, CASE WHEN tool = 'error' THEN 'transport' ELSE 'authorization' END AS source, CASE WHEN outcome = 'ok' THEN 'allowed' ELSE 'denied' END AS decision, outcome FROM o""",
    "visible_tools": "SELECT DISTINCT event_type AS tool FROM events WHERE event_type IN ('click', 'signup', 'view')",
    "gate_scores": f"""WITH {_E}, g AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'search' ELSE 'direct' END AS stated, k % 4 = 0 AND event_id % 2 = 0 AS moved, CASE WHEN k % 8 = 0 THEN 'tools' WHEN k % 9 = 0 OR k % 2 = 1 THEN 'direct' ELSE 'search' END AS actual FROM e)
      SELECT user_id % 3 AS "set", count(*) AS n, count(*) FILTER (actual = stated) AS raw, count(*) FILTER (actual = CASE WHEN moved THEN 'tools' ELSE stated END) AS "right", count(*) FILTER (moved) AS relabelled FROM g GROUP BY 1""",
    "grade_changes": f"""WITH {_E}, g AS (SELECT ['correct', 'incorrect', 'none'][k % 3 + 1] AS a, ['correct', 'incorrect', 'none'][(k + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS b FROM e) SELECT a || '->' || b AS change, count(*) AS n FROM g WHERE a <> b GROUP BY 1""",
    "calls_without_interaction": "SELECT event_type AS purpose, count(*) AS n FROM events WHERE user_id % 9 = 0 GROUP BY 1",
    "judge_requests": f"WITH {_E} SELECT event_id, 'Question:' || chr(10) || event_type || chr(10) || chr(10) || 'Answer:' || chr(10) || props AS request FROM e WHERE k % 3 < 2 AND k % 2 = 0",
    "latest_runs": "WITH d AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS run_id FROM events) SELECT event_id, user_id, run_id FROM d WHERE (user_id, run_id) IN (SELECT (user_id, max(run_id)) FROM d GROUP BY user_id)",
    "retried_calls": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events), f AS (SELECT user_id || '/' || event_type AS call_id, min(n) FILTER (value > 60) AS good, max(n) AS tried, arg_min(event_id, n) FILTER (value > 60) AS result, max(event_id) AS last FROM a WHERE n <= 3 GROUP BY user_id, event_type)
      SELECT call_id, coalesce(good, tried) AS attempts, result, CASE WHEN good IS NULL THEN 'failed at ' || last END AS error FROM f""",
    "turn_history": """WITH h AS (SELECT conv_id AS session_id, turn, coalesce(array_to_string(list(role || ': ' || coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history FROM conversations)
      SELECT session_id, turn, sha256(history) AS sha256, length(history) AS n_chars FROM h""",
    "attempt_texts": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e)
      SELECT user_id AS correlation_id, string_agg('Round ' || n || ': ' || event_type || ' [' || ['poor', 'declined', 'answered'][k % 3 + 1] || ']', chr(10) ORDER BY n) AS attempts FROM r WHERE n <= 3 GROUP BY user_id""",
}
