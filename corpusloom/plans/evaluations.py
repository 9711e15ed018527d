"""Queries that grade answers, decisions, tool calls and runs over the driver's tables, each beside its SQL in ``EVALUATION_SQL``.

Events stand for graded interactions: a number in their props (0 to 99) sets what was expected and what came out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import calls as ca
from corpusloom.operators import cleaning, conversation, filters, metrics, records
from corpusloom.plans import tables as t
from corpusloom.plans.queries import _docs, _dollars, _questions, recall_precision
from corpusloom.plans.sql import _CALLS, _EMPTY, _ROLLUP, _SCORED, _norm
from corpusloom.storage import spread


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def _pick(value: Column, *options: str | None) -> Column:
    """An option by the value modulo their number."""
    return F.element_at(F.array(*[F.lit(o).cast("string") for o in options]), (value % len(options) + 1).cast("int"))


def token_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which every token of a benchmark text occurs."""
    return metrics.token_hits(spread(_docs(spark, sf_dir).select("doc_id", "text")), _questions(spark, sf_dir).select(F.col("query_id").alias("quote_id"), F.col("text").alias("quote")))


def _graded(spark, sf_dir):
    k = F.col("k")
    expected = F.when(F.col("event_type").isin("view", "click"), "answered").when(F.col("event_type") == "purchase", "not_in_corpus").otherwise("answered_direct")
    e = _events(spark, sf_dir).withColumn("outcome_expected", expected)
    e = e.withColumn("outcome", F.when(k % 8 == 0, "not_in_corpus").when(k % 8 == 1, "answered_direct").otherwise(F.col("outcome_expected")))
    line = F.when(k % 10 == 7, "Source: other").when(F.col("outcome") == "answered", "Source: Fees (version 3.0)").when(F.col("outcome") == "answered_direct", "Source: general").otherwise("Source: none found")
    tenant = F.when(F.col("user_id") % 7 == 0, "business").otherwise("retail")
    rows = e.select(
        "event_id",
        (F.col("user_id") % 5).alias("run"),
        _pick(k, "search", "direct").alias("gate_expected"),
        F.when(k % 9 == 0, "direct").otherwise(_pick(k, "search", "direct")).alias("gate_actual"),
        "outcome_expected",
        "outcome",
        (k % 3).cast("int").alias("rounds"),
        line.alias("source_line"),
        F.when(k % 13 == 0, "cut").otherwise(F.concat(F.lit("By version 3.0.\n\n"), line)).alias("reply"),
        F.array(F.struct(k.alias("doc_id"), tenant.alias("tenant"), F.when(k % 17 == 0, "restricted").otherwise("public").alias("sensitivity"))).alias("citations"),
        F.lit("retail").alias("tenant"),
        (k % 5 != 0).alias("citation_hit"),
        _pick(k, None, "incorrect", "correct", "correct", "correct", "correct").alias("judge_verdict"),
        F.when(k % 2 == 0, F.array(F.lit("declined"), F.lit("answered"))).otherwise(F.array(F.lit("answered"))).alias("round_verdicts"),
        (k % 8 == 3).alias("rewrite_helped"),
        (k % 11 == 3).alias("rescued_after_decline"),
        F.col("value").cast(ca.USD).alias("cost_usd"),
    )
    return ca.graded(rows)


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and counts of graded interactions by run."""
    return ca.quality_summary(_graded(spark, sf_dir), "run")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same interactions by run, each run at its own threshold."""
    return _dollars(ca.sweep(_graded(spark, sf_dir).withColumn("tau", 0.25 + F.col("run") / 8), "tau"), "cost_mean")


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success, cost and latency by purpose."""
    rows = t.calls(spark, sf_dir).withColumn("task_success", F.col("input_tokens") % 3 == 0)
    return _dollars(ca.model_comparison(rows, "purpose"), "cost_total", "cost_per_success")


def calibration_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for a second judge: all that weren't judged correct, and evenly spaced correct ones up to 500 a purpose (the report's size)."""
    judged = _events(spark, sf_dir).select(F.col("event_id").alias("call_id"), F.col("event_type").alias("purpose"), F.when(F.col("k") % 7 == 0, "incorrect").otherwise("correct").alias("judge_verdict"))
    return ca.calibration_sample(judged, 500, "purpose", "call_id")


def _tool_rows(spark, sf_dir):
    k = F.col("k")
    card = F.concat(F.lit("CARD-"), F.lpad(k.cast("string"), 4, "0"))
    source = F.when(k % 4 == 0, "Source: general").when(k % 4 == 1, "none").otherwise("Source: record ACC-0001")
    return spread(_events(spark, sf_dir).select("event_id", "event_type", "k")).select(
        "event_id",
        F.concat(F.lit("Card "), card, F.lit(" is frozen, fee $1,"), k.cast("string"), F.lit(".\n\n"), source).alias("reply"),
        F.when(k % 3 == 0, F.array(F.lit("ACC-0001"))).otherwise(F.array(F.lit("ACC-0001"), card)).alias("known_ids"),
        _pick(k, "tools", "search").alias("gate_expected"),
        F.when(k % 9 == 0, "tools").otherwise(_pick(k, "tools", "search")).alias("gate_actual"),
        F.array(F.lit("read")).alias("tools_expected"),
        F.when(k % 5 == 0, F.array("event_type")).otherwise(F.array(F.col("event_type"), F.lit("read"))).alias("tools_called"),
        F.array(F.lit("answered_from_records"), F.lit("answered")).alias("outcomes_expected"),
        F.when(k % 2 == 0, "answered_from_records").when(k % 7 == 0, "declined").otherwise("answered").alias("outcome"),
        F.array(F.lit("blocked|FROZEN"), F.concat(F.lit("fee $1"), (k % 50).cast("string"))).alias("facts"),
        F.array(F.lit("fee 17")).alias("must_not"),
        F.when(k % 11 == 0, F.array(F.lit("freeze_card"))).otherwise(F.array(F.lit("read"))).alias("tools_ok"),
    )


def tool_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed checks and invented ids of every tool question."""
    out = ca.tool_grades(_tool_rows(spark, sf_dir))
    return out.select("event_id", "passed", F.array_join("failed", ",").alias("failed"), F.array_join("invented_ids", ",").alias("invented"))


def check_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tool questions pass each check."""
    return ca.check_rates(ca.tool_grades(_tool_rows(spark, sf_dir)))


def decision_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning decisions against those that the quality labels ask for; every tenth should name the copy it follows."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    tenth = F.col("doc_id") % 10 == 0
    expected = t.table(spark, sf_dir, "labels").select(
        name.alias("filename"),
        F.when(F.col("quality") == 1, "cleaned").otherwise("dropped").alias("expected_status"),
        F.when(tenth, "Duplicate of another").alias("expected_reason"),
        F.when(tenth, "placeholder").alias("expected_canonical"),
        F.lit("txt").alias("expected_format"),
        F.lit("naive").alias("parser"),
    )
    actual = cleaning.near_empty(_docs(spark, sf_dir)).select(name.alias("filename"), "status", "reason")
    return metrics.decision_grades(expected, actual)


def row_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line, spaced out, and its last one, changed for odd ids, looked up among its lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = _docs(spark, sf_dir)
    last = F.concat(F.element_at(lines, -1), F.when(F.col("doc_id") % 2 == 1, " (changed)").otherwise(""))
    want = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("  "), F.element_at(lines, 1)), last)).alias("row"))
    return metrics.row_accuracy(docs.select("doc_id", F.explode(lines).alias("row")), want)


def probe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cache probes of four variants."""
    rows = ca.rollup(t.calls(spark, sf_dir)).withColumn("variant", F.col("correlation_id") % 4).withColumn("expect_cache", _pick(F.col("correlation_id"), "miss", "hit"))
    return ca.probe_results(rows)


def recalled_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest found outcome of a user's earlier events of the same kind and account."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("tool"), _pick(F.col("k"), "A0", "A1", None).alias("account_id"), F.when(F.col("value") > 60, "found").otherwise("not_found").alias("outcome_status"), F.col("event_id").alias("outcome"))
    return conversation.recall(e).select("session_id", "turn", "recalled")


def account_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which account a user's event means: named, the last one, the other one, or none."""
    turns = _events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), "k", _pick(F.col("k"), "A0", "A1", None, None, None, None).alias("account_id"))
    kind = _pick(F.col("k"), "explicit", "last", "other", "none")
    named = F.concat(F.lit("A"), (F.col("k") % 5).cast("string"))
    own = F.array(F.lit("A0"), F.lit("A1"), F.lit("A2"))
    seen = conversation.references(turns).withColumn("r", conversation.resolve(kind, named, own, F.col("last_reference"), F.col("references")))
    return seen.select("turn", "r.account_id", "r.reason")


def fault_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as attempts, each third one succeeds."""
    return conversation.fault_schedule(_events(spark, sf_dir), "user_id", "event_id").select("event_id", "ok")


def repeated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as queries of a conversation, upper case at every third turn."""
    c = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("correlation_id"), F.col("turn").alias("n"), F.when(F.col("turn") % 3 == 0, F.upper("role")).otherwise(F.col("role")).alias("query"))
    return conversation.repeated_queries(c).select("correlation_id", "n", "query", "repeated")


def service_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses of a service, and the wait before the next attempt."""
    k = F.col("k")
    status = _pick(k, "200", "404", "409", "500", "401", "200", "200").cast("int")
    failed = F.when(F.col("event_type") == "error", "timeout")
    wait = filters.backoff_bounds(k % 4, 0.5, 0.25)
    return _events(spark, sf_dir).select("event_id", filters.http_outcome(status, failed, k % 10 != 9).alias("outcome"), wait["least"].alias("least"), wait["most"].alias("most"))


def latest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest successful event of each user and account."""
    e = _events(spark, sf_dir).select((F.col("k") % 10).alias("account"), "user_id", F.col("event_id").alias("i"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), "event_type")
    return records.latest_source(e, "user_id", "account").select("user_id", "account", "call.i", "call.event_type")


def cited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the order lines that hold the part of the order's first line, as part or supplier."""
    li = t.table(spark, sf_dir, "lineitem")
    both = F.explode(F.create_map(F.lit("part"), F.col("l_partkey"), F.lit("supplier"), F.col("l_suppkey"))).alias("name", "value")
    fields = li.select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("record"), both)
    return records.cited_records(fields, li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("call_id"), F.col("l_partkey").alias("id"))).select("call_id", "record", "name", "value")


def line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third line of every order by a key of two columns: ok or not_found."""
    asked = t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(3).alias("l_linenumber"))
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return records.lookup(asked, lines, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "outcome", "l_partkey")


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each of a user's events, as a round, leads, and what a decline at it would say."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = _events(spark, sf_dir).withColumn("n", n).withColumn("verdict", _pick(F.col("k"), "usable", "answered", "poor", "declined", "ungrounded"))
    last = F.when(F.col("k") % 4 != 0, F.concat(F.lit("no fee for "), "event_type"))
    why = conversation.decline_reason(F.array(F.lit("poor"), F.col("verdict")), last)
    return e.select("event_id", conversation.next_step(F.col("verdict"), F.col("n"), 3).alias("step"), why.alias("reason"))


def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label, as a configuration, whose queries have the best recall."""
    v = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("row"))
    at = lambda k: F.round(F.avg(F.when(F.col("k") == k, F.col("recall"))), 6).alias(f"recall_{k}")
    return metrics.best_configuration(recall_precision(spark, sf_dir).join(v, "query_id").groupBy("row").agg(at(5), at(10)))


_E = "e AS (SELECT *, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_GRADED = f"""
{_E}, g0 AS (SELECT *, user_id % 5 AS run, CASE WHEN event_type IN ('view', 'click') THEN 'answered' WHEN event_type = 'purchase' THEN 'not_in_corpus' ELSE 'answered_direct' END AS want FROM e),
g1 AS (SELECT *, CASE WHEN k % 8 = 0 THEN 'not_in_corpus' WHEN k % 8 = 1 THEN 'answered_direct' ELSE want END AS got FROM g0),
g2 AS (SELECT *, got = want AND (want <> 'answered_direct' OR k % 3 = 0) AS outcome_ok, k % 13 <> 0 AND k % 10 <> 7 AS line_ok, CASE WHEN k % 6 = 0 THEN 'none' WHEN k % 6 = 1 THEN 'incorrect' ELSE 'correct' END AS judge FROM g1),
g AS (SELECT *, outcome_ok AND (want <> 'answered' OR (judge = 'correct' AND k % 5 <> 0)) AS success, k % 17 = 0 OR user_id % 7 = 0 AS leak, line_ok OR (k % 13 <> 0 AND k % 10 = 7 AND got = 'answered') AS source_ok FROM g2)
"""
_TOOLS = f"""
{_E}, t0 AS (SELECT *, 'CARD-' || lpad(cast(k AS VARCHAR), 4, '0') AS card, 'fee 1' || k || '.' AS said FROM e),
checks AS (SELECT event_id, card, k, unnest([
  {{'check': 'gate', 'ok': k % 9 <> 0 OR k % 2 = 0}}, {{'check': 'tools', 'ok': k % 5 <> 0}}, {{'check': 'outcome', 'ok': k % 2 = 0 OR k % 7 <> 0}},
  {{'check': 'facts', 'ok': contains(said, 'fee 1' || (k % 50))}}, {{'check': 'must_not', 'ok': NOT contains(said, 'fee 17')}},
  {{'check': 'source_line', 'ok': k % 4 <> 1 AND (k % 2 <> 0 OR k % 4 = 2)}}, {{'check': 'no_invented_ids', 'ok': k % 3 <> 0}}, {{'check': 'no_forbidden_write', 'ok': k % 11 <> 0}}], recursive := true) FROM t0)
"""

EVALUATION_SQL: dict[str, str] = {
    "token_survival": f"WITH b AS (SELECT item_id AS quote_id, list_filter(string_split({_norm('text')}, ' '), lambda w: w <> '') AS w FROM benchmark), d AS (SELECT doc_id, {_norm("coalesce(text, '')")} AS norm FROM documents) SELECT DISTINCT quote_id, doc_id FROM b, d WHERE len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(norm, x))) = 0",
    "quality_summary": f"""WITH {_GRADED} SELECT run, count(*) AS questions, round(avg(success::INT), 4) AS task_success, count(*) FILTER (success) AS task_success_count, round(avg((k % 9 <> 0 OR k % 2 = 1)::INT), 4) AS gate_accuracy,
      round(avg(outcome_ok::INT), 4) AS outcome_correct, round(avg((got = 'answered')::INT) FILTER (want = 'answered'), 4) AS answerable_answered, round(avg((judge = 'correct')::INT) FILTER (want = 'answered'), 4) AS judge_correct,
      round(avg((k % 5 <> 0)::INT) FILTER (want = 'answered'), 4) AS citation_hit, round(avg((got = 'not_in_corpus')::INT) FILTER (want = 'not_in_corpus'), 4) AS decline_recall,
      round(avg((want = 'not_in_corpus')::INT) FILTER (got = 'not_in_corpus'), 4) AS decline_precision, count(*) FILTER (got = 'not_in_corpus' AND want = 'answered') AS false_declines,
      count(*) FILTER (NOT source_ok) AS source_line_violations, count(*) FILTER (leak) AS leaks, count(*) FILTER (k % 2 = 0) AS declined_rounds FROM g GROUP BY run""",
    "threshold_sweep": f"""WITH {_GRADED} SELECT cast(0.25 + run / 8 AS DOUBLE) AS tau, count(*) AS questions, count(*) FILTER (success) AS successes, count(*) FILTER (got = 'not_in_corpus' AND want = 'answered') AS false_declines,
      round(avg(k % 3) FILTER (k % 3 > 0), 3) AS mean_rounds, round(cast(sum(cast(value AS DECIMAL(18,8))) AS DOUBLE) / count(*), 6) AS cost_mean, count(*) FILTER (k % 8 = 3) AS rewrite_helped, count(*) FILTER (k % 11 = 3) AS rescued_after_decline FROM g GROUP BY run""",
    "model_comparison": f"""WITH {_CALLS} SELECT purpose, count(*) AS questions, count(*) FILTER (k % 3 = 0) AS successes, cast(sum(cost_usd) AS DOUBLE) AS cost_total, round(cast(sum(cost_usd) AS DOUBLE) / nullif(count(*) FILTER (k % 3 = 0), 0), 6) AS cost_per_success,
      round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95 FROM calls GROUP BY purpose""",
    "calibration_sample": f"""WITH {_E}, j AS (SELECT event_id AS call_id, event_type AS purpose, CASE WHEN k % 7 = 0 THEN 'incorrect' ELSE 'correct' END AS judge_verdict FROM e),
      g AS (SELECT *, row_number() OVER (PARTITION BY purpose ORDER BY call_id) - 1 AS place, count(*) OVER (PARTITION BY purpose) AS good FROM j WHERE judge_verdict = 'correct'),
      f AS (SELECT purpose, count(*) AS flagged FROM j WHERE judge_verdict <> 'correct' GROUP BY purpose), r AS (SELECT g.*, greatest(500 - coalesce(flagged, 0), 0) AS room FROM g LEFT JOIN f USING (purpose))
      SELECT * FROM j WHERE judge_verdict <> 'correct' UNION ALL SELECT call_id, purpose, judge_verdict FROM r WHERE room > 0 AND place % greatest(good // room, 1) = 0 AND place // greatest(good // room, 1) < room""",
    "tool_grades": f"WITH {_TOOLS} SELECT event_id, bool_and(ok) AS passed, coalesce(string_agg(\"check\", ',' ORDER BY \"check\") FILTER (NOT ok), '') AS failed, CASE WHEN any_value(k) % 3 = 0 THEN any_value(card) ELSE '' END AS invented FROM checks GROUP BY event_id",
    "check_rates": f'WITH {_TOOLS} SELECT "check", count(*) FILTER (ok) AS passed, count(*) AS n FROM checks GROUP BY "check"',
    "decision_grades": f"""WITH {_EMPTY}, a AS (SELECT doc_id, CASE WHEN reason IS NULL THEN 'cleaned' ELSE 'dropped' END AS status, reason FROM decided),
      j AS (SELECT l.doc_id, coalesce(status, 'MISSING') AS status, reason, coalesce(status, 'MISSING') = CASE WHEN quality = 1 THEN 'cleaned' ELSE 'dropped' END AS same, l.doc_id % 10 = 0 AND NOT coalesce(contains(reason, 'placeholder'), false) AS wrong FROM labels l LEFT JOIN a USING (doc_id))
      SELECT 'd' || doc_id AS filename, status, reason, CASE WHEN same AND NOT wrong THEN 'OK' WHEN same THEN 'MISMATCH (should name placeholder)' ELSE 'MISMATCH' END AS verdict FROM j""",
    "row_accuracy": f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), got AS (SELECT DISTINCT doc_id, {_norm('line')} AS "row" FROM (SELECT doc_id, unnest(ls) AS line FROM l)),
      want AS (SELECT doc_id, {_norm('line')} AS "row" FROM (SELECT doc_id, unnest(['  ' || ls[1], ls[-1] || CASE WHEN doc_id % 2 = 1 THEN ' (changed)' ELSE '' END]) AS line FROM l))
      SELECT w.doc_id, count(g.doc_id) AS exact, count(*) AS "rows" FROM want w LEFT JOIN got g ON g.doc_id = w.doc_id AND g."row" = w."row" GROUP BY w.doc_id""",
    "probe_results": f"""WITH {_ROLLUP} SELECT correlation_id % 4 AS variant, count(*) AS n, count(*) FILTER (coalesce(first_call_cache, 'miss') = CASE WHEN correlation_id % 2 = 0 THEN 'miss' ELSE 'hit' END) AS ok,
      cast(sum(local_cache_hits - CASE WHEN first_call_cache = 'hit' THEN 1 ELSE 0 END) AS BIGINT) AS within_question_hits FROM rolled GROUP BY variant""",
    "recalled_outcomes": f"""WITH {_E} SELECT user_id AS session_id, event_id AS turn, last_value(CASE WHEN value > 60 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, event_type, k % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS recalled FROM e""",
    "account_resolution": f"""WITH {_E}, r AS (SELECT event_id, user_id, k, CASE k % 6 WHEN 0 THEN 'A0' WHEN 1 THEN 'A1' END AS ref FROM e),
      s AS (SELECT *, last_value(ref IGNORE NULLS) OVER w AS last, coalesce(bool_or(ref = 'A0') OVER w, false) AS a0, coalesce(bool_or(ref = 'A1') OVER w, false) AS a1 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      a AS (SELECT *, CASE WHEN k % 4 = 0 AND k % 5 < 3 THEN 'A' || (k % 5) WHEN k % 4 = 1 THEN last WHEN k % 4 = 2 AND a0 AND a1 THEN 'A2' END AS account_id FROM s)
      SELECT event_id AS turn, account_id, CASE WHEN account_id IS NOT NULL THEN NULL WHEN k % 4 = 0 THEN 'not one of the customer''s accounts' WHEN k % 4 = 1 THEN 'nothing was referenced before' WHEN k % 4 = 2 THEN 'not exactly one other account' ELSE 'no account needed' END AS reason FROM a""",
    "fault_schedule": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 3 = 0 AS ok FROM events",
    "repeated_queries": "SELECT conv_id AS correlation_id, turn AS n, CASE WHEN turn % 3 = 0 THEN upper(role) ELSE role END AS query, row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn) > 1 AS repeated FROM conversations",
    "service_outcomes": f"""WITH {_E} SELECT event_id, CASE WHEN event_type = 'error' THEN 'unavailable' WHEN k % 7 = 1 THEN 'not_found' WHEN k % 7 = 2 THEN 'conflict' WHEN k % 7 IN (3, 4) OR k % 10 = 9 THEN 'unavailable' ELSE 'ok' END AS outcome,
      cast(0.5 * pow(2, k % 4) AS DOUBLE) AS least, cast(0.5 * pow(2, k % 4) + 0.25 AS DOUBLE) AS most FROM e""",
    "latest_sources": f"WITH {_E} SELECT user_id, k % 10 AS account, max(event_id) AS i, arg_max(event_type, event_id) AS event_type FROM e WHERE event_type <> 'error' GROUP BY ALL",
    "cited_records": """WITH f AS (SELECT l_orderkey AS call_id, l_linenumber AS record, unnest(['part', 'supplier']) AS name, unnest([l_partkey, l_suppkey]) AS value FROM lineitem),
      c AS (SELECT l_orderkey AS call_id, l_partkey AS value FROM lineitem WHERE l_linenumber = 1), h AS (SELECT DISTINCT call_id, record FROM f SEMI JOIN c USING (call_id, value)) SELECT f.* FROM f SEMI JOIN h USING (call_id, record)""",
    "line_lookup": "SELECT o_orderkey AS l_orderkey, CASE WHEN l.l_orderkey IS NULL THEN 'not_found' ELSE 'ok' END AS outcome, l_partkey FROM orders LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey AND l.l_linenumber = 3",
    "next_steps": f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e)
      SELECT event_id, CASE WHEN k % 5 = 0 THEN 'generate' WHEN k % 5 = 1 THEN 'finalise' WHEN n < 3 THEN 'planner' ELSE 'not_in_corpus' END AS step,
      CASE WHEN k % 5 = 2 THEN 'no chunk scored >= tau after 2 rounds' ELSE 'answer step did not answer in round 2: ' || CASE WHEN k % 4 <> 0 THEN 'no fee for ' || event_type ELSE '' END END AS reason FROM r""",
    "best_configuration": f"""{_SCORED}, c AS (SELECT label AS "row", round(avg(recall) FILTER (k = 5), 6) AS recall_5, round(avg(recall) FILTER (k = 10), 6) AS recall_10 FROM scored JOIN q USING (query_id) GROUP BY label) SELECT * FROM c ORDER BY recall_5 DESC, recall_10 DESC, "row" LIMIT 1""",
}
