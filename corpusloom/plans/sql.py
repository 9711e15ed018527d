"""SQL equivalents of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(replace(translate({x}, '‘’‚′“”„″–—‒−‑', '''''''''\"\"\"\"-----'), '…', '...')), '\s+', ' ', 'g'))"


_TOKENS = rf"regexp_extract_all({_norm('coalesce(text, chr(32))')}, '[a-z0-9$][a-z0-9$%.\-/,]*[a-z0-9%]|[a-z0-9$%]')"
_CATALOG = """
catalog AS (SELECT doc_id, text, CASE WHEN cast(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 0 THEN 'retail' ELSE 'business' END AS tenant,
  CASE WHEN lang = 'de' THEN 'restricted' ELSE 'public' END AS sensitivity, doc_id % 7 <> 0 AS is_current FROM documents)
"""
_BM25 = f"""
toks AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
lens AS (SELECT doc_id, len(w) AS n FROM toks),
whole AS (SELECT count(*) AS n_docs, avg(n) AS avg_length FROM lens),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY ALL),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), whole),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, doc_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_length)))), 6) AS score
  FROM q JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (doc_id), whole GROUP BY ALL)
"""
_TOP = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {0}) WHERE rank <= 10"
_VEC = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
sim AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e), 6) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0),
vtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim)
"""
_LAB = """
ltop AS (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(v.vec_id - q.vec_id), v.vec_id) AS rank
  FROM v AS q JOIN v USING (label) WHERE q.vec_id % 50 = 0)
"""
_SCORED = f"""
WITH {_VEC}, q AS (SELECT vec_id AS query_id, label FROM v WHERE vec_id % 50 = 0),
m AS (SELECT t.query_id, CASE WHEN t.vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS item, min(rank) AS r FROM vtop t JOIN v USING (vec_id) JOIN q ON q.query_id = t.query_id AND q.label = v.label
  WHERE rank <= 10 AND t.vec_id <> t.query_id GROUP BY ALL),
items AS (SELECT query_id, unnest(['even', 'odd']) AS item FROM q),
per AS (SELECT query_id, item, r, unnest([5, 10]) AS k FROM items LEFT JOIN m USING (query_id, item)),
scored AS (SELECT query_id, cast(k AS BIGINT) AS k, count(*) AS n_items, count(*) FILTER (r <= k) / count(*) AS recall, count(DISTINCT CASE WHEN r <= k THEN r END) / k AS "precision", least(count(*), k) / k AS ceiling FROM per GROUP BY query_id, k)
"""
_EMPTY = rf"""
made AS (SELECT doc_id, lang, n_chars, len(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS n,
  CASE WHEN regexp_matches(lower(text), '\bcontent\s+to\s+follow\b') THEN 'content to follow' WHEN regexp_matches(lower(text), '\bcoming\s+soon\b') THEN 'coming soon' WHEN regexp_matches(lower(text), '\btbd\b') THEN 'tbd' END AS phrase FROM documents),
decided AS (SELECT *, CASE WHEN n < 50 THEN 'near-empty: ' || n || ' words' || coalesce('; placeholder text ("' || phrase || '")', '')
  WHEN phrase IS NOT NULL AND n < 200 THEN 'near-empty: ' || n || ' words; placeholder text ("' || phrase || '")' END AS reason FROM made)
"""
_PAIRS = f"""
norms AS (SELECT doc_id, {_norm("coalesce(text, '')")} AS norm FROM documents),
reps AS (SELECT min(doc_id) AS id, norm FROM norms GROUP BY norm),
ws AS (SELECT id, string_split(norm, ' ') AS w FROM reps WHERE norm <> ''),
sh AS (SELECT DISTINCT id, list_aggregate(w[i:i+4], 'string_agg', ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM ws)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
both_in AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b, c / (p.n + q.n - c) AS jaccard FROM both_in JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE c / (p.n + q.n - c) >= 0.9)
"""
_CALLS = """
calls AS (SELECT event_id AS call_id, user_id AS correlation_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'llm' ELSE 'local_model' END AS kind, event_type AS purpose,
  event_type <> 'error' AS billable, cast(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN cast(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN 'hit' ELSE 'miss' END AS local_cache,
  cast(value AS DECIMAL(18,8)) AS cost_usd, value AS latency_ms, CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error FROM events)
"""
_ROLLUP = f"""
{_CALLS}, rolled AS (SELECT correlation_id, coalesce(sum(cost_usd) FILTER (billable), 0) AS cost_usd, count(*) FILTER (kind = 'llm') AS llm_calls,
  count(*) FILTER (kind = 'llm' AND local_cache = 'hit') AS local_cache_hits,
  cast(round(sum(CASE WHEN kind = 'llm' THEN cast(latency_ms AS DECIMAL(18,4)) ELSE 0 END), 1) AS DOUBLE) AS llm_latency_ms, cast(round(sum(CASE WHEN kind = 'local_model' THEN cast(latency_ms AS DECIMAL(18,4)) ELSE 0 END), 1) AS DOUBLE) AS local_latency_ms,
  cast(sum(CASE WHEN kind = 'llm' THEN k ELSE 0 END) AS BIGINT) AS input_tokens, cast(sum(CASE WHEN kind = 'llm' THEN 2 * k ELSE 0 END) AS BIGINT) AS output_tokens,
  count(error) AS n_errors, arg_min(error, (ts, call_id)) FILTER (error IS NOT NULL) AS first_error,
  arg_min(local_cache, (ts, call_id)) FILTER (kind = 'llm') AS first_call_cache,
  cast(sum(cost_usd) FILTER (purpose = 'click') AS DOUBLE) AS cost_click, cast(sum(cost_usd) FILTER (purpose = 'purchase') AS DOUBLE) AS cost_purchase,
  cast(sum(cost_usd) FILTER (purpose = 'signup') AS DOUBLE) AS cost_signup, cast(sum(cost_usd) FILTER (purpose = 'view') AS DOUBLE) AS cost_view
  FROM calls GROUP BY correlation_id)
"""
_STOP = """CASE WHEN a + 800 < n AND contains(translate(substr(text, a + 751, 51), chr(10), ' '), ' ') THEN a + 801 - strpos(reverse(translate(substr(text, a + 751, 51), chr(10), ' ')), ' ') ELSE least(a + 800, n) END"""
_ACCOUNTS = "accounts AS (SELECT c_custkey AS account_id, c_nationkey AS member_id, c_mktsegment AS type, cast(cast(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS balance FROM customer)"

# The redacted formats in this dialect, which has no look-behind.
_FORMATS = {
    "MEMBER": r"\bHCU-\d{6}\b",
    "ACCOUNT": r"\b7730-\d{4}-\d{4}\b",
    "SSN": r"\b9\d{2}-\d{2}-\d{4}\b",
    "PHONE": r"\(555\) ?\d{3}-\d{4}\b|\b555[ .-]\d{3}-\d{4}\b|\b555-01\d{2}\b",
    "EMAIL": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.(?:com|org)\b",
    "ADDRESS": r"\b\d{1,5}(?: [A-Z][a-z]+){1,3} (?:Lane|Street|Road|Court|Drive|Way|Avenue), [A-Z][a-z]+(?: [A-Z][a-z]+)?, ME 0\d{4}\b",
}
_REDACTED = r"regexp_replace(text, '(DOB:? )\d{2}/\d{2}/\d{4}', '\1[REDACTED-DOB]', 'g')"
for _kind, _rx in _FORMATS.items():
    _REDACTED = f"regexp_replace({_REDACTED}, '{_rx}', '[REDACTED-{_kind}]', 'g')"

SQL: dict[str, str] = {
    "bm25_topk": f"WITH {_BM25} " + _TOP.format("scores WHERE score > 0"),
    "bm25_term_stats": f"WITH {_BM25} SELECT term, round(idf, 6) AS idf FROM idf",
    "filtered_topk": f"WITH {_BM25}, {_CATALOG} " + _TOP.format("(SELECT s.* FROM scores s JOIN catalog c USING (doc_id) WHERE score > 0 AND tenant = 'retail' AND sensitivity <> 'restricted' AND is_current)"),
    "leak_counts": f"WITH {_BM25}, {_CATALOG}, hits AS ({_TOP.format('scores WHERE score > 0')}) SELECT query_id, count(*) FILTER (sensitivity = 'restricted') AS restricted, count(*) FILTER (tenant <> 'retail') AS wrong_tenant, count(*) FILTER (NOT is_current) AS superseded FROM hits JOIN catalog USING (doc_id) GROUP BY query_id",
    "query_verdicts": f"WITH {_VEC} SELECT query_id, CASE WHEN max(score) >= 0.5 THEN 'usable' ELSE 'poor' END AS verdict, count(*) FILTER (score >= 0.5) AS kept FROM vtop WHERE rank <= 10 GROUP BY query_id",
    "vector_topk": f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM vtop WHERE rank <= 10",
    "hybrid_rrf": f"""WITH {_VEC}, {_LAB}, fused AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM
      (SELECT query_id, vec_id, rank FROM vtop WHERE rank <= 50 UNION ALL SELECT query_id, vec_id, rank FROM ltop WHERE rank <= 50) GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fused) WHERE rank <= 10""",
    "hybrid_stage_scores": f"WITH {_VEC}, {_LAB} SELECT query_id, vec_id, l.rank AS label_rank, t.rank AS vector_rank, t.score AS vector_score FROM (SELECT * FROM ltop WHERE rank <= 50) l FULL JOIN (SELECT * FROM vtop WHERE rank <= 50) t USING (query_id, vec_id)",
    "recall_precision": f'{_SCORED} SELECT query_id, k, n_items, recall, "precision", ceiling FROM scored',
    "retrieval_summary": f'{_SCORED} SELECT k, label, count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg("precision"), 6) AS "precision", round(avg(ceiling), 6) AS ceiling FROM scored JOIN q USING (query_id) GROUP BY GROUPING SETS ((k), (k, label))',
    "near_empty_decisions": f"WITH {_EMPTY} SELECT doc_id, CASE WHEN reason IS NULL THEN 'cleaned' ELSE 'dropped' END AS status, reason FROM decided",
    "decision_counts": f"WITH {_EMPTY} SELECT lang, CASE WHEN reason IS NULL THEN 'cleaned' ELSE 'dropped' END AS status, count(*) AS n, max(n_chars) AS longest FROM decided GROUP BY ALL",
    "exact_dups": "WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT doc_id, sha256, canonical, n_copies, doc_id <> canonical AS is_duplicate FROM d JOIN (SELECT sha256, min(doc_id) AS canonical, count(*) AS n_copies FROM d GROUP BY sha256) USING (sha256)",
    "near_dups": f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs",
    "dup_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT id, id AS other FROM reps UNION SELECT r.id, e.b FROM reach r JOIN e ON r.other = e.a)
      SELECT doc_id, g AS group_id FROM norms JOIN reps USING (norm) JOIN (SELECT id, min(other) AS g FROM reach GROUP BY id) USING (id)""",
    "closest_documents": f"WITH {_PAIRS.replace(' WHERE c / (p.n + q.n - c) >= 0.9', '')}, m AS (SELECT a AS doc_id, b AS other, jaccard FROM pairs UNION ALL SELECT b, a, jaccard FROM pairs) SELECT doc_id, other, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, other) AS p FROM m) WHERE p = 1",
    "quote_survival": f"SELECT item_id AS quote_id, doc_id FROM benchmark b, documents d WHERE contains({_norm('d.text')}, {_norm('b.text')})",
    "pii_counts": r"""SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.(?:com|org)\b')) AS emails,
      len(regexp_extract_all(text, '\(555\) ?\d{3}-\d{4}\b|\b555[ .-]\d{3}-\d{4}\b|\b555-01\d{2}\b')) AS phones, len(regexp_extract_all(text, '\b9\d{2}-\d{2}-\d{4}\b')) AS ssns FROM documents""",
    "pii_redacted": rf"WITH r AS (SELECT doc_id, {_REDACTED} AS t FROM documents) SELECT doc_id, sha256(t) AS sha256, coalesce(len(regexp_extract_all(t, '\[REDACTED-[A-Z]+\]')), 0) AS n_spans FROM r",
    "running_lines": rf"""WITH l AS (SELECT source AS doc_id, doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
      f AS (SELECT * FROM l WHERE trim(line) <> ''),
      p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY no) AS top, row_number() OVER (PARTITION BY doc_id, page ORDER BY no DESC) AS low FROM f),
      s AS (SELECT doc_id, regexp_replace({_norm('line')}, '\d+', '#', 'g') AS key, count(DISTINCT page) AS "on" FROM p WHERE top <= 3 OR low <= 3 GROUP BY ALL),
      n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM f GROUP BY doc_id HAVING count(DISTINCT page) > 1)
      SELECT doc_id, key, "on", pages FROM s JOIN n USING (doc_id) WHERE "on" >= greatest(2, ceil(pages * 0.05))""",
    "whitespace_cleaned": r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160) || chr(8239) || chr(9), '   '), chr(10)), lambda x: trim(regexp_replace(x, ' {2,}', ' ', 'g'))), chr(10)), '^\n+', ''), '\n+$', '') AS clean FROM documents)
      SELECT doc_id, sha256(clean) AS sha256, length(clean) AS n_clean FROM c""",
    "interaction_rollup": f"WITH {_ROLLUP} SELECT * REPLACE (cast(cost_usd AS DOUBLE) AS cost_usd), local_cache_hits - CASE WHEN first_call_cache = 'hit' THEN 1 ELSE 0 END AS within_question_hits FROM rolled",
    "run_summary": f"""WITH {_ROLLUP}, r AS (SELECT correlation_id % 10 AS run, cost_usd, llm_latency_ms AS ms, llm_calls, local_cache_hits, n_errors > 15 AS bad FROM rolled)
      SELECT run, count(*) AS questions, count(*) FILTER (bad) AS errors, cast(round(cast(sum(cost_usd) FILTER (NOT bad) AS DOUBLE) / count(*) FILTER (NOT bad), 6) AS DOUBLE) AS cost_mean,
      round(quantile_cont(cast(cost_usd AS DOUBLE), 0.5) FILTER (NOT bad), 6) AS cost_p50, round(quantile_cont(cast(cost_usd AS DOUBLE), 0.95) FILTER (NOT bad), 6) AS cost_p95,
      cast(max(cost_usd) FILTER (NOT bad) AS DOUBLE) AS cost_max, cast(sum(cost_usd) FILTER (NOT bad) AS DOUBLE) AS cost_total,
      round(quantile_cont(ms, 0.5) FILTER (NOT bad), 6) AS latency_p50, round(quantile_cont(ms, 0.95) FILTER (NOT bad), 6) AS latency_p95, max(ms) FILTER (NOT bad) AS latency_max,
      round(sum(local_cache_hits) / nullif(sum(llm_calls), 0), 4) AS hit_rate FROM r GROUP BY run""",
    "latency_percentiles": """WITH o AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
      SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, any_value(v[cast(round_even(0.95 * (len(v) - 1), 0) AS INT) + 1]) AS p95_nearest, any_value(v[len(v) // 2 + 1]) AS p50_upper, round(avg(value), 4) AS mean FROM events JOIN o USING (event_type) GROUP BY event_type""",
    "ledger_totals": f"""WITH {_CALLS}, l AS (SELECT purpose, strftime(ts, '%Y-%m') AS run_id, kind AS model, cost_usd FROM calls WHERE billable)
      SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(purpose) = 0 THEN 'purpose' WHEN grouping(run_id) = 0 THEN 'run_id' ELSE 'total' END AS title, coalesce(run_id, purpose, model) AS name, count(*) AS calls, cast(sum(cost_usd) AS DOUBLE) AS cost FROM l GROUP BY GROUPING SETS ((), (run_id), (purpose), (model))""",
    "budget_guard": f"WITH {_CALLS} SELECT call_id, correlation_id, cast(spent AS DOUBLE) AS spent_before, spent >= 500 AS stopped FROM (SELECT *, coalesce(sum(cost_usd) OVER (PARTITION BY correlation_id ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM calls)",
    "cost_model": """SELECT model, count(*) AS calls, cast(sum(cast(round((i * ri + r * rr + o * ro) / 1000000, 8) AS DECIMAL(18,8))) AS DOUBLE) AS cost_usd FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'large' WHEN 'A' THEN 'small' ELSE 'small-20250101' END AS model,
      cast(l_quantity * 1000 AS BIGINT) AS i, l_linenumber AS r, l_partkey AS o, CASE WHEN l_returnflag = 'R' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS ri, CASE WHEN l_returnflag = 'R' THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END AS rr, CASE WHEN l_returnflag = 'R' THEN 25.0::DOUBLE ELSE 5.0::DOUBLE END AS ro FROM lineitem) GROUP BY model""",
    "extremes": """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS top, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS low FROM orders)
      SELECT o_custkey, o_orderkey, o_totalprice, 'most' AS side, top AS place FROM r WHERE top <= 5 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 'least', low FROM r WHERE low <= 5""",
    "newest_transactions": """WITH n AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS posted_on, cast(cast(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) * CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE 1 END AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY cast(o_orderdate AS DATE) DESC, o_orderkey DESC) AS place FROM orders)
      SELECT c_custkey AS account_id, o_orderkey AS transaction_id, posted_on, amount, place FROM customer LEFT JOIN (SELECT * FROM n WHERE place <= 10) ON o_custkey = c_custkey""",
    "accounts_by_member": f"WITH {_ACCOUNTS} SELECT member_id, account_id, type, balance FROM accounts JOIN nation ON n_nationkey = member_id",
    "account_lookup": f"WITH {_ACCOUNTS} SELECT p_partkey * 3 AS account_id, CASE WHEN a.account_id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome, balance FROM part LEFT JOIN accounts a ON a.account_id = p_partkey * 3",
    "canonical_copies": r"""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, doc_id % 3 = 0 AS marked, [4, 0, 9, 3][doc_id % 4 + 1] AS fmt,
        CASE WHEN doc_id % 5 = 0 THEN '9999-99-99' ELSE '2024-0' || (doc_id % 5) || '-01' END AS day, 'd' || doc_id || CASE WHEN doc_id % 3 = 0 THEN ' copy' ELSE '' END AS name FROM documents),
      r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY sha256 ORDER BY marked, fmt, day, name) AS canonical, count(*) OVER (PARTITION BY sha256) AS n_copies FROM d)
      SELECT doc_id, sha256, canonical, n_copies, doc_id <> canonical AS is_duplicate FROM r""",
    "json_limit_lookup": """SELECT e.event_id AS policy_number, CASE WHEN e.user_id % 2 = 0 THEN 'k' ELSE 'flood' END AS peril, p.event_id IS NOT NULL AS found, p.event_type AS status, cast(json_extract_string(p.props, '$.' || CASE WHEN e.user_id % 2 = 0 THEN 'k' ELSE 'flood' END) AS DOUBLE) AS "limit"
      FROM events e LEFT JOIN (SELECT * FROM events WHERE event_type <> 'error') p USING (event_id)""",
    "figure_check": """WITH a AS (SELECT l_orderkey, list(DISTINCT cast(l_extendedprice AS DECIMAL(18,2))) AS v, sum(cast(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, cast(3 AS BIGINT) AS figures, CASE WHEN list_contains(v, cast(total + 1 AS DECIMAL(18,2))) THEN '' ELSE cast(cast(total + 1 AS DECIMAL(18,2)) AS VARCHAR) END AS unverified FROM a""",
    "authz_decisions": """WITH c AS (SELECT event_id AS call_id, CASE WHEN user_id % 2 = 0 THEN 'member_assistant' ELSE 'contact_centre' END AS caller, event_type AS tool, event_id % 5 = 0 AS extra FROM events),
      g AS (SELECT *, tool IN ('view', 'click', 'signup') OR (tool = 'purchase' AND caller = 'contact_centre') AS granted, tool IN ('view', 'click', 'purchase') AS known FROM c)
      SELECT call_id, caller, tool, CASE WHEN NOT granted OR NOT known OR extra THEN 'denied' ELSE 'allowed' END AS decision, CASE WHEN NOT granted THEN 'forbidden' WHEN NOT known OR extra THEN 'invalid_arguments' ELSE 'ok' END AS outcome,
      CASE WHEN NOT granted THEN caller || ' may not call ' || tool WHEN NOT known THEN 'unknown tool ' || tool WHEN extra THEN 'undeclared argument(s): extra' END AS error FROM g""",
    "reference_resolution": """WITH u AS (SELECT conv_id AS session_id, turn, CASE WHEN turn % 3 <> 2 THEN 'A' || (length(text) % 3) END AS r FROM conversations WHERE role = 'user'),
      s AS (SELECT session_id, turn, last_value(r IGNORE NULLS) OVER w AS last_reference, list(r) FILTER (r IS NOT NULL) OVER w AS refs FROM u WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      d AS (SELECT session_id, turn, last_reference, list_filter(coalesce(refs, []), lambda x, i: NOT list_contains(coalesce(refs, [])[1:i-1], x)) AS refs FROM s), o AS (SELECT *, list_filter(['A0', 'A1', 'A2'], lambda x: NOT list_contains(refs, x)) AS rest FROM d)
      SELECT session_id, turn, last_reference, coalesce(array_to_string(refs, ','), '') AS refs, CASE WHEN len(rest) = 1 THEN rest[1] END AS other FROM o""",
    "cache_probe": r"""WITH k AS (SELECT role, conv_id, turn, regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), '[?!.\s]+$', '') AS k FROM conversations)
      SELECT role, conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY role, k ORDER BY conv_id, turn) = 1 THEN 'miss' ELSE 'hit' END AS result FROM k""",
    "replay_diff": "SELECT event_id, 'event_type' AS field FROM events WHERE event_id % 10 = 0 AND event_type <> 'view' UNION ALL SELECT event_id, 'value' FROM events WHERE event_id % 100 = 0",
    "per_run_failures": "SELECT doc_id, CASE WHEN quality = 1 THEN 'ok' ELSE 'low' END AS quality, CASE WHEN toxic = 0 THEN 'ok' ELSE 'toxic' END AS toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND NOT (quality = 1 AND toxic = 0)",
    "confusion": "SELECT quality || '->' || toxic AS cell, count(*) AS n FROM labels GROUP BY ALL",
    "orphans": "SELECT doc_id, 'document' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'label' FROM labels ANTI JOIN documents USING (doc_id)",
    "round_outcomes": """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 'answered' WHEN 'purchase' THEN 'answered' WHEN 'click' THEN 'poor' WHEN 'signup' THEN 'declined' ELSE 'error' END AS v FROM events),
      l AS (SELECT user_id, list(v ORDER BY n) AS v FROM r WHERE n <= 3 GROUP BY user_id)
      SELECT user_id AS correlation_id, CASE WHEN v[-1] = 'answered' THEN 'answered' ELSE 'not_in_corpus' END AS outcome, len(v) AS rounds, v[-1] = 'answered' AND list_contains(v[1:len(v)-1], 'poor') AS rewrite_helped, v[-1] = 'answered' AND list_contains(v[1:len(v)-1], 'declined') AS rescued_after_decline FROM l""",
    "rounds_distribution": "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'error') % 4 AS rounds FROM events GROUP BY day) SELECT r.range AS rounds, count(d.day) AS n FROM range(4) r LEFT JOIN d ON d.rounds = r.range GROUP BY r.range",
    "loop_limits": """WITH s AS (SELECT user_id, row_number() OVER w AS step, coalesce(sum(cast(json_extract_string(props, '$.k') AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used, event_type = 'purchase' AND value > 150 AS ends FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      b AS (SELECT *, CASE WHEN step > 50 THEN 'terminated_iteration_limit' WHEN used >= 1500 THEN 'terminated_budget_limit' WHEN ends THEN 'terminated_success' END AS status FROM s)
      SELECT user_id AS session_id, arg_min(status, step) AS status, min(step) AS at_step FROM b WHERE status IS NOT NULL GROUP BY user_id""",
    "fixed_chunks": f"""WITH RECURSIVE d AS (SELECT doc_id, text, translate(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS s, length(text) AS n FROM documents WHERE text <> ''),
      cut AS (SELECT doc_id, a, {_STOP} AS stop FROM (SELECT *, cast(0 AS BIGINT) AS a FROM d) UNION ALL
        SELECT doc_id, a, {_STOP} FROM (SELECT doc_id, text, n, CASE WHEN contains(substr(s, b, stop - b), ' ') THEN b + strpos(substr(s, b, stop - b), ' ') - 1 ELSE stop END AS a
          FROM (SELECT doc_id, stop, greatest(stop - 150, a + 1) AS b FROM cut) JOIN d USING (doc_id) WHERE stop < n)),
      piece AS (SELECT doc_id, a, text, substr(s, a + 1, stop - a) AS p FROM cut JOIN d USING (doc_id)),
      place AS (SELECT doc_id, text, a + length(p) - length(ltrim(p)) AS l, a + length(rtrim(p)) AS r FROM piece WHERE trim(p) <> '')
      SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY l, r) - 1 AS INTEGER) AS chunk_index, cast(l AS INTEGER) AS char_start, cast(r AS INTEGER) AS char_end, sha256(substr(text, l + 1, r - l)) AS sha256 FROM place""",
    "source_lines": """WITH c AS (SELECT conv_id, turn, length(text) % 7 AS d, length(text) AS n FROM conversations),
      per AS (SELECT conv_id, d, min(turn) AS first, list_sort(list(DISTINCT n % 5 - 1) FILTER (n % 5 > 1)) AS pages, bool_or(n % 2 = 0) AS fees, bool_or(n % 11 = 0) AS made FROM c GROUP BY conv_id, d),
      e AS (SELECT conv_id, first, 'Doc ' || d || CASE WHEN d % 6 = 0 THEN ' (version 3.0, effective 2025-01-01)' WHEN d % 2 = 0 THEN ' (version 3.0)' WHEN d % 3 = 0 THEN ' (effective 2025-01-01)' ELSE '' END
        || CASE WHEN len(pages) > 0 THEN ', p.' || array_to_string(pages, ', ') ELSE '' END || CASE WHEN fees THEN ', Fees' ELSE '' END || CASE WHEN made THEN ' [includes a model-generated figure caption]' ELSE '' END AS entry FROM per)
      SELECT conv_id AS correlation_id, 'Source: ' || coalesce(string_agg(entry, ' | ' ORDER BY first, entry), '') AS source_line FROM e GROUP BY conv_id""",
    "windowed_costs": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS calls, cast(sum(cast(value AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM events GROUP BY ALL",
}
