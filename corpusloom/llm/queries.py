"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontamination, fingerprints, jaccard, language, mixing, negatives, notices, quality, ranking, secrets, toxicity, urlfilter
from corpusloom.storage import materialize, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The contract's extra conversation: one text that looks like a turn's end and the next turn's start.
HOSTILE = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    messages = chat.linear_tree(given.unionByName(extra))
    return chat.digest(chat.read_back(chat.format_paths(messages, chat.paths(messages, unique=True), unique=True)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    secrets.scan_new(docs, ledger)
    found = secrets.join_findings(secrets.address(docs).select("doc_id", "blob"), ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.judged(_table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = urlfilter.listing(pages).unionByName(urlfilter.mirrored(pages)).distinct()
    return urlfilter.judge(pages, materialize(listed, "listed-urls"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judged(_table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("positions", "source")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_toxicity, op3_secret_scans, op4_benchmark_decontamination, op5_quality_classifier, op6_ngram_jaccard_join, op7_url_filters, op8_language_id, op9_document_fingerprints, op10_source_mixing, op11_ranked_search, op12_hard_negatives, op13_license_scans)
}

_OP1 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), coded AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 14 AS chars FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(chars) AS BIGINT) AS formatted_chars
FROM coded GROUP BY conv_id
"""

_OP7 = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
    regexp_matches(host, '(^|\.)(casino-win|free-bets|ads-track|spam-farm|cheap-pills|adult-x)\.') AS named,
    regexp_replace(regexp_replace(host, ':\d+$', ''), '^(www|m|blog)\.', '') || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') AS canonical FROM parts
), judged AS (
  SELECT *, canonical IN (SELECT canonical FROM ruled WHERE named UNION ALL SELECT canonical FROM ruled WHERE host <> '' GROUP BY canonical HAVING count(DISTINCT host) >= 2) AS listed FROM ruled
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM judged
"""

_CODES = """list_transform({0}, lambda t, i: CASE WHEN t < ':' THEN '1' WHEN t = lower(t) THEN CASE WHEN t IN ({1}) AND i > 1 AND {0}[i - 1] < ':' THEN '2' ELSE t END
  WHEN (t <> upper(t) OR length(t) = 1) AND left(t, 1) <> lower(left(t, 1)) THEN '3' ELSE lower(t) END)""".format("toks", ", ".join(f"'{u}'" for u in decontamination.UNITS))

_OP4 = rf"""
WITH items AS (
  SELECT *, {_CODES} AS codes, least(len(toks), {decontamination.WINDOW}) AS size FROM (
    SELECT item_id, text AS item, regexp_extract_all(coalesce(text, ''), '{decontamination.TOKEN}') AS toks FROM (SELECT DISTINCT item_id, text FROM benchmark)) WHERE len(toks) > 0
), marks AS (
  SELECT item_id, item, size, pos, array_to_string(codes[pos:pos + size - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(codes) - size + 2)) AS pos FROM items)
  WHERE len(list_filter(codes[pos:pos + size - 1], lambda c: c NOT IN ('1', '2', '3'))) >= size * {decontamination.PLAIN}
), docs AS (
  SELECT *, {_CODES} AS codes FROM (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{decontamination.TOKEN}') AS toks FROM (SELECT DISTINCT doc_id, text FROM documents))
), places AS (
  SELECT doc_id, text, size, toks, d_at, array_to_string(codes[d_at:d_at + size - 1], ' ') AS win FROM (SELECT docs.*, size, unnest(range(1, len(codes) - size + 2)) AS d_at FROM docs, (SELECT DISTINCT size FROM items))
), steps AS (SELECT p.doc_id, p.text, p.toks AS d_toks, p.d_at, m.* FROM places p JOIN marks m USING (size, win)),
pairs AS (
  SELECT doc_id, item_id, item, count(DISTINCT win) AS matched, n_windows FROM steps JOIN (SELECT item_id, item, count(DISTINCT win) AS n_windows FROM marks GROUP BY ALL) USING (item_id, item)
  GROUP BY doc_id, item_id, item, n_windows HAVING count(DISTINCT win) >= {decontamination.COVERAGE} * n_windows
), good AS (SELECT steps.*, d_at - pos AS shift FROM steps SEMI JOIN pairs USING (doc_id, item_id, item)),
here AS (SELECT doc_id, text, item_id, item, shift, count(DISTINCT win) AS here FROM good GROUP BY ALL),
slots AS (
  SELECT DISTINCT doc_id, text, item_id, item, shift, k, i.codes[k] AS kind, i.toks[k] AS ours, d_toks[k + shift] AS theirs
  FROM (SELECT *, unnest(range(pos, pos + size)) AS k FROM good) JOIN (SELECT item_id, item, codes, toks FROM items) i USING (item_id, item) WHERE i.codes[k] IN ('1', '2', '3')
), ours AS (
  SELECT doc_id, text, item_id, item, shift, max(n) AS n, sum(slots) AS n_slots, sum(changed) AS n_changed FROM (
    SELECT doc_id, text, item_id, item, shift, kind, ours, count(DISTINCT theirs) AS n, count(DISTINCT k) AS slots, count(DISTINCT k) FILTER (ours <> theirs) AS changed FROM slots GROUP BY ALL) GROUP BY ALL
), theirs AS (
  SELECT doc_id, text, item_id, item, shift, max(n) AS m FROM (SELECT doc_id, text, item_id, item, shift, kind, theirs, count(DISTINCT ours) AS n FROM slots GROUP BY ALL) GROUP BY ALL
), best AS (
  SELECT doc_id, item_id, item, coalesce(n_slots, 0) AS n_slots, coalesce(n_changed, 0) AS n_changed, row_number() OVER (PARTITION BY doc_id, item_id, item ORDER BY here DESC, coalesce(n_slots, 0) DESC, coalesce(n_changed, 0)) AS p
  FROM here LEFT JOIN ours USING (doc_id, text, item_id, item, shift) LEFT JOIN theirs USING (doc_id, text, item_id, item, shift) WHERE coalesce(n, 1) = 1 AND coalesce(m, 1) = 1
)
SELECT doc_id, item_id, matched, n_windows, round(matched / n_windows, 6) AS coverage, cast(n_slots AS BIGINT) AS n_slots, cast(n_changed AS BIGINT) AS n_changed FROM best JOIN pairs USING (doc_id, item_id, item) WHERE p = 1
"""

_OP6 = r"""
WITH RECURSIVE words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
), sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS same FROM shingles GROUP BY doc_id),
firsts AS (SELECT same, n, min(doc_id) AS id FROM sets GROUP BY same, n),
kept AS (SELECT doc_id AS id, s FROM shingles SEMI JOIN firsts ON doc_id = id),
links AS (
  SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS c FROM kept x JOIN kept y ON x.s = y.s AND x.id <> y.id GROUP BY ALL)
  JOIN firsts f ON f.id = a JOIN firsts g ON g.id = b WHERE 100 * c >= 75 * (f.n + g.n - c)
), reach AS (SELECT id, id AS other FROM firsts UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(g, d.doc_id) AS component_id FROM documents d
LEFT JOIN (SELECT doc_id, s.n, g FROM sets s JOIN firsts f USING (same) JOIN (SELECT id, min(other) AS g FROM reach GROUP BY id) r ON r.id = f.id) USING (doc_id)
"""

_OP11 = r"""
WITH asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS toks FROM documents
), whole AS (SELECT count(*) FILTER (len(toks) > 0) AS docs, cast(sum(len(toks)) AS BIGINT) AS total FROM docs),
postings AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(toks) AS n, unnest(toks) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL
), weights AS (SELECT term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term),
scored AS (
  SELECT item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM postings JOIN weights USING (term) JOIN asked USING (term), whole GROUP BY ALL
)
SELECT item_id, cast(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""

_OP12 = r"""
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (SELECT vec_id AS anchor_id, label AS own, v AS a FROM given WHERE vec_id % 100 = 0),
scored AS (SELECT anchor_id, own, vec_id, label, cast(list_dot_product(a, v) AS BIGINT) AS score FROM anchors, given),
positives AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE label = own AND vec_id <> anchor_id) WHERE place <= 5
), found AS (
  SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, cast(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 5
"""

SQL: dict[str, str] = {"op11_ranked_search": _OP11, "op12_hard_negatives": _OP12, "op1_chat_formatting": _OP1, "op4_benchmark_decontamination": _OP4, "op6_ngram_jaccard_join": _OP6, "op7_url_filters": _OP7}
