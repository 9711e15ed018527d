"""One query for each operator of the engine over the driver's tables. Money comes out as DOUBLE of an exact DECIMAL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import params
from corpusloom.functions import text as tx
from corpusloom.operators import calls as ca
from corpusloom.operators import chunking, cleaning, conversation, dedupe, filters, metrics, pii, records, retrieval
from corpusloom.plans import tables as t
from corpusloom.sources import loaders
from corpusloom.sources.lexical import LexicalIndex
from corpusloom.storage import shared_dir, spread

#: A stated query set against all rows: every vector whose id is divisible by this.
QUERY_STEP = 50


def _docs(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def _questions(spark, sf_dir):
    return t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _dollars(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def _index(spark, sf_dir):
    """The stored index of the documents: the first query that asks for it builds it, later ones find it in the shared folder."""
    return LexicalIndex.of(_docs(spark, sf_dir), shared_dir(spark))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents of every benchmark text."""
    return _index(spark, sf_dir).top(_questions(spark, sf_dir)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).term_statistics().select("term", F.round("idf", 6).alias("idf"))


def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents that a retail reader may see: the filter comes before the cut, statistics cover all documents."""
    docs = t.catalogued_documents(spark, sf_dir)
    hits = _index(spark, sf_dir).top(_questions(spark, sf_dir), keep=docs.where(filters.where(filters.access("retail"))).select("doc_id"))
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def leak_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an unfiltered search would leak to a retail reader, query by query."""
    docs = t.catalogued_documents(spark, sf_dir)
    hits = retrieval.enrich(_index(spark, sf_dir).top(_questions(spark, sf_dir)), docs.drop("text"))
    return metrics.leaks(hits, "retail", "query_id")


def query_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usable or poor for every query, by a threshold on its vector hits."""
    return filters.verdicts(_vector_hits(spark, sf_dir), 0.5, "query_id")


def _vector_hits(spark, sf_dir, n=params.RETRIEVAL["top_k"]):
    v = t.table(spark, sf_dir, "embeddings")
    asked = v.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_top(spread(v.select("vec_id", "embedding")), asked, n)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_hits(spark, sf_dir).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def _label_hits(spark, sf_dir, n):
    """A second retriever: vectors of the query's label, by id distance."""
    v = t.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = v.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "label", "vec_id")
    return retrieval.neighbours(v, asked, "label", "vec_id", n)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of two hit lists of 50 candidates each."""
    n = params.RETRIEVAL["candidates"]
    fused = retrieval.rrf(_vector_hits(spark, sf_dir, n), _label_hits(spark, sf_dir, n), item="vec_id")
    return fused.where(F.col("rank") <= params.RETRIEVAL["top_k"]).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_stage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = params.RETRIEVAL["candidates"]
    out = retrieval.merge_stages(_label_hits(spark, sf_dir, n), _vector_hits(spark, sf_dir, n), item="vec_id")
    return out.select("query_id", "vec_id", F.col("bm25_rank").cast("long").alias("label_rank"), F.col("vector_rank").cast("long").alias("vector_rank"), "vector_score")


def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items for each query: vectors of its label with an even and with an odd id."""
    v = t.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = v.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"))
    items = asked.select("query_id", F.explode(F.array(F.lit("even"), F.lit("odd"))).alias("item"))
    hits = _vector_hits(spark, sf_dir).join(v, "vec_id").join(asked, "query_id").where((F.col("label") == F.col("q_label")) & (F.col("vec_id") != F.col("query_id")))
    matches = hits.select("query_id", F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("item"), "rank")
    return metrics.scored(matches, items).select("query_id", F.col("k").cast("long").alias("k"), "n_items", "recall", "precision", "ceiling")


def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages overall and by the query's label."""
    v = t.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    per = recall_precision(spark, sf_dir).join(v, "query_id")
    out = metrics.macro(per, "label")
    return out.select("k", "label", "n_queries", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round("ceiling", 6).alias("ceiling"))


def near_empty_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.near_empty(_docs(spark, sf_dir)).select("doc_id", "status", "reason")


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cleaning.near_empty(_docs(spark, sf_dir))
    return made.groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.exact_groups(_docs(spark, sf_dir))


def canonical_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred copy of equal texts: no copy marker in its name, better format, earlier date. Names, formats and dates follow the ids."""
    n = F.col("doc_id")
    name = F.concat(F.lit("d"), n.cast("string"), F.when(n % 3 == 0, " copy").otherwise(""))
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("txt", "pdf", "zip", "md")]), (n % 4 + 1).cast("int"))
    date = F.when(n % 5 != 0, F.concat(F.lit("2024-0"), (n % 5).cast("string"), F.lit("-01")))
    return dedupe.exact_groups(_docs(spark, sf_dir), order=dedupe.preference(name, fmt, date))


def near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near copies, the most alike first."""
    return dedupe.near_pairs(_docs(spark, sf_dir)).select("a", "b", F.round("jaccard", 6).alias("jaccard")).orderBy(F.desc("jaccard"), "a", "b")


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.near_groups(_docs(spark, sf_dir))


def closest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's most similar other one, however little they have in common."""
    return dedupe.closest(_docs(spark, sf_dir)).select("doc_id", "other", F.round("jaccard", 6).alias("jaccard"))


def quote_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark text."""
    quotes = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return metrics.quote_hits(_docs(spark, sf_dir), quotes)


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", pii.count_of(F.col("text"), "EMAIL").cast("long").alias("emails"), pii.count_of(F.col("text"), "PHONE").cast("long").alias("phones"), pii.count_of(F.col("text"), "SSN").cast("long").alias("ssns"))


def pii_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scrub(spread(_docs(spark, sf_dir).select("doc_id", "text")))
    return out.select("doc_id", F.sha2("text", 256).alias("sha256"), F.size("pii_spans").cast("long").alias("n_spans"))


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source: lines in the band of many of them."""
    docs = _docs(spark, sf_dir)
    lines = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cleaning.running_lines(lines, share=0.05).select("doc_id", "key", "on", "pages")


def whitespace_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _docs(spark, sf_dir).withColumn("clean", tx.clean_whitespace(F.col("text")))
    return out.select("doc_id", F.sha2("clean", 256).alias("sha256"), F.length("clean").cast("long").alias("n_clean"))


def _page_blocks(spark, sf_dir):
    pages = t.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("format"), F.col("html").cast("binary").alias("content"))
    return loaders.parse(pages).withColumn("doc_id", F.col("path").cast("long"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_blocks(spark, sf_dir).select("doc_id", "pos", "type", F.sha2("text", 256).alias("sha256"), "source_hint")


def html_without_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.remove_boilerplate(_page_blocks(spark, sf_dir))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "char_start", "char_end", F.sha2("text", 256).alias("sha256"))


def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = cleaning.remove_boilerplate(_page_blocks(spark, sf_dir)).select("doc_id", "pos", "type", "text", "level")
    return chunking.structure_chunks(chunking.section_paths(blocks)).select("doc_id", "chunk_index", "char_start", "char_end", "prefix_chars", F.sha2("text", 256).alias("sha256"))


def interaction_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ca.rollup(t.calls(spark, sf_dir))
    purposes = [F.col("cost_by_purpose")[p].cast("double").alias(f"cost_{p}") for p in ("click", "purchase", "signup", "view")]
    return _dollars(out.select("correlation_id", "cost_usd", "llm_calls", "local_cache_hits", "llm_latency_ms", "local_latency_ms", "input_tokens", "output_tokens", F.size("errors").cast("long").alias("n_errors"), F.get("errors", F.lit(0)).alias("first_error"), "first_call_cache", "within_question_hits", *purposes), "cost_usd")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions grouped into runs by the user's last digit."""
    rows = ca.rollup(t.calls(spark, sf_dir)).select((F.col("correlation_id") % 10).alias("run"), "cost_usd", F.col("llm_latency_ms").alias("latency_ms"), "llm_calls", "local_cache_hits", F.when(F.size("errors") > 15, "error").otherwise("answered").alias("outcome"))
    return _dollars(ca.run_summary(rows, "run"), "cost_mean", "cost_max", "cost_total")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear, nearest-rank and upper-median percentiles by kind of event."""
    e = t.table(spark, sf_dir, "events")
    smooth = e.groupBy("event_type").agg(metrics.percentile_linear("value", 0.5).alias("p50"), metrics.percentile_linear("value", 0.95).alias("p95"), F.round(F.avg("value"), 4).alias("mean"))
    return smooth.join(metrics.picked(e, "value", {"p95_nearest": metrics.nearest_place(0.95), "p50_upper": metrics.middle_place()}, "event_type"), "event_type", "left")


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = t.calls(spark, sf_dir).where("billable").select("purpose", F.date_format("ts", "yyyy-MM").alias("run_id"), F.col("kind").alias("model"), "cost_usd")
    return _dollars(ca.ledger_totals(ledger, "run_id", "purpose", "model"), "cost")


def budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user that a cap would have stopped."""
    out = ca.budget_guard(t.calls(spark, sf_dir), 500.0, "correlation_id", ("ts", "call_id"))
    return _dollars(out.select("call_id", "correlation_id", "spent_before", "stopped"), "spent_before")


def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token costs with four rates; dated model names are priced as their undated ones."""
    prices = spark.createDataFrame([("small", 1.0, 1.25, 0.1, 5.0), ("large", 5.0, 6.25, 0.5, 25.0)], "model string, input double, cache_write double, cache_read double, output double")
    li = t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "large").when(F.col("l_returnflag") == "A", "small").otherwise("small-20250101").alias("model"),
        (F.col("l_quantity") * 1000).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("cache_creation_input_tokens"), F.col("l_linenumber").cast("long").alias("cache_read_input_tokens"), F.col("l_partkey").alias("output_tokens"),
    )
    out = ca.priced(li, prices)
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").cast("double").alias("cost_usd"))


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five dearest and five cheapest orders of each customer."""
    o = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ca.extremes(o, "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice", "side", F.col("place").cast("long").alias("place"))


def newest_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten newest orders of each customer; customers without orders stay."""
    out = records.newest(t.accounts(spark, sf_dir), t.transactions(spark, sf_dir), "account_id", "posted_on", "transaction_id", 10)
    return _dollars(out.select("account_id", "transaction_id", F.date_format("posted_on", "yyyy-MM-dd").alias("posted_on"), "amount", F.col("place").cast("long").alias("place")), "amount")


def accounts_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = t.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("member_id"))
    return _dollars(records.by_owner(owners, t.accounts(spark, sf_dir), "member_id").select("member_id", "account_id", "type", "balance"), "balance")


def account_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts asked for by suppliers' keys: ok or not_found."""
    asked = t.table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("account_id"))
    return _dollars(records.lookup(asked, t.accounts(spark, sf_dir), "account_id").select("account_id", "outcome", "balance"), "balance")


def json_limit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as policies with a JSON limit map: one peril is there, the other isn't; some asked policies don't exist."""
    events = t.table(spark, sf_dir, "events")
    policies = events.where(F.col("event_type") != "error").select(F.col("event_id").alias("policy_number"), F.col("event_type").alias("status"), F.col("props").alias("coverage_limits"))
    asked = events.select(F.col("event_id").alias("policy_number"), F.when(F.col("user_id") % 2 == 0, "k").otherwise("flood").alias("peril"))
    return records.policy_limit(asked, policies)


def figure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's answer reports its largest line, its sum, and a figure off by one; the last one traces to nothing."""
    li = t.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    fields = li.select("l_orderkey", F.lit("amount").alias("name"), F.col("amount").cast("string").alias("value"))
    allowed = records.allowed_figures(fields, "l_orderkey")
    answers = li.groupBy("l_orderkey").agg(F.max("amount").alias("top"), F.sum("amount").alias("total"))
    said = F.concat(F.lit("Largest $"), F.col("top").cast("string"), F.lit(", in all $"), F.col("total").cast("string"), F.lit(", not $"), (F.col("total") + 1).cast("string"), F.lit("."))
    j = answers.withColumn("answer", said).join(allowed, "l_orderkey")
    bad = records.unverified(F.col("answer"), F.col("allowed"))
    return j.select("l_orderkey", F.size(tx.figures(F.col("answer"))).cast("long").alias("figures"), F.array_join(F.transform(bad, lambda x: x.cast("string")), ",").alias("unverified"))


def authz_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls of two callers, through authorization and argument checks."""
    e = t.table(spark, sf_dir, "events")
    made = e.select(F.col("event_id").alias("call_id"), F.when(F.col("user_id") % 2 == 0, "member_assistant").otherwise("contact_centre").alias("caller"), F.col("event_type").alias("tool"), F.create_map(F.when(F.col("event_id") % 5 == 0, "extra").otherwise("k"), F.col("props")).alias("arguments"), F.lit(None).cast("string").alias("run_outcome"))
    reads = ["view", "click", "signup"]
    grants = spark.createDataFrame([("member_assistant", x) for x in reads] + [("contact_centre", x) for x in [*reads, "purchase"]], "caller string, tool string")
    tools = spark.createDataFrame([(x, ["k"], ["k"]) for x in ["view", "click", "purchase"]], "tool string, declared array<string>, required array<string>")
    return filters.enforce(made, grants, tools).select("call_id", "caller", "tool", "decision", "outcome", "error")


def reference_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns refer to the account that their length points to, every third turn to none."""
    c = t.table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    turns = c.select(F.col("conv_id").alias("session_id"), "turn", F.when(F.col("turn") % 3 != 2, F.concat(F.lit("A"), (F.length("text") % 3).cast("string"))).alias("account_id"))
    seen = conversation.references(turns)
    own = F.array(F.lit("A0"), F.lit("A1"), F.lit("A2"))
    return seen.select("session_id", "turn", "last_reference", F.array_join("references", ",").alias("refs"), conversation.the_other(own, F.col("references")).alias("other"))


def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen and repeated questions by role over all conversations."""
    c = t.table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", "text")
    return ca.cache_replay(c, "role", ("conv_id", "turn")).select("role", "conv_id", "turn", "result")


def replay_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the events: every tenth type and every hundredth value differ."""
    e = t.table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    new = e.withColumn("event_type", F.when(F.col("event_id") % 10 == 0, "view").otherwise(F.col("event_type"))).withColumn("value", F.when(F.col("event_id") % 100 == 0, F.lit(None)).otherwise(F.col("value")))
    return ca.replay_diff(e, new, "event_id", ["event_type", "value", "props"])


def per_run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents that fail quality or toxicity, one column each."""
    lab = t.table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    grades = lab.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("run"), F.when(F.col("quality") == 1, "ok").otherwise("low").alias("cell")), F.struct(F.lit("toxic").alias("run"), F.when(F.col("toxic") == 0, "ok").otherwise("toxic").alias("cell")))).alias("g")).select("doc_id", "g.*")
    return ca.failing_anywhere(grades, "doc_id", "run", ["quality", "toxic"], F.col("cell"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.confusion(t.table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")), "quality", "toxic")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, and labels without a document."""
    d, lab = t.table(spark, sf_dir, "documents").select("doc_id"), t.table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_anti").withColumn("side", F.lit("document")).unionByName(lab.join(d, "doc_id", "left_anti").withColumn("side", F.lit("label")))


def round_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first three events as recorded rounds of one question."""
    verdict = F.create_map(*[F.lit(x) for kv in {"view": "answered", "purchase": "answered", "click": "poor", "signup": "declined", "error": "error"}.items() for x in kv])
    e = t.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", verdict[F.col("event_type")].alias("verdict"))
    first = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where(F.col("n") <= params.MAX_ROUNDS)
    out = conversation.replay(first.select(F.col("user_id").alias("correlation_id"), "n", "verdict"))
    return out.select("correlation_id", "outcome", F.col("rounds").cast("long").alias("rounds"), "rewrite_helped", "rescued_after_decline")


def rounds_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many days had how many errors, modulo 4 and with zeros filled."""
    e = t.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.count_if(F.col("event_type") == "error") % 4).cast("int").alias("rounds"))
    return ca.rounds_distribution(e, 3).select(F.col("rounds").cast("long").alias("rounds"), "n")


def loop_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which limit stops a user's sequence of events first: 50 steps, 1500 tokens, or a purchase above 150 ends it."""
    e = t.table(spark, sf_dir, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    steps = e.select(F.col("user_id").alias("session_id"), "step", F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.lit(0.0).alias("elapsed"), ((F.col("event_type") == "purchase") & (F.col("value") > 150)).alias("terminates"))
    out = conversation.first_breach(steps, 50, 1500, 60.0)
    return out.select("session_id", "status", F.col("at_step").cast("long").alias("at_step"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines of conversations whose turns cite documents."""
    c = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("correlation_id"), F.col("turn").alias("pos"), (F.length("text") % 7).alias("d"), F.length("text").alias("n"))
    cites = c.select("correlation_id", "pos", F.col("d").alias("doc_id"), F.concat(F.lit("Doc "), F.col("d").cast("string")).alias("title"), F.when(F.col("d") % 2 == 0, "3.0").otherwise("").alias("version"), F.when(F.col("d") % 3 == 0, "2025-01-01").otherwise("").alias("effective_date"), (F.col("n") % 5 - 1).alias("page"), F.when(F.col("n") % 2 == 0, "Fees").otherwise("").alias("section"), (F.col("n") % 11 == 0).alias("generated"))
    return conversation.source_lines(cites)


def windowed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each kind of event in windows of an hour: the batch form of the streaming query."""
    e = t.table(spark, sf_dir, "events")
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("cost"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "calls", "cost")
