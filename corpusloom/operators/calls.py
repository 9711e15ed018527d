"""Analytics over call records: rollups, costs, cache behaviour, grades and comparison of runs.

A call record: call_id, correlation_id, run_id, ts, kind, purpose, billable, tokens, local_cache, cost_usd, latency_ms, error.
Money is DECIMAL throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import params
from corpusloom.functions import text as tx
from corpusloom.operators import metrics
from corpusloom.params import BROADCAST_ROWS
from corpusloom.storage import small_enough

USD = "decimal(18,8)"


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """cost_usd from token counts and rates per million (model, input, cache_write, cache_read, output); an unknown model is an error.

    A model's own price goes before that of its undated name; a call is priced once.
    """
    rates = ("input", "cache_write", "cache_read", "output")
    table = prices.groupBy("model").agg(F.first(F.struct(*rates)).alias("p"))
    table = F.broadcast(table) if small_enough(table, BROADCAST_ROWS) else table
    exact, undated = (table.select(F.col("model").alias(f"{k}_model"), F.col("p").alias(k)) for k in ("exact", "undated"))
    j = calls.join(exact, F.col("model") == F.col("exact_model"), "left").join(undated, tx.model_name(F.col("model")) == F.col("undated_model"), "left")
    j = j.withColumn("price", F.coalesce("exact", "undated"))
    total = sum((F.coalesce(F.col(t), F.lit(0)) * F.col(f"price.{r}") for t, r in (("input_tokens", "input"), ("cache_creation_input_tokens", "cache_write"), ("cache_read_input_tokens", "cache_read"), ("output_tokens", "output"))), F.lit(0))
    cost = F.when(F.col("price").isNull(), F.raise_error(F.concat(F.lit("no price for "), "model")).cast(USD)).otherwise(F.round(total / 1_000_000, 8).cast(USD))
    return j.select(*calls.columns, cost.alias("cost_usd"))


def _millis(among: Column) -> Column:
    """Milliseconds of some calls to one place, summed as decimals so that the order of rows doesn't matter."""
    return F.round(F.sum(F.when(among, F.col("latency_ms").cast("decimal(18,4)")).otherwise(F.lit(0).cast("decimal(18,4)"))), 1).cast("double")


def rollup(calls: DataFrame) -> DataFrame:
    """One row for each interaction. The first model call decides whether the cache saw the question before."""
    llm = F.col("kind") == "llm"
    bill = F.when(F.col("billable"), F.col("cost_usd")).otherwise(F.lit(0).cast(USD))
    per = calls.groupBy("correlation_id").agg(
        F.sum(bill).alias("cost_usd"),
        F.count_if(llm).alias("llm_calls"),
        F.count_if(llm & (F.col("local_cache") == "hit")).alias("local_cache_hits"),
        _millis(llm).alias("llm_latency_ms"),
        _millis(F.col("kind").isin("local_model", "mcp_tool")).alias("local_latency_ms"),
        F.sum(F.when(llm, F.col("input_tokens")).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(llm, F.col("output_tokens")).otherwise(0)).alias("output_tokens"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("ts", "call_id", "error")))), lambda e: e["error"]).alias("errors"),
        F.min_by(F.when(llm, F.col("local_cache")), F.when(llm, F.struct("ts", "call_id"))).alias("first_call_cache"),
    )
    purposes = calls.where("billable").groupBy("correlation_id", "purpose").agg(F.sum("cost_usd").alias("cost"))
    by = purposes.groupBy("correlation_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("purpose", "cost")))).alias("cost_by_purpose"))
    hits_first = F.when(F.col("first_call_cache") == "hit", 1).otherwise(0)
    return per.join(by, "correlation_id", "left").withColumn("within_question_hits", F.col("local_cache_hits") - hits_first)


def run_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Cost and latency of a run's interactions (cost_usd, latency_ms, llm_calls, local_cache_hits, outcome)."""
    good = F.col("outcome") != "error"
    cost, ms = F.when(good, F.col("cost_usd")), F.when(good, F.col("latency_ms"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(~good).alias("errors"),
        F.round(F.avg(cost), 6).alias("cost_mean"),
        metrics.percentile_linear(cost.cast("double"), 0.5).alias("cost_p50"),
        metrics.percentile_linear(cost.cast("double"), 0.95).alias("cost_p95"),
        F.max(cost).alias("cost_max"),
        F.sum(cost).alias("cost_total"),
        metrics.percentile_linear(ms, 0.5).alias("latency_p50"),
        metrics.percentile_linear(ms, 0.95).alias("latency_p95"),
        F.max(ms).alias("latency_max"),
        F.round(F.sum("local_cache_hits") / F.nullif(F.sum("llm_calls"), F.lit(0)), 4).alias("hit_rate"),
    )


def rounds_distribution(rows: DataFrame, most: int = params.MAX_ROUNDS) -> DataFrame:
    """rounds, n for 0 to ``most``, zeros included."""
    every = rows.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("rounds"))
    return every.join(rows.groupBy("rounds").agg(F.count(F.lit(1)).alias("n")), "rounds", "left").select("rounds", F.coalesce("n", F.lit(0)).alias("n"))


def ledger_totals(ledger: DataFrame, *keys: str) -> DataFrame:
    """Totals overall and by each key, dearest first: one pass with grouping sets. Columns: title, name, calls, cost."""
    sets = [[], *[[F.col(k)] for k in keys]]
    title = F.lit("total")
    for k in keys:
        title = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(title)
    out = ledger.groupingSets(sets, *[F.col(k) for k in keys]).agg(title.alias("title"), F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost"))
    return out.select("title", F.coalesce(*[F.col(k).cast("string") for k in keys]).alias("name"), "calls", "cost").orderBy("title", F.desc("cost"), "name")


def budget_guard(ledger: DataFrame, guard: float, key: str, order: tuple[str, ...]) -> DataFrame:
    """Spend before each call within ``key``, and whether the guard would have stopped it."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost_usd").over(before), F.lit(0).cast(USD))
    return ledger.withColumn("spent_before", spent).withColumn("stopped", F.col("spent_before") >= F.lit(guard))


def extremes(rows: DataFrame, key: str, value: str, item: str, n: int = 5) -> DataFrame:
    """The n dearest and the n cheapest rows of each key."""
    top = Window.partitionBy(key).orderBy(F.desc(value), item)
    low = Window.partitionBy(key).orderBy(value, item)
    a = rows.withColumn("place", F.row_number().over(top)).where(F.col("place") <= n).withColumn("side", F.lit("most"))
    b = rows.withColumn("place", F.row_number().over(low)).where(F.col("place") <= n).withColumn("side", F.lit("least"))
    return a.unionByName(b)


def replay_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of every stable field that differs; nulls compare as values."""
    o = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields])
    j = new.select(key, *fields).join(o, key)
    each = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return j.select(key, F.explode(each).alias("field"))


def cache_replay(questions: DataFrame, session: str, order: tuple[str, ...]) -> DataFrame:
    """hit if the normalised question was asked before within the session, else miss."""
    keyed = questions.withColumn("cache_key", F.sha2(tx.question_key(F.coalesce("text", F.lit(""))), 256))
    seen = Window.partitionBy(session, "cache_key").orderBy(*order)
    return keyed.withColumn("result", F.when(F.row_number().over(seen) == 1, "miss").otherwise("hit"))


def probe_results(rows: DataFrame) -> DataFrame:
    """Probes by variant: n, as expected, hits within a question."""
    result = F.coalesce("first_call_cache", F.lit("miss"))
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(result == F.col("expect_cache")).alias("ok"), F.sum("within_question_hits").alias("within_question_hits"))


def confusion(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    return rows.groupBy(F.concat_ws("->", expected, actual).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def share(condition: Column, among: Column | None = None) -> Column:
    """Share of true values, null if there are none to count."""
    value = condition.cast("int")
    return F.round(F.avg(value if among is None else F.when(among, value)), 4)


def graded(rows: DataFrame) -> DataFrame:
    """Deterministic grades of interactions joined with their evaluation items.

    Columns in: gate_expected, gate_actual, outcome_expected, outcome, rounds, reply, source_line, citations (array of structs with
    doc_id, tenant, sensitivity), tenant, citation_hit, judge_verdict, round_verdicts.
    """
    outcome_ok = F.when(F.col("outcome_expected") == "answered_direct", (F.col("outcome") == "answered_direct") & (F.col("rounds") == 0)).otherwise(F.col("outcome") == F.col("outcome_expected"))
    line = F.col("source_line")
    line_ok = F.col("reply").endswith(line) & F.when(F.col("outcome") == "answered_direct", line.startswith("Source: general")).when(F.col("outcome") == "answered", line.startswith("Source: ") & ~line.startswith("Source: none found")).otherwise(line.startswith("Source: none found"))
    leak = F.exists("citations", lambda c: (c["sensitivity"] == "restricted") | (F.coalesce(c["tenant"], F.lit("")).isin("") == F.lit(False)) & (c["tenant"] != F.col("tenant")))
    out = rows.withColumn("gate_correct", F.col("gate_actual") == F.col("gate_expected")).withColumn("outcome_correct", outcome_ok)
    out = out.withColumn("source_line_ok", line_ok & (line != "")).withColumn("leak", leak)
    out = out.withColumn("declined_rounds", F.size(F.filter("round_verdicts", lambda v: v == "declined"))).withColumn("version_quoted", tx.names_version_in_force(F.col("reply")))
    success = F.when(F.col("outcome_expected") == "answered", F.col("outcome_correct") & (F.coalesce("judge_verdict", F.lit("")) == "correct") & F.coalesce("citation_hit", F.lit(False))).otherwise(F.col("outcome_correct"))
    return out.withColumn("task_success", success)


def quality_summary(grades: DataFrame, *keys: str) -> DataFrame:
    """Shares and counts over graded questions; a share of nothing is null."""
    answerable = F.col("outcome_expected") == "answered"
    declined_expected, declined = F.col("outcome_expected") == "not_in_corpus", F.col("outcome") == "not_in_corpus"
    return grades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("questions"),
        share(F.col("task_success")).alias("task_success"),
        F.count_if("task_success").alias("task_success_count"),
        share(F.col("gate_correct")).alias("gate_accuracy"),
        share(F.col("outcome_correct")).alias("outcome_correct"),
        share(F.col("outcome") == "answered", answerable).alias("answerable_answered"),
        share(F.coalesce("judge_verdict", F.lit("")) == "correct", answerable).alias("judge_correct"),
        share(F.coalesce("citation_hit", F.lit(False)), answerable).alias("citation_hit"),
        share(declined, declined_expected).alias("decline_recall"),
        share(declined_expected, declined).alias("decline_precision"),
        F.count_if(declined & answerable).alias("false_declines"),
        F.count_if(~F.col("source_line_ok")).alias("source_line_violations"),
        F.count_if("leak").alias("leaks"),
        F.sum("declined_rounds").alias("declined_rounds"),
    )


def model_comparison(rows: DataFrame, key: str) -> DataFrame:
    """One row for each run: success, cost, cost per success (null without one), latency."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("task_success").alias("successes"),
        F.sum("cost_usd").alias("cost_total"),
        F.round(F.sum("cost_usd") / F.nullif(F.count_if("task_success"), F.lit(0)), 6).alias("cost_per_success"),
        metrics.percentile_linear("latency_ms", 0.5).alias("latency_p50"),
        metrics.percentile_linear("latency_ms", 0.95).alias("latency_p95"),
    )


def sweep(rows: DataFrame, tau: str) -> DataFrame:
    """One row for each threshold, ascending: successes, false declines, mean rounds of questions that searched at all, cost, and rewrites that helped."""
    declined = (F.col("outcome") == "not_in_corpus") & (F.col("outcome_expected") == "answered")
    per = rows.groupBy(tau).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("task_success").alias("successes"),
        F.count_if(declined).alias("false_declines"),
        F.round(F.avg(F.when(F.col("rounds") > 0, F.col("rounds"))), 3).alias("mean_rounds"),
        F.round(F.avg("cost_usd"), 6).alias("cost_mean"),
        F.count_if("rewrite_helped").alias("rewrite_helped"),
        F.count_if("rescued_after_decline").alias("rescued_after_decline"),
    )
    return per.orderBy(tau)


def failing_anywhere(grades: DataFrame, key: str, run: str, runs: list, cell: Column) -> DataFrame:
    """Questions that failed in at least one run, one column for each run."""
    wide = grades.groupBy(key).pivot(run, runs).agg(F.first(cell))
    bad = F.lit(False)
    for r in runs:
        bad = bad | ~F.col(f"`{r}`").eqNullSafe("ok")
    return wide.where(bad)


def calibration_sample(judged: DataFrame, per_run: int, run: str, key: str) -> DataFrame:
    """All answers not judged correct, then evenly spaced correct ones, up to ``per_run``."""
    flagged = judged.where(F.col("judge_verdict") != "correct")
    n_flagged = flagged.groupBy(run).agg(F.count(F.lit(1)).alias("flagged"))
    good = judged.where(F.col("judge_verdict") == "correct").withColumn("at", F.row_number().over(Window.partitionBy(run).orderBy(key)) - 1)
    n_good = good.groupBy(run).agg(F.count(F.lit(1)).alias("good"))
    room = F.greatest(F.lit(per_run) - F.coalesce("flagged", F.lit(0)), F.lit(0))
    spaced = good.join(n_good, run).join(n_flagged, run, "left").withColumn("room", room).where(F.col("room") > 0)
    step = F.greatest(F.floor(F.col("good") / F.col("room")), F.lit(1))
    taken = spaced.where((F.col("at") % step == 0) & (F.col("at") / step < F.col("room"))).select(*judged.columns)
    return flagged.unionByName(taken)


def relabelled(items: DataFrame, relabels: DataFrame, tools: DataFrame) -> DataFrame:
    """Expected label of each item; a relabel holds only if its tool is advertised."""
    active = relabels.join(tools.select(F.col("tool").alias("requires_tool")), "requires_tool", "left_semi")
    return items.join(active.select("id", F.col("expected").alias("new_expected")), "id", "left").withColumn("relabelled", F.col("new_expected").isNotNull()).withColumn("expected", F.coalesce("new_expected", "expected")).drop("new_expected")


def tool_grades(rows: DataFrame) -> DataFrame:
    """Checks of tool questions as a map, the failed ones, and invented ids (mentioned, but neither own nor returned)."""
    unknown = F.array_except(tx.record_ids(F.col("reply")), "known_ids")
    # a text in a list of one is made plain once a row, not once for each alternative
    said = lambda text, test: F.element_at(F.transform(F.array(tx.fact_text(text)), test), 1)
    body, source = F.regexp_replace("reply", r"(?s)\n\n[^\n]*$", ""), F.element_at(F.split("reply", "\n\n"), -1)
    checks = F.create_map(
        F.lit("gate"), F.col("gate_actual") == F.col("gate_expected"),
        F.lit("tools"), F.size(F.array_except("tools_expected", "tools_called")) == 0,
        F.lit("outcome"), F.array_contains("outcomes_expected", F.col("outcome")),
        F.lit("facts"), said(F.col("reply"), lambda r: F.forall("facts", lambda f: tx.contains_fact(r, f, plain=True))),
        F.lit("must_not"), ~said(body, lambda r: F.exists("must_not", lambda f: tx.contains_fact(r, f, plain=True))),
        F.lit("source_line"), source.startswith("Source:") & ((F.col("outcome") != "answered_from_records") | source.rlike(tx.RECORD_ID)),
        F.lit("no_invented_ids"), F.size(unknown) == 0,
        F.lit("no_forbidden_write"), ~F.array_contains("tools_ok", "freeze_card"),
    )
    out = rows.withColumn("invented_ids", F.array_sort(unknown)).withColumn("checks", checks)
    out = out.withColumn("failed", F.array_sort(F.map_keys(F.map_filter("checks", lambda k, v: ~v))))
    return out.withColumn("passed", F.size("failed") == 0)


def check_rates(grades: DataFrame) -> DataFrame:
    """passed and n of each check."""
    # for a plain explode Spark infers a filter on the map's size, which computes every check twice and all their inputs anew for each use
    each = grades.select(F.explode_outer("checks").alias("check", "ok")).where(F.col("check").isNotNull())
    return each.groupBy("check").agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("n"))


def gate_scores(items: DataFrame, relabels: DataFrame, tools: DataFrame, *keys: str) -> DataFrame:
    """n, right answers of the gate by its stated labels and by those that the advertised tools leave valid. ``items``: id, expected, actual."""
    marked = relabelled(items.withColumn("stated", F.col("expected")), relabels, tools)
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("actual") == F.col("stated")).alias("raw"), F.count_if(F.col("actual") == F.col("expected")).alias("right"), F.count_if("relabelled").alias("relabelled"))


def grade_changes(old: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """change (old->new), n of the grades that differ between two gradings; a null grade is none."""
    none = F.lit("none")
    before = old.select(key, F.coalesce(field, none).alias("before"))
    both = new.select(key, F.coalesce(field, none).alias("after")).join(before, key).where("before <> after")
    return both.groupBy(F.concat_ws("->", "before", "after").alias("change")).agg(F.count(F.lit(1)).alias("n"))


def without_interaction(calls: DataFrame) -> DataFrame:
    """Calls that name no interaction, which no bill counts."""
    return calls.where(F.coalesce("correlation_id", F.lit("")) == "")


def to_judge(rows: DataFrame, item: str, question: str, answer: str) -> DataFrame:
    """item and what the judge is asked, of answers to answerable questions; others need no judge."""
    asked = F.concat(F.lit("Question:\n"), F.col(question), F.lit("\n\nAnswer:\n"), F.col(answer))
    return rows.where((F.col("outcome_expected") == "answered") & (F.col("outcome") == "answered")).select(item, asked.alias("request"))


def latest_run(rows: DataFrame, run: str, *keys: str) -> DataFrame:
    """The rows of each key's latest run."""
    return rows.join(rows.groupBy(*keys).agg(F.max(run).alias(run)), [*keys, run], "left_semi")
