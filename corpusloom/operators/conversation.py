"""Conversation state and agent control as window logic over recorded turns and rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import params


def references(turns: DataFrame, session: str = "session_id", turn: str = "turn", ref: str = "account_id") -> DataFrame:
    """last_reference and references (distinct, first seen first) before each turn."""
    before = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("last_reference", F.last(ref, ignorenulls=True).over(before)).withColumn("references", F.array_distinct(F.collect_list(ref).over(before)))


def the_other(accounts: Column, seen: Column) -> Column:
    """The only account not yet referenced, else null."""
    rest = F.array_except(accounts, seen)
    return F.when(F.size(rest) == 1, F.element_at(rest, 1))


def resolve(kind: Column, explicit: Column, accounts: Column, last: Column, seen: Column) -> Column:
    """(account_id, reason): explicit accounts must be the customer's own; 'last' and 'other' are looked up."""
    other = the_other(accounts, seen)
    account = F.when((kind == "explicit") & F.array_contains(accounts, explicit), explicit).when(kind == "last", last).when(kind == "other", other)
    reason = F.when(account.isNotNull(), F.lit(None)).when(kind == "explicit", "not one of the customer's accounts").when(kind == "last", "nothing was referenced before").when(kind == "other", "not exactly one other account").otherwise("no account needed")
    return F.struct(account.alias("account_id"), reason.alias("reason"))


def recall(turns: DataFrame) -> DataFrame:
    """The latest outcome found before each turn for the same session, tool and account (null accounts are alike)."""
    before = Window.partitionBy("session_id", "tool", "account_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("recalled", F.last(F.when(F.col("outcome_status") == "found", F.col("outcome")), ignorenulls=True).over(before))


def repeated_queries(rounds: DataFrame) -> DataFrame:
    """Whether a query repeats an earlier one of its question, but for case."""
    before = Window.partitionBy("correlation_id", F.lower("query")).orderBy("n")
    return rounds.withColumn("repeated", F.row_number().over(before) > 1)


def fault_schedule(attempts: DataFrame, resource: str, order: str, period: int = 3) -> DataFrame:
    """Fails until each ``period``-th attempt at a resource."""
    return attempts.withColumn("ok", F.row_number().over(Window.partitionBy(resource).orderBy(order)) % period == 0)


def first_breach(steps: DataFrame, most_steps: int, most_tokens: int, most_seconds: float) -> DataFrame:
    """Each session's status: which limit stops it first, checked before every step, or success.

    ``steps``: session_id, step (from 1), tokens, elapsed (seconds since the start, before the step), terminates.
    """
    before = Window.partitionBy("session_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    status = F.when(F.col("step") > most_steps, "terminated_iteration_limit").when((used >= most_tokens) | (F.col("elapsed") >= most_seconds), "terminated_budget_limit").when(F.col("terminates"), "terminated_success")
    return steps.withColumn("status", status).where(F.col("status").isNotNull()).groupBy("session_id").agg(F.min_by("status", "step").alias("status"), F.min("step").alias("at_step"))


def round_verdict(status: Column, cited: Column, kept: Column) -> Column:
    """answered only if something was cited and all of it was given; else ungrounded, declined or error."""
    grounded = (F.size(F.array_distinct(cited)) > 0) & (F.size(F.array_except(cited, kept)) == 0)
    return F.when((status == "answered") & grounded, "answered").when(status == "answered", "ungrounded").when(status == "not_in_corpus", "declined").otherwise("error")


def next_step(verdict: Column, n: Column, most: int = params.MAX_ROUNDS) -> Column:
    """Where a round leads: generate, finalise, planner again, or not_in_corpus at the cap."""
    return F.when(verdict == "usable", "generate").when(verdict == "answered", "finalise").when(n < most, "planner").otherwise("not_in_corpus")


def replay(rounds: DataFrame) -> DataFrame:
    """outcome, rounds, rewrite_helped and rescued_after_decline of each recorded question (correlation_id, n, verdict)."""
    r = rounds.groupBy("correlation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "verdict"))), lambda x: x["verdict"]).alias("v"))
    earlier = F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0)))
    answered = F.element_at("v", -1) == "answered"
    return r.select(
        "correlation_id",
        F.when(answered, "answered").otherwise("not_in_corpus").alias("outcome"),
        F.size("v").alias("rounds"),
        (answered & F.exists(earlier, lambda x: x == "poor")).alias("rewrite_helped"),
        (answered & F.exists(earlier, lambda x: x == "declined")).alias("rescued_after_decline"),
        F.col("v").alias("round_verdicts"),
    )


def decline_reason(verdicts: Column, last_reason: Column) -> Column:
    n = F.size(verdicts)
    return F.when(F.element_at(verdicts, -1) == "poor", F.concat(F.lit("no chunk scored >= tau after "), n, F.lit(" rounds"))).otherwise(F.concat(F.lit("answer step did not answer in round "), n, F.lit(": "), F.coalesce(last_reason, F.lit(""))))


def source_lines(citations: DataFrame) -> DataFrame:
    """The source line of each answer: its documents in the order of first citation, with version, pages and sections.

    ``citations``: correlation_id, pos, doc_id, title, version, effective_date, page, section, generated.
    """
    per = citations.groupBy("correlation_id", "doc_id").agg(
        F.min("pos").alias("first"),
        F.min_by(F.struct("title", "version", "effective_date"), "pos").alias("c"),
        F.array_sort(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when((F.col("section") != "") & (F.col("section") != F.col("title")), F.struct("pos", "section")))), lambda s: s["section"])).alias("sections"),
        F.bool_or("generated").alias("generated"),
    )
    detail = F.concat_ws(", ", F.when(F.col("c.version") != "", F.concat(F.lit("version "), "c.version")), F.when(F.col("c.effective_date") != "", F.concat(F.lit("effective "), "c.effective_date")))
    entry = F.concat(
        F.col("c.title"),
        F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""),
        F.when(F.size("pages") > 0, F.concat(F.lit(", p."), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "))).otherwise(""),
        F.when(F.size("sections") > 0, F.concat(F.lit(", "), F.array_join("sections", "; "))).otherwise(""),
        F.when(F.col("generated"), " [includes a model-generated figure caption]").otherwise(""),
    )
    lines = per.select("correlation_id", F.struct("first", entry.alias("entry")).alias("e")).groupBy("correlation_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return lines.select("correlation_id", F.concat(F.lit("Source: "), F.array_join(F.transform("es", lambda e: e["entry"]), " | ")).alias("source_line"))


def observations(attempts: DataFrame, most: int = 3) -> DataFrame:
    """call_id, attempts, result, error: the first success within ``most`` attempts, else the last of their errors.

    ``attempts``: call_id, attempt (from 1), result, error (null for a success).
    """
    ok = F.col("error").isNull()
    per = attempts.where(F.col("attempt") <= most).groupBy("call_id").agg(
        F.min(F.when(ok, F.col("attempt"))).alias("good"),
        F.max("attempt").alias("tried"),
        F.min_by("result", F.when(ok, F.col("attempt"))).alias("result"),
        F.max_by("error", "attempt").alias("error"),
    )
    failed = F.col("good").isNull()
    return per.select("call_id", F.coalesce("good", "tried").alias("attempts"), F.when(~failed, F.col("result")).alias("result"), F.when(failed, F.col("error")).alias("error"))


def history(turns: DataFrame, most: int, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """What was said in up to ``most`` turns (role, text) before each one, a line for each; empty at the start."""
    before = Window.partitionBy(session).orderBy(turn).rowsBetween(-most, -1)
    line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))


def attempts_text(rounds: DataFrame, most: int = params.MAX_ROUNDS) -> DataFrame:
    """correlation_id and its rounds (n, query, verdict) as the text that the planner is shown."""
    r = rounds.where(F.col("n") <= most).groupBy("correlation_id").agg(F.array_sort(F.collect_list(F.struct("n", "query", "verdict"))).alias("r"))
    line = lambda x: F.concat(F.lit("Round "), x["n"].cast("string"), F.lit(": "), x["query"], F.lit(" ["), x["verdict"], F.lit("]"))
    return r.select("correlation_id", F.array_join(F.transform("r", line), "\n").alias("attempts"))
