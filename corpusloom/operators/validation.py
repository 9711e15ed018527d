"""Checks of structured answers: the first stage that fails names the error, else null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.filters import first_error

# Fixed values of the contracts.
PERILS = ("fire", "water", "wind", "hail", "theft", "vandalism", "liability", "collision", "flood", "other")
SEVERITIES = ("minor", "moderate", "severe", "total_loss")
POLICY_STATUSES = ("active", "lapsed", "cancelled", "pending")
POLICY_NUMBER = r"^POL-\d{6}$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
CLAIM = "loss_date string, peril string, estimated_severity string, coverage_flag boolean"


def claim_stage(text: Column, tool: Column, tool_input: Column, wanted_tool: str) -> Column:
    """The stage at which a model's claim answer fails: no_text_block, json_parse, claim_schema, no_tool_call, wrong_tool_name, tool_schema."""
    said = F.coalesce(F.trim(text), F.lit("")) != ""
    claim = F.from_json(text, CLAIM + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    date_ok = claim["loss_date"].isNull() | claim["loss_date"].rlike(ISO_DATE)
    shape = date_ok & claim["peril"].isin(*PERILS) & claim["estimated_severity"].isin(*SEVERITIES) & claim["coverage_flag"].isNotNull()
    asked = F.from_json(tool_input, "policy_number string, peril string")
    return first_error(
        (said, "no_text_block"),
        (F.try_parse_json(text).isNotNull(), "json_parse"),
        (shape, "claim_schema"),
        (tool.isNotNull(), "no_tool_call"),
        (tool == wanted_tool, "wrong_tool_name"),
        (asked["policy_number"].rlike(POLICY_NUMBER) & asked["peril"].isin(*PERILS), "tool_schema"),
    )


def action_error(actions: DataFrame, tools: DataFrame, decisions: tuple[str, ...]) -> DataFrame:
    """error of each planner action (action, tool, args map, decision, reasoning): a known tool with its required arguments, or a decision with a reason."""
    j = actions.join(tools.select("tool", "required"), "tool", "left")
    missing = F.array_except("required", F.map_keys("args"))
    call = first_error((F.col("required").isNotNull(), "unregistered tool"), (F.col("args").isNotNull(), "missing args"), (F.size(missing) == 0, "missing required args"))
    stop = first_error((F.col("decision").isin(*decisions), "invalid decision"), (F.col("reasoning").isNotNull(), "missing reasoning"))
    return j.withColumn("error", F.when(F.col("action") == "call_tool", call).when(F.col("action") == "terminate", stop).otherwise("unknown action")).drop("required")


def turn_error(turns: DataFrame, tools: DataFrame, references: tuple[str, ...]) -> DataFrame:
    """error of each conversation decision (action, tool, account_reference, reasoning); ``tools``: tool, scope."""
    j = turns.join(tools.select("tool", "scope"), "tool", "left")
    reason = (F.col("reasoning").isNotNull(), "missing reasoning")
    account = (F.col("scope") != "account") | F.col("account_reference").isin(*references)
    tool = first_error((F.col("scope").isNotNull(), "unregistered tool"), (account, "invalid account_reference"), reason)
    return j.withColumn("error", F.when(F.col("action") == "answer_directly", first_error(reason)).when(F.col("action").isin("call_tool", "recall_from_history"), tool).otherwise("unknown action")).drop("scope")


def caption_action(sensitivity: Column, figure_label: Column, image_ref: Column) -> Column:
    """Whether a figure may be captioned: public documents and linked figures only."""
    linked = (F.coalesce(figure_label, F.lit("")) != "") & (F.coalesce(image_ref, F.lit("")) != "")
    return F.when(sensitivity != "public", "placeholder").when(~linked, "skip").otherwise("caption")


def exactly_one(result: Column, error: Column) -> Column:
    """An observation has a result or an error, not both and not neither."""
    return result.isNotNull() != error.isNotNull()
