from pyspark.sql import functions as F

from corpusloom.operators import validation
from corpusloom.sources import evalsets, schemas


def test_claim_stages(spark):
    good = '{"loss_date": "2025-01-02", "peril": "fire", "estimated_severity": "minor", "coverage_flag": true}'
    asked = '{"policy_number": "POL-123456", "peril": "fire"}'
    rows = [("  ", None, None), ("not json", None, None), ('{"peril": "ice"}', None, None), (good, None, None), (good, "other", asked), (good, "check", '{"policy_number": "X", "peril": "fire"}'), (good.replace('"2025-01-02"', "null"), "check", asked)]
    d = spark.createDataFrame(rows, "t string, tool string, i string")
    got = [r[0] for r in d.select(validation.claim_stage(F.col("t"), F.col("tool"), F.col("i"), "check")).collect()]
    assert got == ["no_text_block", "json_parse", "claim_schema", "no_tool_call", "wrong_tool_name", "tool_schema", None]


def test_actions(spark):
    a = spark.createDataFrame([("call_tool", "x", {"id": "1"}, None, None), ("call_tool", "x", {}, None, None), ("call_tool", "y", {}, None, None), ("terminate", None, None, "approve", "r"), ("terminate", None, None, "maybe", "r"), ("jump", None, None, None, None)], "action string, tool string, args map<string,string>, decision string, reasoning string")
    t = spark.createDataFrame([("x", ["id"])], "tool string, required array<string>")
    got = sorted(str(r.error) for r in validation.action_error(a, t, ("approve", "deny")).collect())
    assert got == sorted(["None", "missing required args", "unregistered tool", "None", "invalid decision", "unknown action"])
    turns = spark.createDataFrame([("answer_directly", None, None, "r"), ("call_tool", "bal", "last", "r"), ("call_tool", "bal", "zzz", "r"), ("call_tool", "who", None, None)], "action string, tool string, account_reference string, reasoning string")
    ts = spark.createDataFrame([("bal", "account"), ("who", "customer")], "tool string, scope string")
    assert sorted(str(r.error) for r in validation.turn_error(turns, ts, ("last", "other")).collect()) == sorted(["None", "None", "invalid account_reference", "missing reasoning"])


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "g.yaml").write_text('version: 1\nqueries:\n  - {id: q1, query: "Fee?", type: fact, tenant: retail, expected: [{doc_id: d1, quote: "The  FEE", match: substring}, {doc_id: d2, quote: "the fee", match: substring}]}\n  - {id: q2, query: "Moon?", type: unanswerable, tenant: retail}\n', encoding="utf-8")
    (tmp_path / "p.yaml").write_text('probes:\n  - {id: r1, source_id: q1, variant: surface, expect_cache: hit, query: "fee"}\n  - {id: r2, source_id: q1, variant: tenant_swap, expect_cache: miss, tenant: business, query: "fee"}\n', encoding="utf-8")
    g = evalsets.read_yaml(spark, str(tmp_path / "g.yaml"), "queries", schemas.GOLDEN)
    p = evalsets.read_yaml(spark, str(tmp_path / "p.yaml"), "probes", schemas.PROBES)
    assert g.select("id").count() == 2 and evalsets.golden_items(g).select("query_id", "item").distinct().count() == 1
    items = {r.id: r for r in evalsets.all_items(evalsets.outcome_of(g), evalsets.probe_items(p, g)).collect()}
    assert items["q1"].expected_outcome == "answered" and items["q2"].expected_outcome == "not_in_corpus" and items["r1"].tenant == "retail" and items["r2"].tenant == "business"


def test_captions_and_observations(spark):
    d = spark.createDataFrame([("internal", "f", "i"), ("public", "", "i"), ("public", "f", "i")], "s string, l string, r string")
    assert [r[0] for r in d.select(validation.caption_action(F.col("s"), F.col("l"), F.col("r"))).collect()] == ["placeholder", "skip", "caption"]
    o = spark.createDataFrame([("x", None), (None, None), ("x", "e")], "a string, b string")
    assert [r[0] for r in o.select(validation.exactly_one(F.col("a"), F.col("b"))).collect()] == [True, False, False]
