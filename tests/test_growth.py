"""Work that must not be done over again as tables grow."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import calls, metrics, records


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_checks_are_computed_once(spark):
    rows = spark.createDataFrame([(1, "a|b"), (2, "c"), (3, None)], "id long, text string")
    rated = calls.check_rates(rows.select(F.when(F.col("id") < 3, F.create_map(F.lit("gate"), F.col("text").contains("b"), F.lit("tools"), F.col("id") > 1)).alias("checks")))
    assert sorted(tuple(r) for r in rated.collect()) == [("gate", 1, 2), ("tools", 1, 2)]
    assert optimized(rated).count("map(gate") == 1


def flat(value, path="$"):
    """Fields of a parsed JSON value, by recursion."""
    for k, v in value.items() if isinstance(value, dict) else enumerate(value):
        inner = f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]"
        if isinstance(v, (dict, list)):
            yield from flat(v, inner)
        elif isinstance(value, dict) and v is not None:
            yield path, k, v


@pytest.mark.parametrize("depth, written", [(3, 1), (12, 4)])
def test_levels_are_written_together(spark, monkeypatch, depth, written):
    value = {"a": "0", "empty": {}, "none": [], "braces": "{}", "brackets": "[]", "null": None}
    for k in range(1, depth):
        value = {"a": str(k), "in": [value, [], "x", None, [{"b": "y"}]]} if k % 2 else {"a": str(k), "in": value, "empty": ""}
    tables = []
    monkeypatch.setattr(records, "materialize", lambda df, name, keep=records.materialize: tables.append(name) or keep(df, name))
    got = records.flatten_json(spark.createDataFrame([(1, json.dumps(value)), (2, "7"), (3, '"{}"'), (4, "{}")], "call_id long, data string"), "call_id", "data")
    assert sorted(tuple(r) for r in got.collect()) == sorted((1, *f) for f in flat(value))
    assert len(tables) <= written


@pytest.mark.parametrize("bound", [10_000, 0])
def test_texts_are_listed_once_and_stay_in_place(spark, monkeypatch, bound):
    monkeypatch.setattr(metrics, "BROADCAST_QUOTES", bound)
    docs = [(1, "unabashedly\x01so the long-worded text"), (2, "abashed ly"), (3, None), (4, "the " * 3000 + "Abashedly"), (5, "ab\x01cdefgh"), (5, "so"), (6, "y" * 50_000 + "abashedly so")]
    quotes = [(1, "abashedly so"), (2, "AB\x01CDEFGH"), (3, "abashedly"), (4, "so"), (5, " ")]
    got = metrics.token_hits(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "quote_id int, quote string"))
    want = {(q, d) for q, quote in quotes for d, text in docs if quote.split() and all(w in (text or "").lower() for w in quote.lower().split())}
    assert sorted((r.quote_id, r.doc_id) for r in got.collect()) == sorted(want)
    plan = optimized(got)
    assert "size(" not in plan and plan.count("regexp_extract_all(array_join(") <= 8
    if bound:
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("hashpartitioning(") == 1  # of the ids that are found


def test_nested_cited_writes_its_fields_once(spark, monkeypatch):
    from corpusloom.plans import trails

    tables = []
    monkeypatch.setattr(records, "materialize", lambda df, name, keep=records.materialize: tables.append(name) or keep(df, name))
    assert trails.nested_cited(spark, "/root/testdata/sf0.001").limit(1).count() == 1
    assert len(tables) == 1


@pytest.mark.parametrize("depth", [3, 12])
def test_fields_of_uncited_records_are_not_written(spark, monkeypatch, depth):
    value = {"a": "0", "b": "x", "empty": {}, "braces": "{}", "null": None}
    for k in range(1, depth):
        value = {"a": str(k), "n": 2.5, "in": [value, [], "x", None, [{"b": "y", "c": True}, {"b": "}"}]]} if k % 2 else {"a": str(k), "in": value, "empty": ""}
    ids = [(1, "0"), (1, "2.5"), (1, "y"), (1, None), (2, "{}"), (3, "true"), (3, "true"), (3, '{"b":"}"}'), (4, "1"), (6, "t")]
    data = [(k, json.dumps(value)) for k in (1, 2, 3, 4, 5)] + [(4, json.dumps({"a": "1", "b": "twice"})), (6, "no json"), (7, "7")]
    tables = []
    monkeypatch.setattr(records, "materialize", lambda df, name, keep=records.materialize: tables.append(keep(df, name)) or tables[-1])
    got = records.flatten_json(spark.createDataFrame(data, "call_id long, data string"), "call_id", "data", spark.createDataFrame(ids, "call_id long, id string"))
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    want = []
    for k, d in data[:6]:
        fields = [(r, n, text(v)) for r, n, v in flat(json.loads(d))]
        hit = {r for r, _, v in fields if (k, v) in ids}
        want += [(k, *f) for f in fields if f[0] in hit]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and {k for k, *_ in want} == {1, 2, 3, 4}
    assert sum(df.where("not _deep").count() for df in tables) == len(want)


def test_nested_cited_writes_cited_records_only(spark, monkeypatch):
    from corpusloom.plans import trails

    tables = []
    monkeypatch.setattr(records, "materialize", lambda df, name, keep=records.materialize: tables.append(keep(df, name)) or tables[-1])
    rows = trails.nested_cited(spark, "/root/testdata/sf0.001").count()
    assert rows == sum(df.count() for df in tables) > 0
