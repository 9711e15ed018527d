"""Nested results, constraints, and streams that are restarted."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import calls, constraints, records
from corpusloom.sources import loaders
from corpusloom.streaming import costs, sinks


def test_fields_at_any_depth(spark):
    rows = [(1, json.dumps({"id": "a", "inner": {"list": [{"amount": "1.00", "deep": {"x": {"amount": "2.50"}}}, 7, [{"amount": "3.00"}]]}, "none": None, "flag": True})), (2, "[]"), (3, "no json"), (4, None), (5, '[{"k": 12.5}, {"k": "t"}]')]
    got = sorted(tuple(r) for r in records.flatten_json(spark.createDataFrame(rows, "key long, data string"), "key", "data").collect())
    assert got == sorted(
        [(1, "$", "flag", "true"), (1, "$", "id", "a"), (1, "$.inner.list[0]", "amount", "1.00"), (1, "$.inner.list[0].deep.x", "amount", "2.50"), (1, "$.inner.list[2][0]", "amount", "3.00"), (5, "$[0]", "k", "12.5"), (5, "$[1]", "k", "t")]
    )


def test_figures_of_deep_records(spark):
    data = json.dumps({"account": {"id": "ACC-1", "balance": "10.00", "items": [{"id": "T1", "amount": "-4.00"}, {"id": "T2", "amount": "6.00"}]}})
    fields = records.flatten_json(spark.createDataFrame([(1, data)], "call_id long, data string"), "call_id", "data")
    cited = records.cited_records(fields, spark.createDataFrame([(1, "T1")], "call_id long, id string"))
    assert [(r.record, r.name, r.value) for r in cited.orderBy("name").collect()] == [("$.account.items[0]", "amount", "-4.00"), ("$.account.items[0]", "id", "T1")]
    (r,) = records.allowed_figures(cited, "call_id").collect()
    assert {str(x) for x in r.allowed} == {"4.00", "0.00"}


def test_constraints(spark, tmp_path):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "p long")
    rows = spark.createDataFrame([(1, 1, "a"), (2, 9, "b"), (2, 2, None), (4, None, "x"), (None, 1, "z")], "id long, p long, kind string")
    checks = {"kind": F.col("kind").isin("a", "b"), "named": F.col("id").isNotNull()}
    found = constraints.audit(constraints.broken(rows, checks, "id"), constraints.repeated(rows, "unique", "id"), constraints.dangling(rows, "parent", "p", "id", parents, "p"), constraints.childless(parents, "used", "p", rows, "p"))
    assert sorted((r.rule, r.id) for r in found.collect() if r.id) == [("kind", "4"), ("parent", "2"), ("unique", "2"), ("used", "3")]
    assert sorted(r.rule for r in found.collect() if not r.id) == ["kind", "named"]
    out, seen = constraints.counted(rows, checks, "seen")
    out.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"rows": 5, "kind": 2, "named": 1}
    with pytest.raises(ValueError, match="parent: 2"):
        constraints.must_hold(constraints.dangling(rows, "parent", "p", "id", parents, "p"))
    constraints.must_hold(found.limit(0))


CALL = "call_id long, correlation_id long, ts timestamp, cost_usd decimal(18,8)"


def call_file(spark, folder, name, rows):
    part = folder / f"_{name}"
    spark.createDataFrame(rows, "call_id long, correlation_id long, ts string, cost string").selectExpr("call_id", "correlation_id", "cast(ts AS timestamp) AS ts", "cast(cost AS decimal(18,8)) AS cost_usd").coalesce(1).write.parquet(str(part))
    (source,) = part.glob("part-*.parquet")
    folder.joinpath("in").mkdir(exist_ok=True)
    shutil.copy(source, folder / "in" / f"{name}.parquet")
    age = 1_700_000_000 + 60 * ord(name)  # files are read by age
    os.utime(folder / "in" / f"{name}.parquet", (age, age))


def rows_of(spark, folder):
    got = sinks.appended(spark, str(folder / "out"), "call_id long, correlation_id long, spent_before double, stopped boolean").collect()
    return sorted((r.call_id, r.correlation_id, round(r.spent_before, 8), r.stopped) for r in got)


def test_streamed_guard_equals_batch_after_restarts(spark, tmp_path):
    first = [(k, k % 3, f"2024-01-01 00:00:{k:02d}", "0.4") for k in range(20)]
    second = [(k, k % 4, f"2024-01-01 00:01:{k - 20:02d}", "0.25") for k in range(20, 40)] + [(40, 1, "2024-01-01 00:02:00", None)]

    def run():
        stream = spark.readStream.schema(CALL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sinks.append_once(sinks.budget_guard(stream, 3.0, "correlation_id"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    call_file(spark, tmp_path, "a", first)
    run()
    call_file(spark, tmp_path, "b", second)
    run()  # goes on from the state of the first run
    whole = spark.read.schema(CALL).parquet(str(tmp_path / "in")).withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0).cast("decimal(18,8)")))
    want = sorted((r.call_id, r.correlation_id, round(float(r.spent_before), 8), r.stopped) for r in calls.budget_guard(whole, 3.0, "correlation_id", ("ts", "call_id")).collect())
    assert rows_of(spark, tmp_path) == want and any(w[3] for w in want)
    commits = sorted((x for x in os.listdir(tmp_path / "check" / "commits") if x.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(tmp_path / "check" / "commits" / name):
            os.remove(tmp_path / "check" / "commits" / name)  # as if the run had died before its commit
    run()
    assert rows_of(spark, tmp_path) == want


def test_sessions_and_repeats_of_a_stream(spark, tmp_path):
    call_file(spark, tmp_path, "a", [(1, 1, "2024-01-01 00:00:00", "1"), (1, 1, "2024-01-01 00:00:00", "1"), (2, 1, "2024-01-01 00:20:00", "1"), (3, 1, "2024-01-01 02:00:00", "1"), (4, 2, "2024-01-01 00:00:00", "1")])
    call_file(spark, tmp_path, "b", [(9, 9, "2024-01-02 00:00:00", "1")])  # moves the watermark on
    call_file(spark, tmp_path, "c", [(8, 9, "2024-01-02 00:00:01", "1")])  # rows are late by the watermark of the batch before
    call_file(spark, tmp_path, "d", [(5, 1, "2024-01-01 02:10:00", "1"), (10, 9, "2024-01-03 00:00:00", "1")])  # the first call is too late

    def table(df, name):
        sinks.append_once(df, str(tmp_path / name), str(tmp_path / f"check-{name}")).awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    stream = costs.call_stream(spark, str(tmp_path / "in"), CALL, "parquet", 1)
    sessions = table(costs.sessions(stream, "correlation_id"), "sessions")
    assert sorted((r.correlation_id, r.session.start.hour, r.calls) for r in sessions.where("correlation_id < 9").collect()) == [(1, 0, 3), (1, 2, 1), (2, 0, 1)]
    once = table(costs.once(costs.call_stream(spark, str(tmp_path / "in"), CALL, "parquet", 1), "call_id"), "once")
    ids = sorted(r.call_id for r in once.collect())
    assert ids[:4] == [1, 2, 3, 4] and ids.count(1) == 1


def test_text_blocks_by_classes_of_lines():
    text = "Rates and Fees\n\n3. Limits\nA daily limit\nholds.\n\n- one\n* two | three\n\nTable below:\na | b\n1 | 2\n\nALL CAPITALS HERE. NOW\n\n2024 was a long year of many words here\n\nIt ends.\n\n> quoted\n\nx | y"
    got = [(b["type"], b["text"], b.get("level")) for b in loaders.text_blocks(text)]
    assert got == [
        ("heading", "Rates and Fees", 1), ("paragraph", "3. Limits\nA daily limit\nholds.", None), ("list_item", "- one", None), ("list_item", "* two | three", None), ("paragraph", "Table below:", None),
        ("table", "a | b\n1 | 2", None), ("heading", "ALL CAPITALS HERE. NOW", 2), ("paragraph", "2024 was a long year of many words here", None), ("paragraph", "It ends.", None), ("paragraph", "> quoted", None), ("paragraph", "x | y", None),
    ]
