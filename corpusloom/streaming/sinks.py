"""Streams to tables without repeats, and the budget guard as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Dollars are summed up as whole numbers of this part of a dollar.
MICRO = 100_000_000


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what there is to ``path``, a folder for each batch. A batch that runs again after a failure replaces its folder, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches."""
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def budget_guard(calls: DataFrame, guard: float, key: str) -> DataFrame:
    """Spend before each call within ``key`` (a bigint), and whether the guard would have stopped it, batch after batch.

    ``calls``: call_id, the key, ts, cost_usd. The sum of a key is its state; in a batch, a key's calls count in the order of (ts, call_id).
    """

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        pdf = pd.concat(list(parts)).sort_values(["ts", "call_id"])  # one key's calls of one batch
        costs = [int(round(x * MICRO)) for x in pdf["cost_usd"]]
        before = []
        for c in costs:
            before.append(spent)
            spent += c
        state.update((spent,))
        yield pd.DataFrame({"call_id": pdf["call_id"].to_numpy(), key: keys[0], "spent_before": [b / MICRO for b in before], "stopped": [b >= guard * MICRO for b in before]})

    rows = calls.selectExpr("call_id", f"`{key}`", "ts", "cast(coalesce(cost_usd, 0) as double) AS cost_usd")
    return rows.groupBy(key).applyInPandasWithState(run, f"call_id long, `{key}` long, spent_before double, stopped boolean", "spent long", "append", GroupStateTimeout.NoTimeout)
