"""Constraints of tables as rows of what breaks them: (rule, id). A null breaks no check but that of being there, as in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _told(rows: DataFrame, rule: str, key: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))


def broken(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """Every row's broken checks, all of them in one pass."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(rule)) for rule, ok in checks.items()])
    return rows.select(F.explode(F.filter(failed, lambda r: r.isNotNull())).alias("rule"), F.col(key).cast("string").alias("id"))


def repeated(rows: DataFrame, rule: str, key: str) -> DataFrame:
    """Keys that more than one row has, each once."""
    return _told(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), rule, key)


def dangling(rows: DataFrame, rule: str, reference: str, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows whose reference names no parent."""
    named = rows.where(F.col(reference).isNotNull())
    return _told(named.join(parents.select(F.col(parent).alias(reference)), reference, "left_anti"), rule, key)


def childless(parents: DataFrame, rule: str, parent: str, rows: DataFrame, reference: str) -> DataFrame:
    """Parents that no row refers to."""
    return _told(parents.join(rows.select(F.col(reference).alias(parent)), parent, "left_anti"), rule, parent)


def audit(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def counted(rows: DataFrame, checks: dict[str, Column], name: str) -> tuple[DataFrame, Observation]:
    """The rows as they are, and an observation that has ``rows`` and how many broke each check once they have been written or read: no pass of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(True))).alias(rule) for rule, ok in checks.items()]), seen


def must_hold(found: DataFrame, most: int = 20) -> None:
    """An error that names some of what is broken."""
    some = [f"{r.rule}: {r.id}" for r in found.limit(most).collect()]
    if some:
        raise ValueError("broken constraints: " + "; ".join(some))
