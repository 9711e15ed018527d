"""Operator 10: time-varying curriculum that mixes sources to target weights.

Each source has a weight schedule over training time 0..1 (piecewise linear between knots).
The schedule is integrated, each source's cumulative token demand is inverted to the time at
which a token is due, and documents are range-sorted by that position.

Defined cases: null or empty text has size 0 and takes 0 words; a null source is a source of its
own, ordered last; repeated rows count each; documents of equal id and size are dealt side by side in any order, which changes no row's
result; very long texts count whole; other columns are left out, or carried on request; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
ROWS_PER_BUCKET = 4096
OWN = ("size", "source_size", "target", "taken", "position", "positions")
#: Relative weight of a source at times 0, 1/2 and 1; repeated over the sources like WEIGHTS.
SCHEDULES = ((1.0, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 2.0))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row for each source: source, position, source_size, n_docs, target.

    Shares are filled like water: a source whose share exceeds ``epochs`` times its size stops there,
    and the excess goes to the others by weight. Sorted by the level at which it stops (its limit over
    its weight), a source is capped exactly if the level shared by it and all later ones is above its own.
    The input is aggregated first, so the ordered windows see one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("ordinal", F.row_number().over(order) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(table, (F.col("ordinal") % len(weights)).cast("int")))
    limit = F.col("source_size").cast("double") * epochs
    by_level = Window.orderBy("level", "ordinal")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    per = per.withColumn("level", limit / F.col("weight"))
    per = per.withColumn("fill", (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("capped", F.col("fill") > F.col("level"))
    water = F.max(F.when(~F.col("capped"), F.col("fill"))).over(everything)  # the first of them; fills fall after it
    per = per.withColumn("target", F.when(F.col("capped") | water.isNull(), limit).otherwise(F.least(limit, water * F.col("weight"))))
    return per.select("source", "ordinal", "source_size", "n_docs", "target")


def _inverse(knots: Sequence[float], share: Column) -> Column:
    """The time at which the schedule's integral reaches ``share`` of its whole."""
    step = 1.0 / (len(knots) - 1)
    areas = [step * (knots[k] + knots[k + 1]) / 2 for k in range(len(knots) - 1)]
    need = share * sum(areas)
    out, done = None, 0.0
    for k, area in enumerate(areas):
        left = F.greatest(need - done, F.lit(0.0))
        slope, level = (knots[k + 1] - knots[k]) / step, knots[k]
        u = left / level if abs(slope) < 1e-12 else (F.sqrt(F.greatest(F.lit(level * level) + 2 * slope * left, F.lit(0.0))) - level) / slope
        t = F.lit(k * step) + F.least(u, F.lit(step))
        out = t if out is None else F.when(need <= done, out).otherwise(t)
        done += area
    return out


def _due(knots: Sequence[float], start: Column, lap: Column, e: Column) -> Column:
    return _inverse(knots, F.least(start + e * lap, F.lit(1.0)))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = MOST_EPOCHS, schedules: Sequence[Sequence[float]] = SCHEDULES, sort: bool = True, carry: bool = False) -> DataFrame:
    """Assign every document its taken words and training position.

    Returns doc_id, source, size, source_size, target, taken, position (of its first copy; 1 if it has
    none) and positions (of each copy). Within a source, documents are
    dealt in the order of a hash. Running word totals are built in two levels (buckets of about
    ROWS_PER_BUCKET rows, then rows of a bucket), so no source is ever in one task. All documents take
    the target's whole multiples; the rest is taken in order up to the exact word. With ``carry`` the documents' other columns (their texts)
    follow; those named like one of the mix's own give way to it.
    """
    own = [F.col("doc_id"), F.col("source").cast("string").alias("source"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("size")]
    sizes = materialize(docs.select(*own), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, epochs), "mix-targets")
    deal = F.xxhash64(F.lit("deal"), F.col("doc_id"), F.col("size"))
    unit = (F.shiftrightunsigned(deal, 11).cast("double")) / F.lit(float(1 << 53))
    bucket = F.floor(unit * F.ceil(F.col("n_docs") / F.lit(ROWS_PER_BUCKET))).cast("long")
    kept = [c for c in docs.columns if c.lower() not in {"doc_id", "source", *OWN}] if carry else []
    carried = [f"_carried_{k}" for k in range(len(kept))]  # away from the names used on the way
    sizes = docs.select(*own, *[F.col(f"`{c}`").alias(x) for c, x in zip(kept, carried, strict=True)]) if carry else sizes
    # one row a source: small beside the documents, but its size isn't known beforehand, so the optimizer chooses the join
    rows = sizes.withColumnRenamed("source", "d_source").join(targets, F.col("d_source").eqNullSafe(F.col("source")), "left").drop("d_source")
    rows = rows.withColumn("unit", unit).withColumn("bucket", bucket)
    totals = rows.groupBy("ordinal", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = totals.withColumn("bucket_before", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("ordinal").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bucket_size")
    inside = Window.partitionBy("ordinal", "bucket").orderBy("unit", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(totals, ["ordinal", "bucket"]).withColumn("before", F.col("bucket_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") - whole * F.col("source_size") + F.lit(0.5)).cast("long")
    rows = rows.withColumn("taken", whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
    start = F.col("before") / F.greatest(F.col("target"), F.lit(1.0))
    lap = F.col("source_size") / F.greatest(F.col("target"), F.lit(1.0))
    copies = whole + F.when(rest > F.col("before"), 1).otherwise(0)
    laps = F.when(copies > 0, F.sequence(F.lit(0), F.least(copies, F.lit(epochs)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    positions = None
    for k, knots in enumerate(schedules):
        one = F.transform(laps, partial(_due, knots, start, lap))
        positions = one if positions is None else F.when(F.col("ordinal") % len(schedules) == k, one).otherwise(positions)
    out = rows.withColumn("positions", positions).select("doc_id", "source", "size", "source_size", "target", "taken", F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(1.0)).alias("position"), "positions", *[F.col(x).alias(c) for c, x in zip(kept, carried, strict=True)])
    return out.orderBy("position", "source", "doc_id") if sort else out
