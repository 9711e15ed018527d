"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import discard, materialize


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """id, group_id (the smallest id reachable) of every id on a link.

    Min labels spread along links and jump to their own label's label, so rounds grow with the logarithm of
    a chain's length. Each round is written to the shared folder.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("group_id")), "groups")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "group_id"), "other").groupBy("id").agg(F.min("group_id").alias("near"))
        further = labels.select(F.col("id").alias("now"), F.col("group_id").alias("further"))
        step = labels.join(near, "id").select("id", F.col("group_id").alias("old"), F.least("group_id", "near").alias("now")).join(further, "now", "left")
        step = materialize(step.select("id", "old", F.least("now", F.coalesce("further", "now")).alias("group_id")), "groups")
        settled = not step.where(F.col("old") != F.col("group_id")).limit(1).count()
        discard(labels)
        if settled:
            discard(both)
            return step.drop("old")
        labels = step
