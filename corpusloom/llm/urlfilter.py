"""Operator 7: URL filters.

Two layers. Rules (host suffix and path prefix, allow or block) are compared with each URL, the longest first: rule lists are short.
The listing holds canonical URLs that are blocked when no rule speaks: a blocked Bloom filter
of the listing passes possible hits on to an exact hash join, which removes the filter's false positives. Other pages aren't shuffled.
A listing is derived from all pages: canonical URLs that several hosts serve (mirrors and aliases), and those of hosts named on a list.

Defined cases: rules of equal length are tried in their order; very long urls are compared whole; other columns don't take part; an empty table gives an empty table; a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; an
empty path fits no rule, as all rule paths start with a slash; repeated rows each get their verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.llm.sketches import BlockedBloom
from corpusloom.storage import materialize

#: Fixed values of the contract: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Names of hosts whose pages are listed.
LISTED = r"(^|\.)(casino-win|free-bets|ads-track|spam-farm|cheap-pills|adult-x)\."
#: A canonical URL that so many hosts serve is listed.
MIRRORS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without its port or ``www.``, and the path without index page, suffix or closing slash."""
    bare = F.regexp_replace(F.regexp_replace(host, r":\d+$", ""), r"^(www|m|blog)\.", "")
    return F.concat(bare, F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits (its index), one comparison for each rule; null if none fits."""
    ranked = sorted(range(len(rules)), key=lambda k: -len(rules[k][1] + rules[k][2]))
    fits = [F.when(((host == rules[k][1]) | host.endswith("." + rules[k][1])) & path.startswith(rules[k][2]), F.lit(k)) for k in ranked]
    return F.coalesce(*fits) if fits else F.lit(None).cast("int")


def listing(pages: DataFrame, pattern: str = LISTED) -> DataFrame:
    """Canonical URLs of the pages whose host name is on the list of names: key, canonical."""
    host, path = parts(F.col("url"))
    listed = pages.select(host.alias("host"), path.alias("path")).where(F.col("host").rlike(pattern))
    return listed.select(canonical(F.col("host"), F.col("path")).alias("canonical")).distinct().withColumn("key", F.xxhash64("canonical"))


def mirrored(pages: DataFrame, hosts: int = MIRRORS) -> DataFrame:
    """Canonical URLs that at least so many different hosts of the pages serve: key, canonical."""
    host, path = parts(F.col("url"))
    each = pages.select(host.alias("host"), path.alias("path")).where(F.col("host") != "")
    each = each.select("host", canonical(F.col("host"), F.col("path")).alias("canonical")).distinct()
    return each.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hosts).select("canonical", F.xxhash64("canonical").alias("key"))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of each page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("canonical", canonical(F.col("host"), F.col("path"))).withColumn("key", F.xxhash64("canonical"))
    bloom = BlockedBloom.build(listed.select("key"), listed.count())
    words = pages.sparkSession.sparkContext.broadcast(bloom.words)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = BlockedBloom(words.value)
        for batch in batches:
            hit = sieve.might_hold(batch.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "maybe"])

    rows = rows.transform(tk.arrow, probe, "page_id long, host string, path string, canonical string, key long, maybe boolean")
    rows = materialize(rows, "probed-pages")
    words.destroy()
    hits = rows.where("maybe").join(listed.select("canonical").distinct().withColumn("is_listed", F.lit(True)), "canonical", "left")
    rows = hits.unionByName(rows.where(~F.col("maybe")).withColumn("is_listed", F.lit(False)))
    number = rule_of(F.col("host"), F.col("path"), rules)
    names = F.array(*[F.lit(h + p) for _, h, p in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(v) for v, _, _ in rules]) if rules else F.array().cast("array<string>")
    rows = rows.withColumn("n", number)
    return rows.select(
        "page_id", "host", "path", F.get(names, F.col("n")).alias("rule"),
        F.coalesce(F.get(verdicts, F.col("n")), F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("is_listed", F.lit(False)).alias("listed"),
    )
