"""Retrieval quality: recall and precision at k, leaks, latency and quote survival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import params
from corpusloom.functions import text as tx
from corpusloom.storage import small_enough

#: Quotes of one or two tokens are looked up by so many characters.
GRAM = 8
#: Quotes are broadcast up to this many rows; beyond it they are joined by shuffle.
BROADCAST_QUOTES = 10_000


def scored(matches: DataFrame, items: DataFrame, ks: tuple[int, ...] = params.EVAL_K) -> DataFrame:
    """query_id, k, n_items, recall, precision, ceiling.

    ``matches`` (query_id, item, rank): the ranks of hits that satisfy an item; ``items`` (query_id, item): all relevant items.
    Walking the hits and crediting each item once equals looking at each item's first rank r: recall counts
    r <= k, precision counts the distinct r <= k over k. A query without items isn't scored.
    """
    first = matches.groupBy("query_id", "item").agg(F.min("rank").alias("r"))
    per = items.select("query_id", "item").distinct().join(first, ["query_id", "item"], "left")
    wide = per.select("query_id", "item", "r", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    out = wide.groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("r") <= F.col("k")).alias("found"), F.countDistinct(F.when(F.col("r") <= F.col("k"), F.col("r"))).alias("credited"))
    return out.select("query_id", "k", "n_items", (F.col("found") / F.col("n_items")).alias("recall"), (F.col("credited") / F.col("k")).alias("precision"), (F.least("n_items", "k") / F.col("k")).alias("ceiling"))


def macro(scores: DataFrame, kind: str) -> DataFrame:
    """Means over queries, overall (null kind) and by kind; empty input is an error."""
    sets = scores.groupingSets([[F.col("k")], [F.col("k"), F.col(kind)]], F.col("k"), F.col(kind))
    out = sets.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"), F.avg("ceiling").alias("ceiling"))
    return out


def must_not_be_empty(df: DataFrame, what: str) -> DataFrame:
    """Fails at run time if there are no rows."""
    check = df.agg(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit(f"nothing to aggregate: {what}"))).alias("ok")).where(F.col("ok").isNull()).select(F.lit(1).alias("one"))
    return df.join(F.broadcast(check)).drop("one")


def leaks(hits: DataFrame, tenant: str, *keys: str) -> DataFrame:
    """Hits that no reader of the tenant should have got, in all or by key."""
    return hits.groupBy(*keys).agg(
        F.count_if(F.col("sensitivity") == "restricted").alias("restricted"),
        F.count_if(F.col("tenant") != tenant).alias("wrong_tenant"),
        F.count_if(~F.col("is_current")).alias("superseded"),
    )


def percentile_linear(value: str | Column, p: float, places: int = 6) -> Column:
    """Between neighbours; null for no values."""
    return F.round(F.percentile(value, p), places)


def percentile_nearest(value: str | Column, p: float) -> Column:
    """The element at the half-even rounded index p (n - 1)."""
    values = F.array_sort(F.collect_list(value))
    return F.try_element_at(values, (F.bround(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def median_upper(value: str | Column) -> Column:
    """Element n // 2."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def picked(rows: DataFrame, value: str, places: dict[str, Column], key: str, *more: str) -> DataFrame:
    """The values at places (counted from 0) of each group's sorted nonnull values; a place may use the column ``total``.

    Equal values are counted first and the counts summed up in order, so no task holds a group's values. A group without values has no row.
    """
    keys = (key, *more)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    summed = counted.withColumn("upto", upto).join(totals, list(keys))
    return summed.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > at, F.col(value))).alias(name) for name, at in places.items()])


def nearest_place(p: float) -> Column:
    """Half-even rounded p (total - 1)."""
    return F.bround(F.lit(p) * (F.col("total") - 1))


def middle_place() -> Column:
    """total // 2."""
    return F.floor(F.col("total") / 2)


def latency(timings: DataFrame, *keys: str) -> DataFrame:
    return timings.groupBy(*keys).agg(F.round(F.avg("ms"), 6).alias("mean_ms"), percentile_linear("ms", 0.95).alias("p95_ms"))


def best_configuration(rows: DataFrame) -> DataFrame:
    """By recall at 5, then at 10, then the earliest."""
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct("recall_5", "recall_10", (-F.col("row")).alias("early"))).alias("best")).select("best.*")


def quote_hits(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote_id, doc_id of every document that contains the quote, normalised on both sides.

    A containment join has no key of its own, so equality joins select candidate documents, and only those are searched
    for the whole quote. Tokens inside a quote are whole tokens of any text that holds it; the first and last may touch other characters.
    So the key is the longest inner token; for one or two tokens it is the first GRAM characters of the quote, or all if there
    are fewer, among the text's runs of as many characters.
    """
    inner = F.slice(F.split("quote", " "), 2, F.greatest(F.size(F.split("quote", " ")) - 2, F.lit(0)))
    longest = F.reduce(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    q = quotes.select("quote_id", tx.normalise("quote", compatibility=True).alias("quote")).where(F.col("quote") != "")
    q = q.withColumn("gram", F.when(F.size(inner) == 0, F.least(F.length("quote"), F.lit(GRAM))))
    q = q.withColumn("token", F.when(F.col("gram").isNull(), longest).otherwise(F.substring("quote", 1, GRAM)))
    grams = sorted(r.gram for r in q.select("gram").where(F.col("gram").isNotNull()).distinct().collect())  # at most GRAM values
    d = docs.select("doc_id", tx.normalise(F.coalesce("text", F.lit("")), compatibility=True).alias("norm"))
    keys = F.array_distinct(F.concat(F.split("norm", " "), *[F.regexp_extract_all("norm", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in grams]))
    holds = F.col("norm").contains(F.col("quote"))
    if small_enough(q, BROADCAST_QUOTES):
        asked = [r.token for r in q.select("token").distinct().collect()]  # BROADCAST_QUOTES at most
        # only keys that some quote has are listed, so that texts aren't copied to each of their tokens
        tokens = d.select("doc_id", "norm", F.explode(F.array_intersect(keys, F.split(F.lit("\x01".join(asked)), "\x01"))).alias("token"))
        return tokens.join(F.broadcast(q), "token").where(holds).select("quote_id", "doc_id").distinct()
    d, q = d.withColumn("doc_key", F.xxhash64("doc_id", "norm")), q.withColumn("quote_key", F.xxhash64("quote_id", "quote"))
    pairs = d.select("doc_key", F.explode(keys).alias("token")).join(q.select("quote_key", "token"), "token").select("doc_key", "quote_key").distinct()
    return pairs.join(q, "quote_key").join(d, "doc_key").where(holds).select("quote_id", "doc_id").distinct()


def token_hits(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """quote_id, doc_id of every document in which each of the quote's tokens occurs somewhere, also inside a longer word; both sides normalised.

    A token may start anywhere in a word, so candidates share the first GRAM characters (all, if there are fewer) of the quote's longest token, looked for
    in a text's different words of at least that length. Few quotes are broadcast, and candidates searched for all tokens where they are read; else ids are joined.
    """
    q = quotes.select("quote_id", tx.normalise("quote", compatibility=True).alias("quote")).where(F.col("quote") != "")
    longest = F.reduce(tx.words(F.col("quote")), F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    q = q.withColumn("gram", F.substring(longest, 1, GRAM))
    sizes = sorted(r.n for r in q.select(F.length("gram").alias("n")).distinct().collect())  # at most GRAM values
    d = docs.select("doc_id", tx.normalise(F.coalesce("text", F.lit("")), compatibility=True).alias("norm")).withColumn("words", F.array_distinct(F.split("norm", " ")))
    long = lambda n: F.array_join(F.filter("words", lambda w: F.length(w) >= n), " ")
    grams = F.array_distinct(F.concat(F.array().cast("array<string>"), *[F.regexp_extract_all(long(n), F.lit(f"(?s)(?=([^ ]{{{n}}}))"), F.lit(1)) for n in sizes]))
    every = tx.quote_matches(F.col("norm"), F.col("quote"), F.lit("all_tokens"))
    # outer explodes, since for plain ones Spark infers a filter that lists everything a second time
    if small_enough(q, BROADCAST_QUOTES):
        asked = [r.gram for r in q.select("gram").distinct().collect()]  # BROADCAST_QUOTES at most; normalised texts hold no \x1f
        found = d.select("doc_id", "norm", F.explode_outer(F.array_intersect(grams, F.split(F.lit("\x1f".join(asked)), "\x1f"))).alias("gram"))
        return found.join(F.broadcast(q), "gram").where(every).select("quote_id", "doc_id").distinct()
    d = d.withColumn("doc_key", F.xxhash64("doc_id", "norm"))
    pairs = d.select("doc_key", F.explode_outer(grams).alias("gram")).join(q.select("quote_id", "gram"), "gram").select("doc_key", "quote_id").distinct()
    return pairs.join(q.select("quote_id", "quote"), "quote_id").join(d.select("doc_key", "doc_id", "norm"), "doc_key").where(every).select("quote_id", "doc_id").distinct()


def quote_survival(locations: DataFrame, docs: DataFrame) -> DataFrame:
    """state of each expected location (query_id, doc_id, quote, match) in the ingested documents.

    ``docs``: doc_id, text, status, canonical (set for dropped copies).
    """
    j = locations.join(docs, "doc_id", "left")
    found = tx.quote_matches(tx.normalise(F.coalesce("text", F.lit("")), compatibility=True), tx.normalise("quote", compatibility=True), F.col("match"))
    state = (
        F.when(F.col("canonical").isNotNull(), F.concat(F.lit("n/a: duplicate of "), "canonical"))
        .when(F.col("status").isNull(), "LOST (doc missing)")
        .when(~F.col("status").isin("pending", "cleaned"), F.concat(F.lit("LOST (doc "), "status", F.lit(")")))
        .when(found, "survived")
        .otherwise("LOST")
    )
    return j.select("query_id", "doc_id", "quote", state.alias("state"))


def decision_grades(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """verdict of each file's decision against the key: OK, EXPECTED, MISMATCH or MISMATCH for naming the wrong copy."""
    j = expected.join(actual, "filename", "left")
    status = F.coalesce("status", F.lit("MISSING"))
    same = status == F.col("expected_status")
    wrong_copy = F.lower("expected_reason").contains("duplicate") & F.col("expected_canonical").isNotNull() & ~F.coalesce(F.col("reason").contains(F.col("expected_canonical")), F.lit(False))
    no_ocr = (F.col("parser") == "naive") & (F.col("expected_format") == "pdf (scanned)") & (status == "quarantined") & F.col("reason").contains("no text layer")
    verdict = F.when(same & ~wrong_copy, "OK").when(no_ocr, "EXPECTED").when(same, F.concat(F.lit("MISMATCH (should name "), "expected_canonical", F.lit(")"))).otherwise("MISMATCH")
    return j.select("filename", status.alias("status"), "reason", verdict.alias("verdict"))


def row_accuracy(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, exact, rows: expected table rows that occur, normalised, among the parsed rows."""
    got = parsed.select("doc_id", tx.normalise("row").alias("row")).distinct().withColumn("hit", F.lit(1))
    want = expected.select("doc_id", tx.normalise("row").alias("row"))
    return want.join(got, ["doc_id", "row"], "left").groupBy("doc_id").agg(F.count("hit").alias("exact"), F.count(F.lit(1)).alias("rows"))
