"""Lexical and vector retrieval for batches of queries, fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import params
from corpusloom.functions import text as tx
from corpusloom.storage import materialize, small_enough, spread


def ranked(hits: DataFrame, n: int, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The n best hits of each query: by score, then item."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id, toks, written once: as an expression, the tokens would be made anew for each use."""
    return materialize(spread(docs.select("doc_id", "text")).select("doc_id", tx.bm25_tokens(F.coalesce("text", F.lit(""))).alias("toks")), "tokens")


def occurrences(toks: DataFrame) -> DataFrame:
    """term, once for each document that holds it: all that document frequencies need."""
    return toks.select(F.explode(F.array_distinct("toks")).alias("term"))


def postings(toks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """doc_id, length, term, tf: the lexical index, or its part for a few terms (broadcast). Partial sums keep a common term's rows in the map tasks."""
    rows = toks.select("doc_id", F.size("toks").alias("length"), F.explode("toks").alias("term"))
    if terms is not None:
        rows = rows.join(F.broadcast(terms), "term", "left_semi")
    return rows.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_statistics(index: DataFrame, toks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, idf) and one row (n_docs, avg_length). ``index`` has a row for each term of each document. Negative idf becomes a share of the mean idf."""
    whole = toks.select(F.size("toks").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(whole.select("n_docs")))
    raw = materialize(df.select("term", (F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw")), "terms")
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.join(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, params.BM25["floor"] * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return idf, whole


def bm25_scores(docs: DataFrame, queries: DataFrame, places: int = 6) -> DataFrame:
    """query_id, doc_id, score > 0 of every query (query_id, text); repeated query tokens count each."""
    k1, b = params.BM25["k1"], params.BM25["b"]
    toks = tokenized(docs)
    idf, whole = term_statistics(occurrences(toks), toks)
    asked = queries.select("query_id", F.explode(tx.bm25_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = materialize(asked.join(idf, "term"), "query-terms")
    index = postings(toks)
    if small_enough(asked, params.BROADCAST_ROWS):
        index = postings(toks, asked.select("term").distinct())
        asked = F.broadcast(asked)
    hits = index.join(asked, "term").join(F.broadcast(whole))
    part = F.col("times") * F.col("idf") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length"))))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), places).alias("score")).where(F.col("score") > 0)


def bm25_top(docs: DataFrame, queries: DataFrame, n: int = params.RETRIEVAL["top_k"], keep: Column | None = None) -> DataFrame:
    """Top hits of each query. ``keep`` filters documents before the cut, while statistics cover all of them."""
    hits = bm25_scores(docs, queries)
    if keep is not None:
        hits = hits.join(docs.where(keep).select("doc_id"), "doc_id", "left_semi")
    return ranked(hits, n)


#: Ids of one bucket in the order of a label's rows.
ORDER_BUCKET = 4096


def neighbours(rows: DataFrame, asked: DataFrame, key: str, item: str, n: int) -> DataFrame:
    """query_id, item, score, rank: the n rows of each query's key that are nearest to it by item number (score: minus the distance), itself included.

    ``rows``: key, item; ``asked``: query_id, key, item. The nearest n lie at most n places before or behind a query in its key's order, so places are joined and no query meets all rows of its key.
    Places are summed up from buckets of item numbers, so no task orders a whole key.
    """
    placed = rows.select(key, item, F.floor(F.col(item) / ORDER_BUCKET).alias("_bucket"))
    sizes = placed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy(key, "_bucket").orderBy(item)
    placed = placed.withColumn("_in", F.row_number().over(inside)).join(sizes.select(key, "_bucket", before.alias("_before")), [key, "_bucket"])
    placed = materialize(placed.select(key, item, (F.col("_before") + F.col("_in")).alias("_place")), "places")
    near = asked.join(placed, [key, item]).select("query_id", key, F.col(item).alias("_own"), F.explode(F.sequence(F.col("_place") - n, F.col("_place") + n)).alias("_place"))
    hits = near.join(placed, [key, "_place"]).select("query_id", item, (-F.abs(F.col(item) - F.col("_own"))).cast("double").alias("score"))
    return ranked(hits, n, item=item)


#: Queries and vectors that are multiplied at a time: a tile of scores takes 16 MB.
TILE = (512, 4096)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most a tile's rows, read from the Arrow buffers; rows without a vector are left out."""
    for batch in batches:
        batch = batch.filter(batch.column("embedding").is_valid())
        for at in range(0, batch.num_rows, TILE[1]):
            part = batch.slice(at, TILE[1])
            yield part.column("vec_id").to_numpy(), part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)


def _first_of_each(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n best hits of each row number, by score, then id."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < n
    return rows[first], scores[first], ids[first]


def _tile_best(q: np.ndarray, m: np.ndarray, n: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, column) of every score that is no lower than its row's n-th best: ties at the cut all stay."""
    s = np.round(q @ m.T, places)
    cut = np.partition(s, -n, axis=1)[:, [-n]] if s.shape[1] > n else np.full((len(s), 1), -np.inf)
    rows, columns = np.nonzero(s >= cut)
    return rows, s[rows, columns], columns


def vector_top(vectors: DataFrame, queries: DataFrame, n: int = params.RETRIEVAL["top_k"], places: int = 6, most_queries: int = 20_000) -> DataFrame:
    """query_id, vec_id, score, rank: exact inner products of unit vectors.

    Queries (query_id, embedding) are sent out in blocks of at most ``most_queries``; every task multiplies its vectors with the
    block, tile by tile, keeps n candidates for each query, and the final window merges the tasks' candidates.
    """
    out = None
    for block in _blocks(queries, most_queries):
        sent = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            q_ids, q = sent.value
            best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
            for ids, m in _matrices(batches):
                tiles = []
                for at in range(0, len(q), TILE[0]):
                    rows, scores, columns = _tile_best(q[at : at + TILE[0]], m, n, places)
                    tiles.append((rows + at, scores, ids[columns]))
                best = _first_of_each(*[np.concatenate([b, *x]) for b, x in zip(best, zip(*tiles, strict=True), strict=True)], n)
            rows, scores, ids = best
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        part = vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    return ranked(out, n, item="vec_id")


def _blocks(queries: DataFrame, most: int):
    ids, rows = [], []
    for r in queries.select("query_id", "embedding").orderBy("query_id").toLocalIterator():
        ids.append(r.query_id)
        rows.append(r.embedding)
        if len(ids) == most:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def rrf(*lists: DataFrame, k: int = params.RETRIEVAL["rrf_k"], item: str = "doc_id", places: int = 9) -> DataFrame:
    """Reciprocal rank fusion of hit lists (query_id, item, rank): each adds 1 / (k + rank)."""
    union = None
    for hits in lists:
        part = hits.select("query_id", item, "rank")
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", item).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), places).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item)))


def merge_stages(lexical: DataFrame, vector: DataFrame, item: str = "doc_id") -> DataFrame:
    """Each hit with its rank and score in both lists."""
    a = lexical.select("query_id", item, F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    b = vector.select("query_id", item, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    return a.join(b, ["query_id", item], "full_outer")


def rerank(fused: DataFrame, score: Callable[[DataFrame], DataFrame], depth: int = params.RETRIEVAL["rerank"], item: str = "doc_id") -> DataFrame:
    """Reorder the best ``depth`` fused hits by a scorer: DataFrame (query_id, item) -> the same with score."""
    return ranked(score(fused.where(F.col("rank") <= depth).select("query_id", item)), depth, item=item)


def enrich(hits: DataFrame, chunks: DataFrame, item: str = "doc_id") -> DataFrame:
    """Top hits with the stored text and metadata."""
    return hits.join(chunks, item)


def citation(title: Column, version: Column, page_start: Column, page_end: Column, section_path: Column) -> Column:
    """Title, version, pages and last section, those that there are."""
    pages = F.when(page_start > 0, F.when(page_end != page_start, F.concat(F.lit("p."), page_start, F.lit("-"), page_end)).otherwise(F.concat(F.lit("p."), page_start)))
    return F.concat_ws(", ", title, F.nullif(version, F.lit("")), pages, F.nullif(F.element_at(F.split(section_path, " > "), -1), F.lit("")))


def search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, keep: Column | None = None, candidates: int = params.RETRIEVAL["candidates"], n: int = params.RETRIEVAL["top_k"], index=None) -> DataFrame:
    """query_id, doc_id, score, rank: lexical and vector candidates of each query, fused by rank and cut.

    ``vectors``: doc_id, embedding; ``queries``: query_id, text, embedding. ``keep`` filters documents before either list is cut.
    ``index``: a stored lexical index of the documents; without it their tokens are counted anew.
    """
    kept = docs.where(keep).select("doc_id") if keep is not None else None
    asked = queries.select("query_id", "text")
    lexical = bm25_top(docs, asked, candidates, keep) if index is None else index.top(asked, candidates, kept)
    if kept is not None:
        vectors = vectors.join(kept, "doc_id", "left_semi")
    near = vector_top(vectors.select(F.col("doc_id").alias("vec_id"), "embedding"), queries.select("query_id", "embedding"), candidates)
    return rrf(lexical, near.withColumnRenamed("vec_id", "doc_id")).where(F.col("rank") <= n)


def over_limit(docs: DataFrame, limit: int, *keys: str) -> DataFrame:
    """How many texts of each key have more words than an embedding model takes."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))
    return docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("texts"), F.count_if(words > limit).alias("over"))
