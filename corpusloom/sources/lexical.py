"""A lexical index on storage: postings in buckets by term, added to segment by segment, and opened for one revision of the corpus.

Layout under the root, all Parquet:

- ``postings`` (segment, bucket | term, doc_id, length, tf) and ``terms`` (segment, bucket | term, df): sorted by term within a file, so that a query reads the
  buckets of its terms (partition pruning), and in these the row groups that may hold them (statistics). Bucket ``DOCUMENTS`` of the postings has a row without a term for each document.
- ``manifest``: one row for each segment, written last: version, revision, segment, n_docs, total_length of the segment, and mean_raw, the mean of all terms' raw idf up to this version.

What a manifest row doesn't name isn't part of the index, so a segment whose writing was cut off is never read. Document frequencies are summed over segments.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import params
from corpusloom.functions import text as tx
from corpusloom.operators.retrieval import _first_of_each, ranked
from corpusloom.storage import materialize, small_batches, small_enough

BUCKETS = 16
#: The bucket of documents, whether they have terms or not.
DOCUMENTS = -1
#: Characters of the texts whose postings one task counts, sorts and writes: what it sorts stays in memory.
TASK_CHARS = 48_000_000
#: Shares of a term's postings, where asked terms are too many to be broadcast.
SALTS = 16
#: Weights (terms times queries) up to which a block of documents is scored by a product of matrices: 32 MB.
WEIGHTS = 4_000_000
#: Documents of such a block.
BLOCK = 256
MANIFEST = "version long, revision string, segment string, n_docs long, total_length long, mean_raw double"


def corpus_revision(docs: DataFrame) -> str:
    """A name for what a table of documents holds (doc_id, text), whatever its order: counts and sums of row hashes."""
    sums = [F.sum(F.xxhash64(F.lit(k), "doc_id", "text").cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    row = docs.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return "-".join(str(x or 0) for x in row)


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _starts(toks: str):
    """Where each term of a sorted list begins."""
    first = F.filter(F.sequence(F.lit(0), F.size(toks) - 1), lambda i: (i == 0) | (F.get(toks, i) != F.get(toks, i - 1)))
    return F.when(F.size(toks) > 0, first).otherwise(F.array().cast("array<int>"))


def _counted(toks: str, at: str):
    """(term, tf) of each term of a sorted list, and one of no term."""
    found = F.transform(at, lambda x, k: F.struct(F.get(toks, x).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(toks)) - x).alias("tf")))
    return F.concat(F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf"))), found)


def _raw(df, n_docs):
    return F.ln(n_docs - df + 0.5) - F.ln(df + 0.5)


class LexicalIndex:
    """An open index: what its manifest names for one revision."""

    def __init__(self, spark: SparkSession, root: str, manifest: list):
        self.spark, self.root, self.segments = spark, root.rstrip("/"), [r.segment for r in manifest]
        self.revision, self.version = manifest[-1].revision, manifest[-1].version
        self.n_docs, total = sum(r.n_docs for r in manifest), sum(r.total_length for r in manifest)
        self.avg_length, self.mean_raw = total / max(self.n_docs, 1), manifest[-1].mean_raw

    # ---------------------------------------------------------------- writing

    @staticmethod
    def _manifest(spark: SparkSession, root: str) -> list:
        try:
            rows = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest").orderBy("version").collect()  # one row for each segment
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return rows

    @classmethod
    def add(cls, docs: DataFrame, root: str, revision: str) -> LexicalIndex:
        """Write ``docs`` (doc_id, text) as a new segment, after which the index is of ``revision``. A document that it holds already is an error."""
        spark, root, segment = docs.sparkSession, root.rstrip("/"), uuid.uuid4().hex
        before = cls._manifest(spark, root)
        chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        # only texts are shuffled: a text's terms are counted within its row, and a task sorts and writes the postings of its own texts
        dealt = docs.select("doc_id", "text").repartition(max(spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)), "doc_id")
        toks = dealt.select("doc_id", F.sort_array(tx.bm25_tokens(F.coalesce("text", F.lit("")))).alias("toks"))
        each = toks.select("doc_id", "toks", _starts("toks").alias("at")).select("doc_id", F.size("toks").alias("length"), F.explode(_counted("toks", "at")).alias("t"))
        rows = each.select("t.term", "doc_id", "length", "t.tf", F.when(F.col("t.term").isNull(), DOCUMENTS).otherwise(_bucket(F.col("t.term"))).alias("bucket"))
        rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/postings/segment={segment}")
        new = cls._documents(spark, root, [segment])
        n_docs, total = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        if new.groupBy("doc_id").count().where("count > 1").limit(1).count():
            raise ValueError("a document is there twice")
        if before and cls._documents(spark, root, [r.segment for r in before]).join(new, "doc_id", "left_semi").limit(1).count():
            raise ValueError("the index holds some of these documents already")
        terms = cls._segments(spark, root, "postings", "term string", [segment]).where(F.col("bucket") != DOCUMENTS).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
        terms.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term").select("term", "df", "bucket").write.partitionBy("bucket").parquet(f"{root}/terms/segment={segment}")
        segments, whole = [r.segment for r in before] + [segment], sum(r.n_docs for r in before) + n_docs
        df = cls._segments(spark, root, "terms", "term string, df long", segments).groupBy("term").agg(F.sum("df").alias("df"))
        mean = df.agg(F.avg(_raw(F.col("df"), F.lit(whole)))).first()[0]
        row = (before[-1].version + 1 if before else 1, revision, segment, n_docs, total, mean or 0.0)
        spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
        return cls.open(spark, root, revision)

    @classmethod
    def open(cls, spark: SparkSession, root: str, revision: str) -> LexicalIndex:
        """The index, if its newest version is of this revision of the corpus; a missing or stale one is an error."""
        rows = cls._manifest(spark, root)
        found = rows[-1].revision if rows else None
        if found != revision:
            raise ValueError(f"index revision {found}, wanted {revision}")
        return cls(spark, root, rows)

    @classmethod
    def of(cls, docs: DataFrame, folder: str) -> LexicalIndex:
        """The index of exactly these documents below ``folder``: opened if there is one, else built."""
        revision = corpus_revision(docs)
        root = f"{folder.rstrip('/')}/lexical-{revision}"
        rows = cls._manifest(docs.sparkSession, root)
        return cls(docs.sparkSession, root, rows) if rows else cls.add(docs, root, revision)

    # ---------------------------------------------------------------- reading

    @staticmethod
    def _segments(spark: SparkSession, root: str, table: str, schema: str, segments: list[str]) -> DataFrame:
        paths = [f"{root}/{table}/segment={x}" for x in segments]
        return spark.read.schema(schema + ", bucket int").option("basePath", f"{root}/{table}").parquet(*paths)

    @classmethod
    def _documents(cls, spark: SparkSession, root: str, segments: list[str]) -> DataFrame:
        return cls._segments(spark, root, "postings", "doc_id long, length int", segments).where(F.col("bucket") == DOCUMENTS).drop("bucket")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self._segments(self.spark, self.root, table, schema, self.segments)

    def term_statistics(self) -> DataFrame:
        """term, df, idf of all terms."""
        df = self._read("terms", "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        return df.select("term", "df", self._idf().alias("idf"))

    def _idf(self):
        raw = _raw(F.col("df"), F.lit(self.n_docs))
        return F.when(raw < 0, params.BM25["floor"] * self.mean_raw).otherwise(raw)

    def asked(self, queries: DataFrame) -> tuple[DataFrame, list[int]]:
        """(query_id, term, times, idf, bucket of each query's terms that the index holds; the buckets, BUCKETS at most)."""
        tokens = queries.select("query_id", F.explode(tx.bm25_tokens(F.coalesce("text", F.lit("")))).alias("term"))
        wanted = materialize(tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("bucket", _bucket("term")), "query-terms")
        buckets = sorted(r.bucket for r in wanted.select("bucket").distinct().collect())
        df = self._read("terms", "term string, df long").where(F.col("bucket").isin(buckets))
        few = small_enough(wanted, params.BROADCAST_ROWS)
        names = wanted.select("term", "bucket").distinct()
        df = df.join(F.broadcast(names) if few else names, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        return wanted.join(df.select("term", self._idf().alias("idf")), "term"), buckets

    def postings(self, buckets: list[int]) -> DataFrame:
        """term, doc_id, length, tf, bucket; only these buckets are read."""
        return self._read("postings", "term string, doc_id long, length int, tf int").where(F.col("bucket").isin(buckets))

    def _weighted(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(query_id, term, weight of each query's terms; term, doc_id, part of the postings in their buckets)."""
        k1, b = params.BM25["k1"], params.BM25["b"]
        asked, buckets = self.asked(queries)
        asked = materialize(asked.select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "query-weights")
        part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / self.avg_length))
        return asked, self.postings(buckets).select("term", "doc_id", part.alias("part"))

    def scores(self, queries: DataFrame, places: int = 6, keep: DataFrame | None = None) -> DataFrame:
        """query_id, doc_id, score > 0 of every query (query_id, text); repeated query tokens count each. ``keep`` (doc_id): the documents that are scored."""
        return self._sums(*self._weighted(queries), places, keep)

    def _sums(self, asked: DataFrame, rows: DataFrame, places: int, keep: DataFrame | None) -> DataFrame:
        if keep is not None:
            rows = rows.join(keep.select("doc_id").distinct(), "doc_id", "left_semi")
        if small_enough(asked, params.BROADCAST_ROWS):
            # dealt by document before each posting meets its queries: the sums below need no other shuffle
            rows = rows.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").repartition("doc_id")
            hits = rows.join(F.broadcast(asked), "term")
        else:  # a common term's postings are one key: dealt by document
            salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            hits = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
        return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("part")), places).alias("score")).where(F.col("score") > 0)

    def _best(self, asked: DataFrame, rows: DataFrame, places: int, n: int, keep: DataFrame | None) -> DataFrame:
        """The n best hits of each query in each task: documents in blocks, their parts times the weights (terms by queries), of which the driver has WEIGHTS at most."""
        weights = asked.toPandas()
        terms, columns = weights["term"].unique(), weights["query_id"].unique()
        matrix = np.zeros((len(terms), len(columns)))
        number = {x: k for k, x in enumerate(terms)}
        matrix[weights["term"].map(number), weights["query_id"].map({x: k for k, x in enumerate(columns)})] = weights["weight"]
        sent = self.spark.sparkContext.broadcast((matrix, columns))
        named = self.spark.createDataFrame(list(number.items()), "term string, t int")
        dealt = rows.join(F.broadcast(named), "term").select("doc_id", "t", "part")
        if keep is not None:
            dealt = dealt.join(keep.select("doc_id").distinct(), "doc_id", "left_semi")
        # a row for each document: where parts only lie side by side after a join, Spark may read them in other pieces
        whole = dealt.groupBy("doc_id").agg(F.collect_list(F.struct("t", "part")).alias("parts")).select("doc_id", F.col("parts.t").alias("t"), F.col("parts.part").alias("part"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix, columns = sent.value
            best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))

            def scored(ids, sizes, t, part):
                rows = np.repeat(np.arange(len(ids)), sizes)
                parts = np.zeros((len(ids), len(matrix)))
                parts[rows, t] = part
                s = np.round(parts @ matrix, places)
                d, q = np.nonzero((s > 0) & (s >= (np.partition(s, -n, axis=0)[-n] if len(s) > n else -np.inf)))
                return q, s[d, q], ids[d]

            for batch in batches:
                found = []
                for at in range(0, batch.num_rows, BLOCK):
                    ids, t, part = batch.slice(at, BLOCK).columns
                    found.append(scored(ids.to_numpy(), t.value_lengths().to_numpy(), t.flatten().to_numpy(), part.flatten().to_numpy()))
                if found:
                    best = _first_of_each(*[np.concatenate([b, *x]) for b, x in zip(best, zip(*found, strict=True), strict=True)], n)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(columns[best[0]]), pa.array(best[2]), pa.array(best[1])], ["query_id", "doc_id", "score"])

        schema = f"query_id {dict(asked.dtypes)['query_id']}, doc_id long, score double"
        return small_batches(whole).mapInArrow(run, schema)

    def top(self, queries: DataFrame, n: int = params.RETRIEVAL["top_k"], keep: DataFrame | None = None, places: int = 6) -> DataFrame:
        """Top hits of each query. ``keep`` (doc_id) says which documents may be hits, before the cut; statistics cover all of them."""
        asked, rows = self._weighted(queries)
        few = small_enough(asked, params.BROADCAST_ROWS) and asked.select("term").distinct().count() * asked.select("query_id").distinct().count() <= WEIGHTS
        return ranked(self._best(asked, rows, places, n, keep) if few else self._sums(asked, rows, places, keep), n)
