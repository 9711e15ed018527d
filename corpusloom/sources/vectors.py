"""An inverted-file vector index on storage: vectors by cell, exact top hits from the cells that can hold one.

Cells are fitted by k-means on a bounded sample; every vector is stored in the cell of its nearest centroid. A cell's centroid, radius and largest norm bound the inner product
of a query with all its vectors. A query first reads the cells of its highest bounds; its n-th best score so far then rules out every cell whose bound lies below. So the hits
are those of a full scan, and a filter, applied in the scan, comes before the cut.

Layout under the root, all Parquet: ``vectors`` (cell | the table's columns, sorted by id), ``cells`` (a row for each), ``manifest`` (one row, written last).
Rows without a vector are stored nowhere. Queries go through the driver in blocks of QUERIES, with QUERIES x MOST_CELLS bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import params
from corpusloom.operators.retrieval import TILE, _blocks, _first_of_each, _tile_best, ranked
from corpusloom.storage import materialize

SAMPLE, MOST_CELLS, CELL_ROWS, ROUNDS = 20_000, 1024, 500, 10
QUERIES = 4096
#: Cells that a query reads before its bound is known, and vectors of one file.
PROBES, FILE_ROWS = 2, 500_000
MANIFEST = "revision string, vec_id string, n_rows long, schema string"
CELLS = "cell int, centroid array<double>, n long, radius double, norm double"


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of so many cells by k-means, the same for the same rows in the same order."""
    centroids = sample[np.random.default_rng(0).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        near = _nearest(sample, centroids)[0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, distance to it) of each row."""
    near = ((centroids**2).sum(1)[None, :] - 2 * m @ centroids.T).argmin(1)
    return near, np.sqrt(((m - centroids[near]) ** 2).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str, manifest):
        self.spark, self.root, self.revision, self.key, self.n_rows = spark, root.rstrip("/"), manifest.revision, manifest.vec_id, manifest.n_rows
        self.rows = spark.read.schema(manifest.schema).option("basePath", f"{self.root}/vectors").parquet(f"{self.root}/vectors")
        cells = spark.read.schema(CELLS).parquet(f"{self.root}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.cells = np.array([c.cell for c in cells], np.int64)
        self.centroids, self.n = np.array([c.centroid for c in cells], np.float64), np.array([c.n for c in cells], np.int64)
        self.radius, self.norm = np.array([c.radius for c in cells]), np.array([c.norm for c in cells])

    @classmethod
    def build(cls, vectors: DataFrame, root: str, revision: str, key: str = "vec_id", cells: int | None = None) -> VectorIndex:
        """Store ``vectors`` (key, embedding and any other columns, on which later queries may filter) for one revision of the model."""
        spark, root = vectors.sparkSession, root.rstrip("/")
        rows = vectors.where(F.col("embedding").isNotNull())
        n = rows.count()
        sample = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("embedding").collect()
        wanted = cells or max(1, min(MOST_CELLS, n // CELL_ROWS))
        centroids = fit(np.array([r.embedding for r in sample], np.float64), wanted) if sample else np.zeros((1, 0))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column("embedding"))
                cell, distance = _nearest(m, centroids)
                more = [pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(np.sqrt((m * m).sum(1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "cell", "_distance", "_norm"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        found = materialize(rows.mapInArrow(assign, schema + ", cell int, _distance double, _norm double"), "assigned")
        stats = found.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("_distance").alias("radius"), F.max("_norm").alias("norm"))
        table = {r.cell: r for r in stats.collect()}  # MOST_CELLS at most
        spark.createDataFrame([(c, centroids[c].tolist(), r.n, r.radius, r.norm) for c, r in sorted(table.items())], CELLS).coalesce(1).write.mode("overwrite").parquet(f"{root}/cells")
        files = spark.createDataFrame([(c, -(-r.n // FILE_ROWS)) for c, r in table.items()], "cell int, _files long")
        dealt = found.join(F.broadcast(files), "cell").withColumn("_file", F.pmod(F.xxhash64(key), "_files"))
        dealt = dealt.repartition("cell", "_file").sortWithinPartitions("cell", key).select(*rows.columns, "cell")
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{root}/vectors")
        spark.createDataFrame([(revision, key, n, schema + ", cell int")], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest")
        return cls.open(spark, root, revision)

    @classmethod
    def open(cls, spark: SparkSession, root: str, revision: str) -> VectorIndex:
        """The index, if it is of this revision; a missing or another one is an error."""
        try:
            row = spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/manifest").first()
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            row = None
        found = row.revision if row else None
        if found != revision:
            raise ValueError(f"index revision {found}, wanted {revision}")
        return cls(spark, root, row)

    def get(self, ids: DataFrame) -> DataFrame:
        """The stored rows of the asked keys; keys that aren't there give none."""
        asked = ids.select(self.key).distinct()
        return self.rows.drop("cell").join(asked, self.key, "left_semi")

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Query by cell: no vector of the cell has a higher inner product with the query.

        Two bounds hold: the centroid's product and the way from it, and, as the triangle inequality limits how near a vector comes, the law of cosines.
        """
        if not len(self.cells):
            return np.zeros((len(q), 0))
        length = np.sqrt((q * q).sum(1))[:, None]
        products = q @ self.centroids.T
        away = np.sqrt(np.maximum(length**2 + (self.centroids**2).sum(1)[None, :] - 2 * products, 0))
        by_centroid = products + length * self.radius[None, :]
        by_distance = (length**2 + self.norm[None, :] ** 2 - np.maximum(away - self.radius[None, :], 0) ** 2) / 2
        return np.minimum(by_centroid, by_distance) + 1e-9

    def _scan(self, q_ids: np.ndarray, q: np.ndarray, asked: np.ndarray, n: int, places: int, keep: Column | None) -> DataFrame:
        """query_id, key, score: the best of each task among the cells that each query asks for."""
        sent = self.spark.sparkContext.broadcast((q_ids, q, {int(c): np.flatnonzero(asked[:, k]) for k, c in enumerate(self.cells) if asked[:, k].any()}))
        rows = self.rows.where(F.col("cell").isin(self.cells[asked.any(0)].tolist()))
        rows = (rows.where(keep) if keep is not None else rows).select(self.key, "embedding", "cell")
        key = self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors, wanted = sent.value
            best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
            for batch in batches:
                cells = batch.column("cell").to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.diff(cells)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)], strict=True):
                    for at in range(a, b, TILE[1]):
                        part = batch.slice(at, min(TILE[1], b - at))
                        ids, m = part.column(key).to_numpy(zero_copy_only=False), _matrix(part.column("embedding"))
                        own = wanted[int(cells[a])]
                        for start in range(0, len(own), TILE[0]):
                            some = own[start : start + TILE[0]]
                            r, scores, columns = _tile_best(vectors[some], m, n, places)
                            best = _first_of_each(*[np.concatenate(x) for x in zip(best, (some[r], scores, ids[columns]), strict=True)], n)
            r, scores, ids = best
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(ids), pa.array(scores)], ["query_id", key, "score"])

        return materialize(rows.mapInArrow(run, f"query_id long, `{key}` long, score double"), "hits")

    def query(self, queries: DataFrame, n: int = params.RETRIEVAL["top_k"], keep: Column | None = None, places: int = 6, most_queries: int = QUERIES) -> DataFrame:
        """query_id, key, score, rank, share: the n best stored vectors of each query (query_id, embedding) among those that ``keep`` (on stored columns) lets pass.

        ``share`` is the part of all vectors that the query was compared with.
        """
        out = self.spark.createDataFrame([], f"query_id long, `{self.key}` long, score double, rank int, share double")
        for names, q in _blocks(queries, most_queries):
            bounds = self.bounds(q)
            probes = np.argsort(-bounds, axis=1, kind="stable")[:, :PROBES]
            asked = np.zeros(bounds.shape, bool)
            np.put_along_axis(asked, probes, True, axis=1)
            first = self._scan(names, q, asked, n, places, keep)
            floor = np.full(len(q), -np.inf)
            at = {int(x): k for k, x in enumerate(names)}
            for r in ranked(first, n, item=self.key).where(F.col("rank") == n).select("query_id", "score").collect():  # one row for each query of the block
                floor[at[r.query_id]] = r.score
            more = (bounds >= floor[:, None] - 10.0**-places) & ~asked
            hits = first.unionByName(self._scan(names, q, more, n, places, keep)) if more.any() else first
            share = ((asked | more) @ self.n) / max(self.n_rows, 1)
            told = self.spark.createDataFrame([(int(x), float(s)) for x, s in zip(names, share, strict=True)], "query_id long, share double")
            out = out.unionByName(ranked(hits, n, item=self.key).join(F.broadcast(told), "query_id"))
        return out
