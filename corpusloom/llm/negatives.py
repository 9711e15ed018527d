"""Operator 12: hard negatives of anchors, by bounds along spanning trees of the anchors.

1. Anchors of one label lie in blocks of about BLOCK neighbours (nearest of a few pivots, then a hash). Each block is joined by its minimum spanning tree.
2. All rows are dealt evenly into parts. Every part meets every block: the root's scores are computed; a child's score differs from its parent's by
   at most the edge times the candidate's norm, so intervals of scores run down the tree, and a candidate is scored again only where its interval meets the anchor's window.
   A score once computed starts a new, exact interval for the children.
3. Positives: the window is what may be among the best POSITIVES of the anchor's label; the anchors of its own block give its lower end.
4. Negatives: the window is SHARE of the lowest to all of the highest positive's score, among the other labels. A first round over the anchors alone gives
   a lower end for each positive, since the anchors are rows like others.

Each part sends on at most the best few for each anchor and positive, so no group of rows is gathered. A task holds one part (PART rows) and one block of anchors.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component take no part. Rows that repeat a vec_id are rows of their own, but
one anchor (with the smallest label, then vector), and no row with the anchor's id is its positive. Vectors of different lengths meet as if the shorter one went on with zeros. Equal scores go by the smaller
vec_id. An empty table, or one without anchors, gives no rows. Other columns don't take part. Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import textkit as tk
from corpusloom.storage import materialize

ANCHORS, MOVED, LABELS, GRAIN = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least this many hundredths of the positive's score.
SHARE = 80
PART, BLOCK, PIVOTS = 8192, 256, 64
#: A block's candidates are scored in one product where more than this share of them is asked for.
DENSE = 0.2
LOWEST = -(1 << 62)


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector of the rows that take part: moved labels, components in whole GRAINs."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("x", lambda v: F.floor(GRAIN * v)).alias("vector"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, shorter ones filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _packed(m: np.ndarray) -> tuple[int, int, bytes]:
    """(width in bytes, columns, values)."""
    width = 4 if np.abs(m).max(initial=0) < 1 << 31 else 8
    return width, m.shape[1], m.astype(f"<i{width}").tobytes()


def _unpacked(width: int, columns: int, values: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(values, f"<i{width}").reshape(rows, columns).astype(np.int64)


_MATRIX = "ids binary, labels binary, width int, columns int, vectors binary"


def parts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(part, ids, labels, width, columns, vectors of PART rows each, number of parts): all rows, dealt evenly."""
    n = max(1, -(-rows.count() // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                m = _packed(_matrix(batch.column("vector")))
                ids, labels = (batch.column(c).to_numpy().tobytes() for c in ("vec_id", "label"))
                yield pa.RecordBatch.from_pylist([{"part": part, "ids": ids, "labels": labels, "width": m[0], "columns": m[1], "vectors": m[2]}], pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("columns", pa.int32()), ("vectors", pa.binary())]))

    return materialize(rows.repartition(n).transform(tk.arrow, run, f"part int, {_MATRIX}"), "parts"), n


def spanning_tree(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent's place in that order, edge) of the minimum spanning tree; the root, the row nearest to all, comes first, parents before children, levels together."""
    n = len(m)
    x = m.astype(np.float64)
    square = (x * x).sum(1)
    distance = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    root = int(distance.sum(1).argmin())
    near, link, out = distance[root].copy(), np.full(n, root), np.zeros(n, bool)
    out[root] = True
    depth, parent = np.zeros(n, np.int64), np.full(n, -1)
    for _ in range(n - 1):
        k = int(np.where(out, np.inf, near).argmin())
        parent[k], depth[k], out[k] = link[k], depth[link[k]] + 1, True
        closer = distance[k] < near
        near[closer], link[closer] = distance[k][closer], k
    order = np.argsort(depth, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    up = np.where(parent[order] < 0, 0, place[parent[order]])
    edge = np.sqrt((((m[order] - m[order][up]).astype(np.float64)) ** 2).sum(1))
    return order, up, edge


def blocks(anchors: DataFrame, positives: int = POSITIVES) -> DataFrame:
    """block, label, n, ids, labels, width, columns, vectors, up, edges, least: trees of anchors, and a lower end of each anchor's window of positives."""
    n = anchors.count()
    pivots = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOTS, n // (4 * BLOCK)))).select("vector").collect()
    pivots = [r.vector for r in pivots]

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("vector")).astype(np.float64)
            wide = max([m.shape[1], *map(len, pivots)])
            p = np.array([[*v, *[0] * (wide - len(v))] for v in pivots], np.float64).reshape(len(pivots), wide)
            m = np.pad(m, ((0, 0), (0, wide - m.shape[1])))
            nearest = ((p * p).sum(1)[None, :] - 2 * m @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], [*batch.schema.names, "cell"])

    celled = materialize(anchors.transform(tk.arrow, cell, "vec_id long, label long, vector array<long>, cell int"), "anchors")
    sizes = celled.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("subs"))
    dealt = celled.join(sizes, ["label", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), "subs"))

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        m = _matrix(pa.array(pdf["vector"], pa.list_(pa.int64())))
        order, up, edge = spanning_tree(m)
        ids, m = pdf["vec_id"].to_numpy()[order], m[order]
        least = np.full(len(m), LOWEST)
        if len(m) > positives:
            scores = m @ m.T
            np.fill_diagonal(scores, LOWEST)
            least = np.partition(scores, -positives, axis=1)[:, -positives]
        width, columns, values = _packed(m)
        row = (str(pdf["label"].iloc[0]) + f"/{pdf['cell'].iloc[0]}/{pdf['sub'].iloc[0]}", int(pdf["label"].iloc[0]), len(m), ids.astype("<i8").tobytes(), b"", width, columns, values, up.astype("<i4").tobytes(), edge.tobytes(), least.astype("<i8").tobytes())
        return pd.DataFrame([row], columns=["block", "label", "n", "ids", "labels", "width", "columns", "vectors", "up", "edges", "least"])

    return materialize(dealt.groupBy("label", "cell", "sub").applyInPandas(tree, f"block string, label long, n int, {_MATRIX}, up binary, edges binary, least binary"), "anchor-blocks")


class _Part:
    """The rows of one part, by label."""

    def __init__(self):
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ready = False

    def add(self, row: dict) -> None:
        ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.pieces.append((ids, labels, _unpacked(row["width"], row["columns"], row["vectors"], len(ids))))
        self.ready = False

    def close(self) -> None:
        if not self.ready:
            wide = max(m.shape[1] for *_, m in self.pieces)
            self.ids, self.labels = (np.concatenate([x[k] for x in self.pieces]) for k in (0, 1))
            self.rows = np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for *_, m in self.pieces])
            order = np.lexsort((self.ids, self.labels))
            self.ids, self.labels, self.rows = self.ids[order], self.labels[order], self.rows[order]
            self.norms = np.sqrt((self.rows.astype(np.float64) ** 2).sum(1))
            self.ready = True


def _exact(most: float):
    """The type in which sums up to ``most`` are exact; 64-bit integers beyond."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def tree_scores(anchors: np.ndarray, up: np.ndarray, edges: np.ndarray, rows: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, scored): scores of anchors by rows; ``scored`` is true wherever the score can lie in the anchor's window [low, high], and only there scores are known."""
    wide = max(anchors.shape[1], rows.shape[1])
    anchors, rows = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (anchors, rows))
    lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    kind = _exact(float(lengths.max(initial=0)) * float(norms.max(initial=0)))
    a, c = anchors.astype(kind), rows.astype(kind)
    least, most = np.empty((len(a), len(c))), np.empty((len(a), len(c)))
    scores, scored = np.zeros((len(a), len(c)), np.int64), np.zeros((len(a), len(c)), bool)
    at = 0
    while at < len(a):
        stop = at + 1
        while at and stop < len(a) and up[stop] < at:  # all whose parents are done
            stop += 1
        if at:
            slack = edges[at:stop, None] * norms[None, :] * (1 + 1e-9) + 1
            least[at:stop], most[at:stop] = least[up[at:stop]] - slack, most[up[at:stop]] + slack
            asked = (most[at:stop] >= low[at:stop, None]) & (least[at:stop] <= high[at:stop, None])
        else:
            asked = np.ones((1, len(c)), bool)
        many = asked.mean(1) > DENSE if len(c) else np.zeros(stop - at, bool)
        asked[many] = True
        if many.any():
            dense = np.flatnonzero(many) + at
            scores[dense] = a[dense] @ c.T
            least[dense] = most[dense] = scores[dense]
        for k in np.flatnonzero(~many) + at:
            some = np.flatnonzero(asked[k - at])
            scores[k, some] = c[some] @ a[k]
            least[k, some] = most[k, some] = scores[k, some]
        scored[at:stop] = asked
        at = stop
    return scores, scored


def _first(keys: list[np.ndarray], scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best of each key, by score, then id."""
    order = np.lexsort((ids, -scores, *reversed(keys)))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < n]


def _block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    return np.frombuffer(row["ids"], "<i8"), _unpacked(row["width"], row["columns"], row["vectors"], n), np.frombuffer(row["up"], "<i4"), np.frombuffer(row["edges"], "<f8")


def _best_positives(row: dict, part: _Part, n: int) -> list[np.ndarray]:
    """[anchor's place, its id, positive's id, score] of the part's best for each anchor."""
    ids, a, up, edges = _block(row)
    own = slice(*np.searchsorted(part.labels, [row["label"], row["label"] + 1]))
    least = np.frombuffer(row["least"], "<i8")
    scores, scored = tree_scores(a, up, edges, part.rows[own], part.norms[own], least.astype(np.float64), np.full(len(a), np.inf))
    k, c = np.nonzero(scored & (scores >= least[:, None]))
    other = ids[k] != part.ids[own][c]
    k, c = k[other], c[other]
    best = _first([k], scores[k, c], part.ids[own][c], n)
    return [k[best], ids[k[best]], part.ids[own][c[best]], scores[k[best], c[best]]]


def _best_negatives(row: dict, part: _Part, n: int) -> list[np.ndarray]:
    """[anchor's place, positive's place, negative's id, score] of the part's best in the window of each positive."""
    ids, a, up, edges = _block(row)
    w = np.array([(x["anchor"], x["place"], x["low"], x["high"]) for x in row["windows"]], np.int64).reshape(-1, 4)
    w = w[w[:, 2] <= w[:, 3]]
    low, high = np.full(len(a), np.inf), np.full(len(a), -np.inf)
    np.minimum.at(low, w[:, 0], w[:, 2])
    np.maximum.at(high, w[:, 0], w[:, 3])
    own = np.searchsorted(part.labels, [row["label"], row["label"] + 1])
    out = []
    for others in (slice(0, own[0]), slice(own[1], None)):
        if not len(part.ids[others]) or not len(w):
            continue
        scores, scored = tree_scores(a, up, edges, part.rows[others], part.norms[others], low, high)
        k, c = np.nonzero(scored & (scores >= low[:, None]) & (scores <= high[:, None]))
        s, names = scores[k, c], part.ids[others][c]
        at = np.searchsorted(k, np.arange(len(a) + 1))
        for anchor, place, least, most in w:
            here = slice(at[anchor], at[anchor + 1])
            fit = np.flatnonzero((s[here] >= least) & (s[here] <= most)) + at[anchor]
            if len(fit):
                fit = fit[np.lexsort((names[fit], -s[fit]))[:n]]
                out.append(np.array([np.full(len(fit), anchor), np.full(len(fit), place), names[fit], s[fit]]))
    if not out:
        return [np.zeros(0, np.int64)] * 4
    k, place, names, s = np.concatenate(out, axis=1)
    best = _first([k, place], s, names, n)
    return [k[best], place[best], names[best], s[best]]


def _meet(dealt: tuple[DataFrame, int], trees: DataFrame, best, names: list[str], n: int) -> DataFrame:
    """block and four columns: what ``best`` takes from each part for each block."""
    rows, count = dealt
    own = rows.select("part", F.lit(False).alias("asks"), *_MATRIX.replace(" binary", "").replace(" int", "").split(", "))
    asks = trees.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("part"), F.lit(True).alias("asks"), "*")
    both = own.unionByName(asks, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "asks", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, _Part()
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != held:
                    held, part = row["part"], _Part()
                if not row["asks"]:
                    part.add(row)
                elif part.pieces:
                    part.close()
                    found = best(row, part, n)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(found[0])), *[pa.array(x.astype(np.int64)) for x in found]], ["block", *names])

    return both.transform(tk.arrow, run, ", ".join(["block string", *[f"{x} long" for x in names]]))


def _negatives(dealt: tuple[DataFrame, int], trees: DataFrame, windows: DataFrame) -> DataFrame:
    """block, anchor, place, negative_id, score, rank of each positive's best negatives. ``windows``: block, anchor, place, low, high."""
    of = windows.groupBy("block").agg(F.collect_list(F.struct("anchor", "place", "low", "high")).alias("windows"))  # at most BLOCK or so x POSITIVES
    found = _meet(dealt, trees.drop("least").join(of, "block"), _best_negatives, ["anchor", "place", "negative_id", "score"], NEGATIVES)
    order = Window.partitionBy("block", "anchor", "place").orderBy(F.desc("score"), "negative_id")
    return materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES), "negatives")


def mine(vectors: DataFrame, every: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor (vec_id divisible by ``every``) and positive."""
    rows = materialize(prepare(vectors), "rows")
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")
    anchors = materialize(anchors, "anchor-rows")
    trees = blocks(anchors)
    dealt = parts(rows)
    found = _meet(dealt, trees, _best_positives, ["anchor", "anchor_id", "positive_id", "score"], POSITIVES)
    order = Window.partitionBy("block", "anchor").orderBy(F.desc("score"), "positive_id")
    positives = materialize(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= POSITIVES), "positives")
    least = F.expr(f"(score * {SHARE} + 99) div 100")  # rounded up; below 0 the window is empty either way
    windows = positives.select("block", "anchor", F.col("place").cast("long").alias("place"), least.alias("low"), F.col("score").alias("high"))
    near = _negatives(parts(anchors), trees, windows).where(F.col("rank") == NEGATIVES).select("block", "anchor", "place", F.col("score").alias("floor"))
    windows = windows.join(near, ["block", "anchor", "place"], "left").select("block", "anchor", "place", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high")
    negatives = _negatives(dealt, trees, materialize(windows, "windows"))
    out = positives.select("block", "anchor", F.col("place").cast("long").alias("place"), "anchor_id", "positive_id", F.col("score").alias("positive_score")).join(negatives, ["block", "anchor", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
