"""Operator 11: ranked lexical search of many items at once, with common parts of their queries evaluated once.

1. Terms: the items' terms are few, so one pass over the documents keeps of each text its number of terms and the counts of asked terms alone.
2. Shared term sets: terms that occur in exactly the same items are one set, a leaf of the sharing DAG. Then the pair of nodes that
   most items hold becomes a node of its own, that replaces both in these items, until no pair is shared.
3. Accumulators: for a block of documents, each posting is added to its leaf once, each inner node is the sum of two nodes, and each item sums up the nodes it is left
   with. All parts are integers, so any order of summing gives the same score.
4. Every task keeps the best documents of each item; a window over the tasks' few candidates gives the ranks.

Items go through the driver in blocks of at most ITEMS; each block is one pass over the documents, and its DAG is what is broadcast. A block of items with very many
terms is mined less (PAIRS bounds the pairs looked at), which costs additions, not results. Terms are compared by 64-bit hashes.

Defined cases: rows of one item_id are one item with the terms of all its texts; a null item_id is an item like others. A null or empty text has no term, and isn't counted in N. Rows
that repeat a doc_id are documents of their own; a null doc_id comes after all others among equal scores. Very long texts are read whole. An empty table gives no
rows, and so does an item without terms. Other columns, whatever their names, don't take part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm import textkit as tk
from corpusloom.storage import materialize

TOP = 50
#: Items of one pass over the documents.
ITEMS = 2_000
#: Pairs of nodes that mining looks at in one block of items.
PAIRS = 4_000_000
#: Documents that are scored at a time, times the nodes of the DAG: accumulators of 8 bytes each.
CELLS = 4_000_000
#: Fixed values of the contract's score.
SCALE, GRAIN, HALF, FLAT = 1_000_000_000, 1000, 50, 20
#: Terms: letters and digits of ASCII, and all bytes of longer UTF-8 sequences.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(texts: list[str]) -> list[np.ndarray]:
    """Distinct term hashes of each text."""
    words = tk.Words(pa.array(texts, pa.string()), inside=IN_TERM)
    h = words.hashes()
    return [np.unique(h[words.first[r] : words.first[r + 1]]) for r in range(words.rows)]


@dataclass
class Sharing:
    """Items as sums over a DAG: ``leaf`` of each term; inner node ``leaves + k`` is the sum of ``pairs[k]``; ``sums`` are the nodes of each item."""

    leaf: np.ndarray
    leaves: int
    pairs: list[tuple[int, int]] = field(default_factory=list)
    sums: list[list[int]] = field(default_factory=list)

    @classmethod
    def mine(cls, items: list[list[int]], n_terms: int, most: int = PAIRS) -> Sharing:
        """From the term numbers of each item."""
        holders = defaultdict(list)
        for k, terms in enumerate(items):
            for t in terms:
                holders[t].append(k)
        sets: dict[tuple, int] = {}
        leaf = np.zeros(n_terms, np.int64)
        for t in range(n_terms):
            leaf[t] = sets.setdefault(tuple(holders[t]), len(sets))
        nodes = [set() for _ in items]
        within: dict[int, set[int]] = {n: set(held) for held, n in sets.items()}
        for n, held in within.items():
            for k in held:
                nodes[k].add(n)
        out = cls(leaf, len(sets))
        counts: Counter = Counter()
        room = most
        for k in sorted(range(len(items)), key=lambda k: len(nodes[k])):
            shared = sorted(n for n in nodes[k] if len(within[n]) > 1)
            room -= len(shared) ** 2 // 2
            if room < 0:
                break
            counts.update((a, b) for i, a in enumerate(shared) for b in shared[i + 1 :])
        by_count = defaultdict(set)
        for pair, c in counts.items():
            if c > 1:
                by_count[c].add(pair)
        top = max(by_count, default=0)
        while top > 1:
            if not by_count[top]:
                top -= 1
                continue
            a, b = min(by_count[top])
            by_count[top].discard((a, b))
            held = within[a] & within[b]
            if len(held) != top:  # less are left than were counted
                if len(held) > 1:
                    by_count[len(held)].add((a, b))
                continue
            new = out.leaves + len(out.pairs)
            out.pairs.append((a, b))
            within[new] = held
            again: Counter = Counter()
            for k in held:
                nodes[k] -= {a, b}
                again.update(n for n in nodes[k] if len(within[n]) > 1)
                nodes[k].add(new)
            within[a] = within[a] - held
            within[b] = within[b] - held
            for n, c in again.items():
                if c > 1:
                    by_count[c].add((n, new))
        out.sums = [sorted(x) for x in nodes]
        return out

    def additions(self) -> int:
        return len(self.pairs) + sum(map(len, self.sums))

    def scores(self, rows: np.ndarray, terms: np.ndarray, parts: np.ndarray, n_rows: int) -> np.ndarray:
        """Item by row: the items' scores from postings (row, term, part)."""
        acc = np.zeros((self.leaves + len(self.pairs), n_rows), np.int64)
        np.add.at(acc, (self.leaf[terms], rows), parts)
        for k, (a, b) in enumerate(self.pairs):
            np.add(acc[a], acc[b], out=acc[self.leaves + k])
        out = np.zeros((len(self.sums), n_rows), np.int64)
        for k, nodes in enumerate(self.sums):
            for n in nodes:
                out[k] += acc[n]
        return out


def asked_terms(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in the sorted vocabulary), tfs of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in tk.slices(batches):
            words = tk.Words(batch.column("text"), inside=IN_TERM)
            h = words.hashes()
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            keys, tfs = np.unique(words.doc[hit] * len(known) + at[hit], return_counts=True)
            ends = np.searchsorted(keys, np.arange(words.rows + 1) * len(known)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % len(known), tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(tk.arrow, run, "doc_id long, n long, terms array<int>, tfs array<int>")
    rows = materialize(rows, "asked-terms")
    sent.destroy()
    return rows


def _parts(n: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What each posting adds to a score; all in 64-bit integers."""
    m = 100 - HALF + (HALF * n * docs) // total
    return weights * ((SCALE * tfs) // (GRAIN * tfs + FLAT * m))


class _Best:
    """The best (item, score, doc_id) of a task."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.ones(items, np.int64)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        item, row = np.nonzero(scores >= self.floor[:, None])
        new = (item, scores[item, row], ids[row], nameless[row])
        item, score, doc, null = (np.concatenate(x) for x in zip(self.kept, new, strict=True))
        order = np.lexsort((doc, null, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.top]
        self.kept = tuple(x[order] for x in (np.concatenate([self.kept[0], new[0]]), score, doc, null))
        last = order[np.searchsorted(self.kept[0], np.arange(len(self.floor)), "right") - 1] if len(order) else order
        held = np.bincount(self.kept[0], minlength=len(self.floor))
        full = held >= self.top
        if full.any():
            self.floor[full] = score[last[full]]


def _ranked(rows: DataFrame, sharing: Sharing, weights: np.ndarray, docs: int, total: int, top: int) -> DataFrame:
    """item (its number), doc_id, score: the candidates of all tasks."""
    sent = rows.sparkSession.sparkContext.broadcast((sharing, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, w = sent.value
        best = _Best(len(dag.sums), top)
        step = max(16, CELLS // (dag.leaves + len(dag.pairs) + len(dag.sums)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                terms = part.column("terms")
                ends = terms.offsets.to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(ends))
                numbers = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tfs = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = part.column("n").to_numpy(zero_copy_only=False)
                parts = _parts(n[row], tfs, w[numbers], docs, total)
                ids = part.column("doc_id")
                best.add(dag.scores(row, numbers, parts, part.num_rows), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        item, score, doc, null = best.kept
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    found = materialize(rows.where("size(terms) > 0").transform(tk.arrow, run, "item long, doc_id long, score long"), "candidates")
    sent.destroy()
    return found


def _weights(rows: DataFrame, n_terms: int) -> tuple[np.ndarray, int, int]:
    """(weight of each term, documents with terms, their terms)."""
    docs, total = rows.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(n_terms, np.int64)
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        weights[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
    return weights, docs, total


def _blocks(items: DataFrame, most: int) -> Iterator[dict]:
    """The items' texts, by item_id, at most so many items at a time."""
    held: dict = {}
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if r.item_id not in held and len(held) == most:
            yield held
            held = {}
        held.setdefault(r.item_id, []).append(r.text)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_items: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, most_items):
        names = list(block)
        hashed = [np.unique(np.concatenate(terms_of(texts))) for texts in block.values()]
        vocabulary = np.unique(np.concatenate(hashed))
        if not len(vocabulary):
            continue
        sharing = Sharing.mine([np.searchsorted(vocabulary, h).tolist() for h in hashed], len(vocabulary))
        rows = asked_terms(docs, vocabulary)
        found = _ranked(rows, sharing, *_weights(rows, len(vocabulary)), top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        numbered = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "item long, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(numbered), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
