"""Operator 5: quality classifier, a generalised additive model with pairwise interactions.

Features are measured on whole texts. Shallow trees on one feature at a time are boosted in cycles; their
sum is a lookup table for each feature. Pairs with the largest gain on the residuals get tables of two
dimensions, sums of shallow trees over both features. A text is scored by adding up the table entries of its bins.

Defined cases: null text counts as empty; an empty text has zero features and a score like any other; a text's features don't depend on the rows
beside it; repeated rows score alike; very long texts are read whole; if no labelled
row (or a single class) is there to learn from, every score is the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import textkit as tk
from corpusloom.llm.samples import FIT_ROWS, labelled, remainder

FOLDS, HELD = 5, 0
THRESHOLD = 0.3
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 200, 0.1, 6, 8, 60
FEATURES = ("log_words", "word_length", "letters", "upper", "digits", "symbols", "pipes", "marks", "distinct", "top_word", "repeats", "longest_run", "lines_repeated", "line_length", "long_words", "symbol_words", "upper_words", "accents")

_LETTER = tk.IN_LETTERS
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_PIPE = np.zeros(256, bool)
_PIPE[ord("|")] = True
_SYMBOL = tk.IN_WORD & ~_LETTER & ~_DIGIT & ~_MARK
_ACCENT = np.zeros(256, bool)
_ACCENT[192:] = True


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    words = tk.Words(column)
    raw, offsets, n = words.raw, words.offsets, words.rows
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    size = np.maximum(np.diff(offsets), 1)
    count = np.maximum(words.count, 1)

    def share(table):
        total = np.concatenate([[0], np.cumsum(table[raw])])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    def per_word(values):
        return np.bincount(words.doc, weights=values, minlength=n) / count

    out[:, 0] = np.log1p(words.count)
    for k, table in ((2, _LETTER), (3, _UPPER), (4, _DIGIT), (5, _SYMBOL), (6, _PIPE), (7, _MARK), (17, _ACCENT)):
        out[:, k] = share(table)
    # lines: their repeats, and words to a line
    feeds = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds[feeds + 1 < len(raw)] + 1]))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    codes = tk.PLACE_CODES[place & 4095] + (place >> 12).astype(np.uint64) * tk.FAR_CODE
    line_row = np.searchsorted(offsets, starts, side="right") - 1
    line = tk.mix(np.add.reduceat(tk.BYTE_CODES[raw] * codes, starts))
    lo = np.lexsort((line, line_row))
    same = np.zeros(len(line), bool)
    same[1:] = (line[lo][1:] == line[lo][:-1]) & (line_row[lo][1:] == line_row[lo][:-1])
    lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    out[:, 12] = np.bincount(line_row[lo], weights=same, minlength=n) / lines
    out[:, 13] = np.log1p(words.count / lines)
    if not len(words.start):
        return out
    # words: a text without any has zeros here, alone as among others
    length = words.end - words.start
    out[:, 1] = per_word(length)
    h = words.hashes()
    order = np.lexsort((h, words.doc))
    hs, ds = h[order], words.doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(hs)))
    out[:, 8] = np.bincount(ds[at], minlength=n) / count
    top = np.zeros(n)
    np.maximum.at(top, ds[at], times)
    out[:, 9] = top / count
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    out[:, 10] = per_word(again)
    edge = np.flatnonzero(~again)
    run = np.zeros(n)
    np.maximum.at(run, words.doc[edge], np.diff(np.append(edge, len(h))))
    out[:, 11] = np.log1p(run)
    out[:, 14] = per_word(length > 20)
    ends = raw[words.end - 1]
    out[:, 15] = per_word(_SYMBOL[ends] | ((ends == ord("!")) & (length > 1) & _MARK[raw[np.maximum(words.end - 2, 0)]]))
    out[:, 16] = per_word(_UPPER[raw[words.start]] & _UPPER[raw[np.minimum(words.start + 1, len(raw) - 1)]] & (length > 1))
    return out


@dataclass
class Additive:
    """Bin edges and lookup tables; small (a few thousand numbers), whatever the corpus."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, splits: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins: the best cut, then the best cut of the better side; Newton steps as leaves."""
    leaves = [(0, len(g))]
    for _ in range(splits):
        best = None
        for k, (a, b) in enumerate(leaves):
            G, H = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            if b - a < 2:
                continue
            left, lh, right, rh = G[:-1], H[:-1], G[-1] - G[:-1], H[-1] - H[:-1]
            gain = left**2 / (lh + 1) + right**2 / (rh + 1) - G[-1] ** 2 / (H[-1] + 1)
            c = int(np.argmax(gain))
            if best is None or gain[c] > best[0]:
                best = (gain[c], k, a + c + 1)
        if best is None or best[0] <= 1e-9:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """(gain, axis, place) of the best straight cut of a block of cells; gain 0 if none helps."""
    best = (0.0, 0, 0)
    for axis in (0, 1):
        G, H = np.cumsum(g.sum(1 - axis)), np.cumsum(h.sum(1 - axis))
        if len(G) > 1:
            gain = G[:-1] ** 2 / (H[:-1] + 1) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + 1) - G[-1] ** 2 / (H[-1] + 1)
            c = int(np.argmax(gain))
            best = max(best, (float(gain[c]), axis, c + 1), key=lambda b: b[0])
    return best


def _pair_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over the cells of two features: straight cuts to ``depth``, Newton steps as leaves."""
    gain, axis, c = _cut(g, h) if depth else (0.0, 0, 0)
    if gain <= 1e-9:
        return np.full(g.shape, g.sum() / (h.sum() + 1))
    parts = [_pair_tree(a, b, depth - 1) for a, b in zip(np.split(g, [c], axis), np.split(h, [c], axis), strict=True)]
    return np.concatenate(parts, axis)


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost one-feature trees in cycles, then shallow two-feature trees of the strongest pairs; classes count alike."""
    n = x.shape[1] if x.ndim == 2 else len(FEATURES)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        base = float(np.clip(share, 1e-3, 1 - 1e-3))
        return Additive(float(np.log(base / (1 - base))), [np.zeros(0)] * n, [np.zeros(1)] * n, [], [np.zeros(0)] * n, [])
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    edges = [_cuts(x[:, f], BINS) for f in range(n)]
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(n)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    base, margin = 0.0, np.zeros(len(y))
    for _ in range(ROUNDS):
        for f in range(n):
            p = 1 / (1 + np.exp(-margin))
            g = np.bincount(bins[f], weights=weight * (y - p), minlength=len(tables[f]))
            h = np.bincount(bins[f], weights=weight * p * (1 - p), minlength=len(tables[f]))
            step = RATE * _tree(g, h)
            tables[f] += step
            margin += step[bins[f]]
    pair_edges = [_cuts(x[:, f], PAIR_BINS) for f in range(n)]
    pair_bins = [np.searchsorted(pair_edges[f], x[:, f], side="right") for f in range(n)]
    p = 1 / (1 + np.exp(-margin))
    gains = []
    for a in range(n):
        for b in range(a):
            cell = pair_bins[a] * (PAIR_BINS + 1) + pair_bins[b]
            g = np.bincount(cell, weights=weight * (y - p), minlength=(PAIR_BINS + 1) ** 2)
            h = np.bincount(cell, weights=weight * p * (1 - p), minlength=(PAIR_BINS + 1) ** 2)
            gains.append((float((g**2 / (h + 1)).sum()), a, b))
    pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    pair_tables = [np.zeros((PAIR_BINS + 1, PAIR_BINS + 1)) for _ in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            cell = pair_bins[a] * (PAIR_BINS + 1) + pair_bins[b]
            p = 1 / (1 + np.exp(-margin))
            g = np.bincount(cell, weights=weight * (y - p), minlength=(PAIR_BINS + 1) ** 2)
            h = np.bincount(cell, weights=weight * p * (1 - p), minlength=(PAIR_BINS + 1) ** 2)
            step = RATE * _pair_tree(g.reshape(PAIR_BINS + 1, -1), h.reshape(PAIR_BINS + 1, -1))
            pair_tables[k] += step
            margin += step.ravel()[cell]
    # classes were weighted alike, so 1/2 divides them best: move that point to the threshold of the contract
    base += float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return Additive(base, edges, tables, pairs, pair_edges, pair_tables)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Additive:
    """Fit on a bounded labelled sample: features are measured on executors, the driver gets ``rows`` short rows."""
    sample = labelled(docs, labels, "quality", FOLDS, HELD, rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])

    got = sample.transform(tk.arrow, measure, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = np.array(got.column("label").to_pylist(), dtype=float)
    order = np.lexsort((*x.T, y))  # sums in one order, however the rows came
    return fit(x[order], y[order])


def _scores(model: Additive, batch: pa.RecordBatch) -> np.ndarray:
    return np.round(model.score(features(batch.column("text"))), 9)


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """The documents with score and predicted; all their other columns stay, columns of these names give way."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            s = _scores(model, batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.transform(tk.arrow, run, schema)


def keep_good(docs: DataFrame, model: Additive) -> DataFrame:
    """The documents whose score (as ``score`` gives it) reaches the threshold, with all their columns and nothing added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            yield batch.filter(pa.array(_scores(model, batch) >= THRESHOLD))

    return docs.transform(tk.arrow, run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (remainder(FOLDS) == HELD).alias("held_out"), "score", "predicted")
