"""Operator 2: toxicity by weak supervision.

Many voters fire on a text: words of a seed lexicon, word forms and stems mined from labelled texts, and
patterns. A generative label model estimates the voters' accuracies (their fire rates given the hidden label) by EM over a
sample of texts with and without labels; labels give the first rates only. What two voters fire together beyond their
class's rates is their correlation, estimated for each pair; a voter counts as one over the voters it repeats. The model's
posteriors alone are the training labels of a linear classifier over the voters, which scores all texts.

Defined cases: null text counts as empty; an empty text fires no voter and scores the classifier's base rate; without
labelled texts (or with one class only) the seed lexicon alone decides; repeated rows score alike; very long texts are read whole; equally strong
mined forms are taken in the order of their hashes; other columns don't take part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.llm.samples import FIT_ROWS, UNLABELLED_ROWS, labelled, remainder, unlabelled

FOLDS, HELD = 4, 2
THRESHOLD = 0.3
MINED = 400
STEMS = (4, 5, 6, 7)
# Seed lexicon of insults.
SEEDS = ("idiot", "idiots", "stupid", "moron", "morons", "dumb", "loser", "losers", "trash", "garbage", "scum", "pathetic", "worthless", "disgusting", "clown", "clowns", "filthy", "vermin", "imbecile", "cretin")
PATTERNS = ("two_hits", "three_kinds", "dense_hits", "shouted_hit", "addressed_hit")


def _hash_word(word: str) -> int:
    return int(tk.Words(pa.array([word]), inside=tk.IN_LETTERS).hashes()[0])


SEED_HASHES = np.sort(np.array([_hash_word(w) for w in SEEDS], np.uint64))
YOU_HASHES = np.sort(np.array([_hash_word(w) for w in ("you", "your", "youre")], np.uint64))


def forms(words: tk.Words) -> list[np.ndarray]:
    """Hashes of each word and of its stems."""
    return [words.hashes(), *[words.hashes(k) for k in STEMS]]


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in the sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class Sieve:
    """Finds a few hundred hashes among millions: a bit table first, a sorted search for what passes."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(table & np.uint64(65535)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, indices in the table) of the values that are in it."""
        maybe = np.flatnonzero(self.bits[(values & np.uint64(65535)).astype(np.int64)])
        at = _among(values[maybe], self.table)
        return maybe[at >= 0], at[at >= 0]


def votes(column: pa.Array, mined: np.ndarray) -> np.ndarray:
    """[texts, voters]: seeds, mined forms, patterns; 1 where the voter fires. The last column is log(1 + words)."""
    words = tk.Words(column, inside=tk.IN_LETTERS)
    n, s, m = words.rows, len(SEED_HASHES), len(mined)
    out = np.zeros((n, s + m + len(PATTERNS) + 1), np.float32)
    out[:, -1] = np.log1p(words.count)
    if not len(words.start):
        return out
    hit = np.zeros(len(words.start), bool)
    kinds = forms(words)
    at, which = Sieve(SEED_HASHES).find(kinds[0])
    out[words.doc[at], which] = 1
    hit[at] = True
    sieve = Sieve(mined)
    for h in kinds:
        at, which = sieve.find(h)
        out[words.doc[at], s + which] = 1
        hit[at] = True
    hits = np.bincount(words.doc, weights=hit, minlength=n)
    p = s + m
    out[:, p] = hits >= 2
    pairs = np.unique(np.stack([words.doc[hit].astype(np.uint64), kinds[0][hit]], axis=1), axis=0)
    out[:, p + 1] = np.bincount(pairs[:, 0].astype(np.int64), minlength=n) >= 3
    out[:, p + 2] = hits >= np.maximum(0.01 * words.count, 1)
    shout = hit & (words.end - words.start > 2) & (words.raw[words.start] < 91) & (words.raw[np.minimum(words.start + 1, len(words.raw) - 1)] < 91)
    out[:, p + 3] = np.bincount(words.doc, weights=shout, minlength=n) > 0
    said = np.zeros(len(hit), bool)
    said[1:] = hit[1:] & (_among(kinds[0][:-1], YOU_HASHES) >= 0) & (words.doc[1:] == words.doc[:-1])
    out[:, p + 4] = np.bincount(words.doc, weights=said, minlength=n) > 0
    return out


def mine(sample: DataFrame, most: int = MINED) -> np.ndarray:
    """Word forms and stems that mark toxic texts: document counts over the whole sample, by shuffle.

    The driver gets the ``most`` strongest only. A form needs three toxic texts and nine in ten of its texts toxic.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            words = tk.Words(batch.column("text"), inside=tk.IN_LETTERS)
            toxic = np.array(batch.column("label").to_pylist(), dtype=bool)
            h = np.concatenate(forms(words))
            doc = np.tile(words.doc, 1 + len(STEMS))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[first & (h != 0)], doc[first & (h != 0)]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            bad = np.add.reduceat(toxic[doc].astype(np.int64), start) if len(h) else np.zeros(0, np.int64)
            every = np.diff(np.append(start, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(bad), pa.array(every)], ["form", "bad", "every"])

    found = sample.transform(tk.arrow, count, "form long, bad long, every long").groupBy("form").agg(F.sum("bad").alias("bad"), F.sum("every").alias("every"))
    strong = found.where((F.col("bad") >= 3) & (F.col("bad") >= 0.9 * F.col("every")))
    rows = strong.orderBy(F.desc("bad"), F.asc("every"), "form").limit(most).collect()
    return np.sort(np.array([r.form for r in rows], np.int64).view(np.uint64))


@dataclass
class Model:
    """Of fixed size: at most MINED forms and a weight for each voter; what the label model estimated of them."""

    mined: np.ndarray
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray

    def score(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v @ self.weights + self.bias, -30, 30)))


def label_model(v: np.ndarray, start: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for binary voters given a hidden label; returns posteriors, [2, voters] fire rates, and [voters, voters] correlations.

    ``start`` are the first posteriors; rows where they are NaN join after the first round. After half the rounds, the correlations of what
    voters do beyond their class's rates are measured; from then on a voter that repeats others counts as one over the number it stands for.
    """
    given = ~np.isnan(start)
    q, seen = np.where(given, start, 0.0), given.astype(np.float64)
    damp, corr = np.ones(v.shape[1]), np.eye(v.shape[1])
    rates = np.zeros((2, v.shape[1]))
    for r in range(rounds):
        for c, w in ((1, q * seen), (0, (1 - q) * seen)):
            rates[c] = (w @ v + 0.1) / (w.sum() + 1.0)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        if r == rounds // 2:
            rest = v - q[:, None] * rates[1] - (1 - q)[:, None] * rates[0]
            scale = np.sqrt((rest**2).mean(0) + 1e-9)
            corr = rest.T @ rest / len(v) / np.outer(scale, scale)
            damp = 1 / np.maximum(np.where(np.abs(corr) > 0.2, np.abs(corr), 0).sum(0), 1.0)
        prior = np.clip((q * seen).sum() / max(seen.sum(), 1.0), 1e-3, 1 - 1e-3)
        odds = np.log(prior / (1 - prior)) + (v * np.log(rates[1] / rates[0]) + (1 - v) * np.log((1 - rates[1]) / (1 - rates[0]))) @ damp
        q, seen = 1 / (1 + np.exp(-np.clip(odds, -30, 30))), np.ones(len(v))
    return q, rates, corr


def fit(v: np.ndarray, y: np.ndarray, mined: np.ndarray) -> Model:
    """Label model over all rows (``y`` is NaN where no label is known), then a ridge logistic regression on its posteriors (Newton steps)."""
    m = v.shape[1] - 1
    fires = v[:, :m].astype(np.float64)
    w = np.zeros(m + 1)
    known = y[~np.isnan(y)]
    if not len(known) or known.max() == known.min():
        w[: len(SEED_HASHES)], w[-1] = 4.0, -3.0
        return Model(mined, np.append(w[:-1], 0.0), float(w[-1]), np.full((2, m), 0.5), np.eye(m))
    q, rates, corr = label_model(fires, np.where(np.isnan(y), np.nan, np.where(y == 1, 0.95, 0.05)))
    x = np.concatenate([fires, np.ones((len(v), 1))], axis=1)
    ridge = np.full(m + 1, 0.5)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (q - p) - ridge * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -3, 3)
    return Model(mined, np.append(w[:-1], 0.0), float(w[-1]), rates, corr)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, more: int = UNLABELLED_ROWS) -> Model:
    """Fit on at most ``rows`` labelled texts and ``more`` others, both outside the held-out fold."""
    sample = labelled(docs, labels, "toxic", FOLDS, HELD, rows)
    mined = mine(sample)
    others = unlabelled(docs, FOLDS, HELD, more)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            v = votes(batch.column("text"), mined)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())], ["label", "v"])

    both = sample.unionByName(others.withColumn("label", F.lit(None).cast("int")))
    got = both.transform(tk.arrow, cast, "label int, v binary").toArrow()
    wide = len(SEED_HASHES) + len(mined) + len(PATTERNS) + 1
    y = np.array([np.nan if x is None else x for x in got.column("label").to_pylist()], dtype=float)
    rows_of = got.column("v").to_pylist()
    order = sorted(range(len(rows_of)), key=lambda r: (-1.0 if np.isnan(y[r]) else y[r], rows_of[r]))  # sums in one order, however the rows came
    v = np.array([np.frombuffer(rows_of[r], np.float16) for r in order], dtype=np.float32).reshape(-1, wide)
    return fit(v, y[order], mined)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            s = np.round(model.score(votes(batch.column("text"), model.mined)), 9)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").transform(tk.arrow, run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (remainder(FOLDS) == HELD).alias("held_out"), "score", "predicted")
