"""Operator 8: language identification of mixed-language text.

Script ranges narrow each word's candidate languages; every word gets a score for each candidate from
hashed counts of whole words, prefixes and suffixes; Viterbi with a switching penalty labels spans;
the document's language is the one that labels most words.

Defined cases: null texts and texts without a letter are ``und`` with score 0; equal word counts go to the larger total
score, then to the first language in code point order; of equally good paths that with one label throughout counts; repeated rows each get
the same answer; very long texts are walked whole; other columns don't take part; without any text to learn from every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.llm.samples import FIT_ROWS, remainder
from corpusloom.llm.sketches import gather
from corpusloom.storage import materialize

FOLDS, HELD = 5, 0
CELLS = 1 << 15
#: Units of a word: the whole, its first two and three bytes, its last two and three.
UNITS = 5
SWITCH = 12.0
#: A language is a candidate for a script that holds at least this share of its words.
SCRIPT_SHARE = 0.01
# Lead bytes of UTF-8 by script; 0 Latin (and what lead bytes 0xE1 and 0xE2 begin), 1 Greek, 2 Cyrillic, 3 Hebrew and Arabic, 4 Indic, Thai and Lao, 5 Kana, 6 Han, 7 Hangul.
SCRIPTS = 8
_SCRIPT = np.zeros(256, np.int64)
_SCRIPT[0xCD:0xD0] = 1
_SCRIPT[0xD0:0xD5] = 2
_SCRIPT[0xD6:0xDC] = 3
_SCRIPT[0xE0] = 4
_SCRIPT[0xE3] = 5
_SCRIPT[0xE4:0xEA] = 6
_SCRIPT[0xEA:0xEE] = 7


def _units(words: tk.Words) -> np.ndarray:
    """[words, UNITS] cells."""
    h = words.hashes()
    parts = [h, words.hashes(2), words.hashes(3), words.suffix_hashes(2), words.suffix_hashes(3)]
    return np.stack([(p & np.uint64(CELLS - 1)).astype(np.int64) for p in parts], axis=1)


def _scripts(words: tk.Words) -> np.ndarray:
    """Each word's script: that of its first byte."""
    return _SCRIPT[words.bytes[words.start]]


@dataclass
class Model:
    """Languages, [languages, UNITS, CELLS] log probabilities and [scripts, languages] candidates: of fixed size."""

    languages: list[str]
    table: np.ndarray
    candidates: np.ndarray


def train(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Count on a bounded sample of documents with a language outside the held-out fold.

    Executors count into arrays of fixed size; the driver gets one merged array.
    """
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(FOLDS) != HELD))
    chosen = known.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64(F.lit("fit"), "doc_id"), "doc_id").limit(rows)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "lang"), "sample-lang")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((0, UNITS, CELLS), np.float32), np.zeros((SCRIPTS, 0), bool))
    k = len(languages)
    counts, scripts = k * UNITS * CELLS, k * SCRIPTS
    length = -(-(counts + scripts) // 16) * 16

    def fill(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        for batch in tk.slices(batches):
            words = tk.Words(batch.column("text"), inside=tk.IN_LETTERS)
            if not len(words.start):
                continue
            lang = np.searchsorted(np.array(languages), np.array(batch.column("lang").to_pylist()))[words.doc]
            cells = _units(words)
            for u in range(UNITS):
                own[:counts] += np.bincount((lang * UNITS + u) * CELLS + cells[:, u], minlength=counts)
            own[counts : counts + scripts] += np.bincount(lang * SCRIPTS + _scripts(words), minlength=scripts)

    got = gather(sample, fill, length, "i8", np.add)
    seen = got[:counts].reshape(k, UNITS, CELLS).astype(np.float64)
    share = (seen + 0.05) / (seen.sum(2, keepdims=True) + 0.05 * CELLS)
    by_script = got[counts : counts + scripts].reshape(k, SCRIPTS)
    return Model(languages, np.log(share).astype(np.float32), (by_script >= SCRIPT_SHARE * np.maximum(by_script.sum(1, keepdims=True), 1)).T)


def word_scores(words: tk.Words, model: Model) -> np.ndarray:
    """[words, languages] log scores, centred on the best; languages whose script doesn't fit are far off."""
    cells = _units(words)
    out = np.zeros((len(words.start), len(model.languages)))
    for u in range(UNITS):
        out += model.table[:, u, :][:, cells[:, u]].T
    out *= 0.5  # the units of a word overlap
    fits = model.candidates[_scripts(words)]
    fits[~fits.any(1)] = True
    out[~fits] -= 50.0
    out -= out.max(1, keepdims=True)
    return np.maximum(out, -60.0)


def viterbi(scores: list[np.ndarray], penalty: float = SWITCH) -> list[np.ndarray]:
    """The best label sequence of each score matrix; all matrices are walked in step."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    if not order:
        return []
    lengths = np.array([len(scores[i]) for i in order])
    most, k = int(lengths[0]), scores[0].shape[1]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate([scores[i] for i in order])
    came = np.zeros(flat.shape, np.int32)
    best = np.zeros((len(order), k))
    label = np.arange(k)
    for t in range(most):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        at = first[:live] + t
        if t == 0:
            best[:live] = flat[at]
            continue
        top = best[:live].argmax(1)
        jump = best[np.arange(live), top] - penalty
        stay = best[:live] >= jump[:, None]
        came[at] = np.where(stay, label, top[:, None])
        best[:live] = np.where(stay, best[:live], jump[:, None]) + flat[at]
    path = np.zeros(len(flat), np.int32)
    now = best.argmax(1)
    for t in range(most - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        at = first[:live] + t
        path[at] = now[:live]
        if t:
            now[:live] = came[at, now[:live]]
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(order)
    for j, i in enumerate(order):
        out[i] = path[first[j] : first[j] + lengths[j]]
    return out


def label_words(words: tk.Words, scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Each word's label on its document's best path.

    A document keeps its best single label throughout where no other path can be better, so that only the others are walked. A path that
    uses the best label somewhere gains at most its stretches under other labels, each of which costs a penalty: none pays if no stretch
    of words gains more than the penalty. A path that never uses it changes labels at least once and gains at most its first stretch, its
    last one, and stretches between that pay a penalty each: it can't pay if the best start and the best end together gain no more than the penalty.
    """
    n, k = words.rows, scores.shape[1]
    total = np.zeros((n, k))
    for l in range(k):
        total[:, l] = np.bincount(words.doc, weights=scores[:, l], minlength=n)
    main = total.argmax(1)
    path = main[words.doc].astype(np.int32)
    mixed = np.zeros(n, bool)
    starts, ends = np.zeros(n), np.zeros(n)
    held = np.flatnonzero(words.count)
    for l in range(k):
        gain = scores[:, l] - scores[np.arange(len(scores)), main[words.doc]]
        run = np.cumsum(gain)
        before = np.concatenate([[0.0], run[:-1]])
        apart = words.doc * (2.0 * (np.abs(run).max(initial=0.0) + 1.0))  # keeps the running minimum inside a document
        lowest = np.minimum.accumulate(before - apart) + apart
        np.logical_or.at(mixed, words.doc, run - lowest > penalty)
        if len(held):
            first = words.first[held]
            starts[held] = np.maximum(starts[held], np.maximum.reduceat(run, first) - before[first])
            ends[held] = np.maximum(ends[held], run[words.first[held + 1] - 1] - np.minimum.reduceat(before, first))
    mixed |= starts + ends > penalty
    rows = np.flatnonzero(mixed)
    for r, labels in zip(rows, viterbi([scores[words.first[r] : words.first[r + 1]] for r in rows], penalty), strict=True):
        path[words.first[r] : words.first[r + 1]] = labels
    return path


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the words on its label), spans (label:first word:last word, joined by commas)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.languages)
        for batch in tk.slices(batches, most=4 << 20):
            words = tk.Words(batch.column("text"), inside=tk.IN_LETTERS)
            n = words.rows
            names, share, spans = ["und"] * n, np.zeros(n), [""] * n
            if k and len(words.start):
                scores = word_scores(words, m)
                path = label_words(words, scores)
                votes = np.bincount(words.doc * k + path, minlength=n * k).reshape(n, k)
                total = np.stack([np.bincount(words.doc, weights=scores[:, l], minlength=n) for l in range(k)], axis=1)
                tied = votes == votes.max(1, keepdims=True)
                chosen = np.where(tied, total, -np.inf).argmax(1)
                plain = np.zeros(n, bool)
                np.logical_or.at(plain, words.doc, words.raw[words.start] < 128)
                change = np.ones(len(path), bool)
                change[1:] = (path[1:] != path[:-1]) | (words.doc[1:] != words.doc[:-1])
                for at in np.split(np.flatnonzero(change), np.searchsorted(np.flatnonzero(change), words.first[1:-1])):
                    if len(at):
                        r = int(words.doc[at[0]])
                        ends = [*(at[1:] - 1), words.first[r + 1] - 1]
                        spans[r] = ",".join(f"{m.languages[path[a]]}:{a - words.first[r]}:{b - words.first[r]}" for a, b in zip(at, ends, strict=True))
                for r in np.flatnonzero(words.count):
                    if plain[r] or any(c.isalpha() for c in batch.column("text")[int(r)].as_py()):
                        names[r] = m.languages[chosen[r]]
                        share[r] = votes[r, chosen[r]] / words.count[r]
                    else:
                        spans[r] = ""
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.round(share, 9)), pa.array(spans, pa.string())], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").transform(tk.arrow, run, "doc_id long, lang_pred string, score double, spans string")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans of every document."""
    out = predict(docs, train(docs))
    return out.select("doc_id", (remainder(FOLDS) == HELD).alias("held_out"), "lang_pred", "score", "spans")
