"""Vectorised text kernels for Arrow batches: word splitting, word hashes and word shingles.

All functions work on the bytes of a whole batch at once, so no per-word Python objects exist.
Words are the runs of bytes outside ``\\x20\\x09-\\x0D``; ``A-Z`` is lower-cased, other letters are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 19
BATCH_BYTES = 2 << 20
_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
PLACE_CODES = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
FAR_CODE = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_CODES = _RNG.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Letters: a-z, A-Z and all bytes of longer UTF-8 sequences.
IN_LETTERS = np.zeros(256, dtype=bool)
IN_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of about BATCH_BYTES, however long the rows are: neither side holds more."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``most`` text bytes (one longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, and each text's offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(ends):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


class Words:
    """The words of a batch: byte ``start``/``end``, ``doc`` (row number), ``first`` (per row: its first word; one more at the end)."""

    def __init__(self, column: pa.Array, lower: bool = True, inside: np.ndarray = IN_WORD):
        raw, self.offsets = text_bytes(column)
        self.raw, self.table = raw, inside
        self.bytes = LOWER[raw] if lower else raw
        self.rows = len(self.offsets) - 1
        inside = inside[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(raw))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.count)

    def places(self) -> np.ndarray:
        """Each byte's distance from the start of its word."""
        place = np.arange(len(self.bytes), dtype=np.int64)
        if len(self.start):
            place[self.start[0] :] -= np.repeat(self.start, np.diff(np.append(self.start, len(self.bytes))))
        return place

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``prefix`` bytes (0 where the word is shorter)."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        place = self.places()
        codes = PLACE_CODES[place & 4095]
        if place.size and place.max() > 4095:  # long words: each further stretch of places has codes of its own
            codes += (place >> 12).astype(np.uint64) * FAR_CODE
        values = BYTE_CODES[self.bytes] * codes
        values[~self.table[self.raw]] = 0
        size = self.end - self.start
        if prefix is None:
            return mix(np.add.reduceat(values, self.start) + size.astype(np.uint64))
        values[place >= prefix] = 0
        return np.where(size < prefix, np.uint64(0), mix(np.add.reduceat(values, self.start) + np.uint64(1_000_003 * prefix)))

    def suffix_hashes(self, suffix: int) -> np.ndarray:
        """A 64-bit hash of each word's last ``suffix`` bytes (0 where the word is shorter)."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(self.start), np.uint64)
        for k in range(suffix):
            total += BYTE_CODES[self.bytes[np.maximum(self.end - 1 - k, 0)]] * PLACE_CODES[2048 + k]
        return np.where(self.end - self.start < suffix, np.uint64(0), mix(total + np.uint64(7_000_003 * suffix)))


def shingle_hashes(words: Words, size: int = 5, weights: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hash, row) of every ``size``-word window; a row with fewer words gives one window of them all.

    With ``weights`` (one for each word), also the sum of the words' weights in each window.
    """
    h = words.hashes()
    n = len(h)
    w = np.zeros(n) if weights is None else weights
    out, rows, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    if n >= size:
        total, weight = np.zeros(n - size + 1, np.uint64), np.zeros(n - size + 1)
        for k in range(size):
            total += h[k : n - size + 1 + k] * SHINGLE_CODES[k]
            weight += w[k : n - size + 1 + k]
        whole = words.doc[: n - size + 1] == words.doc[size - 1 :]
        out, rows, sums = mix(total[whole]), words.doc[: n - size + 1][whole], weight[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        at = np.arange(n) - words.first[words.doc]
        part = h * SHINGLE_CODES[np.minimum(at, 14)]
        ends = [(words.first[r], words.first[r + 1]) for r in short]
        out = np.concatenate([out, mix(np.array([part[a:b].sum(dtype=np.uint64) for a, b in ends], np.uint64) + words.count[short].astype(np.uint64))])
        sums = np.concatenate([sums, [w[a:b].sum() for a, b in ends]])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows, sums = out[order], rows[order], sums[order]
    return (out, rows) if weights is None else (out, rows, sums)


def shingle_sets(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes, in row order."""
    h, rows = shingle_hashes(words, size)
    at = np.searchsorted(rows, np.arange(words.rows + 1))
    for r in range(words.rows):
        yield np.unique(h[at[r] : at[r + 1]])
