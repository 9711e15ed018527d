"""Bounded sketches built by all executors: blocked Bloom filters and hashed counts.

Each task fills its own fixed-size array and sends it in chunks; chunks with the same number are merged
by a shuffle, so that the driver gets one array of the size that the caller fixed, however large the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import textkit as tk
from corpusloom.llm.textkit import mix

BLOCK = 512
PROBES = 6


def chunk_rows(own: np.ndarray, chunks: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """A task's array as (chunk, part) columns of one row each; parts of zeros are left out."""
    size = len(own) // chunks
    for k in range(chunks):
        part = own[k * size : (k + 1) * size]
        if part.any():
            yield pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())


def merge_chunks(parts: DataFrame, length: int, chunks: int, kind: str = "u4", merge: Callable = np.add) -> np.ndarray:
    """Merge the parts (chunk, part) of all tasks chunk by chunk on executors, return the whole."""
    size = length // chunks

    def together(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("chunk").to_pylist(), batch.column("part"), strict=True):
                new = np.frombuffer(part.as_buffer(), kind)  # no copy: parts are large
                if k in kept:
                    merge(kept[k], new, out=kept[k])
                else:
                    kept[k] = new.copy()
        for k, x in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["chunk", "part"])

    whole = np.zeros(length, kind)
    for row in parts.repartition(chunks, "chunk").transform(tk.arrow, together, "chunk int, part binary").toLocalIterator():
        whole[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(bytes(row.part), kind)
    return whole


def gather(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], length: int, kind: str, merge: Callable, chunks: int = 16) -> np.ndarray:
    """Fill one array of ``length`` for each task, merge them chunk by chunk, return the whole."""

    def each(batches):
        own = np.zeros(length, kind)
        fill(batches, own)
        for chunk, part in chunk_rows(own, chunks):
            yield pa.RecordBatch.from_arrays([chunk, part], ["chunk", "part"])

    return merge_chunks(df.transform(tk.arrow, each, "chunk int, part binary"), length, chunks, kind, merge)


class BlockedBloom:
    """A Bloom filter whose probes for a key all lie in one 512-bit block."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def length(keys: int, most_bytes: int = 8 << 20) -> int:
        """Words of 64 bits: about 16 bits a key, a power of two, at most ``most_bytes``."""
        want = max(1024, min(most_bytes, 2 * keys)) // 8
        return 1 << int(np.ceil(np.log2(want)))

    @staticmethod
    def _places(keys: np.ndarray, length: int):
        h = mix(keys.astype(np.uint64) + np.uint64(0x51ED270B))
        block = (h & np.uint64(length * 64 // BLOCK - 1)).astype(np.int64) * (BLOCK // 64)
        g = mix(h)
        for p in range(PROBES):
            bit = (g >> np.uint64(9 * p)) & np.uint64(BLOCK - 1)
            yield block + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))

    @classmethod
    def build(cls, keys: DataFrame, count: int, most_bytes: int = 8 << 20) -> BlockedBloom:
        """From a one-column table of 64-bit keys; ``count`` only sets the size."""
        length = cls.length(count, most_bytes)

        def fill(batches, own):
            for batch in batches:
                for word, bit in cls._places(batch.column(0).to_numpy().view(np.uint64), length):
                    np.bitwise_or.at(own, word, bit)

        return cls(gather(keys, fill, length, "u8", np.bitwise_or))

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for word, bit in self._places(keys.view(np.uint64), len(self.words)):
            out &= (self.words[word] & bit) != 0
        return out
