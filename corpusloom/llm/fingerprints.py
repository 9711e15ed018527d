"""Operator 9: homomorphic multiset hash of a document's paragraphs.

Every paragraph (line) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors modulo powers of two. So the order of paragraphs doesn't matter, and inserting or
deleting a paragraph adds or subtracts its vector without reading the rest.

The vector has two parts. EQUAL_LANES lanes of 64 bits, from a keyed hash of the whole paragraph, sum
modulo 2**64 and decide equality. LIKE_LANES lanes sum modulo 2**32: each three-word window of
the paragraph adds +1 or -1 to one lane (a text of at most 2**31 bytes has fewer than 2**31 windows, so no lane wraps), so that the cosine of two fingerprints estimates how many
windows the texts share.

Defined cases: null text counts as empty; an empty text has the all-zero fingerprint (empty
paragraphs add nothing); two zero fingerprints are alike by 1, a zero and a nonzero one by 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk

EQUAL_LANES = 8
LIKE_LANES = 128
WINDOW = 3
LANE_KEYS = np.random.default_rng(77).integers(1, 2**63, EQUAL_LANES, dtype=np.uint64) | np.uint64(1)


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, length) of each nonempty line of a batch, case kept."""
    raw, offsets = tk.text_bytes(column)
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    starts = starts[starts < len(raw)]
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(raw))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts)
    values = tk.BYTE_CODES[raw] * (tk.PLACE_CODES[place & 4095] + (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[raw == 10] = 0
    sums = np.add.reduceat(values, starts)
    length = ends - starts - (raw[ends - 1] == 10)
    full = length > 0
    return tk.mix(sums[full] + length[full].astype(np.uint64)), row[full], length[full]


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(equality lanes uint64 [rows, EQUAL_LANES], likeness lanes int32 [rows, LIKE_LANES]) of a batch of texts."""
    lines, line_row, _ = _lines(column)
    rows = len(column)
    equal = np.zeros((rows, EQUAL_LANES), np.uint64)
    for k in range(EQUAL_LANES):
        np.add.at(equal[:, k], line_row, tk.mix(lines * LANE_KEYS[k] + LANE_KEYS[k]))
    words = tk.Words(column, lower=False)
    h = words.hashes()
    like = np.zeros(rows * LIKE_LANES, np.int64)
    if len(h):
        # windows stay inside a line: a line's number is the count of line feeds before the word
        line_no = np.cumsum(words.raw == 10)[words.start] + words.doc * 0
        new = np.ones(len(h), bool)
        new[1:] = (line_no[1:] != line_no[:-1]) | (words.doc[1:] != words.doc[:-1])
        group = np.cumsum(new)
        total = h.copy()
        for k in range(1, WINDOW):
            same = np.zeros(len(h), bool)
            same[: len(h) - k] = group[k:] == group[: len(h) - k]
            total[: len(h) - k] += np.where(same[: len(h) - k], h[k:] * tk.SHINGLE_CODES[k], 0)
            if k == WINDOW - 1:
                whole = same
        size = np.bincount(group)[group]
        keep = whole | (new & (size < WINDOW))  # a shorter line is one window
        mixed = tk.mix(total[keep])
        lane = words.doc[keep] * LIKE_LANES + (mixed & np.uint64(LIKE_LANES - 1)).astype(np.int64)
        sign = ((mixed >> np.uint64(32)) & np.uint64(1)).astype(np.int64) * 2 - 1
        like = np.bincount(lane, weights=sign, minlength=rows * LIKE_LANES).astype(np.int64)
    return equal, like.reshape(rows, LIKE_LANES).astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of two likeness parts, row by row, not below 0."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    na, nb = (a * a).sum(1), (b * b).sum(1)
    both = np.where((na == 0) & (nb == 0), 1.0, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        cos = (a * b).sum(1) / np.sqrt(na * nb)
    return np.round(np.where((na > 0) & (nb > 0), np.clip(cos, 0.0, 1.0), both), 9)


def encode(equal: np.ndarray, like: np.ndarray) -> list[str]:
    """Hex of all lanes, big-endian."""
    wide = np.concatenate([equal.astype(">u8").view(np.uint8).reshape(len(equal), -1), like.astype(">i4").view(np.uint8).reshape(len(like), -1)], axis=1)
    return [row.tobytes().hex() for row in np.ascontiguousarray(wide)]


def decode(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(text)
    return np.frombuffer(raw[: 8 * EQUAL_LANES], ">u8").astype(np.uint64), np.frombuffer(raw[8 * EQUAL_LANES :], ">i4").astype(np.int32)


def combine(one: str, other: str, sign: int = 1) -> str:
    """The fingerprint after inserting (1) or deleting (-1) ``other``'s paragraphs."""
    (e1, l1), (e2, l2) = decode(one), decode(other)
    equal = e1 + e2 if sign > 0 else e1 - e2
    return encode(equal[None, :], (l1 + l2 if sign > 0 else l1 - l2)[None, :])[0]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each text: one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(*vectors(batch.column(1))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").transform(tk.arrow, run, "doc_id long, fingerprint string")


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 document ids that cut the table into even ranges, descending."""
    found = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10000)).first()[0] or []
    return sorted(set(found), reverse=True)


def with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text.

    The edited text: the last floor(n/2) code points are replaced by the first as many of the next
    document in descending doc_id (after the last: the first). Texts are shuffled once, by ranges of
    doc_id cut at existing ids; each range's first row is sent to the range before it too, so
    every row meets its successor without a global window. Rows with equal doc_id follow one another
    by text; a null doc_id comes last.
    """
    spark = docs.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _bounds(docs, parts)
    top = docs.agg(F.max("doc_id")).first()[0]
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    table = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    last = len(cuts)
    # range r holds the ids up to cuts[r - 1] (which it starts with) and above cuts[r]
    part = F.size(F.filter(table, lambda c: key <= c))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), part.alias("part"), F.lit(0).alias("guest"))
    heads = F.array(*[F.struct(F.lit(c).cast("long").alias("id"), F.lit(k).alias("home")) for k, c in [*enumerate(cuts), (last, top)]])
    home = F.filter(heads, lambda h: h["id"] == F.col("doc_id"))
    guests = rows.where(F.col("doc_id").isin([*cuts, top] if top is not None else cuts) | (F.lit(top is None))).select("doc_id", "text", F.explode(F.transform(home, lambda h: h["home"])).alias("part"), F.lit(1).alias("guest"))
    if top is None:
        guests = rows.select("doc_id", "text", F.lit(last).alias("part"), F.lit(1).alias("guest"))
    dealt = rows.unionByName(guests).repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in tk.slices(batches):
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            n = table.num_rows
            part, guest = table.column("part").to_numpy(), table.column("guest").to_numpy()
            text = table.column("text").combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            own = np.flatnonzero((guest[:-1] == 0) & (part[:-1] == part[1:]))
            kept = table.slice(n - 1, 1)
            if not len(own):
                continue
            equal, like = vectors(text)
            said = text.to_pylist()
            edited, n_chars, digest = [], [], []
            for i in own:
                a, b = said[i], said[i + 1]
                half = len(a) // 2
                e = a[: len(a) - half] + b[:half]
                edited.append(e)
                n_chars.append(len(a))
                digest.append(hashlib.sha256(e.encode()).hexdigest())
            e_equal, e_like = vectors(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks().take(pa.array(own)) if not isinstance(table.column("doc_id").combine_chunks(), pa.ChunkedArray) else table.column("doc_id").take(pa.array(own)).combine_chunks(),
                    pa.array(n_chars, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(encode(equal[own], like[own]), pa.string()),
                    pa.array(encode(e_equal, e_like), pa.string()),
                    pa.array(likeness(like[own], e_like)),
                    pa.array(likeness(like[own], like[own + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return dealt.transform(tk.arrow, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
