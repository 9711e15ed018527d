"""Operator 3: secret scans through an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256. The ledger (a Parquet table in a
shared folder) records which (blob, rule version) pairs were scanned and what was found. A run scans only
the blobs that the ledger lacks for the current rule version, then joins findings back to all paths
(document rows) that hold the blob.

Defined cases: null text counts as empty; an empty text has no finding; repeated rows share their blob and
each get its findings; a blob that the ledger holds more than once (a repeated or concurrent append) counts once; very long texts are scanned whole;
equal spans of two kinds stand in the order of KINDS; an empty table writes an empty ledger part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.storage import small_enough

# The contract's base rules and the method's additions, in order of precedence.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BEARER = re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})")
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
KINDS = ("assign", "access", "hex", "bearer", "pem")
BASE = 3
RULE_VERSION = "3"
FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_spans string, spans string"
#: Findings are broadcast up to this many rows (about 200 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 50_000


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all findings in one text, by start, then kind."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    if any(x in text for x in ("gh", "xox", "eyJ")):
        out += [(m.start(), 3, m.end()) for m in BEARER.finditer(text)]
    if "-----BEGIN" in text:
        out += [(m.start(), 4, m.end()) for m in PEM.finditer(text)]
    return sorted(out)


_SUSPECT_BYTES = np.zeros(256, bool)
_SUSPECT_BYTES[[*range(48, 58), *range(97, 103)]] = True
_HINTS = re.compile(rb"passw|secret|token|api_?key|AKIA|gh[pousr]_|xox|eyJ|-----BEGIN", re.I)


def _suspects(column: pa.Array) -> np.ndarray:
    """Rows that may hold a finding: a hint word, or 32 hex digits in a row. Never misses one."""
    raw, offsets = tk.text_bytes(column)
    found = np.zeros(len(offsets) - 1, bool)
    if not len(raw):
        return found
    at = [m.start() for m in _HINTS.finditer(raw.tobytes())]
    breaks = np.flatnonzero(~_SUSPECT_BYTES[raw])
    run = np.flatnonzero(np.diff(np.concatenate([[-1], breaks, [len(raw)]])) > 32)
    at += [int(breaks[k - 1]) + 1 if k else 0 for k in run]  # runs over a row's edge only widen the net
    for k in run:
        lo, hi = (int(breaks[k - 1]) + 1 if k else 0), (int(breaks[k]) if k < len(breaks) else len(raw))
        a, b = np.searchsorted(offsets, [lo, hi], side="right") - 1
        found[a : min(b, len(found) - 1) + 1] = True
    found[np.searchsorted(offsets, np.array(at, np.int64), side="right") - 1] = True
    return found


def _spans(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _scan(rule_version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches):
            blobs = batch.column("blob").to_pylist()
            rows = np.flatnonzero(_suspects(batch.column("text")))
            texts = dict(zip(rows.tolist(), batch.column("text").take(pa.array(rows)).to_pylist(), strict=True))
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_spans", "spans")}
            for r in range(len(blobs)):
                found = find(texts[r] or "") if r in texts else []
                base = [x for x in found if x[1] < BASE]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(x[1] == k for x in base))
                out["base_spans"].append(_spans(base))
                out["spans"].append(_spans(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array([rule_version] * len(blobs), pa.string()), *[pa.array(out[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")], pa.array(out["base_spans"], pa.string()), pa.array(out["spans"], pa.string())],
                ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
            )

    return run


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Address texts; of equal ones in a task pass a single one on. So a hot blob reaches its partition once a task, not once a row."""
    seen: set[bytes] = set()
    for batch in tk.slices(batches):
        raw, offsets = tk.text_bytes(batch.column("text"))
        data, keep, blobs = raw.tobytes(), [], []
        for r in range(batch.num_rows):
            d = hashlib.sha256(data[offsets[r] : offsets[r + 1]]).digest()
            if d not in seen:
                if len(seen) < 1_000_000:  # bounds the memory; equal texts beyond it are dropped after the shuffle
                    seen.add(d)
                keep.append(r)
                blobs.append(d.hex())
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), batch.column("text").take(pa.array(keep)).cast(pa.string())], ["blob", "text"])


def read_ledger(spark: SparkSession, path: str, rule_version: str = RULE_VERSION) -> DataFrame:
    return spark.read.schema(FINDINGS).parquet(path).where(F.col("rule_version") == rule_version)


def scan_new(docs: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> None:
    """Append to the ledger the findings of each blob it lacks for this rule version."""
    spark = docs.sparkSession
    spark.createDataFrame([], FINDINGS).write.mode("append").parquet(ledger)
    known = read_ledger(spark, ledger, rule_version).select("blob").distinct()
    blobs = docs.select(F.coalesce("text", F.lit("")).alias("text")).transform(tk.arrow, _first_in_task, "blob string, text string")
    unseen = blobs.join(known, "blob", "left_anti")
    unseen.repartition("blob").sortWithinPartitions("blob").transform(tk.arrow, _once(_scan(rule_version)), FINDINGS).write.mode("append").parquet(ledger)


def _once(scan):
    """Drop blobs that came from several tasks; all copies of a blob follow one another in one partition, one for each task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            last = None
            for batch in batches:
                keep = []
                for r, blob in enumerate(batch.column("blob").to_pylist()):
                    if blob != last:
                        last = blob
                        keep.append(r)
                if len(keep) == batch.num_rows:
                    yield batch
                elif keep:
                    yield batch.take(pa.array(keep))

        yield from scan(fresh())

    return run


def address(docs: DataFrame) -> DataFrame:
    """The documents with their blob address."""
    return docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))


def join_findings(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Each row of ``versions`` (with its blob) and the findings of its blob; only blobs that have some are joined.

    Columns of ``versions`` that are named like a finding's give way to it.
    """
    found = read_ledger(versions.sparkSession, ledger, rule_version).where(F.col("spans") != "").drop("rule_version").dropDuplicates(["blob"])
    if small_enough(found, BROADCAST_ROWS):
        found = F.broadcast(found)
    clash = [c for c in versions.columns if c != "blob" and c.lower() in {x.lower() for x in found.columns}]
    out = versions.drop(*clash).join(found, "blob", "left")
    return out.fillna(0, ["n_assign", "n_access", "n_hex"]).fillna("", ["base_spans", "spans"])


def _redact(spans_name: str):
    """Replace every span of ``text`` by its kind in brackets; overlapping spans are replaced together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes = batch.column("n_chars") if "n_chars" in batch.schema.names else None
            spans_of = batch.column(spans_name)
            rows = [r for r, s in enumerate(spans_of.to_pylist()) if s]
            if rows:
                texts, sizes = texts.to_pylist(), sizes.to_pylist() if sizes is not None else {}
                for r in rows:
                    merged: list[list] = []
                    for x in spans_of[r].as_py().split(","):
                        kind, a, b = x.split(":")
                        if merged and int(a) < merged[-1][2]:
                            merged[-1][2] = max(merged[-1][2], int(b))
                        else:
                            merged.append([kind, int(a), int(b)])
                    for kind, a, b in reversed(merged):
                        texts[r] = f"{texts[r][:a]}[{kind}]{texts[r][b:]}"
                    sizes[r] = len(texts[r])
                texts = pa.array(texts, batch.column("text").type)
                sizes = pa.array(sizes, batch.column("n_chars").type) if isinstance(sizes, list) else None
            names = [x for x in batch.schema.names if x != spans_name]
            new = {"text": texts, "n_chars": sizes}
            yield pa.RecordBatch.from_arrays([new[x] if x in new else batch.column(x) for x in names], names)

    return run


def redacted(docs: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan what the ledger lacks, then give the documents with every found secret replaced, and n_chars (if they have it) to match."""
    scan_new(docs, ledger, rule_version)
    blob, spans = (_free(docs, x) for x in ("blob", "spans"))
    found = read_ledger(docs.sparkSession, ledger, rule_version).where(F.col("spans") != "").select(F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob])
    if small_enough(found, BROADCAST_ROWS):
        found = F.broadcast(found)
    wide = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, blob, "left").select(*docs.columns, spans)
    return wide.transform(tk.arrow, _redact(spans), docs.schema)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in {x.lower() for x in docs.columns}:
        name = "_" + name
    return name
