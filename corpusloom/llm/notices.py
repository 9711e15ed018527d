"""Operator 13: license scans, by fuzzy search for short notices.

A text is brought to its words, joined by single spaces. A notice of L characters may have k = max(1, L // PER_EDIT) edits (characters put in, left out or exchanged). Cut into
k + 1 pieces, a notice with k edits keeps one piece whole. So an automaton finds all pieces of all notices in one pass; around each the regex library's bounded-error
matching verifies the notice, counts its edits and gives its span. Base labels come from phrases whose words stand consecutively.

No row is shuffled, and only what lies around pieces is matched. What is found depends on the text alone, not on the batch.

Defined cases: a null text counts as empty; a text without words has no place, no label and score 0; fewer words than a phrase has hold none. Repeated rows each get their findings, null doc_ids
too; very long texts are read whole; places of several phrases all count; an empty table gives an empty table. Other columns, whatever their names, don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textkit as tk
from corpusloom.llm.ranking import IN_TERM as IN_WORD

# Fixed values of the contract: phrases of the base, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# The method's notices, as words.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost", "boost software license version 1 0"),
)
#: A notice may have one edit for each so many characters.
PER_EDIT = 14
#: Windows of at most so many characters are looked up among those of late; equal notices are common.
REMEMBERED = 1_000
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"


def edits_of(notice: str) -> int:
    return max(1, len(notice) // PER_EDIT)


def pieces(notice: str) -> list[tuple[int, str]]:
    """(place, piece): the notice cut into one piece more than it may have edits."""
    n = edits_of(notice) + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    """All notices: an automaton over their pieces, and their patterns. A list of (label, notice) must not change between runs that are compared."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES):
        self.notices = notices
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(text, special_only=True, literal_spaces=True)}){{e<={edits_of(text)}}}") for _, text in notices]
        of: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(notices):
            for at, piece in pieces(text):
                of.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in of.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.verified = lru_cache(maxsize=20_000)(self._verified)

    def _verified(self, k: int, window: str) -> tuple[tuple[int, int, int], ...]:
        return tuple((m.start(), m.end(), sum(m.fuzzy_counts)) for m in self.patterns[k].finditer(window))

    def windows(self, plain: str, row_of, bounds: np.ndarray) -> dict[tuple[int, int], list[list[int]]]:
        """(row, notice): stretches of ``plain`` (one character for each byte) that hold whatever match has a piece there, in order, apart from each other."""
        out: dict[tuple[int, int], list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(plain):
            row = row_of(end)
            for k, at in where:
                text = self.notices[k][1]
                slack = 4 * edits_of(text)  # an edit may be a character of four bytes
                lo = max(int(bounds[row]), end + 1 - size - at - slack)
                hi = min(int(bounds[row + 1]), end + 1 + len(text) - at - size + slack)
                out.setdefault((row, k), []).append([lo, hi])
        for key, found in out.items():
            found.sort()
            apart = found[:1]
            for lo, hi in found[1:]:
                if lo <= apart[-1][1]:
                    apart[-1][1] = max(apart[-1][1], hi)
                else:
                    apart.append([lo, hi])
            out[key] = apart
        return out


def _joined(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, each with a space behind it, or a line feed at the end of its row; each row's bounds in them; each byte's place in the texts)."""
    size = words.end - words.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(begin[-1], 32, np.uint8)
    place = np.zeros(begin[-1], np.int64)
    source = np.flatnonzero(words.table[words.raw])
    target = source + np.repeat(begin[:-1] - words.start, size)
    out[target] = words.bytes[source]
    place[target] = source
    place[begin[1:] - 1] = words.end
    last = words.first[1:][words.count > 0]
    out[begin[last] - 1] = 10
    return out, begin[words.first], place


def _base(words: tk.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word number, phrase number) of every place."""
    h = words.hashes()
    found = []
    for k, (phrase, _) in enumerate(PHRASES):
        asked = tk.Words(pa.array([phrase]), inside=IN_WORD).hashes()
        n = len(asked)
        if len(h) < n:
            continue
        hit = words.doc[: len(h) - n + 1] == words.doc[n - 1 :]
        for i, x in enumerate(asked):
            hit &= h[i : len(h) - n + 1 + i] == x
        at = np.flatnonzero(hit)
        found.append(np.array([words.doc[at], at - words.first[words.doc[at]], np.full(len(at), k)]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 3


def _fuzzy(words: tk.Words, search: Search) -> dict[int, list[tuple[int, int, str, int, float]]]:
    """Row: (start, end, label, edits, score) of every verified notice, in characters of the text."""
    data, bounds, place = _joined(words)
    plain = data.tobytes().decode("latin-1")
    out: dict[int, list] = {}
    for (row, k), stretches in search.windows(plain, lambda at: int(np.searchsorted(bounds, at, "right")) - 1, bounds).items():
        label, notice = search.notices[k]
        for lo, hi in stretches:
            while lo < hi and data[lo] & 0xC0 == 0x80:
                lo += 1
            while hi < len(data) and hi > lo and data[hi] & 0xC0 == 0x80:
                hi -= 1
            window = data[lo:hi].tobytes().decode("utf-8", "replace").rstrip("\n")
            matches = search.verified(k, window) if len(window) <= REMEMBERED else search._verified(k, window)
            for a, b, edits in matches:
                if a == b:
                    continue
                byte = [lo + len(window[:x].encode()) for x in (a, b - 1)]
                start, last = (int(place[x]) for x in byte)
                chars = words.raw[words.offsets[row] : last + 1] & 0xC0 != 0x80
                first = int(chars[: start - words.offsets[row]].sum())
                out.setdefault(row, []).append((first, int(chars.sum()), label, edits, 1 - edits / len(notice)))
    return out


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:start:end:edits) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for batch in tk.slices(batches):
            words = tk.Words(batch.column("text"), inside=IN_WORD)
            row, number, phrase = _base(words)
            n_base = np.bincount(row, minlength=words.rows)
            first, last = np.full(words.rows, np.iinfo(np.int64).max), np.full(words.rows, -1)
            np.minimum.at(first, row, number)
            np.maximum.at(last, row, number)
            base: dict[int, set[str]] = {}
            for r, k in zip(row.tolist(), phrase.tolist(), strict=True):
                base.setdefault(r, set()).add(PHRASES[k][1])
            fuzzy = _fuzzy(words, search)
            none = n_base == 0
            labels = [base.get(r, set()) | {x[2] for x in fuzzy.get(r, ())} for r in range(words.rows)]
            scores = np.where(none, [max((x[4] for x in fuzzy.get(r, ())), default=0.0) for r in range(words.rows)], 1.0)
            spans = [",".join(f"{x[2]}:{x[0]}:{x[1]}:{x[3]}" for x in sorted(set(fuzzy.get(r, ())))) for r in range(words.rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(n_base.astype(np.int64)), pa.array(first, mask=none), pa.array(last, mask=none),
                 pa.array([",".join(sorted(base.get(r, ()))) for r in range(words.rows)], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(scores.astype(np.float64)), pa.array(spans, pa.string())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(tk.arrow, run, SCHEMA)
