"""Scalar text functions as Column expressions; they stay in the JVM."""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Curly quotes, primes and dashes with their ASCII forms, one to one.
QUOTES_FROM = "‘’‚′“”„″–—‒−‑"
QUOTES_TO = "''''\"\"\"\"-----"
SPACES = r"[\s\x0B\x1C-\x1F\u0085   -     　]+"
# Tokens that keep 4.05%, $30.00 and 5/1/5 whole.
BM25_TOKEN = r"[a-z0-9$][a-z0-9$%.\-/,]*[a-z0-9%]|[a-z0-9$%]"
MONEY = r"\$\s?((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?)"
MONEY_TEXT = r"^-?\d+\.\d{2}$"
RECORD_ID = r"\b(?:M|ACC|CARD|TXN)-\d{4}\b"
VERSION_3 = r"(?i)\bv(?:ersion)?\s?3(?:\.0)?\b|\b3\.0\b"
VERSION_2 = r"(?i)\bv(?:ersion)?\s?2(?:\.0)?\b"
DELETED = r"\s*\[DELETED:[^\]]*\]"
MOJIBAKE = "â€.|Ã.|Â(?=\\W)"
NUMBERED = r"^\d{1,2}(\.\d{1,2})*\.?\s+\S"


def _ranges(chars: list[str]) -> str:
    """A regular expression's class of these characters, in ranges."""
    out, codes = [], sorted(map(ord, chars))
    for k, code in enumerate(codes):
        if k and code == codes[k - 1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\u{x:04X}-\\u{y:04X}" for x, y in out) + "]"


def _plane() -> list[str]:
    return [chr(k) for k in range(0xA0, 0x10000) if not 0xD800 <= k < 0xE000]


@cache
def _compatible() -> dict[str, str]:
    """What NFKC makes of single characters, and of letters with their marks behind them."""
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    single = {c: nfkc(c) for c in _plane() if nfkc(c) != c and not unicodedata.combining(c)}
    marked = {d: c for c in _plane() if (d := unicodedata.normalize("NFD", c)) != c and nfkc(d) == c and all(map(unicodedata.combining, d[1:]))}
    voiced = {c + m: nfkc(c + m) for c in map(chr, range(0xFF66, 0xFF9E)) for m in "\uff9e\uff9f"}
    return voiced | marked | single


@cache
def _folded() -> dict[str, str]:
    """Characters whose full case folding isn't their lower case."""
    return {c: c.casefold() for c in _plane() if c.casefold() != c.lower()}


def _replaced(text: Column, coarse: str, found: list[str], table: dict[str, str]) -> Column:
    """The text with what the table lists replaced: one replacement for each different thing that is found; texts outside the coarse class are left as they are."""
    listed = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    each = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(x), F.lit(0)) for x in found]))
    whole = F.aggregate(each, text, lambda t, x: F.replace(t, x, F.coalesce(F.try_element_at(listed, x), x)))
    return F.when(text.rlike(coarse), whole).otherwise(text)


def nfkc(text: Column) -> Column:
    """Unicode NFKC in the JVM, by tables made from Unicode's own rules for characters of the basic plane: ligatures, full-width forms, fractions, signs, letters with marks behind them.

    Marks that stand in another than their canonical order, and Hangul in single letters, stay as they are.
    """
    table = _compatible()
    return _replaced(text, r"[\u00A0-\u00BE\u0132-\uFFFF]", [r"[\uFF66-\uFF9D][\uFF9E\uFF9F]", r"\P{M}\p{M}+", _ranges([c for c in table if len(c) == 1])], table)


def casefold(text: Column) -> Column:
    """Full case folding: lower case, and sharp s, final sigma, ligatures and the like by a table."""
    table = _folded()
    return F.lower(_replaced(text, r"[\u00B5-\uFFFF]", [_ranges(list(table))], table))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def plain(text: Column | str, compatibility: bool = False) -> Column:
    """ASCII quotes and dashes, dots for an ellipsis, lower case; on request compatibility characters as plain ones."""
    base = nfkc(F.col(text) if isinstance(text, str) else text) if compatibility else text
    return F.lower(F.replace(F.translate(base, QUOTES_FROM, QUOTES_TO), F.lit("…"), F.lit("...")))


def normalise(text: Column | str, compatibility: bool = False) -> Column:
    """Plain text with single spaces."""
    return collapse(plain(text, compatibility))


def bm25_tokens(text: Column) -> Column:
    """Tokens of the plain text; none holds a space, so how many there are doesn't matter."""
    return F.regexp_extract_all(plain(text, compatibility=True), F.lit(BM25_TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Space-separated words of a normalised text; none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def shingles(word_list: Column, size: int) -> Column:
    """Distinct windows of ``size`` words joined by spaces; a shorter list is one window."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(word_list) - (size - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(word_list, i, size), " ")))


def mask_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


def figures(text: Column) -> Column:
    """Dollar figures as decimals of two places."""
    found = F.regexp_extract_all(text, F.lit(MONEY), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("decimal(18,2)"))


def money(text: Column) -> Column:
    return F.when(text.rlike(MONEY_TEXT), text.cast("decimal(18,2)"))


def record_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RECORD_ID), F.lit(0))


def names_version_in_force(text: Column) -> Column:
    return text.rlike(VERSION_3) & ~text.rlike(VERSION_2)


def question_key(text: Column) -> Column:
    """Case-folded question, compatibility characters as plain ones, without trailing marks, for the response cache."""
    return F.regexp_replace(collapse(casefold(nfkc(text))), r"[?!.\s]+$", "")


def fact_text(text: Column) -> Column:
    return F.lower(F.translate(text, ",$", ""))


def contains_fact(reply: Column, fact: Column, plain: bool = False) -> Column:
    """Any of the fact's alternatives (split at bars) occurs; commas, dollar signs and case don't count. ``plain``: the reply is its ``fact_text`` already."""
    said = reply if plain else fact_text(reply)
    return F.exists(F.split(fact, r"\|"), lambda alt: said.contains(fact_text(alt)))


def quote_matches(text: Column, quote: Column, match: Column) -> Column:
    """``substring``: the normalised quote is in the text; ``all_tokens``: each of its tokens is. Both sides normalised. Another rule is an error."""
    every = F.forall(F.split(quote, " "), lambda t: text.contains(t))
    return F.when(match == "substring", text.contains(quote)).when(match == "all_tokens", every).otherwise(F.raise_error(F.concat(F.lit("unknown match rule "), F.coalesce(match, F.lit("null")))).cast("boolean"))


def clean_whitespace(text: Column) -> Column:
    """Line feeds for other line ends, plain spaces for fixed spaces and tabs, no runs of spaces, trimmed lines."""
    out = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.translate(out, "  \t", "   ")
    lines = F.transform(F.split(out, "\n"), lambda ln: F.trim(F.regexp_replace(ln, " {2,}", " ")))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def whitespace_counts(text: Column) -> Column:
    return F.struct(
        F.regexp_count(text, F.lit("\r")).alias("line_ends"),
        F.regexp_count(text, F.lit("[  ]")).alias("fixed_spaces"),
        F.regexp_count(text, F.lit("\t")).alias("tabs"),
    )


def drop_tracked_changes(text: Column) -> Column:
    return F.regexp_replace(text, DELETED, "")


def word_count(text: Column) -> Column:
    """How many words the text has between white space."""
    return F.size(words(collapse(text)))


def near_empty_reason(text: Column, min_words: int, phrases: tuple[str, ...], max_words: int, n: Column | None = None) -> Column:
    """Why a text counts as near-empty, or null. ``n``: its word count, if it is there as a column already."""
    n = word_count(text) if n is None else n
    norm = normalise(text)
    phrase = F.coalesce(*[F.when(norm.rlike(rf"\b{p}\b"), F.lit(p)) for p in phrases])
    short = F.concat(F.lit("near-empty: "), n, F.lit(" words"), F.coalesce(F.concat(F.lit('; placeholder text ("'), phrase, F.lit('")')), F.lit("")))
    named = F.concat(F.lit("near-empty: "), n, F.lit(' words; placeholder text ("'), phrase, F.lit('")'))
    # long texts are only counted: phrases are looked for in those that they can decide about
    return F.when(n >= max(min_words, max_words), F.lit(None)).when(n < min_words, short).when((n < max_words) & phrase.isNotNull(), named)


def looks_like_heading(line: Column) -> Column:
    """A numbered line, a short line in capitals, or a short line that doesn't end like a sentence."""
    s = F.trim(line)
    letters = F.regexp_replace(s, r"[^\p{L}]", "")
    possible = (F.length(s) > 0) & (F.length(s) <= 80) & ~s.rlike("^[-*>•]")
    numbered = s.rlike(NUMBERED) & ~s.endswith(".")
    capitals = (F.length(letters) >= 4) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    short = ~s.rlike(r"[.,;:]$") & ~s.rlike(r"^\d") & (F.size(F.split(s, r"\s+")) <= 8)
    return possible & (numbered | capitals | short)


def table_row(line: Column) -> Column:
    cells = F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|")
    return F.array_join(F.transform(cells, F.trim), " | ")


def is_boilerplate(hint: Column, tags: tuple[str, ...], names: tuple[str, ...]) -> Column:
    """An ancestor ('tag#id.class > ...') with a boilerplate tag, or a class or id that holds a boilerplate name."""

    def bad(part: Column) -> Column:
        tag = F.regexp_extract(part, r"^[^.#]*", 0)
        rest = F.lower(F.regexp_replace(part, r"^[^.#]*", ""))
        named = [rest.contains(x) for x in names]
        hit = tag.isin(*tags)
        for x in named:
            hit = hit | x
        return hit

    return F.exists(F.split(hint, " > "), bad)


def canonical_json_hash(*cols: Column) -> Column:
    """SHA-256 over named values, for cache keys; callers pass columns in key order."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def model_name(model: Column) -> Column:
    """Without a dated suffix."""
    return F.regexp_replace(model, r"-\d{8}$", "")
