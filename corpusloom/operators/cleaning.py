"""Cleaning of block tables. A block table has doc_id, pos, type, text, and what a cleaner needs besides (page, source_hint, format)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom import params
from corpusloom.functions import text as tx

HEADER_LINE = r"(?i)^(-{3,}\s*Original Message\s*-{3,}|(From|Sent|To|Cc|Subject):.*)$"


def _misread() -> dict[str, int]:
    """Each character that a byte of a longer UTF-8 sequence becomes when read as cp1252 (bytes without a character there as their own number)."""
    return {bytes([k]).decode("cp1252", "ignore") or chr(k): k for k in range(0x80, 0x100)}


@F.pandas_udf(T.StringType())
def repair_mojibake(text: pd.Series) -> pd.Series:
    """Undo UTF-8 read as cp1252, sequence by sequence: a lead byte's character and those of its continuation bytes, where these bytes are valid UTF-8. What stands beside them stays."""
    byte = _misread()
    chars = lambda low, high: "[" + "".join(re.escape(c) for c, k in byte.items() if low <= k < high) + "]"
    more = chars(0x80, 0xC0)
    sequence = re.compile("|".join([chars(0xC2, 0xE0) + more, chars(0xE0, 0xF0) + more + "{2}", chars(0xF0, 0xF5) + more + "{3}"]))

    def fix(m: re.Match) -> str:
        try:
            return bytes(byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return text.map(lambda x: None if x is None else sequence.sub(fix, x))


def fix_mojibake(blocks: DataFrame) -> DataFrame:
    """Only blocks with a suspicious sequence go through Python."""
    bad = F.coalesce(F.regexp_count("text", F.lit(tx.MOJIBAKE)), F.lit(0))
    out = blocks.withColumn("mojibake", bad)
    clean = out.where(F.col("mojibake") == 0)
    return clean.unionByName(out.where(F.col("mojibake") > 0).withColumn("text", repair_mojibake("text")))


def remove_boilerplate(blocks: DataFrame) -> DataFrame:
    """HTML blocks under navigation, headers, banners and the like go."""
    return blocks.where(~F.coalesce(tx.is_boilerplate(F.col("source_hint"), params.CLEAN["boilerplate_tags"], params.CLEAN["boilerplate_names"]), F.lit(False)))


def clean_email(blocks: DataFrame) -> DataFrame:
    """Unquote replies, drop address headers and disclaimers, split at blank lines, drop repeated paragraphs (the first stays)."""
    lines = F.transform(F.split("text", "\n"), lambda ln: F.regexp_replace(ln, r"^\s*(>\s?)+", ""))
    bad = lambda ln: F.trim(ln).rlike(HEADER_LINE) | _starts(F.trim(ln), params.CLEAN["disclaimer_prefixes"])
    text = F.array_join(F.filter(lines, lambda ln: ~bad(ln)), "\n")
    paras = blocks.select(*[c for c in blocks.columns if c != "text"], F.posexplode(F.split(text, r"\n\s*\n")).alias("part", "text"))
    paras = paras.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda ln: F.trim(ln) != ""), "\n")).where(F.col("text") != "")
    first = Window.partitionBy("doc_id", tx.normalise(F.col("text"))).orderBy("pos", "part")
    kept = paras.withColumn("n", F.row_number().over(first)).where(F.col("n") == 1).drop("n")
    order = Window.partitionBy("doc_id").orderBy("pos", "part")
    return kept.withColumn("pos", F.row_number().over(order) - 1).drop("part").select(*blocks.columns)


def _starts(line: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | line.startswith(p)
    return out


def running_lines(lines: DataFrame, band: int = params.CLEAN["running_band"], share: float = params.CLEAN["running_page_share"]) -> DataFrame:
    """doc_id, key of lines that recur in the top or bottom band of most pages. ``lines``: doc_id, page, line_no, line.

    Digits are masked first, so page numbers don't tell lines apart. A document of one page has none.
    """
    full = lines.where(F.trim("line") != "")
    page = Window.partitionBy("doc_id", "page")
    placed = full.withColumn("top", F.row_number().over(page.orderBy("line_no"))).withColumn("low", F.row_number().over(page.orderBy(F.desc("line_no"))))
    banded = placed.where((F.col("top") <= band) | (F.col("low") <= band)).select("doc_id", "page", tx.mask_digits(tx.normalise(F.col("line"))).alias("key"))
    n = full.groupBy("doc_id").agg(F.countDistinct("page").alias("pages")).where(F.col("pages") > 1)
    seen = banded.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("on"))
    return seen.join(n, "doc_id").where(F.col("on") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share))).select("doc_id", "key", "on", "pages")


def remove_running_lines(lines: DataFrame) -> DataFrame:
    found = running_lines(lines).select("doc_id", "key")
    return lines.withColumn("key", tx.mask_digits(tx.normalise(F.col("line")))).join(found, ["doc_id", "key"], "left_anti").select(*lines.columns)


def near_empty(docs: DataFrame) -> DataFrame:
    """status, reason of each active document after cleaning: dropped as near-empty, or cleaned."""
    reason = tx.near_empty_reason(F.coalesce("text", F.lit("")), params.CLEAN["min_words"], params.CLEAN["placeholder_phrases"], params.CLEAN["placeholder_max_words"], F.col("_words"))
    return docs.withColumn("_words", tx.word_count(F.coalesce("text", F.lit("")))).withColumn("reason", reason).drop("_words").withColumn("status", F.when(F.col("reason").isNull(), "cleaned").otherwise("dropped"))


def load_note(info: Column) -> Column:
    """What loading had to repair, from its notes (a map of texts)."""
    get = lambda k: F.try_element_at(info, F.lit(k))
    return F.concat_ws(
        "; ",
        F.when(get("bom") == "true", "stripped UTF-8 BOM"),
        F.when(get("utf8_failed") == "true", F.concat(F.lit("decoded as "), get("encoding"), F.lit(" (not valid UTF-8)"))),
        F.when(get("converter") == "rtf", "converted legacy RTF to text"),
    )


def fix_blocks(blocks: DataFrame) -> DataFrame:
    """All cleaners of running text: tracked changes, mojibake, whitespace; empty blocks go."""
    out = fix_mojibake(blocks.withColumn("text", tx.drop_tracked_changes(F.col("text")))).drop("mojibake")
    return out.withColumn("text", tx.clean_whitespace(F.col("text"))).where((F.col("text") != "") | (F.col("type") == "figure_caption"))


def document_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: the nonempty blocks joined by blank lines, in order."""
    packed = blocks.where(F.col("text") != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return packed.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))


def offsets(blocks: DataFrame) -> DataFrame:
    """start and end of each nonempty block in the document's text."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    full = blocks.where(F.col("text") != "")
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return full.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def by_partition(df: DataFrame, fn, schema) -> DataFrame:
    """Rows through a pandas function, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
