"""The ingestion plan: load, clean, dedupe, scrub, chunk. Rejected documents stay in the table with their reason."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, cleaning, dedupe, filters, pii
from corpusloom.sources import loaders
from corpusloom.storage import materialize


@dataclass
class Ingested:
    documents: DataFrame  # doc_id, filename, format, status, stage, reason, text, pii_spans
    chunks: DataFrame  # doc_id, chunk_index, char_start, char_end, text, page_start, page_end, section_path, contains_generated_text, name (the doc_id)


def _reject(docs: DataFrame, found: DataFrame, stage: str, status: str = "dropped") -> DataFrame:
    """Give the documents in ``found`` (doc_id, why) a decision; others keep theirs."""
    j = docs.join(found, "doc_id", "left")
    hit = F.col("why").isNotNull() & filters.is_active()
    return j.withColumn("stage", F.when(hit, stage).otherwise(F.col("stage"))).withColumn("reason", F.when(hit, F.col("why")).otherwise(F.col("reason"))).withColumn("status", F.when(hit, status).otherwise(F.col("status"))).drop("why")


def ingest(spark: SparkSession, folder: str, catalog: DataFrame, chunker: str = "structure", tag_names: Callable[[DataFrame], DataFrame] | None = None, not_names: Sequence[str] = ()) -> Ingested:
    """Run all stages over a folder of files and its catalog (filename, doc_id, effective_date, version).

    ``tag_names``: any tagger of persons, which adds ``name_spans`` (array of start, end in the text) to a table of blocks; spans that are full names, and hold none of ``not_names``, are redacted.
    """
    files = materialize(loaders.load_decision(loaders.catalogued(loaders.scan(spark, folder), catalog)), "files")
    docs = files.select("doc_id", "filename", "format", "path", "version", "effective_date", "status", F.when(F.col("status") != "pending", "load").alias("stage"), "reason")
    parsed = materialize(loaders.parse(files.where(filters.is_active())), "parsed").join(docs.select("path", "doc_id"), "path")
    docs = _reject(docs, parsed.where(F.col("type") == "error").select("doc_id", F.col("error").alias("why")), "parse", "quarantined")
    blocks = cleaning.remove_boilerplate(parsed.where(F.col("type") != "error")).select("doc_id", "pos", "type", "text", "level")
    mail = docs.where(F.col("format") == "eml").select("doc_id")
    letters = cleaning.clean_email(blocks.join(mail, "doc_id", "left_semi"))
    blocks = materialize(cleaning.fix_blocks(blocks.join(mail, "doc_id", "left_anti").unionByName(letters)), "clean-blocks")
    docs = docs.join(cleaning.document_text(blocks), "doc_id", "left")
    judged = cleaning.near_empty(docs.where(filters.is_active()).select("doc_id", "text")).where(F.col("status") == "dropped")
    docs = materialize(_reject(docs, judged.select("doc_id", F.col("reason").alias("why")), "clean"), "clean")
    active = docs.where(filters.is_active()).select("doc_id", "text", "version", "effective_date", "filename", "format")
    groups = dedupe.near_groups(active, "version").join(active.drop("text"), "doc_id")
    best = groups.groupBy("group_id").agg(F.min_by("doc_id", dedupe.preference(F.col("filename"), F.col("format"), F.col("effective_date"))).alias("canonical"))
    copies = groups.join(best, "group_id").where(F.col("doc_id") != F.col("canonical")).select("doc_id", F.concat(F.lit("near-duplicate of "), "canonical").alias("why"))
    docs = materialize(_reject(docs, copies, "dedupe"), "deduped")
    docs = docs.withColumn("status", F.when(F.col("status") == "pending", "cleaned").otherwise(F.col("status"))).withColumn("stage", F.coalesce("stage", F.lit("clean")))
    kept = docs.where(filters.is_active()).select("doc_id")
    kept_blocks = blocks.join(kept, "doc_id", "left_semi")
    if tag_names:
        full = lambda x: pii.full_name(F.substring("text", x["start"] + 1, x["end"] - x["start"]), list(not_names))
        kept_blocks = tag_names(kept_blocks).withColumn("name_spans", F.filter(F.coalesce("name_spans", F.array()), full))
    scrubbed = materialize(pii.scrub(kept_blocks, "name_spans" if tag_names else None).drop("name_spans"), "scrubbed")
    spans = scrubbed.groupBy("doc_id").agg(F.flatten(F.collect_list("pii_spans")).alias("pii_spans"))
    final = docs.drop("text").join(cleaning.document_text(scrubbed), "doc_id", "left").join(spans, "doc_id", "left")
    placed = materialize(chunking.section_paths(scrubbed.drop("pii_spans")), "sections")
    chunks = chunking.structure_chunks(placed) if chunker == "structure" else chunking.fixed_chunks(cleaning.document_text(placed))
    chunks = materialize(chunks, "cut")
    told = chunking.block_metadata(chunks, placed.withColumn("page", F.lit(None).cast("int")).withColumn("generated", F.lit(False)))
    chunks = chunks.join(told, ["doc_id", "chunk_index"], "left").withColumn("name", F.col("doc_id"))
    return Ingested(materialize(final.drop("path", "effective_date"), "documents"), materialize(chunks, "chunks"))


def must_be_complete(done: Ingested) -> list[str]:
    """Broken promises: kept documents without chunks, documents still undecided."""
    kept = done.documents.where(filters.is_active())
    bare = [r.doc_id for r in kept.join(done.chunks.select(F.col("name").alias("doc_id")), "doc_id", "left_anti").select("doc_id").limit(20).collect()]
    open_ = [r.doc_id for r in done.documents.where(F.col("status") == "pending").select("doc_id").limit(20).collect()]
    return [f"no chunk: {x}" for x in bare] + [f"undecided: {x}" for x in open_]
