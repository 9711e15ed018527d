"""Queries over stored indexes and over documents as blocks, each beside its SQL in ``STORED_SQL``.

A document's nonempty lines stand for its blocks: a line's length says whether it is a heading, of which level, and whether it was generated; its place gives its page.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import chunking, cleaning
from corpusloom.plans import tables as t
from corpusloom.plans.queries import QUERY_STEP, _docs, _index, _questions
from corpusloom.plans.sql import _BM25, _TOP, _VEC, SQL
from corpusloom.sources.lexical import LexicalIndex, corpus_revision
from corpusloom.sources.vectors import VectorIndex
from corpusloom.storage import shared_dir


def _blocks(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("text <> ''")
    n = F.length("text")
    heading = n % 5 == 0
    return lines.select("doc_id", "pos", F.when(heading, "heading").otherwise("paragraph").alias("type"), "text", F.when(heading, (n % 3 + 1).cast("int")).alias("level"), (F.col("pos") % 7).alias("page"), (n % 11 == 0).alias("generated"))


def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open headings above each line of a document."""
    out = chunking.section_paths(_blocks(spark, sf_dir))
    return out.select("doc_id", "pos", F.size("section_path").cast("long").alias("depth"), F.sha2(F.array_join("section_path", " > "), 256).alias("sha256"))


def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, section and generated flag of each fixed chunk, from the lines that it overlaps."""
    blocks = chunking.section_paths(_blocks(spark, sf_dir))
    chunks = chunking.fixed_chunks(cleaning.document_text(blocks))
    out = chunking.block_metadata(chunks, blocks)
    return out.select("doc_id", "chunk_index", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), F.sha2("section_path", 256).alias("sha256"), "contains_generated_text")


def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index of the documents holds; built if it isn't there."""
    index = _index(spark, sf_dir)
    return index.term_statistics().agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings")).select(F.lit(index.n_docs).alias("n_docs"), F.round(F.lit(index.avg_length), 6).alias("avg_length"), "terms", "postings")


def lexical_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best documents of every benchmark text, from an index that was written in three segments."""
    docs, root = _docs(spark, sf_dir).select("doc_id", "text"), f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    index = None
    for k in range(3):
        index = LexicalIndex.add(docs.where(F.col("doc_id") % 3 == k), root, corpus_revision(docs.where(F.col("doc_id") % 3 <= k)))
    return index.top(_questions(spark, sf_dir)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _vectors(spark, sf_dir):
    v = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    root = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    return v, VectorIndex.build(v, root, "1")


def stored_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vectors for every fiftieth one, from cells of a stored index."""
    v, index = _vectors(spark, sf_dir)
    asked = v.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return index.query(asked).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def filtered_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vectors of even labels for every fiftieth one: the filter comes before the cut."""
    v, index = _vectors(spark, sf_dir)
    asked = v.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return index.query(asked, keep=F.col("label") % 2 == 0).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of asked ids, some of which aren't there."""
    v, index = _vectors(spark, sf_dir)
    got = index.get(v.select((F.col("vec_id") * 3).alias("vec_id")))
    return got.select("vec_id", F.col("label").cast("long").alias("label"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


_LINES = """
lines AS (SELECT doc_id, text, pos, length(text) % 5 = 0 AS heading, length(text) % 3 + 1 AS level, pos % 7 AS page, length(text) % 11 = 0 AS generated
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE text <> ''),
last AS (SELECT *, {0} FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
paths AS (SELECT *, list_filter([CASE WHEN p1 IS NOT NULL AND (NOT heading OR level > 1) THEN t1 END, CASE WHEN p2 > coalesce(p1, -1) AND (NOT heading OR level > 2) THEN t2 END,
  CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) AND NOT heading THEN t3 END], lambda x: x IS NOT NULL) AS path FROM last)
""".format(", ".join(f"max(CASE WHEN heading AND level = {k} THEN pos END) OVER w AS p{k}, last_value(CASE WHEN heading AND level = {k} THEN text END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3)))
_CHUNKED = SQL["fixed_chunks"].replace("FROM documents WHERE", "FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM paths GROUP BY doc_id) WHERE").replace("WITH RECURSIVE ", "")
_CHUNKED = _CHUNKED[: _CHUNKED.index("SELECT doc_id, cast(row_number()")]

STORED_SQL: dict[str, str] = {
    "section_path": f"WITH {_LINES} SELECT doc_id, cast(pos AS INT) AS pos, len(path) AS depth, sha256(array_to_string(path, ' > ')) AS sha256 FROM paths",
    "chunk_blocks": f"""WITH RECURSIVE {_LINES}, {_CHUNKED},
      chunks AS (SELECT doc_id, l, r, cast(row_number() OVER (PARTITION BY doc_id ORDER BY l, r) - 1 AS INTEGER) AS chunk_index FROM place),
      placed AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM paths)
      SELECT doc_id, chunk_index, coalesce(min(nullif(page, 0)), -1) AS page_start, coalesce(max(nullif(page, 0)), -1) AS page_end, sha256(array_to_string(arg_min(CASE WHEN heading THEN list_append(path, p.text) ELSE path END, pos), ' > ')) AS sha256,
        bool_or(generated) AS contains_generated_text FROM chunks c JOIN placed p USING (doc_id) WHERE a < r AND a + length(p.text) > l GROUP BY doc_id, chunk_index""",
    "lexical_index": f"WITH {_BM25} SELECT n_docs, round(avg_length, 6) AS avg_length, (SELECT count(*) FROM idf) AS terms, (SELECT count(*) FROM post) AS postings FROM whole",
    "lexical_segments": f"WITH {_BM25} " + _TOP.format("scores WHERE score > 0"),
    "stored_vector_topk": f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM vtop WHERE rank <= 10",
    "filtered_vector_topk": f"WITH {_VEC}, even AS (SELECT s.query_id, s.vec_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.vec_id) AS rank FROM sim s JOIN v USING (vec_id) WHERE label % 2 = 0) SELECT * FROM even WHERE rank <= 10",
    "stored_vectors": 'SELECT vec_id, cast(label AS BIGINT) AS label, round(cast(embedding[1] AS DOUBLE), 6) AS "first" FROM embeddings SEMI JOIN (SELECT vec_id * 3 AS vec_id FROM embeddings) USING (vec_id)',
}
