"""Stored lexical and vector indexes: what they find, what they read, and when they refuse to open; chunks and the blocks they overlap."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking, cleaning, retrieval
from corpusloom.sources import lexical, loaders
from corpusloom.sources.lexical import LexicalIndex
from corpusloom.sources.vectors import VectorIndex, fit
from corpusloom.storage import BATCH_BYTES


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    rows = [(d, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for d in range(90)] + [(90, None), (91, "")]
    asked = [(1, "w1 w2 w2 nowhere"), (2, "w3"), (3, None), (4, "nowhere")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


def hits(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_stored_index_scores_like_an_unstored_one(spark, corpus, tmp_path):
    docs, asked = corpus
    index = LexicalIndex.add(docs, str(tmp_path / "i"), "a")
    assert hits(index.top(asked)) == hits(retrieval.bm25_top(docs, asked)) != []
    few = docs.where("doc_id % 2 = 0").select("doc_id")
    assert hits(index.top(asked, keep=few)) == hits(retrieval.bm25_top(docs, asked, keep=F.col("doc_id") % 2 == 0))


def test_documents_stay_whole_when_the_filter_turns_into_a_broadcast(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(2 + 9 * k)) for k in range(60)]  # of such lengths that files differ by bucket, not by document
    docs = spark.createDataFrame([(d, " ".join(rng.sample(words, 30))) for d in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(words))], "query_id long, text string")
    index = LexicalIndex.add(docs, str(tmp_path / "i"), "a")
    few = docs.where("doc_id % 2 = 0").select("doc_id")
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        got = hits(index.top(asked, keep=few))
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert got == hits(retrieval.bm25_top(docs, asked, keep=F.col("doc_id") % 2 == 0)) != []


def test_segments_add_up(spark, corpus, tmp_path, monkeypatch):
    docs, asked = corpus
    monkeypatch.setattr(lexical.params, "BROADCAST_ROWS", 1)  # postings are joined by shuffle, in shares
    root = str(tmp_path / "i")
    LexicalIndex.add(docs.where("doc_id < 50"), root, "a")
    index = LexicalIndex.add(docs.where("doc_id >= 50"), root, "b")
    assert hits(index.top(asked)) == hits(retrieval.bm25_top(docs, asked)) and index.version == 2
    with pytest.raises(ValueError, match="already"):
        LexicalIndex.add(docs.where("doc_id = 3"), root, "c")
    with pytest.raises(ValueError, match="twice"):
        LexicalIndex.add(docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3")), str(tmp_path / "j"), "c")
    assert LexicalIndex.open(spark, root, "b").n_docs == 92  # what was refused left no trace


def test_stale_or_missing_index_does_not_open(spark, corpus, tmp_path):
    root = str(tmp_path / "i")
    with pytest.raises(ValueError, match="None"):
        LexicalIndex.open(spark, root, "a")
    LexicalIndex.add(corpus[0], root, "a")
    with pytest.raises(ValueError, match="revision a, wanted b"):
        LexicalIndex.open(spark, root, "b")


def test_index_of_documents_follows_their_texts(spark, corpus, tmp_path):
    docs, folder = corpus[0], str(tmp_path)
    first = LexicalIndex.of(docs, folder)
    assert LexicalIndex.of(docs.orderBy(F.desc("doc_id")), folder).root == first.root
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text")))
    assert LexicalIndex.of(changed, folder).root != first.root


def test_a_query_reads_the_buckets_of_its_terms(spark, corpus, tmp_path):
    index = LexicalIndex.add(corpus[0], str(tmp_path / "i"), "a")
    _, buckets = index.asked(corpus[1].where("query_id = 2"))
    assert len(buckets) == 1
    assert "PartitionFilters: [isnotnull(bucket" in plan(index.postings(buckets))


def test_empty_index(spark, corpus, tmp_path):
    index = LexicalIndex.add(corpus[0].limit(0), str(tmp_path / "i"), "a")
    assert index.top(corpus[1]).count() == 0 and index.n_docs == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    m = centres[rng.integers(12, size=1500)] + 0.05 * rng.normal(size=(1500, 6))
    m[700:800] = m[700]  # copies: ties
    rows = [(k, [float(np.float32(x)) for x in v], k % 3) for k, v in enumerate(m)] + [(9999, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return rows[:-1], df, VectorIndex.build(df, str(tmp_path_factory.mktemp("v")), "r1", cells=12)


def nearest(rows, q, n, ok=lambda r: True):
    scored = sorted((-round(float(np.dot(np.float64(q), np.float64(v))), 6), k) for k, v, label in rows if ok((k, v, label)))
    return [(k, -s) for s, k in scored[:n]]


@pytest.mark.parametrize("most", [4096, 7])
def test_vector_index_equals_a_full_scan(spark, stored, most):
    rows, df, index = stored
    asked = [(k, rows[k][1]) for k in range(0, 1500, 100)] + [(-1, [0.0] * 6), (-2, [-3.0, 1.0, 0.0, 0.0, 0.0, 5.0])]
    got = index.query(spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5, most_queries=most).collect()
    for q, v in asked:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in mine] == nearest(rows, v, 5)
    shares = {r.query_id: r.share for r in got}
    assert shares[-1] == 1.0 and np.median(list(shares.values())) < 0.4


def test_vector_filter_comes_before_the_cut(spark, stored):
    rows, df, index = stored
    got = index.query(spark.createDataFrame([(1, rows[5][1])], "query_id long, embedding array<double>"), 4, keep=F.col("label") == 1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == nearest(rows, rows[5][1], 4, lambda r: r[2] == 1)
    none = index.query(spark.createDataFrame([(1, rows[5][1])], "query_id long, embedding array<double>"), 4, keep=F.col("label") == 7)
    assert none.count() == 0


def test_vector_index_gets_rows_and_refuses_other_revisions(spark, stored):
    rows, df, index = stored
    got = index.get(spark.createDataFrame([(3,), (3,), (9999,), (-5,)], "vec_id long")).collect()
    assert [(r.vec_id, r.label) for r in got] == [(3, 0)]
    with pytest.raises(ValueError, match="revision r1, wanted r2"):
        VectorIndex.open(spark, index.root, "r2")
    with pytest.raises(ValueError, match="None"):
        VectorIndex.open(spark, index.root + "/nowhere", "r1")


def test_empty_vector_index(spark, stored, tmp_path):
    index = VectorIndex.build(stored[1].limit(0), str(tmp_path / "v"), "r")
    assert index.query(spark.createDataFrame([(1, [1.0] * 6)], "query_id long, embedding array<double>")).count() == 0


def test_fit_finds_groups():
    m = np.concatenate([np.full((50, 2), x) + np.random.default_rng(0).normal(size=(50, 2)) * 0.01 for x in (0.0, 5.0)])
    c = fit(m, 2)
    assert sorted(np.round(c[:, 0]).tolist()) == [0.0, 5.0]


# ------------------------------------------------------------- chunks and blocks


def test_block_metadata(spark):
    rows = [(1, 0, "heading", "Fees", 1, 2, False), (1, 1, "paragraph", "x" * 3000, None, None, False), (1, 2, "figure_caption", "", None, 9, True), (1, 3, "paragraph", "y" * 10, None, 4, True), (2, 0, "paragraph", "z", None, 0, None)]
    blocks = chunking.section_paths(spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, level int, page int, generated boolean"))
    chunks = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 4, 6), (1, 2, 100, 2000), (1, 3, 2900, 3018), (2, 0, 0, 1)], "doc_id long, chunk_index int, char_start int, char_end int")
    got = {(r.doc_id, r.chunk_index): (r.page_start, r.page_end, r.section_path, r.contains_generated_text) for r in chunking.block_metadata(chunks, blocks).collect()}
    assert got == {(1, 0): (2, 2, "Fees", False), (1, 1): (2, 2, "Fees", False), (1, 2): (-1, -1, "Fees", False), (1, 3): (4, 4, "Fees", True), (2, 0): (-1, -1, "", False)}


@pytest.mark.parametrize("bucket", [7, 1024])
def test_overlaps_equal_brute_force(spark, bucket):
    rng = random.Random(6)
    chunks = [(d, k, a, a + rng.randint(1, 60)) for d in range(4) for k, a in enumerate(rng.randint(0, 300) for _ in range(12))]
    blocks = [(d, k, "paragraph", "x" * rng.choice([1, 5, 40, 90])) for d in range(4) for k in range(9)]
    placed = cleaning.offsets(spark.createDataFrame(blocks, "doc_id long, pos int, type string, text string"))
    rows = placed.collect()
    got = [(r.doc_id, r.chunk_index, r.pos) for r in chunking.overlapping(spark.createDataFrame(chunks, "doc_id long, chunk_index int, char_start int, char_end int"), placed, bucket).collect()]
    assert sorted(got) == sorted((d, k, r.pos) for d, k, a, b in chunks for r in rows if r.doc_id == d and r.start < b and r.end > a)


def test_section_paths_reset(spark):
    levels = [("heading", "A", 1), ("heading", "B", 3), ("paragraph", "p", None), ("heading", "C", 2), ("paragraph", "q", None), ("heading", "D", 3), ("heading", "E", None), ("paragraph", "r", None), ("heading", "F", 1), ("paragraph", "s", None)]
    df = spark.createDataFrame([(1, k, *x) for k, x in enumerate(levels)], "doc_id long, pos int, type string, text string, level int")
    got = {r.pos: r.section_path for r in chunking.section_paths(df).collect()}
    assert got == {0: [], 1: ["A"], 2: ["A", "B"], 3: ["A"], 4: ["A", "C"], 5: ["A", "C"], 6: ["A"], 7: ["A", "E"], 8: [], 9: ["F"]}


def test_postings_are_counted_without_a_shuffle_of_them_and_scored_in_blocks(spark, corpus, tmp_path, monkeypatch):
    docs, asked = corpus
    index = LexicalIndex.add(docs, str(tmp_path / "i"), "a")
    listed = LexicalIndex._documents(spark, index.root, index.segments)
    assert {(r.doc_id, r.length) for r in listed.collect()} >= {(90, 0), (91, 0)} and listed.count() == 92
    monkeypatch.setattr(lexical, "BLOCK", 3)
    blocks, few = index.top(asked), docs.where("doc_id % 2 = 0").select("doc_id")
    assert "MapInArrow" in plan(blocks)
    want = hits(blocks), hits(index.top(asked, keep=few))
    monkeypatch.setattr(lexical, "WEIGHTS", 0)
    assert (hits(index.top(asked)), hits(index.top(asked, keep=few))) == want


def test_python_is_sent_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    blocks = spark.createDataFrame([(1, 0, "paragraph", "x", [])], "doc_id long, pos int, type string, text string, section_path array<string>")
    pages = spark.createDataFrame([("1", "html", bytearray(b"<p>x</p>"))], "path string, format string, content binary")
    for make in (lambda: chunking.fixed_chunks(blocks), lambda: chunking.structure_chunks(blocks), lambda: loaders.parse(pages)):
        spark.conf.set(key, before)
        make()
        assert spark.conf.get(key) == str(BATCH_BYTES)
    spark.conf.set(key, before)
