"""Near-empty documents: words are counted once, and long texts are only counted."""

from pyspark.sql import functions as F

from corpusloom import params
from corpusloom.functions import text as tx
from corpusloom.operators import cleaning


def test_words_are_counted_once(spark):
    texts = [None, "", "tbd", "word " * 60 + "TBD", "word " * 250 + "tbd", " a\x0bb  c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = cleaning.near_empty(docs)
    assert out.columns == ["doc_id", "text", "reason", "status"]
    got = [(r.status, r.reason) for r in out.orderBy("doc_id").collect()]
    assert got[2] == ("dropped", 'near-empty: 1 words; placeholder text ("tbd")') and got[3] == ("dropped", 'near-empty: 61 words; placeholder text ("tbd")')
    assert got[0] == got[1] == ("dropped", "near-empty: 0 words") and got[4] == ("cleaned", None) and got[5] == ("dropped", "near-empty: 3 words")
    c = params.CLEAN
    given = tx.near_empty_reason(F.lit("x"), c["min_words"], c["placeholder_phrases"], c["placeholder_max_words"], F.lit(7))
    assert docs.select(given.alias("r")).first().r == "near-empty: 7 words"
