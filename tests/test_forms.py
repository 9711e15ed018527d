"""Compatibility forms and case folding in the JVM equal Unicode's own."""

import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as tx

TEXTS = [
    "", "plain ascii", "déjà vu Ünder ñandú", "ofﬁce ﬂoor ＡＢＣ１２ ½ ① ™ µm a b … ㎒ ㍿", "Straße STRASSE ẞ Σίσυφος İx ŉ",
    "é ñ ấ ợ q́", "Å Ω 一 漢字 豈 ｶﾞ", "ﬃ" * 3 + "x²³ №5 ㍿",
]


def test_nfkc_equals_unicode(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = {r.k: (r.n, r.t) for r in df.select("k", "t", tx.nfkc(F.col("t")).alias("n")).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k][0] == unicodedata.normalize("NFKC", t), t
    every = [chr(c) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000 and not unicodedata.combining(chr(c))]
    wide = spark.createDataFrame([(k, "".join(f"{c}|" for c in every[k : k + 500])) for k in range(0, len(every), 500)], "k int, t string")
    for r in wide.select("t", tx.nfkc(F.col("t")).alias("n")).collect():
        assert r.n == "".join(unicodedata.normalize("NFKC", c) for c in r.t)


def test_casefold_equals_unicode(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", tx.casefold(F.col("t")).alias("f")).collect():
        assert r.f == r.t.casefold()


def test_keys_of_questions_and_quotes(spark):
    df = spark.createDataFrame([("Wie lang ist die Straße? ", "WIE LANG IST DIE STRASSE", "ＡPY ofﬁce ½")], "a string, b string, c string")
    r = df.select(tx.question_key(F.col("a")), tx.question_key(F.col("b")), tx.normalise(F.col("c"), compatibility=True), tx.bm25_tokens(F.col("c"))).first()
    assert r[0] == r[1] == "wie lang ist die strasse" and r[2] == "apy office 1⁄2" and r[3][:2] == ["apy", "office"]
