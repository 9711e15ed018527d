"""Worked examples and brute-force comparisons of the engine's operators."""

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import calls, chunking, cleaning, conversation, dedupe, filters, graph, metrics, pii, records, retrieval
from corpusloom.sources import loaders, stores


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0]


def test_normalise(spark):
    assert one(spark, tx.normalise(F.col("x")), x=" A “B”  …\n— ﬁ") == 'a "b" ... - ﬁ'
    assert one(spark, tx.normalise(F.col("x"), True), x="ﬁne") == "fine"


def test_bm25_tokens_stay_whole(spark):
    assert one(spark, tx.bm25_tokens(F.col("x")), x="APY 4.05%, fee $30.00 on a 5/1/5 ARM.") == ["apy", "4.05%", "fee", "$30.00", "on", "a", "5/1/5", "arm"]


def test_figures_and_versions(spark):
    assert one(spark, tx.figures(F.col("x")), x="$4,210.55 then $ 30 and 7") == [Decimal("4210.55"), Decimal("30.00")]
    assert one(spark, tx.names_version_in_force(F.col("x")), x="see v3.0") and not one(spark, tx.names_version_in_force(F.col("x")), x="v3 not v2")


def test_quote_matches(spark):
    d = spark.createDataFrame([("24 months | 3.95% | 4.05%", "24 months 4.05%", "all_tokens"), ("abc def", "c d", "substring"), ("abc", "x", "substring")], "t string, q string, m string")
    assert [r[0] for r in d.select(tx.quote_matches(F.col("t"), F.col("q"), F.col("m"))).collect()] == [True, True, False]


def test_whitespace_and_tracked_changes(spark):
    assert one(spark, tx.clean_whitespace(F.col("x")), x="\r\n a  b\t\tc \r d e\n") == "a b c\nd e"
    assert one(spark, tx.drop_tracked_changes(F.col("x")), x="fee [DELETED: $5] $6") == "fee $6"
    d = spark.createDataFrame([(1, 0, "p", "Itâ€™s fine")], "doc_id long, pos int, type string, text string")
    assert cleaning.fix_blocks(d).first().text == "It’s fine"


def test_near_empty(spark):
    d = spark.createDataFrame([(1, "tbd"), (2, "w " * 60), (3, "coming soon " + "w " * 60), (4, "tbd " + "w " * 300), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.status, r.reason) for r in cleaning.near_empty(d).collect()}
    assert got[1] == ("dropped", 'near-empty: 1 words; placeholder text ("tbd")') and got[2][0] == "cleaned" and got[3][0] == "dropped" and got[4][0] == "cleaned" and got[5][1] == "near-empty: 0 words"


def test_where_dialect(spark):
    d = spark.createDataFrame([("a", "x", True), ("a", "restricted", True), ("b", "x", True), ("a", "x", False)], "tenant string, sensitivity string, is_current boolean")
    assert d.where(filters.where(filters.access("a"))).count() == 1
    assert d.where(filters.where(filters.access("a", True, False))).count() == 3
    assert d.where(filters.where({})).count() == 4 and d.where(filters.where({"tenant_in": ["b"]})).count() == 1


def test_boilerplate(spark):
    d = spark.createDataFrame([("nav > ul > li",), ("div.cookie-bar > p",), ("article > p",)], "h string")
    assert [r[0] for r in d.select(tx.is_boilerplate(F.col("h"), ("nav",), ("cookie",))).collect()] == [True, True, False]


def test_rrf_worked_example(spark):
    a = spark.createDataFrame([(1, "c7", 1), (1, "c9", 2), (1, "c2", 3)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "c2", 1), (1, "x", 2), (1, "y", 3), (1, "c7", 4)], "query_id int, doc_id string, rank int")
    got = {r.doc_id: (r.rank, r.score) for r in retrieval.rrf(a, b).collect()}
    assert got["c2"][0] == 1 and got["c7"][0] == 2
    assert [round(got[x][1], 5) for x in ("c2", "c7", "c9")] == [0.03227, 0.03202, 0.01613]


def test_recall_precision_equal_the_walk(spark):
    rng = random.Random(5)
    match, items, want = [], [], {}
    for q in range(60):
        n = rng.randint(1, 5)
        sat = {i: [r for r in range(1, 11) if rng.random() < 0.2] for i in range(n)}
        items += [(q, i) for i in range(n)]
        match += [(q, i, r) for i, rs in sat.items() for r in rs]
        for k in (5, 10):
            found, credited = set(), 0
            for r in range(1, k + 1):
                new = {i for i in sat if i not in found and r in sat[i]}
                credited, found = credited + bool(new), found | new
            want[q, k] = (len(found) / n, credited / k)
    got = metrics.scored(spark.createDataFrame(match, "query_id int, item int, rank int"), spark.createDataFrame(items, "query_id int, item int")).collect()
    assert {(r.query_id, r.k): (r.recall, r.precision) for r in got} == want


def test_empty_metrics_raise(spark):
    with pytest.raises(Exception, match="nothing to aggregate"):
        metrics.must_not_be_empty(spark.createDataFrame([], "x int"), "scores").collect()


def test_percentiles(spark):
    d = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "ms double")
    r = d.agg(metrics.percentile_linear("ms", 0.5), metrics.percentile_nearest("ms", 0.5), metrics.median_upper("ms")).first()
    assert tuple(r) == (2.5, 3.0, 3.0)
    assert d.where("ms > 9").agg(metrics.percentile_linear("ms", 0.5), metrics.percentile_nearest("ms", 0.5)).first()[0] is None


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 + str(rng.randint(0, 30)) for _ in range(80)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(4):
            w = b.split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    docs = [(i, t) for i, t in enumerate(texts)] + [(90, ""), (91, None), (92, "one two")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    reps = {}
    for i, t in docs:
        if t:
            reps.setdefault(t, i)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t, i in reps.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.9}
    assert {(r.a, r.b) for r in dedupe.near_pairs(d).collect()} == want
    groups = {r.doc_id: r.group_id for r in dedupe.near_groups(d).collect()}
    assert set(groups) == {i for i, _ in docs} and all(groups[a] == groups[b] for a, b in want)


def test_versions_are_never_duplicates(spark):
    t = " ".join(f"w{i}" for i in range(50))
    d = spark.createDataFrame([(1, t, "2"), (2, t + " x", "3"), (3, t + " y", "3")], "doc_id long, text string, version string")
    assert [(r.a, r.b) for r in dedupe.near_pairs(d, "version").collect()] == [(2, 3)]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    got = {r.id: r.group_id for r in graph.connected_components(e, "a", "b").collect()}
    assert {got[i] for i in range(31)} == {0} and got[51] == 50


def test_canonical_copy(spark):
    d = spark.createDataFrame([(1, "x", "faq (1).html", "html"), (2, "x", "faq.html", "html"), (3, "x", "a.docx", "docx"), (4, "y", "b.txt", "txt")], "doc_id long, text string, filename string, format string")
    got = {r.doc_id: r.canonical for r in dedupe.exact_groups(d, order=dedupe.preference(F.col("filename"), F.col("format"), F.lit(""))).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4}


def test_pii(spark):
    d = spark.createDataFrame([(1, "mail a.b@x.org, DOB: 01/02/1980, (555) 123-4567, HCU-123456"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.scrub(d).collect()}
    assert got[1].text == "mail [REDACTED-EMAIL], DOB: [REDACTED-DOB], [REDACTED-PHONE], [REDACTED-MEMBER]" and got[2].text == "nothing" and got[3].text is None
    assert [s.type for s in got[1].pii_spans] == ["EMAIL", "DOB", "PHONE", "MEMBER"]


def test_span_choice_matches_fold(spark):
    rng = random.Random(2)
    cases = [[(a := rng.randint(0, 20), a + rng.randint(1, 8), rng.choice(["NAME", "EMAIL", "PHONE"])) for _ in range(rng.randint(0, 7))] for _ in range(50)]
    d = spark.createDataFrame([(i, [tuple(h) for h in set(c)]) for i, c in enumerate(cases)], "i int, hits array<struct<start:int,end:int,type:string>>")
    got = {r.i: [tuple(x) for x in r.s] for r in d.select("i", pii.choose(F.col("hits")).alias("s")).collect()}
    for i, c in enumerate(cases):
        taken = []
        for a, b, k in sorted(set(c), key=lambda h: (h[2] == "NAME", h[0] - h[1], h[0], h[1], h[2])):
            if all(b <= s or a >= e for s, e, _ in taken):
                taken.append((a, b, k))
        assert got[i] == sorted(taken)


def test_full_names(spark):
    d = spark.createDataFrame([("Rosa Delgado-Pierce",), ("J. Okafor",), ("Rosa",), ("Port Town Branch",)], "n string")
    assert [r[0] for r in d.select(pii.full_name(F.col("n"), ["Port Town"])).collect()] == [True, False, False, False]


def test_windows_never_cut_words():
    rng = random.Random(3)
    for _ in range(50):
        text = " ".join("x" * rng.randint(1, 12) for _ in range(rng.randint(0, 200)))
        cut = chunking.windows(text, 80, 15, 20)
        assert all(0 <= a < b <= len(text) and b - a <= 80 for a, b in cut)
        assert all(a == 0 or text[a - 1] == " " for a, _ in cut) and all(b == len(text) or text[b] == " " for _, b in cut)
        covered = set().union(*(range(a, b) for a, b in cut)) if cut else set()
        assert all(i in covered for i, c in enumerate(text) if c != " ")


def test_structure_chunks(spark):
    rows = [(1, 0, "heading", "Title", 1), (1, 1, "heading", "Fees", 2), (1, 2, "paragraph", "p " * 150, None), (1, 3, "table", "a | b\n" + "\n".join(f"{i} | {'v' * 40}" for i in range(120)), None), (1, 4, "heading", "End", 2), (1, 5, "paragraph", "bye", None)]
    blocks = chunking.section_paths(spark.createDataFrame([(d, p, t, x.strip(), lv) for d, p, t, x, lv in rows], "doc_id long, pos int, type string, text string, level int"))
    paths = {r.pos: r.section_path for r in blocks.collect()}
    assert paths[2] == ["Title", "Fees"] and paths[4] == ["Title"]
    out = chunking.structure_chunks(blocks).orderBy("chunk_index").collect()
    tables = [r for r in out if "a | b" in r.text]
    assert len(tables) > 1 and all(len(r.text) - r.prefix_chars <= 2000 + 60 for r in tables) and out[-1].text.endswith("bye")
    assert sum(r.text.count("v" * 40) for r in tables) == 120


def test_running_lines(spark):
    lines = [(1, p, i, x) for p in (1, 2, 3) for i, x in enumerate(["Bank", *["xyz"[p - 1] + f" body {k}" for k in "abcdefgh"], f"Page {p} of 3"])]
    d = spark.createDataFrame(lines, "doc_id long, page int, line_no int, line string")
    assert {r.key for r in cleaning.running_lines(d).collect()} == {"bank", "page # of #"}
    assert cleaning.remove_running_lines(d).count() == 24
    assert cleaning.running_lines(d.where("page = 1")).count() == 0


def test_email(spark):
    d = spark.createDataFrame([(1, 0, "paragraph", "> Hello\n> \n> there\nFrom: x@y"), (1, 1, "paragraph", "Hello"), (1, 2, "paragraph", "CONFIDENTIALITY NOTICE: secret\nBye")], "doc_id long, pos int, type string, text string")
    assert [r.text for r in cleaning.clean_email(d).orderBy("pos").collect()] == ["Hello", "there", "Bye"]


def test_rollup_and_guard(spark):
    ts = lambda i: datetime(2025, 1, 1, 0, 0, i)
    rows = [("a", "q", ts(1), "llm", "gate", True, "hit", Decimal("0.1"), 10.0, 5, 1, None), ("b", "q", ts(2), "llm", "generate", True, "hit", Decimal("0.2"), 20.0, 5, 1, "boom"), ("c", "q", ts(3), "local_model", "retrieve", False, "miss", Decimal("9"), 5.0, 0, 0, None)]
    d = spark.createDataFrame(rows, "call_id string, correlation_id string, ts timestamp, kind string, purpose string, billable boolean, local_cache string, cost_usd decimal(18,8), latency_ms double, input_tokens long, output_tokens long, error string")
    r = calls.rollup(d).first()
    assert (float(r.cost_usd), r.llm_calls, r.local_cache_hits, r.first_call_cache, r.within_question_hits, r.errors) == (0.3, 2, 2, "hit", 1, ["boom"])
    assert [x.stopped for x in calls.budget_guard(d, 0.3, "correlation_id", ("ts",)).orderBy("ts").collect()] == [False, False, True]


def test_unknown_price_raises(spark):
    p = spark.createDataFrame([("m", 1.0, 1.0, 1.0, 1.0)], "model string, input double, cache_write double, cache_read double, output double")
    c = spark.createDataFrame([("m-20250101", 1_000_000, 0, 0, 0)], "model string, input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, output_tokens long")
    assert float(calls.priced(c, p).first().cost_usd) == 1.0
    with pytest.raises(Exception, match="no price for"):
        calls.priced(c.withColumn("model", F.lit("zz")), p).collect()


def test_figure_check(spark):
    f = spark.createDataFrame([(1, 0, "amount", "-63.48"), (1, 0, "transaction_id", "TXN-1"), (1, 1, "amount", "207.23"), (1, 1, "transaction_id", "TXN-2"), (1, 2, "balance", "99.99"), (1, 2, "account_id", "ACC-9")], "call_id int, record int, name string, value string")
    cited = spark.createDataFrame([(1, "TXN-1"), (1, "TXN-2")], "call_id int, id string")
    allowed = records.allowed_figures(records.cited_records(f, cited), "call_id")
    d = allowed.select(records.unverified(F.lit("net $143.75, out $63.48, in $207.23, no $144.75 or $99.99"), F.col("allowed")).alias("u"))
    assert [str(x) for x in d.first().u] == ["144.75", "99.99"]


def test_unknown_account_is_not_an_empty_one(spark):
    acc = spark.createDataFrame([("ACC-1",), ("ACC-2",)], "account_id string")
    t = spark.createDataFrame([("T1", "ACC-1", "2025-01-01"), ("T2", "ACC-1", "2025-01-02")], "transaction_id string, account_id string, posted_on string")
    got = records.newest(acc, t, "account_id", "posted_on", "transaction_id", 1).collect()
    assert {(r.account_id, r.transaction_id) for r in got} == {("ACC-1", "T2"), ("ACC-2", None)}
    asked = spark.createDataFrame([("ACC-1",), ("ACC-7",)], "account_id string")
    assert {r.account_id: r.outcome for r in records.lookup(asked, acc, "account_id").collect()} == {"ACC-1": "ok", "ACC-7": "not_found"}


def test_conversation(spark):
    t = spark.createDataFrame([("s", 1, "A"), ("s", 2, None), ("s", 3, "B"), ("s", 4, None)], "session_id string, turn int, account_id string")
    got = {r.turn: (r.last_reference, r.references) for r in conversation.references(t).collect()}
    assert got == {1: (None, []), 2: ("A", ["A"]), 3: ("A", ["A"]), 4: ("B", ["A", "B"])}
    steps = spark.createDataFrame([("x", i, 100, 0.0, i == 9) for i in range(1, 12)] + [("y", 1, 1, 0.0, True)], "session_id string, step int, tokens int, elapsed double, terminates boolean")
    got = {r.session_id: (r.status, r.at_step) for r in conversation.first_breach(steps, 50, 500, 60.0).collect()}
    assert got == {"x": ("terminated_budget_limit", 6), "y": ("terminated_success", 1)}


def test_round_verdicts(spark):
    d = spark.createDataFrame([("answered", ["a"], ["a", "b"]), ("answered", [], ["a"]), ("answered", ["z"], ["a"]), ("not_in_corpus", [], []), ("x", [], [])], "s string, c array<string>, k array<string>")
    assert [r[0] for r in d.select(conversation.round_verdict(F.col("s"), F.col("c"), F.col("k"))).collect()] == ["answered", "ungrounded", "ungrounded", "declined", "error"]


def test_enforcement_order_and_redaction(spark):
    made = spark.createDataFrame([("m", "read", {"id": "1"}, None), ("m", "write", {"id": "1"}, None), ("m", "gone", {}, None), ("m", "read", {"id": "1", "pin": "9"}, None), ("m", "read", {}, "not_found")], "caller string, tool string, arguments map<string,string>, run_outcome string")
    grants = spark.createDataFrame([("m", "read"), ("m", "gone")], "caller string, tool string")
    tools = spark.createDataFrame([("read", ["id"], ["id"]), ("write", ["id"], ["id"])], "tool string, declared array<string>, required array<string>")
    got = sorted((r.tool, r.outcome, r.decision, str(r.arguments)) for r in filters.enforce(made, grants, tools).collect())
    assert [g[1] for g in got] == ["invalid_arguments", "invalid_arguments", "invalid_arguments", "ok", "forbidden"]
    assert any("[REDACTED]" in g[3] and "9" not in g[3] for g in got)


def test_loaders():
    md = list(loaders.load_md(b"# T\n\npara one\npara two\n| a | b |\n|---|---|\n| 1 | 2 |\n- item\n"))
    assert [(b["type"], b["text"]) for b in md] == [("heading", "T"), ("paragraph", "para one\npara two"), ("table", "a | b\n1 | 2"), ("list_item", "- item")]
    txt = list(loaders.load_txt("﻿FEES\n\na|b\nc|d\n\n- x\n- y\n\nA sentence that ends.".encode()))
    assert [b["type"] for b in txt] == ["heading", "table", "list_item", "list_item", "paragraph"]
    html = list(loaders.load_html(b"<html><head><title>x</title><script>no</script></head><body><nav><ul><li>menu</li></ul></nav><h2>Hi</h2><p>a <b>b</b><p>c<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table></body></html>"))
    assert [(b["type"], b["text"]) for b in html] == [("list_item", "menu"), ("heading", "Hi"), ("paragraph", "a b"), ("paragraph", "c"), ("table", "1 | 2\n3 | 4")]
    assert loaders.rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}caf\'e9\par $5 \{x\}}") == "café\n$5 {x}"
    assert list(loaders.load_csv(b"")) == [] and next(iter(loaders.load_csv(b"a,b\n,\n1,2\n")))["text"] == "a | b\n1 | 2"
    assert [b["type"] for b in loaders.load_eml(b"Subject: S\nDate: today\n\nbody\n\nmore\n")] == ["heading", "paragraph", "paragraph", "paragraph"]
    assert loaders.decode_bytes(b"\xe9\x80")[1] == "cp1252"


def test_files_to_blocks_and_decisions(spark, tmp_path):
    for name, raw in {"a.md": b"# A\n\ntext", "a (1).md": b"# A\n\ntext", "e.txt": b"", "z.bin": b"\x00", "u.txt": b"uncatalogued"}.items():
        (tmp_path / name).write_bytes(raw)
    cat = spark.createDataFrame([("a.md", "d1"), ("a (1).md", "d2"), ("e.txt", "d3"), ("z.bin", "d4")], "filename string, doc_id string")
    files = loaders.load_decision(loaders.catalogued(loaders.scan(spark, str(tmp_path)), cat))
    got = {r.filename: r.status for r in files.collect()}
    assert got == {"a.md": "pending", "a (1).md": "dropped", "e.txt": "dropped", "z.bin": "pending", "u.txt": "quarantined"}
    assert {r.type for r in loaders.parse(files.where("filename = 'z.bin'")).collect()} == {"error"}


def test_stage_cache_and_fingerprint(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    key = stores.stage_key("load", "1", {"a": 1}, "")
    assert stores.cached_stage(spark, str(tmp_path), key, make).count() == 3 and stores.cached_stage(spark, str(tmp_path), key, make).count() == 3 and len(made) == 1
    assert key != stores.stage_key("load", "2", {"a": 1}, "")
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "filename string, sha256 string")
    assert stores.corpus_fingerprint(f) == stores.corpus_fingerprint(f.orderBy(F.desc("filename"))) != stores.corpus_fingerprint(f.limit(1))


def test_vector_store_revision(spark, tmp_path):
    s = stores.VectorStore(spark, str(tmp_path / "v"))
    s.add(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>"), "p", "c", "r1")
    assert s.open("p", "c", "r1").count() == 1
    with pytest.raises(ValueError):
        s.open("p", "c", "r2")


def test_stream_equals_batch(spark, tmp_path):
    from corpusloom.streaming import costs

    rows = [(i, datetime(2025, 1, 1, 0, i % 50, 0), "a" if i % 2 else "b", 1.5) for i in range(100)]
    src = spark.createDataFrame(rows, "call_id long, ts timestamp, purpose string, cost double")
    src.write.parquet(str(tmp_path / "in"))
    s = costs.windowed(costs.call_stream(spark, str(tmp_path / "in"), "call_id long, ts timestamp, purpose string, cost double", "parquet"), "purpose", "cost")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window.start, r.purpose): float(r.cost) for r in spark.table("w").collect()}
    want = {(r.window.start, r.purpose): float(r.cost) for r in costs.windowed(src, "purpose", "cost").collect()}
    assert got == want and len(got) == 10


@pytest.mark.parametrize("bound", [10_000, 0])
def test_quotes_that_touch_other_characters(spark, monkeypatch, bound):
    monkeypatch.setattr(metrics, "BROADCAST_QUOTES", bound)
    texts = ['He said "overdraft fee is waived" twice', "see (non-overdraft fee is waived, always)", "overdraft  FEE is waived", "a pre-approved loan", "(loan)", "overdraft fees", None, "", "x\nwaived\U0001f600, ok"]
    quotes = ["overdraft fee is waived", "overdraft fee", "loan", "approved", "is", "waived\U0001f600", "o", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    low = [" ".join((t or "").lower().split()) for t in texts]
    want = {(i, k) for i, quote in enumerate(quotes) if quote for k, t in enumerate(low) if quote in t}
    got = [(r.quote_id, r.doc_id) for r in metrics.quote_hits(d, q).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_call_is_priced_once(spark):
    p = spark.createDataFrame([("small", 1.0, 0.0, 0.0, 0.0), ("small-20250101", 3.0, 0.0, 0.0, 0.0)], "model string, input double, cache_write double, cache_read double, output double")
    c = spark.createDataFrame([("small-20250101", 1_000_000), ("small-20240101", 1_000_000), ("small", 1_000_000)], "model string, input_tokens long")
    c = c.withColumns({x: F.lit(0).cast("long") for x in ("cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")})
    assert sorted((r.model, float(r.cost_usd)) for r in calls.priced(c, p).collect()) == [("small", 1.0), ("small-20240101", 1.0), ("small-20250101", 3.0)]


def test_policy_without_a_status_is_found(spark):
    policies = spark.createDataFrame([("P1", None, {"fire": 5.0})], "policy_number string, status string, coverage_limits map<string,double>")
    asked = spark.createDataFrame([("P1", "fire"), ("P2", "fire")], "policy_number string, peril string")
    assert {r.policy_number: (r.found, r.limit) for r in records.policy_limit(asked, policies).collect()} == {"P1": (True, 5.0), "P2": (False, None)}


def test_unknown_match_rule_raises(spark):
    d = spark.createDataFrame([("a b", "a", "fuzzy")], "t string, q string, m string")
    with pytest.raises(Exception, match="unknown match rule"):
        d.select(tx.quote_matches(F.col("t"), F.col("q"), F.col("m"))).collect()


def test_picked_places_equal_the_sorted_list(spark):
    from corpusloom.operators import metrics

    data = {"a": [3.0, 1.0, 1.0, 2.0, None], "b": [5.0], "c": [None]}
    d = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: (r.near, r.mid) for r in metrics.picked(d, "v", {"near": metrics.nearest_place(0.5), "mid": metrics.middle_place()}, "k").collect()}
    sure = {k: sorted(v for v in vs if v is not None) for k, vs in data.items()}
    assert got == {k: (vs[round(0.5 * (len(vs) - 1))], vs[len(vs) // 2]) for k, vs in sure.items() if vs}


def test_token_hits_equal_brute_force(spark):
    from corpusloom.operators import metrics

    docs = [(1, "Terms: 24 months | 3.95% | 4.05%"), (2, "(24)months4.05%"), (3, None), (4, ""), (5, "24 4.05%"), (5, "24 months 4.05%"), (6, "x" * 100_000 + "months 24,4.05%")]
    quotes = [(1, "24 Months 4.05%"), (2, "x"), (3, ""), (4, "months")]
    got = metrics.token_hits(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "quote_id int, quote string"))
    want = {(q, d) for q, quote in quotes for d, text in docs if quote and all(w in (text or "").lower() for w in quote.lower().split())}
    assert sorted((r.quote_id, r.doc_id) for r in got.collect()) == sorted(want)
    none = metrics.token_hits(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([], "quote_id int, quote string"))
    assert none.count() == 0


def test_limits_of_newest(spark):
    import pytest

    from corpusloom.operators import records

    a = spark.createDataFrame([(1,)], "account_id int")
    t = spark.createDataFrame([(1, 1, "2024-01-01")], "account_id int, id int, day string")
    assert records.newest(a, t, "account_id", "day", "id", 50).count() == 1
    for n in (0, 51):
        with pytest.raises(ValueError):
            records.newest(a, t, "account_id", "day", "id", n)


def test_vector_top_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", (3, 4))
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(60)]
    asked = [(100 + i, v) for i, v in rows[:7]]
    vectors = spark.createDataFrame([*rows, (99, None)], "vec_id long, embedding array<double>")
    got = retrieval.vector_top(vectors, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5, most_queries=4)
    want = set()
    for q, v in asked:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows)[:5]
        want |= {(q, i, -s, at + 1) for at, (s, i) in enumerate(best)}
    assert {(r.query_id, r.vec_id, r.score, r.rank) for r in got.collect()} == want
    assert not retrieval.vector_top(vectors, vectors.limit(0).withColumnRenamed("vec_id", "query_id")).count()


def test_search_filters_before_the_cut(spark):
    docs = spark.createDataFrame([(i, f"fee schedule {'card ' * i}", i % 2 == 0) for i in range(1, 9)] + [(50, None, True), (51, "other words", True), (52, "more", False)], "doc_id long, text string, ok boolean")
    vectors = docs.select("doc_id", F.array(F.lit(1.0), F.col("doc_id") / 10.0).alias("embedding"))
    asked = spark.createDataFrame([(1, "card", [0.0, 1.0])], "query_id long, text string, embedding array<double>")
    got = [(r.doc_id, r.rank) for r in retrieval.search(docs, vectors, asked, keep=F.col("ok"), candidates=2, n=3).orderBy("rank").collect()]
    assert {d for d, _ in got} <= {2, 4, 6, 8, 50, 51} and [k for _, k in got] == [1, 2, 3]
    assert {51, 50} & {d for d, _ in got} and {6, 8} & {d for d, _ in got}


def test_observations(spark):
    tries = [("a", 1, None, "x"), ("a", 2, "r", None), ("b", 1, None, "x"), ("b", 2, None, "y"), ("b", 3, None, "z"), ("b", 4, "late", None), ("c", 1, None, None)]
    got = {r.call_id: (r.attempts, r.result, r.error) for r in conversation.observations(spark.createDataFrame(tries, "call_id string, attempt int, result string, error string")).collect()}
    assert got == {"a": (2, "r", None), "b": (3, None, "z"), "c": (1, None, None)}


def test_history_and_attempts(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 3, "user", "more"), (2, 1, "user", "x")], "session_id int, turn int, role string, text string")
    got = {(r.session_id, r.turn): r.history for r in conversation.history(turns, 2).collect()}
    assert got == {(1, 1): "", (1, 2): "user: hi", (1, 3): "user: hi\nassistant: ", (2, 1): ""}
    rounds = spark.createDataFrame([(1, 2, "b", "answered"), (1, 1, "a", "poor"), (1, 9, "c", "poor")], "correlation_id int, n int, query string, verdict string")
    assert conversation.attempts_text(rounds).first().attempts == "Round 1: a [poor]\nRound 2: b [answered]"
