"""Hard cases of the training-data operators, each against a brute-force version or a stated result."""

import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import EDGE, brute_classes, brute_secrets, docs_of, prose

from corpusloom.llm import chat, decontamination, jaccard, language, mixing, quality, secrets, toxicity, urlfilter
from corpusloom.llm import textkit as tk
from corpusloom.storage import shared_dir


def test_long_words_with_exchanged_halves_differ():
    a, b = "x" * 4096, "y" * 4096
    h = tk.Words(pa.array([f"{a}{b} {b}{a} {a}{b}"])).hashes()
    assert h[0] == h[2] != h[1]


# ------------------------------------------------------------- op1


def test_chat_cycles_and_repeated_nodes(spark):
    rows = [(1, n, n - 1 if n else None, "user", f"m{n}", 1.0) for n in range(4)]
    rows += [(1, 2, 1, "user", "m2", 1.0), (1, 3, 2, "user", "m3", 1.0), (1, 3, 2, "user", "m3", 1.0)]  # repeated nodes
    rows += [(2, 0, 1, "user", "a", 0.0), (2, 1, 0, "user", "b", 0.0), (2, 2, 1, "user", "c", 0.0)]  # a cycle and a leaf below it
    rows += [(3, 0, None, "user", "r", 0.0), (3, 1, 9, "user", "s", 5.0)]  # a missing parent is a root
    rows += [(-(2**63), 0, None, "user", "least", 0.0), (None, 0, None, "assistant", "x" * 200_000, 0.0), (4, None, None, "user", "no node", 0.0)]
    m = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    read = {r.conv_id: [x.text for x in r.turns] for r in chat.read_back(chat.format_paths(m, chat.paths(m))).collect()}
    assert read == {1: ["m0", "m1", "m2", "m3"], 3: ["s"], -(2**63): ["least"], None: ["x" * 200_000]}


# ------------------------------------------------------------- op2


def plain_em(v, start, rounds):
    q, known = [0.0 if np.isnan(x) else x for x in start], [not np.isnan(x) for x in start]
    rates, n, m = None, len(v), len(v[0])
    for _ in range(rounds):
        rates = []
        for c in (0, 1):
            w = [(q[i] if c else 1 - q[i]) if known[i] else 0.0 for i in range(n)]
            rates.append([min(max((sum(w[i] * v[i][j] for i in range(n)) + 0.1) / (sum(w) + 1.0), 1e-5), 1 - 1e-5) for j in range(m)])
        prior = min(max(sum(q[i] for i in range(n) if known[i]) / sum(known), 1e-3), 1 - 1e-3)
        out = []
        for i in range(n):
            like = [1 - prior, prior]
            for c in (0, 1):
                for j in range(m):
                    like[c] *= rates[c][j] if v[i][j] else 1 - rates[c][j]
            out.append(like[1] / (like[0] + like[1]))
        q, known = out, [True] * n
    return q, rates


def test_label_model_equals_plain_em():
    rng = np.random.default_rng(20)
    truth = rng.random(60) < 0.4
    v = np.where(truth[:, None], rng.random((60, 5)) < 0.7, rng.random((60, 5)) < 0.1).astype(float)
    start = np.where(rng.random(60) < 0.5, np.where(truth, 0.95, 0.05), np.nan)
    # one round before correlations are measured: no damping
    q, rates, corr = toxicity.label_model(v, start, 1)
    want_q, want_rates = plain_em(v.tolist(), start.tolist(), 1)
    assert np.allclose(rates, want_rates)
    q, rates, corr = toxicity.label_model(np.delete(v, 4, 1), start, 9)
    if (np.abs(corr - np.diag(np.diag(corr))) <= 0.2).all():
        want_q, want_rates = plain_em(np.delete(v, 4, 1).tolist(), start.tolist(), 9)
        assert np.allclose(q, want_q, atol=1e-9) and np.allclose(rates, want_rates)
    assert corr.shape == (4, 4) and np.mean((q > 0.5) == truth) > 0.85


def test_correlated_voters_are_found():
    rng = np.random.default_rng(21)
    truth = rng.random(500) < 0.5
    one = np.where(truth, rng.random(500) < 0.7, rng.random(500) < 0.3)
    v = np.stack([one, one, one, np.where(truth, rng.random(500) < 0.7, rng.random(500) < 0.3)], axis=1).astype(float)
    corr = toxicity.label_model(v, np.where(truth, 0.95, 0.05))[2]
    assert corr[0, 1] > 0.9 and abs(corr[0, 3]) < 0.4


# ------------------------------------------------------------- op3


def test_ledger_rows_that_repeat_count_once(spark):
    led = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    d = docs_of(spark, [(1, "token=abcdefgh1 -----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9, "en", "s"), (2, "x " * 90_000 + "password=longenough", "en", "s")])
    secrets.scan_new(d, led)
    spark.read.schema(secrets.FINDINGS).parquet(led).write.mode("append").parquet(led + "-copy")
    spark.read.schema(secrets.FINDINGS).parquet(led).write.mode("append").parquet(led + "-copy")
    got = {r.doc_id: r for r in secrets.join_findings(secrets.address(d), led + "-copy").collect()}
    assert len(got) == 2 and secrets.join_findings(secrets.address(d), led + "-copy").count() == 2
    assert [x.split(":")[0] for x in got[1].spans.split(",")] == ["assign", "pem", "bearer"] and got[1].base_spans == brute_secrets("token=abcdefgh1")
    assert got[2].base_spans == "assign:180000:180019"


def test_redaction_without_a_length_column(spark):
    d = spark.createDataFrame([(1, "a token=abcdefgh1 b"), (2, "c")], "doc_id long, text string")
    out = secrets.redacted(d, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    assert {r.doc_id: r.text for r in out.collect()} == {1: "a [assign] b", 2: "c"} and out.schema == d.schema


# ------------------------------------------------------------- op4


def test_inserted_words_do_not_hide_inconsistent_slots(spark):
    rng = random.Random(22)
    said = [prose(rng, 16) for _ in range(4)]
    item = f"{said[0]} Oslo {said[1]} 60 {said[2]} Oslo {said[3]}"
    half = item.split()
    cut = len(said[0].split()) + 1 + len(said[1].split()) // 2
    same = half[:cut] + ["two", "words"] + half[cut:]
    mixed = list(same)
    mixed[len(said[0].split())] = "Rome"
    whole = [("Rome" if w == "Oslo" else w) for w in same]
    rows = [(1, " ".join(same), "en", "s"), (2, " ".join(mixed), "en", "s"), (3, " ".join(whole), "en", "s"), (4, "x " * 90_000 + item, "en", "s"), (4, "x " * 90_000 + item, "en", "s")]
    items = spark.createDataFrame([(1, item, "n")], "item_id long, text string, doc_id string")
    got = {r.doc_id: r for r in decontamination.find_leaks(docs_of(spark, rows), items, verbatim=2.0).collect()}
    assert set(got) == {1, 3, 4} and got[3].n_changed > 0 and got[4].n_changed == 0


# ------------------------------------------------------------- op5


def test_features_do_not_depend_on_neighbours():
    texts = ["\n\n\n\n", "hello world", "", None, " \t ", "a\na\na\n", "X" * 9000, "é" * 50, "a b " * 30_000]
    together = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(quality.features(pa.array([t], pa.string())), together[k])
    far = quality.features(pa.array(["x" * 4096 + "y" * 4096 + "\n" + "y" * 4096 + "x" * 4096]))
    assert far[0, quality.FEATURES.index("lines_repeated")] == 0


def test_additive_scores_equal_table_lookups():
    rng = np.random.default_rng(23)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x, y)
    assert (1, 0) in m.pairs and np.mean((m.score(x) >= quality.THRESHOLD) == y) > 0.9
    for r in range(20):
        total = m.base + sum(t[sum(e <= x[r, f] for e in m.edges[f])] for f, t in enumerate(m.tables))
        for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
            total += t[sum(e <= x[r, a] for e in m.pair_edges[a]), sum(e <= x[r, b] for e in m.pair_edges[b])]
        assert abs(total - m.margin(x[r : r + 1])[0]) < 1e-9


def test_pair_tree_cuts_equal_every_cut():
    rng = np.random.default_rng(24)
    g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
    gain = lambda G, H: G**2 / (H + 1)
    best = max(gain(g[:c].sum(), h[:c].sum()) + gain(g[c:].sum(), h[c:].sum()) for c in range(1, 4))
    best = max([best, *(gain(g[:, :c].sum(), h[:, :c].sum()) + gain(g[:, c:].sum(), h[:, c:].sum()) for c in range(1, 5))])
    assert abs(quality._cut(g, h)[0] - (best - gain(g.sum(), h.sum()))) < 1e-9


def test_scores_with_clashing_columns(spark):
    d = docs_of(spark, EDGE)
    out = quality.score(d, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))
    assert out.schema["score"].dataType.typeName() == "double" and {r.score for r in out.collect()} == {0.5}


# ------------------------------------------------------------- op6


@pytest.mark.parametrize("seed", [30, 31])
def test_jaccard_recursion_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "PIVOT_SHINGLES", 400)
    rng = random.Random(seed)
    rows, n = [], 0
    for size in (60, 90):
        base = prose(rng, size).split()
        for _ in range(70):  # near copies, and copies too far from all others
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((n, " ".join(w), "en", "s"))
            n += 1
    rows += [(10_000 + i, t, l, s) for i, t, l, s in EDGE]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.judged(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_jaccard_repeated_and_null_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    d = spark.createDataFrame([(1, a, 5), (1, a, 5), (2, a, 6), (None, b, 7), (None, b, 8), (3, b, 9)], "doc_id long, text string, entity long")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.judged(d).collect()), key=repr)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 3), (None, 3), (3, 3)], key=repr)


# ------------------------------------------------------------- op7


def test_mirrors_equal_brute_force(spark):
    rng = random.Random(25)
    urls = [f"http://{rng.choice(['www.', 'm.', '', 'x.'])}{rng.choice('abc')}.net/{rng.choice('pq')}{rng.randrange(6)}{rng.choice(['', '/', '.html', '?u=1'])}" for _ in range(150)] + ["http://a.net/" + "z" * 100_000, None, "none"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    hosts = {}
    for u in urls:
        if u and "://" in u:
            host, path = re.match(r"[^:]+://([^/?#]*)([^?#]*)", u).groups()
            hosts.setdefault(re.sub(r"^(www|m|blog)\.", "", host) + re.sub(r"/+$", "", re.sub(r"(/index)?\.html?$", "", path)), set()).add(host)
    assert {r.canonical for r in urlfilter.mirrored(d).collect()} == {c for c, h in hosts.items() if len(h) > 1}
    got = urlfilter.judge(d, urlfilter.mirrored(d)).collect()
    assert len(got) == len(urls) and any(r.verdict == "block" for r in got)
    for r in got:
        if r.host:
            host, path = re.match(r"[^:]+://([^/?#]*)([^?#]*)", urls[r.page_id]).groups()
            bare = re.sub(r"^(www|m|blog)\.", "", host) + re.sub(r"/+$", "", re.sub(r"(/index)?\.html?$", "", path))
            assert (r.verdict == "block") == (len(hosts[bare]) > 1)


# ------------------------------------------------------------- op8


def test_paths_that_never_use_the_best_single_label():
    s = np.zeros((20, 3))
    s[:10], s[10:] = [0, -6, -1], [-6, 0, -1]
    w = tk.Words(pa.array(["a " * 20]))
    assert language.label_words(w, s, 12.0).tolist() == [0] * 10 + [1] * 10
    rng = np.random.default_rng(26)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        s = np.repeat(-rng.integers(0, 7, size=(n, 3)).astype(float) + rng.random((n, 3)) * 1e-3, 2, axis=0)
        w = tk.Words(pa.array(["a " * 2 * n]))
        value = lambda p, s=s: s[np.arange(len(p)), p].sum() - 4.0 * np.sum(p[1:] != p[:-1])
        assert abs(value(language.label_words(w, s, 4.0)) - value(language.viterbi([s], 4.0)[0])) < 1e-9


def test_language_counts_equal_plain_counts(spark):
    rows = [(i, t, x, "s") for i, (t, x) in enumerate([("ab cd", "p"), ("cd ef ab", "q"), ("ab", "p"), ("zz", None)] * 12)]
    m = language.train(docs_of(spark, rows))
    held = {r[0] for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0}
    counts = {}
    for i, t, x, _ in rows:
        if i not in held and x:
            for w in t.split():
                counts[x, w] = counts.get((x, w), 0) + 1
    assert m.languages == ["p", "q"]
    for (x, w), n in counts.items():
        cell = int(tk.Words(pa.array([w]), inside=tk.IN_LETTERS).hashes()[0] & np.uint64(language.CELLS - 1))
        total = sum(c for (y, _), c in counts.items() if y == x)
        assert abs(m.table[m.languages.index(x), 0, cell] - np.log((n + 0.05) / (total + 0.05 * language.CELLS))) < 1e-4


# ------------------------------------------------------------- op10


def test_mix_carries_texts(spark):
    rows = [(i, f"w{i} " * (i % 5), "en", f"s{i % 3}") for i in range(60)] + [(100 + i, t, l, s) for i, t, l, s in EDGE]
    d = docs_of(spark, rows)
    plain, full = mixing.mix(d).collect(), mixing.mix(d, carry=True).collect()
    key = lambda r: (r.doc_id, r.size, r.taken, r.position)
    assert sorted(map(key, plain)) == sorted(map(key, full)) and [r.position for r in full] == sorted(r.position for r in full)
    assert sorted((r.doc_id, r.text or "") for r in full) == sorted((i, t or "") for i, t, *_ in rows)


# ------------------------------------------------------------- op6: dense cells


def _compared(monkeypatch):
    """Counts members x pivots that meet by texts, group by group, through a table of what ``meet`` was asked."""
    seen = []
    meet = jaccard.meet

    def counted(members, pivots, texts):
        per = members.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).join(pivots.groupBy("cell").agg(F.count(F.lit(1)).alias("p")), "cell")
        seen.append(per.agg(F.coalesce(F.sum(F.col("m") * F.col("p")), F.lit(0))).first()[0])
        return meet(members, pivots, texts)

    monkeypatch.setattr(jaccard, "meet", counted)
    return seen


def _pages(n, common, own, rng):
    template = [f"t{k}" for k in range(common)]
    return [(k, " ".join([*template, *(f"u{rng.randrange(10**9)}" for _ in range(own))]), "en", "s") for k in range(n)]


def test_jaccard_template_pages_do_not_all_meet(spark, monkeypatch):
    """3,000 pages at a distance of 0.4 from each other, at production constants."""
    seen = _compared(monkeypatch)
    rows = _pages(3000, 300, 100, random.Random(3))
    got = jaccard.judged(docs_of(spark, rows)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 3000
    assert sum(seen) < 3000 * 2999 / 2 / 10


def test_jaccard_dense_cells_divide_or_go_on(spark, monkeypatch):
    """Cells with more members than seats: groups of near pages at many distances, small constants, exact classes."""
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    monkeypatch.setattr(jaccard, "PIVOT_SHINGLES", 1)
    monkeypatch.setattr(jaccard, "DIVIDING", 4)
    monkeypatch.setattr(jaccard, "GROUP", 8)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(140):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            w[rng.randrange(60)] = f"x{rng.randrange(12)}"
        if k % 4 == 0:
            w = w[: rng.choice([46, 50, 55])]
        rows.append((k, " ".join(w), "en", "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.judged(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_jaccard_survives_a_round_without_a_pivot(spark, monkeypatch):
    """Cells that draw no pivot for some turns go on unchanged and end with exact classes."""
    draw, turns = jaccard._elect, []

    def none_at_first(cells, turn):
        turns.append(turn)
        out = draw(cells, turn)
        return out if turn > 1 else out.withColumn("pivot", F.lit(False)).withColumn("more", F.lit(True)).withColumn("divide", F.lit(turn == 0))

    monkeypatch.setattr(jaccard, "_elect", none_at_first)
    rng = random.Random(12)
    rows = []
    for k in range(40):
        w = [f"b{j}" for j in range(60)]
        for _ in range(k % 6):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w), "en", "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.judged(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows) and len(turns) > 2


# ------------------------------------------------------------- op4: rows without an id; op10: names used on the way


def test_leaks_of_documents_without_an_id(spark):
    item = "the quick brown fox jumps over the lazy dog while seven 12 small cats watch it quietly"
    items = spark.createDataFrame([(5, item), (6, "another question that nobody holds anywhere in these few texts")], "item_id long, text string")
    clean, other = "nothing of the sort is said here, nor was it ever said in any other place", "more of nothing " * 9
    rows = [(1, f"x {item} y"), (None, f"a b {item} c"), (None, f"a b {item} c"), (None, f"{item} again"), (None, clean), (None, None), (2, other)]
    d = spark.createDataFrame([(i, t, "de", "s", 1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, leaking_text string")
    got = [(r.doc_id, r.item_id) for r in decontamination.find_leaks(d, items).collect()]
    assert sorted(got, key=repr) == sorted([(1, 5), (None, 5), (None, 5)], key=repr)
    left = decontamination.without_leaks(d, items)
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(None, clean), (None, None), (2, other)], key=repr)


def test_mix_carries_columns_named_like_its_own_scratch(spark):
    names = ["bucket", "unit", "before", "ordinal", "n_docs", "bucket_before", "d_source", "Taken", "text", "_carried_0"]
    d = spark.createDataFrame([(k, "s", *[f"{n}{k}" for n in names]) for k in range(20)], ", ".join(["doc_id long", "source string", *[f"{n} string" for n in names]]))
    out = mixing.mix(d, carry=True)
    kept = [n for n in names if n != "Taken"]
    assert [c for c in out.columns if c in names] == kept
    assert all(getattr(r, n) == f"{n}{r.doc_id}" for r in out.collect() for n in kept)
