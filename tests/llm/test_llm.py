"""Each training-data operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontamination, fingerprints, jaccard, language, mixing, quality, samples, secrets, sketches, toxicity, urlfilter
from corpusloom.llm import textkit as tk
from corpusloom.storage import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, blob string, entity string, spans string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(d, t, lang, src, len(t or ""), "s", "b", "e", "x") for d, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


def prose(rng, n, vocabulary="abcdefghij"):
    return " ".join("".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 7))) for _ in range(n))


EDGE = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "one", "en", "b"), (4, "one", "en", "b"), (5, "½ → 漢字", "zh", "c"), (6, "word " * 30_000, "en", "a")]


# ------------------------------------------------------------- kernels


def test_words_equal_regex():
    rng = random.Random(0)
    texts = ["", None, " a", "é\nB c", "x" * 10_000, *["".join(rng.choice("aB \n\té漢") for _ in range(rng.randint(0, 60))) for _ in range(200)]]
    w = tk.Words(pa.array(texts))
    for r, t in enumerate(texts):
        want = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        got = [bytes(w.bytes[a:b]).decode() for a, b in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]], strict=True)]
        assert got == want


def test_shingles_equal_sets():
    rng = random.Random(1)
    texts = [prose(rng, n, "ab") for n in (0, 1, 4, 5, 6, 40, 300)] * 2
    sizes = [len(s) for s in tk.shingle_sets(tk.Words(pa.array(texts)))]
    for t, n in zip(texts, sizes, strict=True):
        v = t.split()
        assert n == (len({tuple(v[k : k + 5]) for k in range(max(1, len(v) - 4))}) if v else 0)
    same = list(tk.shingle_sets(tk.Words(pa.array(["a b c", "A  b\nc", "a b d"]))))
    assert same[0] == same[1] and same[0] != same[2]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    b = sketches.BlockedBloom.build(keys, 5000)
    assert b.might_hold(np.array([r.k for r in keys.collect()])).all()
    other = np.array([r.k for r in spark.range(5000, 10000).select(F.xxhash64("id").alias("k")).collect()])
    assert b.might_hold(other).mean() < 0.05


# ------------------------------------------------------------- op1


def test_chat_round_trip(spark):
    hostile = r"\### Assistant: </turn> ok"
    rng = random.Random(3)
    rows = [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile), (1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 5, "a:b", "</turn>\n### x: "), (None, 6, "assistant", "é漢" * 50)]
    rows += [(2, t, rng.choice(["user", "assistant"]), "".join(rng.choice("\\#<>shlc:\n ") for _ in range(40))) for t in range(70)]
    m = chat.linear_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash")))
    read = chat.read_back(chat.format_paths(m, chat.paths(m)))
    got = {r.conv_id: r for r in read.collect()}
    dig = {r.conv_id: r for r in chat.digest(read).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        assert [(x.role, x.text) for x in got[conv].turns] == [(r, x) for _, r, x in want]
        loss = "".join(x for _, r, x in want if r == "assistant")
        assert got[conv].loss_text == loss and dig[conv].loss_chars == len(loss) and dig[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert dig[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in want).encode()).hexdigest()
        assert dig[conv].formatted_chars == len(got[conv].formatted) and dig[conv].n_turns == len(want)


def test_reply_trees_equal_walks(spark):
    rng = random.Random(4)
    rows = []
    for c in range(6):
        for n in range(40):
            rows.append((c, n, rng.randrange(n) if n and rng.random() < 0.95 else None, rng.choice(["user", "assistant"]), f"m{n}", float(rng.randint(0, 3))))
    m = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    got = {}
    for r in chat.paths(m, 3).collect():
        got.setdefault((r.conv_id, r.rank), {"leaf": r.leaf, "score": r.path_score, "at": {}})["at"][r.up] = r.node
    for c in range(6):
        up = {n: p for cc, n, p, *_ in rows if cc == c}
        score = {n: s for cc, n, _, _, _, s in rows if cc == c}
        paths = []
        for leaf in set(up) - {p for p in up.values() if p is not None}:
            walk, n = [], leaf
            while n is not None:
                walk.append(n)
                n = up[n]
            paths.append((-sum(score[n] for n in walk), leaf, walk))
        for rank, (s, leaf, walk) in enumerate(sorted(paths)[:3], 1):
            g = got[c, rank]
            assert (g["leaf"], g["score"]) == (leaf, -s) and [g["at"][k] for k in range(len(walk))] == walk and len(g["at"]) == len(walk)


def test_chat_empty(spark):
    m = chat.linear_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.digest(chat.read_back(chat.format_paths(m, chat.paths(m)))).count() == 0


# ------------------------------------------------------------- op2, op5, op8


def labelled_corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic, good = rng.random() < 0.2, rng.random() < 0.7
        words = prose(rng, rng.randint(30, 80)).split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "zzqua" + rng.choice("abcdef") + rng.choice("abcdef")])
        text = " ".join(words) if good else " ".join(w + rng.choice(["***", "&&&", "%%%"]) for w in words)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = labelled_corpus(random.Random(5), 600)
    d, lab = docs_of(spark, rows + [(10_000 + i, t, l, s) for i, t, l, s in EDGE]), spark.createDataFrame([*labels, (1, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(d, lab).collect()}
    truth = {i: q for i, q, _ in labels}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 60 and np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    kept = quality.keep_good(d, quality.train(d, lab))
    assert kept.schema == d.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_toxicity_held_out(spark):
    rows, labels = labelled_corpus(random.Random(6), 800)
    d, lab = docs_of(spark, rows + [(10_000 + i, t, l, s) for i, t, l, s in EDGE]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(d, lab).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 100 and np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(got[10_000 + i].predicted == 0 for i, *_ in EDGE)


def test_training_without_labels(spark):
    d, lab = docs_of(spark, EDGE), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.judged(d, lab).collect()} == {0.5}
    assert {r.predicted for r in toxicity.judged(d, lab).collect()} == {0}
    empty = d.limit(0)
    assert quality.judged(empty, lab).count() == 0 and toxicity.judged(empty, lab).count() == 0 and language.judged(empty).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows, labels = labelled_corpus(random.Random(7), 200)
    d = docs_of(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = lab.withColumn("quality", F.when(samples.remainder(5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.judged(d, x).collect()) for x in (lab, flipped))
    assert a == b


def test_language_spans_and_accuracy(spark):
    rng = random.Random(8)
    voc = {"aa": "abcde", "bb": "fghij", "cc": "бвгде"}
    rows = [(i, prose(rng, 60, voc[x]), x, "s") for i, x in enumerate(rng.choices(list(voc), k=400))]
    mixed = prose(rng, 40, voc["aa"]) + " " + prose(rng, 25, voc["bb"])
    d = docs_of(spark, [*rows, (1000, mixed, None, "s"), (1001, "12 34 !!", "aa", "s"), (1002, None, "aa", "s"), (1003, "→ ½", "aa", "s")])
    got = {r.doc_id: r for r in language.judged(d).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x, _ in rows if got[i].held_out]) > 0.98
    assert got[1000].lang_pred == "aa" and got[1000].spans == "aa:0:39,bb:40:64" and abs(got[1000].score - 40 / 65) < 1e-6
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3


def test_viterbi_equals_every_path():
    rng = np.random.default_rng(9)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        s = rng.normal(size=(n, 3)) * 3
        best = max(np.ndindex(*(3,) * n), key=lambda p: sum(s[i, c] for i, c in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(language.viterbi([s], 2.0)[0]) == best
        w = tk.Words(pa.array(["a " * n, "b"]))
        both = np.concatenate([s, np.zeros((1, 3))])
        assert tuple(language.label_words(w, both, 2.0)[:n]) == best


# ------------------------------------------------------------- op3


def brute_secrets(text):
    out = []
    for k, (rx, least, group) in enumerate(((r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), (r"AKIA[A-Z0-9]+", 16, 0), (r"[0-9a-f]+", 32, 0))):
        out += [(m.start(), k, m.end()) for m in re.finditer(rx, text) if len(m[group]) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(10)
    bits = ["password=", 'TOKEN = "', "api_key: ", "apikey:'", "secret", "AKIA", "ABCDEF1234567890", "0123456789abcdef" * 2, "abcdef", " ", "\n", "é", "x", "ſecret=abcdefgh", "=", "12345678"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), "en", "s") for i in range(300)] + [(1000 + i, t, l, s) for i, t, l, s in EDGE]
    rows += [(2000 + i, "token=abcdefgh12", "en", "s") for i in range(50)]
    d = docs_of(spark, rows)
    led = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    secrets.scan_new(d, led)
    got = sorted((r.doc_id, r.base_spans) for r in secrets.join_findings(secrets.address(d.select("doc_id", "text")), led).collect())
    assert got == sorted((i, brute_secrets(t or "")) for i, t, _, _ in rows)


def test_ledger_scans_only_unseen(spark):
    led = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    a, b = docs_of(spark, [(1, "token=abcdefgh1", "en", "s")]), docs_of(spark, [(2, "token=abcdefgh1", "en", "s"), (3, "new", "en", "s")])
    secrets.scan_new(a, led)
    secrets.scan_new(b, led)
    assert spark.read.schema(secrets.FINDINGS).parquet(led).count() == 2
    secrets.scan_new(b, led, "next")
    assert spark.read.schema(secrets.FINDINGS).parquet(led).count() == 4
    assert {r.doc_id: r.n_assign for r in secrets.join_findings(secrets.address(b), led).collect()} == {2: 1, 3: 0}


def test_redaction(spark):
    d = docs_of(spark, [(1, "é token=abcdefgh1 end", "en", "s"), (2, None, "en", "s"), (3, "clean", "en", "s")])
    out = secrets.redacted(d, f"{shared_dir(spark)}/t-{uuid.uuid4().hex}")
    assert out.schema == d.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "é [assign] end" and got[1].n_chars == len(got[1].text) and got[2].text is None and got[3].text == "clean" and got[3].blob == "b"


# ------------------------------------------------------------- op4


def test_decontamination(spark):
    rng = random.Random(11)
    q = "A train leaves Oslo at 60 km per hour and reaches Bergen after 7 hours, so how far does it travel from Oslo to Bergen in that time"
    changed = q.replace("60", "85").replace("Oslo", "Rome").replace("Bergen", "Milan").replace("7 hours", "4 hours")
    broken = q.replace("Oslo at", "Rome at").replace("60", "85")
    items = spark.createDataFrame([(1, q), (2, prose(rng, 40)), (3, "tiny unusual phrase"), (4, None), (5, "")], "item_id long, text string")
    rows = [(1, prose(rng, 50) + " " + q + " " + prose(rng, 50), "en", "s"), (2, prose(rng, 30) + " " + changed, "en", "s"), (3, broken, "en", "s"), (4, "so a tiny unusual phrase is here", "en", "s"), (5, prose(rng, 300), "en", "s"), (6, q + " " + q, "en", "s"), (6, q + " " + q, "en", "s"), (7, None, "en", "s"), (8, "", "en", "s")]
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(docs_of(spark, rows), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 3), (6, 1)}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed > 0
    assert decontamination.find_leaks(docs_of(spark, rows), items.limit(0)).count() == 0
    assert decontamination.find_leaks(docs_of(spark, []), items).count() == 0


def test_decontamination_of_windows_without_plain_tokens(spark):
    rng = random.Random(12)
    names = "Anna Berg Carl Dahl Emil Falk Greta Holm Ida Jung Karl Lund Mona Nord"
    mixed = "Add 12 and 7 to 30 and 45 and 61 and 18 and 22 then tell us what the sum of all of these numbers would be"
    items = spark.createDataFrame([(1, "What is 12 + 34 * 56?"), (2, names), (3, "1914 1918 1939 1945 1949 1961 1989 1990 1991"), (4, mixed)], "item_id long, text string")
    rows = [
        (1, prose(rng, 20) + " What is 12 + 34 * 56? " + prose(rng, 20), "en", "s"),
        (2, "What is 13 + 34 * 56? " + prose(rng, 20), "en", "s"),
        (3, prose(rng, 5) + " " + names + " " + prose(rng, 5), "en", "s"),
        (4, names.replace("a", "e").replace("e", "i"), "en", "s"),
        (5, "see 1914 1918 1939 1945 1949 1961 1989 1990 1991", "en", "s"),
        (6, mixed.replace("12", "13").replace("45", "46").replace("22", "23"), "en", "s"),
        (7, " ".join(mixed.split()[:17]), "en", "s"),
    ]
    got = {(r.doc_id, r.item_id): (r.matched, r.n_windows) for r in decontamination.find_leaks(docs_of(spark, rows), items).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3), (6, 4), (7, 4)}
    assert got[1, 1] == (1, 1) and got[3, 2] == (7, 7) and got[5, 3] == (2, 2)


def test_decontamination_of_slots_and_places(spark):
    rng = random.Random(13)
    said = [prose(rng, 14) for _ in range(4)]
    item = f"The {said[0]} 3 {said[1]} 5 {said[2]} The {said[3]}"
    merged = item.replace("3", "4").replace("5", "4")
    words = item.split()
    parts = [" ".join(words[k : k + 12]) for k in (1, 17, 32, 48)]
    scattered = "".join(p + " " + prose(rng, 120) + " " for p in parts)
    longer = " ".join(words[:30] + ["extra", "words"] + words[30:])
    once = prose(rng, 3) + " " + item.replace("The " + said[3], "A " + said[3])
    rows = [(1, once, "en", "s"), (2, merged, "en", "s"), (3, " ".join(words[:20] + words[40:]), "en", "s"), (4, longer, "en", "s"), (5, scattered, "en", "s"), (6, merged + " " + prose(rng, 40) + " " + item, "en", "s")]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_leaks(docs_of(spark, rows), items, 0.3).collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert (got[2].n_slots, got[2].n_changed) == (4, 2) and got[4].n_changed == 0 and got[6].n_changed == 0


# ------------------------------------------------------------- op6


def brute_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(ids[x]), find(ids[y]))] = min(find(ids[x]), find(ids[y]))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [12, 13])
def test_jaccard_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    header = prose(rng, 14)
    for _ in range(12):
        base = prose(rng, rng.choice([3, 8, 60, 120])).split()
        for _ in range(rng.choice([1, 2, 8, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((n, (header + " " if rng.random() < 0.5 else "") + " ".join(w), "en", "s"))
            n += 1
    rows += [(10_000 + i, t, l, s) for i, t, l, s in EDGE]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.judged(docs_of(spark, rows)).collect()}
    assert got == brute_classes(rows)
    kept = jaccard.keep_one(docs_of(spark, rows))
    assert kept.schema == docs_of(spark, rows).schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if c == i)


def test_jaccard_empty_and_all_alike(spark):
    assert jaccard.judged(docs_of(spark, [])).count() == 0
    same = [(i, "the very same words in every text here", "en", "s") for i in range(200)]
    assert {r.component_id for r in jaccard.judged(docs_of(spark, same)).collect()} == {0}


# ------------------------------------------------------------- op7


def test_url_rules(spark):
    urls = ["http://a.org/x", "HTTP://EXAMPLE.ORG/es/1?q", "http://example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/a#t", "http://x.com/de/", "http://y.net", "nothing", None, "http://www.spam-farm.example.com/fr/1", "http://spam-farm.example.net/z.html", "http://org/"]
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(d, urlfilter.listing(d)).collect()}
    assert [got[i] for i in range(len(urls))] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/fr/", "allow"), (None, "block"), ("org/", "allow")]
    assert urlfilter.judge(d.limit(0), urlfilter.listing(d.limit(0))).count() == 0


# ------------------------------------------------------------- op9


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(14)
    rows = [(i * 3, "\n".join(prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(0, 6))), "en", "s") for i in range(80)]
    rows += [(500 + i, t, l, s) for i, t, l, s in EDGE]
    out = fingerprints.with_edits(docs_of(spark, rows), 5).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    fp = lambda t: fingerprints.encode(*fingerprints.vectors(pa.array([t])))[0]
    want = []
    for k, (i, t, *_) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), fp(a), fp(e)))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in out) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_fingerprint_is_homomorphic():
    a, b = "one two three\nfour five six\n\nseven", "eight nine ten\neleven"
    fp = lambda t: fingerprints.encode(*fingerprints.vectors(pa.array([t])))[0]
    assert fp(a) == fp("seven\nfour five six\none two three") != fp(b)
    assert fingerprints.combine(fp(a), fp(b)) == fp(a + "\n" + b) and fingerprints.combine(fp(a + "\n" + b), fp(b), -1) == fp(a)
    assert fp("") == "0" * len(fp(a))


def test_likeness_of_long_repetitive_texts():
    _, like = fingerprints.vectors(pa.array(["a b c\n" * 40_000, "a b c\n" * 20_000, "one " * 40_000]))
    assert np.abs(like).max(1).tolist() == [40_000, 20_000, 39_998]
    assert fingerprints.likeness(like[:1], like[1:2])[0] == 1
    one, other = fingerprints.encode(*fingerprints.vectors(pa.array(["a b c\n" * 30_000, "a b c\n" * 10_000])))
    assert np.abs(fingerprints.decode(fingerprints.combine(one, other))[1]).max() == 40_000


def test_fingerprints_of_few(spark):
    assert fingerprints.with_edits(docs_of(spark, [])).count() == 0
    r = fingerprints.with_edits(docs_of(spark, [(7, "abcdef", "en", "s")])).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r[0].near_next == 1.0


# ------------------------------------------------------------- op10


def brute_targets(sizes, weights=(5.0, 2.0, 1.0)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 3 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randint(0, 30)), "en", rng.choice(["a", "b", "c", "d", None, "e"]) if rng.random() > 0.5 else "b") for i in range(400)] + [(900 + i, t, l, s) for i, t, l, s in EDGE]
    d = docs_of(spark, rows)
    out = mixing.mix(d).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(sizes)
    for s, n in sizes.items():
        mine = [r for r in out if r.source == s]
        assert {r.source_size for r in mine} == {n} and abs(mine[0].target - target[s]) < 1e-6
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1 and all(r.taken <= 3 * r.size for r in mine)
    assert len(out) == len(rows) and [r.position for r in out] == sorted(r.position for r in out) and all(0 <= p <= 1 for r in out for p in r.positions)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(d.repartition(7)).collect()))
    assert mixing.mix(d.limit(0)).count() == 0


def test_schedule_inverse():
    def area(knots, t, n=20_000):
        x = (np.arange(n) + 0.5) / n * t
        return np.interp(x, np.linspace(0, 1, len(knots)), knots).mean() * t

    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    d = s.createDataFrame([(k / 20,) for k in range(21)], "u double")
    for knots in mixing.SCHEDULES:
        for u, t in d.select("u", mixing._inverse(knots, F.col("u"))).collect():
            assert abs(area(knots, t) / area(knots, 1.0) - u) < 1e-4 if t else u == 0


# ------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rows, labels = labelled_corpus(random.Random(16), 300)
    rows = [(i, t, "en", f"s{i % 4}") for i, t, _, _ in rows]
    item = prose(random.Random(17), 30)
    rows += [(1000, rows[0][1], "en", "s0"), (1001, rows[1][1] + " " + item, "en", "s1"), (1002, rows[2][1] + " token=abcdefgh12", "en", "s2")]
    d = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"st{k}"))
        docs = spark.read.parquet(str(tmp_path / f"st{k}"))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == d.columns
    good = {i for i, q, _ in labels if q}
    assert len(seen[0] & good) > 0.97 * len(good) and len(seen[0] - good - {1000, 1001, 1002}) < 10
    classes = {i: c for i, (_, c) in brute_classes([r for r in rows if r[0] in seen[0]]).items()}
    assert seen[1] == {i for i, c in classes.items() if i == c}
    assert seen[2] == seen[1] - {1001} and seen[3] == seen[2] == seen[4]
    assert "abcdefgh12" not in "".join(r.text for r in spark.read.parquet(str(tmp_path / "st3")).collect())
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == seen[4]
