"""Operators 11 to 13 against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import negatives, notices, ranking

CLASH = "doc_id long, text string, item_id long, score long, n long, terms string, rank int, item long, part int, row int"
EDGE = [(1, None), (2, ""), (3, " \n\t-"), (4, "one"), (4, "one"), (None, "one two"), (5, "½ → 漢字 ONE"), (6, "two " * 30_000)]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, 9, 9, 9, "x", 9, 9, 9, 9) for d, t in rows], CLASH)


# ------------------------------------------------------------- op11

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top=50):
    toks = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(x) for _, x in toks), sum(len(x) for _, x in toks)
    df = Counter(t for _, x in toks for t in set(x))
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for item, want in asked.items():
        found = []
        for row, (d, x) in enumerate(toks):
            tf, score = Counter(x), 0
            for t in want & set(x):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * len(x) * n_docs) // total
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                found.append((-score, d is None, d, row))
        out |= {(item, k + 1, d, -s) for k, (s, _, d, _) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:top])}
    return out


def test_ranking_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé9") for _ in range(rng.randint(1, 3))) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(words).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.randint(1, 60))) for k in range(300)] + EDGE
    docs += [(k, docs[7][1]) for k in range(400, 470)]  # ties beyond the cut
    items = [(k, text(rng.randint(1, 12))) for k in range(30)] + [(30, docs[7][1]), (3, "one two"), (31, None), (32, "-"), (None, "one"), (33, "漢字 nowhere")]
    given_items = spark.createDataFrame([(i, t, 1, 1, "x") for i, t in items], "item_id long, text string, item long, rank int, doc_id string")
    want = ranked(docs, items)
    for most in (ranking.ITEMS, 7):
        got = [tuple(r) for r in ranking.search(docs_of(spark, docs), given_items, most_items=most).collect()]
        assert len(got) == len(want) and set(got) == want


def test_ranking_of_empty_tables(spark):
    none, some = docs_of(spark, []), docs_of(spark, EDGE)
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranking.search(none, items).count() == 0
    assert ranking.search(some, items.limit(0)).count() == 0
    assert ranking.search(docs_of(spark, EDGE[:3]), items).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 11), max_size=9), min_size=1, max_size=9), st.sampled_from([0, 20, 10**6]))
def test_sharing_dag_sums_each_term_once(items, most):
    dag = ranking.Sharing.mine([sorted(x) for x in items], 12, most)
    weights = 3 ** np.arange(12)
    got = dag.scores(np.zeros(12, np.int64), np.arange(12), weights, 1)[:, 0]
    assert got.tolist() == [sum(3**t for t in x) for x in items]


def test_sharing_saves_additions():
    items = [[1, 2, 3, 4, 5, 10 + k] for k in range(6)] + [[1, 2, 3, 20], [4, 5, 21]]
    dag = ranking.Sharing.mine(items, 22)
    assert dag.additions() < sum(map(len, items)) / 2 and dag.pairs


# ------------------------------------------------------------- op12

VECTORS = "vec_id long, embedding array<float>, label int, score double, part int, block string"


def mined(rows):
    sound = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    anchors = {}
    for i, label, v in sound:
        if i % 100 == 0 and (i not in anchors or (label, v) < anchors[i]):
            anchors[i] = (label, v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (own, v) in anchors.items():
        scored = [(-dot(v, w), i, label) for i, label, w in sound]
        positives = sorted(x for x in scored if x[2] == own and x[1] != a)[:5]
        others = sorted(x for x in scored if x[2] != own)
        for p, pid, _ in positives:
            fit = [x for x in others if -80 * p <= -100 * x[0] <= -100 * p][:5]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fit)]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1.0, 1, "x") for i, v, label in rows], VECTORS)


@pytest.mark.parametrize("block", [256, 6])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "PART", 300)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8))
    rows = []
    for k in range(0, 6000, 4):
        c = int(rng.integers(4))
        v = centres[c] + 0.4 * rng.normal(size=8)
        rows.append((k, [float(x) for x in v / np.linalg.norm(v)], c))
    rows += [(k, rows[0][1], rows[0][2]) for k in range(1, 400, 2)]  # a group of copies: ties
    rows += [(k, rows[0][1], 3 - rows[0][2]) for k in range(401, 600, 2)]
    rows += [(7001, None, 1), (7100, [1.0, None], 1), (7002, [float("nan")] * 8, 1), (7003, [float("inf")] * 8, 2), (7004, [0.1] * 8, None), (None, [0.1] * 8, 1)]
    rows += [(7005, [0.5] * 3, 1), (7200, [0.5] * 9, 1), (7300, [], 2), (7400, [0.0] * 8, 2), (7500, [3e4] * 8, 2), (400, rows[100][1], 2), (400, rows[100][1], rows[100][2])]
    got = [tuple(r) for r in negatives.mine(vectors_of(spark, rows)).collect()]
    assert sorted(got) == sorted(mined(rows)) and len(got) > 200


def test_negatives_of_empty_tables(spark):
    assert negatives.mine(vectors_of(spark, [])).count() == 0
    assert negatives.mine(vectors_of(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0
    assert negatives.mine(vectors_of(spark, [(100, [1.0], 1)])).count() == 0


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16) * 300
    anchors = (centre + rng.normal(size=(60, 16)) * 5).round().astype(np.int64)
    rows = (np.concatenate([centre + rng.normal(size=(40, 16)) * 40, rng.normal(size=(2000, 16)) * 300])).round().astype(np.int64)
    order, up, edges = negatives.spanning_tree(anchors)
    assert up[0] == 0 and all(up[k] < k for k in range(1, 60))
    a = anchors[order]
    whole = a @ rows.T
    low = np.partition(whole, -5, axis=1)[:, -5].astype(float)
    high = whole.max(1) * 0.98
    scores, scored = negatives.tree_scores(a, up, edges, rows, np.sqrt((rows.astype(float) ** 2).sum(1)), low, high)
    inside = (whole >= low[:, None]) & (whole <= high[:, None])
    assert (scored | ~inside).all() and (scores[scored] == whole[scored]).all()
    assert scored[1:].mean() < 0.1


# ------------------------------------------------------------- op13


def distance(a, b):
    """Least edits from ``a`` to any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return min(row)


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def base(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in notices.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return words, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("xé漢 ") + text[k:], text[:k] + rng.choice("yüz") + text[k + 1 :]])
    return text


def license_texts():
    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["the", "mit", "license", "under", "of", "apache", "General", "public", "cc", "by", "déjà", "4.0", "漢字"]) for _ in range(n))
    texts = [None, "", " -\n", "MIT", "The MIT-License. Apache  license; mit license", "Copyright\n * Licensed under the\n * Apache License,\n * Version 2.0", "mit license " * 9000]
    for _, notice in notices.NOTICES:
        k = notices.edits_of(notice)
        texts += [filler(30) + "\n# " + edited(rng, notice.title(), n) + ", " + filler(20) for n in (0, 1, k, k + 1, 3 * k) for _ in range(2)]
    return texts + [filler(300) for _ in range(30)]


def test_license_scan_equals_brute_force(spark):
    texts = license_texts()
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, texts[4]), (None, texts[5])]
    got = notices.scan(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d is None, d or 0) for d, _ in rows)
    seen = set()
    for r in got:
        text = texts[5 if r.doc_id is None else r.doc_id]
        words, n, first, last, labels = base(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), n, first, last, labels)
        if len(words) > 5000:
            continue
        plain = " ".join(words)
        want = set(filter(None, labels.split(","))) | {label for label, notice in notices.NOTICES if distance(notice, plain) <= notices.edits_of(notice)}
        assert set(filter(None, r.labels.split(","))) == want, text
        assert (r.score == 1) if n else (r.score > 0) == bool(r.spans)
        for span in filter(None, r.spans.split(",")):
            label, a, b, edits = span.split(":")
            part = " ".join(re.findall(WORD, text[int(a) : int(b)].lower()))
            assert any(x == label and distance(notice, f" {part} ") <= int(edits) + 2 for x, notice in notices.NOTICES)
            seen.add(int(edits))
    assert {0, 1, 2} <= seen


def test_license_spans_are_of_the_text(spark):
    text = "é漢 (c) ACME\n// Released  under\tthe MIT Licence. More"
    (r,) = notices.scan(docs_of(spark, [(1, text)])).collect()
    label, a, b, edits = r.spans.split(":")
    assert (text[int(a) : int(b)], label, edits, r.n_base, r.labels) == ("Released  under\tthe MIT Licence", "mit", "1", 0, "mit")
    assert abs(r.score - (1 - 1 / 30)) < 1e-9


def test_license_scan_of_an_empty_table(spark):
    assert notices.scan(docs_of(spark, [])).count() == 0


def test_pieces_cover_a_notice():
    for _, notice in notices.NOTICES:
        cut = notices.pieces(notice)
        assert "".join(x for _, x in cut) == notice and len(cut) == notices.edits_of(notice) + 1 and all(notice[a : a + len(x)] == x for a, x in cut)
