import random

import numpy as np

from loomscribe.llm import abuse as A

GOOD = ["The planners review the weekly report before the quarter ends.", "Two buyers compare the price list with the finance desk.", "Our clients share the release notes in plain language.",
        "The job kills the child process after 9 seconds and aborts the parent.", "Rat poison, nuts and screws ship in packs of ten.", "Immigrants founded 9 of the firms in this survey."]
BAD = ["You pathetic {}, nobody wants your {}.", "Shut your mouth, you {} liar about the {}.", "What a stupid team of {} behind this {}."]
NOUNS, THINGS = ["morons", "idiots", "scumbags", "pigs"], ["demo", "webinar", "invoices", "newsletter"]
MASKED = {"morons": "m0rons", "idiots": "i d i o t s", "scumbags": "scum​bags", "pigs": "рigs"}


def corpus(n=400, seed=1):
    r = random.Random(seed)
    docs, labels, truth = [], [], set()
    for i in range(n):
        s = [r.choice(GOOD) for _ in range(r.randrange(1, 6))]
        if i % 8 == 0:
            noun = r.choice(NOUNS)
            s.insert(r.randrange(len(s) + 1), r.choice(BAD).format(MASKED[noun] if i % 24 == 0 else noun, r.choice(THINGS)))
            truth.add(i)
        docs.append((i, " ".join(s), "clash"))
        if i % 2 == 0:
            wrong = i % 62 == 2
            labels.append((i, "r1", ("abusive" if (i in truth) != wrong else " OK"), i))
    return docs, labels, truth


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    v = spark.createDataFrame(labels, "doc_id long, rater string, verdict string, t long")
    return d, v.selectExpr("doc_id", "rater", "verdict", "timestamp_seconds(t) AS labelled_at")


def test_finds_unlabelled_and_disguised(spark):
    docs, labels, truth = corpus()
    labels = [x for x in labels if x[0] < 250]
    d, v = frames(spark, docs + [(900, None, ""), (901, "", ""), (902, "word " * 30_000, "")], labels)
    got = {r["doc_id"]: r for r in A.scores(d, v).collect()}
    assert len(got) == 403 and got[900]["score"] == got[901]["score"] == 0
    found = {k for k, r in got.items() if r["score"] >= A.CUTOFF}
    held = {k for k in truth if k >= 250}
    assert len(found & held) / len(held) >= 0.95, held - found
    assert len(found - truth) <= 2
    assert all(got[k]["example"] for k in found)


def test_no_labels_or_no_documents(spark):
    docs, labels, _ = corpus(40)
    d, v = frames(spark, docs, labels)
    assert {r["score"] for r in A.scores(d, v.limit(0)).collect()} == {0.0}
    assert A.scores(d.limit(0), v).count() == 0


def test_labels_by_majority_of_last_words(spark):
    rows = [(1, "a", "ok", 1), (1, "a", "Abusive ", 2), (2, "a", "hateful", 1), (2, "b", "ok", 1), (2, "c", "ok", 1), (3, "a", "unsure", 1), (4, None, None, 1), (None, "a", "ok", 1), (1, "a", "ok", 1)]
    _, v = frames(spark, [(1, "", "")], rows)
    assert {r["doc_id"]: r["kind"] for r in A.document_labels(v).collect()} == {1: "abusive", 2: "ok"}


def test_index_equals_brute_force():
    r = np.random.default_rng(0)
    weights = r.uniform(0.1, 5, 120)
    rows = [r.integers(-1, 120, r.integers(2, 15)).tolist() for _ in range(700)]
    bad = r.random(700) < 0.3
    index = A.Index(weights, rows, bad, ["abusive" if b else "ok" for b in bad], [str(i) for i in range(700)])
    full = np.zeros((700, 120))
    for i, name in enumerate(index.texts):
        t, w = index.vector(rows[int(name)])
        full[i, t] = w
    for _ in range(200):
        q = r.integers(-1, 120, r.integers(1, 15)).tolist()
        other = 36.0 * q.count(-1)
        t, w = index.vector(q, other)
        sim = full[:, t] @ w
        near = np.flatnonzero(sim >= A.LEAST_SIMILARITY)
        near = near[np.lexsort((near, -sim[near]))][: A.NEIGHBOURS]
        got, s = index.neighbours(q, other)
        if len(got):
            assert np.allclose(s, sim[got]) and np.allclose(s, sim[near])
        else:
            assert not index.bad[sim >= A.LEAST_SIMILARITY].any()


def test_terms():
    say = lambda t: [A.term(w) for w in A.fold(t).split()]
    assert say("M0R0NS f-u-c-k $h1t scuuuumbags guest272 Scheiße рigs 2024") == ["moron", "fuck", "shit", "scumbag", "guest", "scheisse", "pigs", ""]
    assert A.fill_mask("i***t", {5: ["idiot"]}) == "idiot" and A.fill_mask("x*y", {3: ["abc"]}) == "x*y"


def test_whole_and_batched_splitting_agree():
    tokens = A.Tokens()
    texts = ["One two. Three four!\nfive six", "", "aa bb " * 100, "x"]
    want = [codes for t in texts for codes, _ in A.sentences(t, tokens)]
    codes, sid, owner = A._batch_codes(texts, tokens)
    got = [[int(c) for c in codes[sid == s] if c != -2] for s in range(sid.max() + 1)]
    assert got == want and owner.tolist() == [0, 0, 0, *[2] * 9, 3]  # 200 words in parts of 40, each half in the one before


def test_more_labels_than_examples(spark, monkeypatch):
    docs, labels, truth = corpus(800)
    labels = [(i, "r1", "abusive" if i in truth else "ok", i) for i in range(600)]  # 75 bad, 525 ok
    monkeypatch.setattr(A, "MAX_LABELLED", 40)
    got = {r["doc_id"]: r["score"] for r in A.scores(*frames(spark, docs, labels)).collect()}
    found, held = {k for k, s in got.items() if s >= A.CUTOFF}, {k for k in truth if k >= 600}
    assert len(found & held) / len(held) >= 0.95, held - found
    assert len(found - truth) <= 8, len(found - truth)


def test_examples_are_weighted_to_all_labels():
    r = random.Random(3)
    half = [("abusive" if i % 2 else "ok", r.choice(GOOD) + (" " + r.choice(BAD).format(r.choice(NOUNS), r.choice(THINGS)) if i % 2 else "")) for i in range(400)]
    own = A.Tokens()
    for _, t in half:
        list(A.sentences(t, own))
    index_of = {w: i for i, w in enumerate(own.names)}
    assert A.bad_share(half, (1.0, 9.0)) == 0.1 and A.bad_share(half, (1.0, 1.0)) == 0.5 and A.bad_share([], (1.0, 1.0)) == 0
    for stands_for in ((1.0, 1.0), (1.0, 9.0), (2.0, 1.0)):
        _, bad, _, texts = A.choose_examples(half, A.Tokens(index_of), np.ones(len(index_of)), stands_for)
        assert bad.any() and all(("you" in t or "stupid" in t) for t, b in zip(texts, bad) if b), stands_for


def test_abuse_across_the_parts_of_a_long_sentence():
    assert A.parts_of(40) == [(0, 40)] and A.parts_of(41)[-1] == (20, 41)
    for n in (41, 60, 61, 99, 200):
        parts = A.parts_of(n)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(b - a <= 40 for a, b in parts)
        assert all(any(a <= i and i + 20 <= b for a, b in parts) for i in range(n - 20))  # any twenty words stand whole in one part


def test_cosine_is_exact_over_all_terms(spark):
    import math
    from collections import Counter

    docs, labels, _ = corpus(300)
    r = random.Random(5)
    docs = [(i, t + f" Rare{r.randrange(40)} words{r.randrange(90)}x here too.", c) for i, t, c in docs] + [(700, "You pathetic morons, nobody wants your qqzzy webinar wrrx.", "")]
    d, v = frames(spark, docs, labels[:60])
    got = {x["doc_id"]: x for x in A.scores(d, v).collect()}[700]
    tokens = A.Tokens()
    df, total = Counter(), 0
    for _, t, _ in docs:
        for codes, _ in A.sentences(t, tokens):
            df.update(set(codes))
            total += 1
    w = lambda c: math.log((1 + total) / (1 + df[c])) + 0.05
    vec = lambda text: {c: w(c) for codes, _ in A.sentences(text, tokens) for c in codes}
    a, b = vec(docs[-1][1]), vec(got["example"])
    size = lambda x: math.sqrt(sum(y * y for y in x.values()))
    whole = sum(a[c] * b[c] for c in a.keys() & b.keys()) / size(a) / size(b)
    assert got["similarity"] >= whole - 1e-6  # an example may be the telling part of its sentence
    assert abs(got["similarity"] - whole) < 0.25 and 0 < got["similarity"] < 1


def test_isotonic_and_reliability(spark):
    knots = A.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([0, 1, 0, 1, 1]))
    assert [y for _, y in knots] == sorted(y for _, y in knots) and knots[0][1] == 0 and knots[-1][1] == 1
    assert A.isotonic(np.zeros(0), np.zeros(0)) == []
    docs, labels, truth = corpus(600, seed=4)
    labels = [(i, "r1", "abusive" if i in truth else "ok", i) for i in range(600)]
    d, v = frames(spark, docs, labels)
    rows = A.reliability(d, v).collect()
    assert sum(r["n"] for r in rows) == 600 and rows[0]["recall"] >= 0.9 and rows[0]["precision"] >= 0.9
    assert rows[0]["bad_share"] < 0.05 and rows[-1]["bad_share"] > 0.9
    got = A.scores(d, v, calibrate=True).collect()
    assert all(0 <= r["probability"] <= 1 for r in got) and max(r["probability"] for r in got if r["doc_id"] in truth) > 0.9
    assert A.reliability(d, v.limit(0)).count() == 0


def python_calls(run):
    """How many Python functions run() calls."""
    import sys

    n = 0

    def count(_frame, event, _arg):
        nonlocal n
        n += event == "call"

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        run()
    finally:
        sys.setprofile(before)
    return n


def test_no_python_call_a_word_or_sentence():
    docs, labels, truth = corpus(200)
    half = [("abusive" if i in truth else "ok", t) for i, t, _ in docs]
    own = A.Tokens()
    df = A.Counter(c for _, t in half for codes, _ in A.sentences(t, own) for c in set(codes))
    judge = A.Judge(half, {own.names[c]: n for c, n in df.items()}, 1000)
    texts = ["The planners review the weekly report " * 40 + "in plain language." for _ in range(100)]  # 24,300 words in 1,200 parts, none bad
    tokens = judge.tokens()
    assert judge.candidates(texts, tokens) == []
    assert python_calls(lambda: judge.candidates(texts, tokens)) < 3000
    assert python_calls(lambda: A._batch_codes(texts, tokens)) < 1500


def test_spaced_letters_are_joined_wherever_they_stand():
    r = random.Random(2)
    for _ in range(20_000):
        text = "".join(r.choice("ab1_.-*· \n!()é") for _ in range(r.randrange(1, 13)))
        assert bool(A._SPACED.search(text)) <= bool(A._MAY_SPACE.search(text)), text
    assert A.fold("x (i d i o t s), y") == "x (idiots), y" and A.fold("a.b") == "a.b" and A.fold("p·i·g") == "pig"


def test_bound_leaves_out_no_sentence_with_a_bad_neighbour():
    docs, labels, truth = corpus(300, seed=6)
    half = [("abusive" if i in truth else "ok", t) for i, t, _ in docs]
    own = A.Tokens()
    df = A.Counter(c for _, t in half for codes, _ in A.sentences(t, own) for c in set(codes))
    judge = A.Judge(half, {own.names[c]: n for c, n in df.items()}, 2000)
    r, words = random.Random(7), [w for _, t in half for w in t.split()] + ["qqzzy", "***", "2024"]
    texts = ["", *(" ".join(r.choice(words) for _ in range(r.randrange(90))) for _ in range(700)), "you " * 90, "You pathetic qqzzy pigs pigs."]
    tokens = judge.tokens()
    want = []
    for k, t in enumerate(texts):
        codes, sid, _ = A._batch_codes([t], tokens)
        for s in range(sid.max() + 1 if len(sid) else 0):
            mine = set(codes[sid == s].tolist())
            if len(judge.index.neighbours(sorted(mine))[0]):
                want.append((k, s, sorted(c for c in mine if c >= 0), sorted(tokens.other[-3 - c] for c in mine if c < -2)))
    assert len(want) > 50 and judge.candidates(texts, tokens) == want
