import random

from loomscribe.llm import spans as X


def brute(records, k):
    seen = {}
    for rec, t in records:
        if rec is None or t is None:
            continue
        w = t.split()
        for j in range(len(w) - k + 1):
            seen.setdefault(tuple(w[j : j + k]), set()).add(rec)
    out = set()
    for s in seen.values():
        if len(s) > 1:
            out |= s
    return out


def made(seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("alpha Beta, gamma. delta **eps** zeta eta theta iota kappa".split())
    run = [word() for _ in range(60)]
    records = []
    for i in range(40):
        body = [word() for _ in range(rnd.randrange(0, 90))]
        if i % 5 == 0:
            at = rnd.randrange(len(body) + 1)
            body[at:at] = run[rnd.randrange(5) :]
        records.append((i, rnd.choice(["  ", " ", "\n"]).join(body)))
    records += [(0, records[0][1]), (98, None), (99, ""), (None, " ".join(run)), (97, " ".join(["same"] * 200)), (96, " ".join(["same"] * 200)), (95, " ".join(["own"] * 300))]
    return records


def test_found_equals_brute_force_also_when_every_bucket_is_hot(spark):
    records = made()
    df = spark.createDataFrame([(r, t, 1) for r, t in records], "rec long, text string, text_id int")
    for k, m in ((20, 8), (50, 20)):
        want = brute(records, k)
        assert want
        for hot in (20_000, 1):
            got = {r["rec"] for r in X.shared_windows(df, k, m, hot).select("rec").distinct().collect()}
            assert got == want


def test_repetitive_texts_are_cut_into_bounded_strings(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_WINDOWS", 7)
    records = made(4)
    df = spark.createDataFrame(records, "rec long, text string")
    got = {r["rec"] for r in X.shared_windows(df, 20, 8).select("rec").distinct().collect()}
    assert got == brute(records, 20) and {96, 97} <= got and 95 not in got
    assert max(r["windows"] for r in X.super_kmers(df.where("rec IS NOT NULL AND text IS NOT NULL").selectExpr("rec", "rec AS text_id", "text"), 20, 8).collect()) == 7
    spans = {(r["rec"], r["start"], r["n_words"]) for r in X.merged_spans(X.shared_windows(df.where("rec IN (96, 97)"), 20, 8), 20).collect()}
    assert spans == {(96, 0, 200), (97, 0, 200)}


def test_spans_are_maximal_and_exact(spark):
    run = [f"w{i}" for i in range(70)]
    a = ["x"] * 3 + run + ["y"] * 4
    b = run[5:] + ["z"] * 9
    df = spark.createDataFrame([(1, " ".join(a)), (2, "\n\n".join(b))], "rec long, text string")
    got = {(r["rec"], r["start"], r["n_words"]) for r in X.merged_spans(X.shared_windows(df)).collect()}
    assert got == {(1, 8, 65), (2, 0, 65)}


def test_case_and_punctuation_count(spark):
    run = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, run), (2, run.upper()), (3, run.replace(" ", ", "))], "rec long, text string")
    assert X.shared_windows(df).count() == 0


def test_empty_and_long(spark):
    assert X.shared_windows(spark.createDataFrame([], "rec long, text string")).count() == 0
    big = " ".join(f"t{i % 9973}" for i in range(60_000))
    df = spark.createDataFrame([(1, big), (2, "q " + big)], "rec long, text string")
    got = sorted((r["rec"], r["start"], r["n_words"]) for r in X.merged_spans(X.shared_windows(df)).collect())
    assert got == [(1, 0, 60_000), (2, 1, 60_000)]
