import random

from loomscribe.llm import truncation as T
from tests.llm.test_pairs import text


def found(spark, rows, corpus):
    texts = spark.createDataFrame(rows, "key long, text string")
    return {r["key"] for r in T.truncated(texts, spark.createDataFrame([(t,) for t in corpus], "text string")).collect()}


def test_copies_of_a_cut_text_make_no_sign_off(spark):
    r = random.Random(2)
    full = [text(r) + "\n\nThe Acme team" for _ in range(30)]
    cut = text(r) + "\n\nNobody here can review the weekly"
    rows = [(i, t) for i, t in enumerate(full)] + [(100 + i, cut) for i in range(8)]
    assert found(spark, rows, [t for _, t in rows]) == set(range(100, 108))


def test_copies_of_a_text_make_no_whole_line(spark):
    r = random.Random(3)
    full = [text(r) for _ in range(30)]
    odd = text(r) + "\n\nBuyers review the weekly\n\n" + text(r)
    cut = text(r) + "\n\nBuyers review the weekly"
    rows = [(i, t) for i, t in enumerate(full)] + [(100, cut)]
    assert found(spark, rows, [t for _, t in rows] + [odd] * 3) == {100}
    assert found(spark, rows, [t for _, t in rows] + [odd, odd + " " + text(r)]) == set()  # in two texts it is a heading


def test_lines_count_texts():
    words = T._Words()
    got = T.window_counts(["The offer\nThe offer\nAll is well here.", "The offer\nAll is well."], words)
    whole = got[(got["level"] == T.LINE) & (got["ends"] > 0)]  # the other rows of this level are lines that go on
    assert sorted(whole["ends"]) == [1, 1, 2]


def test_strict_prefixes_against_brute_force(spark):
    r = random.Random(5)
    shared = text(r, 3)
    texts = [shared[:n] for n in (3, 4, 15, 16, 17, 60, 63, 64, 65, 200)] + [shared, shared + " And on.", "other " + shared, "other", "", shared + "  \n"]
    texts += [shared + text(r, 1) for _ in range(40)]  # a prefix that most texts share
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").where("text IS NOT NULL").repartition(5)
    for extra in ([], [shared + " And on, and on."]):
        bare = {t.rstrip() for t in texts + extra}
        want = {t for t in texts if len(t.rstrip()) >= T.SHORTEST and any(b != t.rstrip() and b.startswith(t.rstrip()) for b in bare)}
        same = {row["same"]: row["text"] for row in df.selectExpr("xxhash64(text) AS same", "text").collect()}
        got = T.strict_prefixes(df, spark.createDataFrame([(t,) for t in extra], "text string")).collect()
        assert {same[g["same"]] for g in got} == want
        for g in got:
            assert any(b.startswith(same[g["same"]].rstrip() + g["follows"]) for b in bare)


def test_whole_copies_come_out_without_the_rules(spark):
    r = random.Random(7)
    full = [text(r, 6) for _ in range(40)]
    rows, want = [], set()
    for i, t in enumerate(full):
        at = r.randrange(80, len(t) - 30)
        while not (t[at - 1].isalpha() and t[at].isalpha()):
            at += 1
        rows += [(i, t[:at]), (1000 + i, t), (2000 + i, t.split(". ")[0] + ".")]
        want.add(i)
    texts = spark.createDataFrame(rows, "key long, text string")
    nothing = spark.createDataFrame([], "text string")
    got = {x["key"]: x["why"] for x in T.truncated(texts, nothing, texts.select("text"), rules=False).collect()}
    assert set(got) == want and set(got.values()) == {"copy"}


def test_every_row_has_evidence_with_and_without_rules(spark):
    r = random.Random(11)
    full = [text(r, 6) + "\n\n- The audit trail\n- The booking flow" for _ in range(80)]
    ends = ["and the buyers [the report](https://a.exam", "for **the weekly", "because of (see", "and so they,", "| Step | Own", "with help from the finance desk an", "the costs, e.g."]
    rows = [(i, t) for i, t in enumerate(full)]
    rows += [(100 + i, text(r, 3) + ("\n\n" if e[0] == "|" else " Some lawyers ") + e) for i, e in enumerate(ends)]
    corpus = full + [f"Some lawyers [the report](https://a.example/{i}) review (see note {i}) **the report** of the desk, e.g. the trail.\n\n| Step | Owner |\n|---|---|\n| one | two |\n\nAll is well." for i in range(30)]
    texts, where = spark.createDataFrame(rows, "key long, text string"), spark.createDataFrame([(t,) for t in corpus], "text string")
    for rules in (True, False):
        got = {x["key"]: x["why"] for x in T.truncated(texts, where, rules=rules).collect()}
        assert set(got) == {100 + i for i in range(len(ends))}, (rules, got)
        assert set(got.values()) <= {"copy", "word", "tail", "shape"}


def test_nothing_alike_is_no_evidence(spark):
    texts = spark.createDataFrame([(1, "Zyx wvu tsr qpo nml kji")], "key long, text string")
    assert T.truncated(texts, spark.createDataFrame([], "text string")).count() == 0
