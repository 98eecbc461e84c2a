import random

from loomscribe.llm import endings as E
from loomscribe.llm import pairs as P
from loomscribe.llm import truncation as T
from loomscribe.llm.language import language
from loomscribe.llm.refusals import is_refusal

SUBJECTS = "The planners,The buyers,Our clients,Two founders,The auditors,Some lawyers,The editors,Most teams".split(",")
VERBS = "review,compare,share,question,publish,rebuild,trim,approve,measure,schedule".split(",")
OBJECTS = "the weekly report,their price list,the release notes,the open tickets,the audit trail,the return policy,the booking flow".split(",")
TAILS = "before the end of the quarter,without a new tool,in front of the whole team,for about nine accounts,with help from the finance desk".split(",")
DE = "Die Einkäufer prüfen die offenen Rechnungen vor dem nächsten Audit. Die Planer vergleichen ihre Verträge mit der Finanzabteilung und melden sich nach drei Tagen zurück. "


def sentence(r):
    return f"{r.choice(SUBJECTS)} {r.choice(VERBS)} {r.choice(OBJECTS)} and {r.choice(VERBS)} {r.choice(OBJECTS)} {r.choice(TAILS)}."


def text(r, n=9):
    return " ".join(sentence(r) for _ in range(n))


def pairs(seed=4, n=400):
    r = random.Random(seed)
    rows, truth = [], set()
    for i in range(n):
        o = text(r)
        w, defect = text(r), None
        k = i % 20
        if k == 0:
            w, defect = r.choice([None, "", "  ", "N/A", "{}", "(empty)", "<p></p>"]), "empty"
        elif k == 1:
            w, defect = r.choice(["I'm sorry, but I can't rewrite this post.", "Leider kann ich diesen Text nicht umformulieren.", "Je ne peux pas reformuler ce billet.", "Lo siento, no puedo reformular esta entrada."]), "refusal"
        elif k == 2:
            parts = o.split(". ")
            r.shuffle(parts)
            w, defect = "- " + ".\n- ".join(x.rstrip(".") for x in parts) + ".", "copy"
        elif k == 3:
            w, defect = DE * 4, "language"
        elif k == 4:
            w = w[: int(len(w) * 0.55)]
            w, defect = w[: w.rfind(" ") - 3], "truncated"
        elif k == 5:
            w = o.split(". ")[0] + ". " + w  # keeps one sentence
        elif k == 6:
            w += ' "I cannot rewrite this text," said one of the buyers.'
        rows.append((i, o, w, float(len((w or "").split())), "x"))
        if defect:
            truth.add((i, defect))
    return rows, truth


def test_planted_defects_validate_the_cutoffs(spark):
    rows, truth = pairs()
    df = spark.createDataFrame(rows + [rows[0], rows[3]], "key long, original string, rewritten string, logged double, votes string")
    got = P.defects(df).collect()
    assert all(r["posterior"] >= P.CUTOFFS[r["defect"]] for r in got)
    found = {(r["key"], r["defect"]) for r in got}
    assert len(found & truth) / len(truth) >= 0.97 and len(found & truth) / len(found) >= 0.97


def test_defects_of_odd_rows(spark):
    kind = "key long, original string, rewritten string, logged double"
    assert P.defects(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, None, None, None), (2, None, "The buyers review the report without a new tool.", None), (3, "", "", 0.0), (None, "a", "b", 1.0)]
    got = {(r["key"], r["defect"]) for r in P.defects(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, "empty"), (3, "empty")}


def test_label_model_without_the_defect():
    post = P.label_model({"---": 1000.0, "-+-": 30.0, "+++": 1.0})
    assert post["---"] < 0.01 and post["-+-"] < 0.5 < post["+++"]
    assert P.label_model({}) == {}


def test_the_first_function_is_outvoted():
    counts = {"-----": 9000.0, "+++++": 120.0, "++++-": 60.0, "+++-+": 30.0, "--+--": 200.0, "-+---": 40.0, "---+-": 120.0, "----+": 150.0, "-++++": 6.0, "+----": 1.0}
    post = P.label_model(counts, P.GROUPS["refusal"])
    assert post["-++++"] > 0.9  # the first function says no, the others overturn it
    post = P.label_model({**counts, "+----": 900.0}, P.GROUPS["refusal"])
    assert post["+----"] < 0.05 and post["+++++"] > 0.9  # a first function that fires everywhere is found out


def test_every_function_can_be_outvoted():
    import numpy as np

    rnd = np.random.default_rng(3)
    for defect, groups in P.GROUPS.items():
        width = sum(map(len, groups))
        bad = rnd.random(20_000) < 0.05
        votes = np.where(rnd.random((20_000, width)) < np.where(bad[:, None], 0.85, 0.04), "+", "-")
        counts = {}
        for row in votes:
            counts["".join(row)] = counts.get("".join(row), 0) + 1
        post = P.LabelModel(counts, groups)
        for f in range(width):
            if all(len(g) < width - 1 for g in groups):
                lone = post.posterior(["-" * f + "+" + "-" * (width - f - 1), "+" * f + "-" + "+" * (width - f - 1)])
                assert [p >= 0.5 for p in lone.values()] == [False, True], (defect, f, lone)


def test_planted_refusals_and_copies_that_the_first_function_misses(spark):
    rows, _ = pairs(seed=6, n=500)
    curve = P.cutoff_curve(spark.createDataFrame([r[:4] for r in rows], "key long, original string, rewritten string, logged double"), (0.2, 0.5)).collect()
    got = {(r["defect"], r["cutoff"]): r for r in curve}
    for d in ("empty", "refusal", "copy"):
        r = got[d, P.CUTOFFS[d]]
        assert r["planted"] > 20 and r["recall"] >= 0.95 and r["other_share"] <= 0.05, r
    assert got["refusal", 0.2]["first_recall"] < 0.9


def test_a_refusal_has_no_language_defect(spark):
    rows, _ = pairs(seed=2, n=300)
    rows = [(r[0], r[1], "Leider kann ich diesen Text nicht umformulieren." if i % 20 == 1 else r[2], r[3]) for i, r in enumerate(rows)]
    got = {(r["key"], r["defect"]) for r in P.defects(spark.createDataFrame(rows, "key long, original string, rewritten string, logged double")).collect()}
    refused = {k for k, d in got if d == "refusal"}
    assert refused and not any((k, "language") in got for k in refused)


def test_endings():
    complete = ["All is well.", "Is it?", 'He said "yes."', "More on this: https://a.example/notes/7", "#ops #tips", "Thanks for reading 🙂", "**Total: 5 %**", "| a | b |\n|---|---|\n| 1 | 2 |",
                "They left. [...]", "(First published in issue 3)", "```\ncode\n```"]
    cut = ["They review the", "in the [report](https://exa", "a custom<str", "tom &am", "| Step | Own", "with **bold", "the costs, e.g.", "and then (see", "because the deadline [...]", "and so…", "in 60 meetÃ", "one,", "```\ncode"]
    assert all(E.ending(t) == E.COMPLETE for t in complete), [t for t in complete if E.ending(t) != E.COMPLETE]
    assert all(E.ending(t) != E.COMPLETE for t in cut), [t for t in cut if E.ending(t) == E.COMPLETE]
    assert not any(map(E.has_content, [None, "", " \n", "N/A", "[]", "(empty)", "<p></p>", "##", "...", "﻿"]))
    assert E.has_content("Yes, we do.")


def test_truncated_by_prefix(spark):
    r = random.Random(9)
    full = [text(r) + "\n\n- The audit trail\n- The booking flow\n- Their price list" for _ in range(60)]
    rows, want = [], set()
    for i, t in enumerate(full):
        if i % 3 == 0:
            body = t.split("\n\n")[0]
            at = r.randrange(200, len(body) - 40)
            while body[at - 1] in ". " or body[at - 2] == ".":
                at += 1
            rows.append((i, body[:at]))
            want.add(i)
        elif i % 3 == 1:
            rows.append((i, t))
        else:
            rows.append((i, t.split("\n\n")[0] + "\n\nThe Acme team"))
    rows += [(900, None), (901, ""), (902, "I can't rewrite this post"), (None, "They review the"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "key long, text string")
    got = {x["key"] for x in T.truncated(df, spark.createDataFrame([(t,) for t in full] + [(None,)], "text string")).collect()}
    assert len(got & want) >= len(want) - 2 and len(got - want) <= 1, (got - want, want - got)
    assert T.truncated(df.limit(0), df.select("text")).count() == 0


def test_refusals():
    yes = ["Unfortunately, I won't be able to rewrite the post.", "I'd rather not alter these claims.", "This request falls outside what I may produce.", "No rewrite will be provided for this draft.",
           "Nein: diesen Beitrag kann ich nicht umformulieren.", "Désolé, il m'est impossible de traiter cette demande.", "Lamentablemente, no me es posible atender esta petición.", "I must decline to edit it."]
    no = ["The buyers cannot rewrite history.", 'One said "I cannot help with this request" and left.', "Wir prüfen nicht alle Verträge.", "Nous ne changeons pas nos prix.", "No extra reporting line is needed.", ""]
    assert all(map(is_refusal, yes)), [t for t in yes if not is_refusal(t)]
    assert not any(map(is_refusal, no)), [t for t in no if is_refusal(t)]


def test_language():
    assert language("The buyers review the open tickets with the finance desk.") == "en"
    assert language(DE) == "de"
    assert language("Les acheteurs comparent les contrats avec le service financier.") == "fr"
    assert language("Los compradores comparan los contratos con el equipo.") == "es"
    assert language("") is None and language(None) is None and language("12 34") is None
