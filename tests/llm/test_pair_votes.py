import random
from collections import Counter

import numpy as np
import pandas as pd

from loomscribe.llm import pairs as P
from loomscribe.llm import truncation as T
from loomscribe.llm.endings import has_content
from loomscribe.llm.language import LANGUAGES, best, by_pieces, share_by_sentence
from loomscribe.llm.language import votes as function_words
from loomscribe.llm.refusals import is_refusal
from tests.llm.test_pairs import DE, text

ODD = ["", None, "N/A", "<p></p>", "Sorry.", "’", "I can’t rewrite this post.", " ich ", "which", "Das kann ich nicht.", "This\nrequest", "this request", "lo siento", "Lo  siento", "tut mir leid", "I am not\nin a position to help", "a_b c_d",
       "İstanbul ΣΑΣ", "\x1cone\x1dtwo", "five-year https://a.example/b_c?d=e", "no re", "cette", "cette demande", "l'eau n'est pas", "１２ ²", "Les acheteurs sont ici. The buyers are here.", "der die das und ist"]


def plain(original, rewritten, logged):
    """The votes of one pair, word by word."""
    full, text_ = has_content(rewritten), rewritten or ""
    low = text_.lower()
    wr, wo = P._words(text_), P._words(original or "")
    cr, co = Counter(wr), Counter(wo)
    vote = lambda yes: "0" if yes is None else "+" if yes else "-"
    shared1 = sum(n for w, n in cr.items() if w in co) / len(wr) if wr and wo else None
    votes = {"empty": vote(not full) + vote(len(wr) <= 2) + vote(None if logged is None else logged <= 2) + vote(None if not wo else not wr or shared1 == 0)}
    if not full:
        return votes | {"refusal": "-----", "copy": "------", "language": "----", "truncated": "--"}
    ratio = len(wr) / len(wo) if wo else None
    tri, other = set(zip(wr, wr[1:], wr[2:])), set(zip(wo, wo[1:], wo[2:]))
    shared3 = len(tri & other) / len(tri) if tri and other else None
    shared2 = overlap = kept = None
    if shared1 is not None and shared1 < 0.7:
        shared2 = overlap = kept = 0.0
    elif shared1 is not None:
        two = set(zip(wr, wr[1:]))
        shared2 = len(two & set(zip(wo, wo[1:]))) / len(two) if two else None
        overlap = sum((cr & co).values()) / len(wr)
        long_ = Counter(w for w in wo if len(w) >= 7)
        kept = sum((long_ & cr).values()) / long_.total() if long_ else None
    declines = is_refusal(text_)
    votes["refusal"] = vote(declines) + vote(None if ratio is None else ratio < 0.4) + vote(None if shared3 is None else shared3 < 0.02) + vote(P._any(P._SOFT, low)) + vote(P._any(P._TASK, low))
    votes["copy"] = (vote(None if shared3 is None else shared3 >= 0.7) + vote(None if shared2 is None else shared2 >= 0.8) + vote(None if shared1 is None else shared1 >= 0.93)
                     + vote(None if overlap is None else overlap >= 0.9) + vote(None if kept is None else kept >= 0.9) + vote(None if ratio is None else 0.85 <= ratio <= 1.2))
    tally = function_words(cr)
    lo, lr = best(function_words(Counter() if declines else co)), best(tally)
    in_own = po = pr = None
    if lo is not None and lr == lo and tally[LANGUAGES.index(lo)] >= 0.9 * sum(tally):
        in_own, po, pr = 1.0, lo, lo
    elif lo is not None:
        here = share_by_sentence(text_)
        in_own, po, pr = here[lo] if sum(here.values()) else None, by_pieces(original or ""), by_pieces(text_)
    votes["language"] = (vote(None if in_own is None else in_own < 0.5) + vote(None if lo is None or lr is None else lo != lr)
                         + vote(None if po is None or pr is None else po != pr) + vote(None if shared1 is None or declines or len(wr) < 8 else shared1 < 0.12))
    votes["truncated"] = vote(None if logged is None else logged > len(text_.split()) + 2) + vote(None if ratio is None else ratio < 0.6)
    return votes


def odd_pairs(n=1500):
    r = random.Random(8)
    some = lambda: r.choice([text(r, 4), DE, "\n".join([text(r, 1), DE])])
    rows = []
    for _ in range(n):
        o = some() if r.random() < 0.8 else r.choice(ODD)
        w = o if r.random() < 0.5 else some() if r.random() < 0.6 else " ".join(r.choice(ODD) or "" for _ in range(r.randrange(5)))
        k = r.randrange(6)
        if w and k == 0:
            words = w.split(" ")
            r.shuffle(words)
            w = " ".join(words)
        elif w and k == 1:
            w = w[: r.randrange(len(w))]
        elif w and k == 2:
            at = r.randrange(len(w))
            w = w[:at] + (r.choice(ODD) or "") + w[at:]
        elif k == 3:
            w = r.choice(ODD)
        rows.append((o, w, r.choice([None, 0.0, 2.0, 40.0, 90.0])))
    return rows


def test_votes_against_brute_force(monkeypatch):
    rows = odd_pairs()
    originals, texts, logged = map(list, zip(*rows))
    want = [plain(*row) for row in rows]
    for base in (P.BASE, 10):  # beyond BASE words the numbers of words are put together in another way
        monkeypatch.setattr(P, "BASE", base)
        words = P._Raw()
        for a, b in ((0, 1), (1, 700), (700, 700), (700, len(rows))):
            got, declines = P.pair_votes(originals[a:b], texts[a:b], np.array(logged[a:b], dtype=float), words)
            assert [{d: v[i] for d, v in got.items()} for i in range(b - a)] == want[a:b]
            assert declines == [has_content(t) and is_refusal(t) for t in texts[a:b]]


def test_a_mark_is_never_missed():
    for k, marks in enumerate((P._REFUSES, P._SOFT, P._TASK)):
        for m in marks:
            looked = [P._LISTS.look(raw) for raw in f"x {m} x".split()]
            pairs = [a[1] & b[2] & P._LISTS.of_list[k] for a, b in zip(looked, looked[1:])]
            assert any(brings >> k & 1 for brings, _, _ in looked) or any(pairs), m


def test_a_known_word_runs_no_pattern(monkeypatch):
    class Counting:
        calls = 0

        def findall(self, t):
            Counting.calls += 1
            return found(t)

    found = P._WORD.findall
    monkeypatch.setattr(P, "_WORD", Counting())
    r = random.Random(5)
    one = pd.DataFrame([(i, i, text(r), text(r), None) for i in range(50)], columns=["key", "same", "original", "rewritten", "logged"])
    calls = []
    for _ in P._look(iter([one, one])):
        calls.append(Counting.calls)
    assert 0 < calls[0] == calls[1] < 100


def test_places_begin_after_list_marks():
    x = T.Places(["| ** Step | Own\n|---|---|\n* one | two\n*** **\n# Title"], T._Words())
    assert [x.words.text[c] for c in x.c[x.starts]] == ["step", "one", "title"] and x.kind[x.starts].tolist() == [3, 1, 2] and x.rules == 1


def test_blanks_at_the_end_do_not_count(spark):
    texts = ["The offer is\t", "The offer is", "abc", "abc  \n\n", "The offer is here\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    same = {r["same"]: r["text"] for r in df.selectExpr("xxhash64(text) AS same", "text").collect()}
    got = {(same[r["same"]], r["follows"]) for r in T.strict_prefixes(df, df).collect()}
    assert got == {(t, " here") for t in texts[:2]}


def test_lines_of_places():
    texts = ["", "One two\n\n```\n| a |\n```\n \x01 \x01\x01 here\n", " \n", "| a | b |\n|---|---|\n| c | d |\n|:-:|\n\n|---|"]
    x = T.Places(texts, T._Words())
    lines = [[x.words.text[c] for c in x.c[a : b + 1] if x.words.text[c]] for a, b in zip(x.starts, x.stops)]
    assert lines == [["one", "two"], ["a"], ["\x01", "\x01\x01", "here"], ["a", "b"], ["c", "d"]]
    assert x.text_of.tolist() == [1, 1, 1, 3, 3] and x.kind[x.starts].tolist() == [0, 3, 0, 3, 3] and x.rules == 2
    assert [x.words.text[x.c[i - 1]] for i in x.final] == ["\x01\x01", "d"] and (x.shape[x.starts] == T.FENCE).tolist() == [False, True, False, False, False]
    assert T.Places([], T._Words()).n == 0 and T.Places(["\n"], T._Words()).n == 0
