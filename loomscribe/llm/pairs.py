"""Problem 3: defective prompt and response pairs, by labelling functions and a label model fitted by EM."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.functions.labels import canon_label
from loomscribe.llm.endings import COMPLETE, CUT, has_content
from loomscribe.llm.language import FUNCTION_WORD_OF, LANGUAGES, best, by_pieces, share_by_sentence
from loomscribe.llm.language import votes as function_words
from loomscribe.llm.refusals import _MARKS as _REFUSES
from loomscribe.llm.refusals import is_refusal
from loomscribe.llm.truncation import ASKED, _Words, as_frame, ask, evidence, strict_prefixes
from loomscribe.runtime import cut, table

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")
#: Posterior from which a label is given, from the curves that `p3_cutoffs` draws on planted pairs.
#: They are flat from .05 to .9 (no planted pair gained or lost), so any value between will do; the one for
#: refusals is low because partial ones, which answer as well, have the least certain posteriors.
CUTOFFS = {"empty": 0.5, "refusal": 0.2, "copy": 0.5, "language": 0.5, "truncated": 0.5}
#: Functions of a defect that are not independent, by place: the votes of a group are one joint variable of the model.
GROUPS = {
    "empty": ((0, 1), (2,), (3,)),
    "refusal": ((0,), (1, 2), (3, 4)),
    "copy": ((0, 1), (2, 3), (4,), (5,)),
    "language": ((0, 1), (2,), (3,)),
    "truncated": ((0,), (1, 2), (3,), (4,)),
}
#: Where every function starts: how often it fires on defective and on sound pairs; kept as so many pseudo pairs of each class.
HIT, NOISE, WEIGHT = 0.6, 0.02, 4.0
PRIOR = 0.04

_WORD = re.compile(r"[^\W_]+")

# Words that often stand in refusals, and words for the task itself.
_SOFT = ("sorry", "unfortunately", "apologi", "afraid", "declin", "unable", "guidelines", "leider", "bedaure", "tut mir leid", "désolé", "regrette", "malheureusement", "lo siento", "lamentablemente", "lamento",
         "happy to help", "let me know", "excerpt")
_TASK = ("rewrit", "reword", "rephras", "paraphras", "this request", "this task", "your request", "this edit", "this draft", "this prompt", "umformulier", "umschreib", "überarbeit", "diese anfrage", "diese bitte", "diesen text", "diesen beitrag",
         "reformul", "réécri", "récri", "cette demande", "ce texte", "ce billet", "reescrib", "esta solicitud", "esta petición", "esta entrada", "este texto", "parafrase")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _any(marks: tuple[str, ...], low: str) -> bool:
    for m in marks:
        if m in low:
            return True
    return False


class _Marks:
    """Which lists of marks a raw word, or two in a row, may bring into a text; bit k is the list k.

    A mark without blanks stands inside one raw word, which is all there is to ask. Of a mark with blanks the first two
    parts end one raw word and begin the next; whether the text has it is asked of the text.
    """

    def __init__(self, *lists: tuple[str, ...]) -> None:
        self.inside = [re.compile("|".join(re.escape(m) for m in marks if " " not in m)) for marks in lists]
        self.single = [(k, m.strip(), m[0] == " ", m[-1] == " ") for k, marks in enumerate(lists) for m in marks if " " in m and " " not in m.strip()]
        pairs = [(k, *m.strip().split(" ")[:2]) for k, marks in enumerate(lists) for m in marks if " " in m.strip()]
        self.firsts = {x: i for i, x in enumerate(sorted({(k, a) for k, a, _ in pairs}))}
        self.seconds: dict[str, int] = {}
        for k, a, b in pairs:
            self.seconds[b] = self.seconds.get(b, 0) | 1 << self.firsts[k, a]
        self.of_list = [sum(1 << i for (k, _), i in self.firsts.items() if k == j) for j in range(len(lists))]
        self.ends, self.begins = tuple({a for _, a in self.firsts}), tuple(self.seconds)

    def look(self, raw: str) -> tuple[int, int, int]:
        """The lists that the raw word brings, and bits of the pairs that it may be first and second of."""
        brings = first = second = 0
        for k, pattern in enumerate(self.inside):
            if pattern.search(raw):
                brings |= 1 << k
        for k, m, begins, ends in self.single:
            if m in raw and (not begins or raw.startswith(m)) and (not ends or raw.endswith(m)):
                brings |= 1 << k
        if raw.endswith(self.ends):
            for (_, a), i in self.firsts.items():
                if raw.endswith(a):
                    first |= 1 << i
        if raw.startswith(self.begins):
            for b, bits in self.seconds.items():
                if raw.startswith(b):
                    second |= bits
        return brings, first, second


_LISTS = _Marks(_REFUSES, _SOFT, _TASK)
#: Words are numbered below this, so that three numbers make one whole number.
BASE = 1 << 21
#: Pairs looked at together.
ROWS = 1000


class _Raw(dict):
    """The code of each raw lower-case word met so far; patterns and marks are asked of it once, and known by its code from then on."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: list[int] = []
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.long: list[bool] = []
        self.spoken: list[tuple[float, ...]] = []
        self._arrays: dict[str, np.ndarray] = {}

    def array(self, name: str, kind) -> np.ndarray:
        """One of the lists as an array; only what is new since the last call is converted."""
        have, all_ = self._arrays.get(name), getattr(self, name)
        n = 0 if have is None else len(have)
        if n < len(all_):
            new = np.array(all_[n:], dtype=kind)
            have = self._arrays[name] = new if have is None else np.concatenate([have, new])
        return have

    def __missing__(self, raw: str) -> int:
        c = self[raw] = len(self.rows)
        words = [raw] if raw.isalnum() else _WORD.findall(raw)
        self.rows.append((len(self.flat), len(words), *_LISTS.look(raw.replace("’", "'"))))
        for w in words:
            k = self.known.get(w)
            if k is None:
                k = self.known[w] = len(self.long)
                self.long.append(len(w) >= 7)
                in_ = FUNCTION_WORD_OF.get(w, ())
                self.spoken.append(tuple(in_.count(i) / max(len(in_), 1) for i in range(len(LANGUAGES))))
            self.flat.append(k)
        return c


def _grams(w: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each two and each three words in a row; equal numbers are equal words."""
    if n_words < BASE:
        two = w[:-1] * BASE + w[1:]
        return two, two[:-1] * BASE + w[2:]
    two = pd.factorize((w[:-1] << 31) + w[1:])[0].astype(np.int64)
    return two, (two[:-1] << 31) + w[2:]


def _in_both(r: np.ndarray, o: np.ndarray) -> int:
    """How many words of r are matched one to one by equal words of o."""
    cr, co = Counter(r.tolist()), Counter(o.tolist())
    both = list(cr.keys() & co.keys())
    return sum(map(min, map(cr.__getitem__, both), map(co.__getitem__, both)))


def _best(tally: np.ndarray) -> np.ndarray:
    """`best` of each row: the place of its language, or -1."""
    order = np.sort(tally, axis=1)
    return np.where((order[:, -1] >= 2.0) & (order[:, -1] > order[:, -2]), tally.argmax(axis=1), -1)


def _signs(*functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The votes of some functions, each given as (yes, known), as a string a row: +, -, or 0 to abstain."""
    code = np.zeros(len(functions[0][0]), dtype=np.int64)
    for yes, known in functions:
        code = code * 3 + np.where(known, np.where(yes, 0, 1), 2)
    return np.array(["".join(v) for v in product("+-0", repeat=len(functions))], dtype=object)[code]


def pair_votes(originals: list[str | None], texts: list[str | None], logged: np.ndarray, words: _Raw, full: list[bool] | None = None) -> tuple[dict[str, np.ndarray], list[bool]]:
    """The votes of each defect's labelling functions on some pairs, and whether each answer declines; of `truncated` only those two that need no other text.

    logged is nan where it is not known; words are those met so far.
    """
    n = len(texts)
    full = np.array([has_content(t) for t in texts] if full is None else full, dtype=bool)
    lows = [(t or "").lower() for t in texts]
    split: list[str] = []
    bounds = [0]
    for low in [(t or "").lower() for t in originals] + lows:
        split += low.split()
        bounds.append(len(split))
    raw, at = np.fromiter(map(words.__getitem__, split), np.int64, len(split)), np.array(bounds)
    sizes = np.diff(at)
    del split
    table = words.array("rows", np.int64).reshape(-1, 5) if len(raw) else np.zeros((0, 5), dtype=np.int64)
    # Words of the raw words, one after another.
    many = table[:, 1][raw]
    to = np.concatenate([[0], np.cumsum(many)])
    flat = words.array("flat", np.int64)
    w = flat[np.repeat(table[:, 0][raw] - to[:-1], many) + np.arange(to[-1])] if to[-1] else np.zeros(0, dtype=np.int64)
    at_w = to[at]
    n_o, n_r = np.diff(at_w)[:n], np.diff(at_w)[n:]

    # Marks of the answers.
    mine = raw[at[n] :]
    brings, pair = table[:, 2][mine], np.zeros(len(mine), dtype=np.int64)
    pair[:-1] = table[:, 3][mine[:-1]] & table[:, 4][mine[1:]]
    any_of = np.zeros((2, n), dtype=np.int64)
    has = np.flatnonzero(sizes[n:])
    if len(has):
        any_of[:, has] = [np.bitwise_or.reduceat(x, at[n:-1][has] - at[n]) for x in (brings, pair)]
    sure = [any_of[0] >> k & 1 == 1 for k in range(3)]
    maybe = [any_of[1] & m != 0 for m in _LISTS.of_list]
    declines = np.zeros(n, dtype=bool)
    for i in np.flatnonzero(full & (sure[0] | maybe[0])).tolist():
        declines[i] = is_refusal(texts[i])
    soft, task = sure[1], sure[2]
    for got, k, marks in ((soft, 1, _SOFT), (task, 2, _TASK)):
        for i in np.flatnonzero(full & maybe[k] & ~got).tolist():
            got[i] = _any(marks, lows[i])

    # Shares of words, of two and of three in a row.
    shared1, shared2, shared3, overlap, kept = np.full((5, n), np.nan)
    two, three = _grams(w, len(words.known))
    long_ = words.array("long", bool)
    seen = np.zeros(len(words.known), dtype=bool)
    edges = at_w.tolist()
    for i, whole in enumerate(full.tolist()):
        a, b, c, d = edges[i], edges[i + 1], edges[n + i], edges[n + i + 1]
        if a == b or c == d:
            continue
        o = w[a:b]
        seen[o] = True
        shared = shared1[i] = np.count_nonzero(seen[w[c:d]]) / (d - c)
        seen[o] = False
        if not whole:
            continue
        if b - a > 2 and d - c > 2:
            tri = set(three[c : d - 2].tolist())
            shared3[i] = len(tri.intersection(three[a : b - 2].tolist())) / len(tri) if shared else 0.0
        if shared < 0.7:  # too far from a copy by its single words: no need to count more
            shared2[i] = overlap[i] = kept[i] = 0.0
            continue
        if d - c > 1:
            duo = set(two[c : d - 1].tolist())
            shared2[i] = len(duo.intersection(two[a : b - 1].tolist())) / len(duo)
        r = w[c:d]
        overlap[i] = _in_both(r, o) / (d - c) if shared >= 0.9 else 0.0  # it never exceeds the share of single words
        r, o = r[long_[r]], o[long_[o]]
        if len(o):
            kept[i] = _in_both(r, o) / len(o)
    ratio = np.full(n, np.nan)
    np.divide(n_r, n_o, out=ratio, where=n_o > 0)

    # Languages by function words.
    tally = np.zeros((2 * n, len(LANGUAGES)))
    if len(w):
        spoken = words.array("spoken", float)
        where = np.flatnonzero(spoken.any(axis=1)[w])
        text_of = np.repeat(np.arange(2 * n), np.diff(at_w))[where]
        for j in range(len(LANGUAGES)):
            tally[:, j] = np.bincount(text_of, spoken[:, j][w[where]], minlength=2 * n)
    lo, lr = _best(tally[:n]), _best(tally[n:])
    lo[declines] = -1  # a refusal counts as one in any language: it answers nothing that could be in the wrong one
    own = np.where(lo >= 0, tally[n:][np.arange(n), lo], 0.0)
    clear = (lo >= 0) & (lr == lo) & (own >= 0.9 * tally[n:].sum(axis=1))  # clear: sentences need not be asked
    wrong, asked, other, told = np.zeros(n, dtype=bool), clear.copy(), np.zeros(n, dtype=bool), clear.copy()
    for i in np.flatnonzero(full & (lo >= 0) & ~clear).tolist():
        here_ = share_by_sentence(texts[i])
        asked[i], wrong[i] = sum(here_.values()) > 0, here_[LANGUAGES[lo[i]]] < 0.5
        po, pr = by_pieces(originals[i]), by_pieces(texts[i])
        told[i], other[i] = po is not None and pr is not None, po != pr

    yes = np.ones(n, dtype=bool)
    is_known = lambda x: ~np.isnan(x)
    votes = {
        "empty": _signs((~full, yes), (n_r <= 2, yes), (logged <= 2, is_known(logged)), ((n_r == 0) | (shared1 == 0), n_o > 0)),
        "refusal": _signs((declines, yes), (ratio < 0.4, is_known(ratio)), (shared3 < 0.02, is_known(shared3)), (soft, yes), (task, yes)),
        "copy": _signs((shared3 >= 0.7, is_known(shared3)), (shared2 >= 0.8, is_known(shared2)), (shared1 >= 0.93, is_known(shared1)), (overlap >= 0.9, is_known(overlap)),
                       (kept >= 0.9, is_known(kept)), ((ratio >= 0.85) & (ratio <= 1.2), is_known(ratio))),
        "language": _signs((wrong, asked), (lo != lr, (lo >= 0) & (lr >= 0)), (other, told), (shared1 < 0.12, is_known(shared1) & ~declines & (n_r >= 8))),  # a few words have no language
        "truncated": _signs((logged > sizes[n:] + 2, is_known(logged)), (ratio < 0.6, is_known(ratio))),
    }
    for k, none in (("refusal", "-----"), ("copy", "------"), ("language", "----"), ("truncated", "--")):
        votes[k][~full] = none
    return votes, declines.tolist()


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the texts: votes that need only the pair, and what is asked about its ending."""
    words, raw = _Words(), _Raw()
    for pdf in batches:
        for i in range(0, len(pdf), ROWS):
            part = pdf.iloc[i : i + ROWS]
            if len(raw) > 500_000:
                raw = _Raw()
            texts = part["rewritten"].tolist()
            full = [has_content(t) for t in texts]
            votes, declines = pair_votes(part["original"].tolist(), texts, part["logged"].to_numpy(dtype=float, na_value=np.nan), raw, full)
            out = as_frame(ask([t if f else None for t, f in zip(texts, full)], words, refuses=declines))
            for k in DEFECTS:
                out[f"v_{k}"] = votes[k]
            out.insert(0, "same", part["same"].to_numpy())
            out.insert(0, "key", part["key"].to_numpy())
            yield out


def pair_votes_of(pairs: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(key, defect, votes) of pairs(key, original, rewritten, logged); corpus(text) is where endings are looked up, by default the pairs' texts."""
    pairs = pairs.where("key IS NOT NULL").select("key", "original", "rewritten", F.col("logged").cast("double").alias("logged"), F.xxhash64("rewritten").alias("same"))
    if corpus is None:
        corpus = pairs.select(F.explode(F.array("original", "rewritten")).alias("text")).where("text IS NOT NULL")
    looked = cut(pairs.mapInPandas(_look, "key long, same long, " + ASKED + "".join(f", v_{k} string" for k in DEFECTS)), "votes")
    open_ = looked.where(F.col("how").isNotNull() & (F.col("how") != COMPLETE)).select("same").distinct()
    asks = pairs.join(open_, "same", "left_semi").select(F.col("rewritten").alias("text")).where("text IS NOT NULL")
    found = evidence(looked, corpus, strict_prefixes(asks, corpus))
    found = found.select("same", F.col("is_cut").alias("is_cut"), "shapes")
    looked = looked.join(found, "same", "left")
    ends = (F.when(F.col("how").isNull() | (F.col("how") == COMPLETE), "---").otherwise(F.concat(
        F.when(F.col("is_cut"), "+").otherwise("-"), F.when(F.col("how") == CUT, "+").otherwise("0"), F.coalesce("shapes", F.lit("0")))))
    votes = F.array(*[F.struct(F.lit(k).alias("defect"), (F.concat(ends, f"v_{k}") if k == "truncated" else F.col(f"v_{k}")).alias("votes")) for k in DEFECTS])
    return looked.select("key", F.explode(votes).alias("v")).select("key", "v.defect", "v.votes")


class LabelModel:
    """The posterior of a defect given a pattern of votes, fitted by expectation-maximization to the counts of patterns.

    Given the class, groups of functions vote independently, the functions of one group jointly, with rates of
    their own; a pattern in which all of a group abstain tells nothing. All functions start alike, a fired one telling
    more than a silent one, and keep this start as a few pseudo pairs, which fixes which class is the defect and keeps the model whole where
    a defect does not occur. No function is trusted: how far each is, the counts decide.
    """

    def __init__(self, counts: dict[str, float], groups: tuple[tuple[int, ...], ...] | None = None, rounds: int = 500, tol: float = 1e-9) -> None:
        patterns = sorted(counts)
        width = max(map(len, patterns), default=0)
        self.groups = groups if groups else tuple((i,) for i in range(width))
        n = np.array([counts[p] for p in patterns], dtype=float)
        self.kinds = [{"".join(v): i for i, v in enumerate(product("+-0", repeat=len(g)))} for g in self.groups]
        start = []
        for g in self.groups:
            one = {k: np.array([r, 1 - r, 0.5]) for k, r in ((1, HIT), (0, NOISE))}
            both = []
            for k in (0, 1):
                t = np.ones(1)
                for _ in g:
                    t = np.outer(t, one[k] / one[k].sum()).ravel()
                both.append(t)
            start.append(np.array(both))
        self.tables, self.prior = [t.copy() for t in start], PRIOR
        codes = self._codes(patterns)
        post = np.zeros(len(patterns))
        for _ in range(rounds if patterns else 0):
            new = self._posterior(codes)
            done = np.abs(new - post).max(initial=0.0) < tol
            post = new
            for j, s in enumerate(start):
                for k, w in ((1, n * post), (0, n * (1 - post))):
                    seen = np.bincount(codes[:, j], w, minlength=s.shape[1]) + WEIGHT * s[k]
                    self.tables[j][k] = seen / seen.sum()
            self.prior = float(np.clip((np.sum(n * post) + WEIGHT * PRIOR) / (n.sum() + WEIGHT), 1e-7, 0.5))
            if done:
                break

    def _codes(self, patterns: list[str]) -> np.ndarray:
        return np.array([[kind["".join(p[i] for i in g)] for g, kind in zip(self.groups, self.kinds)] for p in patterns], dtype=np.int64).reshape(len(patterns), len(self.groups))

    def _posterior(self, codes: np.ndarray) -> np.ndarray:
        odds = np.full(len(codes), np.log(self.prior / (1 - self.prior)))
        for j, t in enumerate(self.tables):
            tells = np.log(t[1]) - np.log(t[0])
            tells[-1] = 0.0  # all abstain
            odds += tells[codes[:, j]]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def posterior(self, patterns: list[str]) -> dict[str, float]:
        return dict(zip(patterns, self._posterior(self._codes(patterns)).tolist()))


def label_model(counts: dict[str, float], groups: tuple[tuple[int, ...], ...] | None = None) -> dict[str, float]:
    """The posterior of the defect for each pattern of votes; counts: how many pairs show it."""
    return LabelModel(counts, groups).posterior(sorted(counts)) if counts else {}


def fitted(votes: DataFrame) -> tuple[dict[str, dict[str, float]], dict[str, LabelModel]]:
    """Counts of the patterns of each defect, and the models. Only counts reach the driver: at most 3 to the power of the functions a defect."""
    seen: dict[str, dict[str, float]] = {}
    for r in votes.groupBy("defect", "votes").agg(F.count("*").alias("n")).collect():
        seen.setdefault(r["defect"], {})[r["votes"]] = r["n"]
    return seen, {d: LabelModel(c, GROUPS[d]) for d, c in seen.items()}


def defects(pairs: DataFrame) -> DataFrame:
    """(key, defect, posterior): every defect of pairs(key long, original, rewritten, logged) whose posterior reaches its cutoff.

    The label model is fitted on the counts of vote patterns of all pairs. A pair may have several defects. Null texts are
    empty answers; a null original leaves copy and language without votes; rows with one key have a defect if any of
    them has it; an empty input gives an empty result.
    """
    votes = cut(pair_votes_of(pairs), "votes")
    seen, models = fitted(votes)
    found = [(d, v, float(p)) for d in sorted(seen) for v, p in models[d].posterior(sorted(seen[d])).items() if p >= CUTOFFS[d]]
    kept = pairs.sparkSession.createDataFrame(found, "defect string, votes string, posterior double")
    got = votes.join(F.broadcast(kept), ["defect", "votes"])  # at most 3 to the power of the functions, for each of five defects
    got = got.groupBy("key").agg(*[F.max(F.when(F.col("defect") == d, F.col("posterior"))).alias(d) for d in DEFECTS])
    got = got.withColumn("language", F.when(F.col("refusal").isNull(), F.col("language")))  # a refusal answers nothing that could be in the wrong language
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior")) for d in DEFECTS]))
    return got.select("key", each.alias("x")).select("key", "x.defect", F.round("x.posterior", 6).alias("posterior")).where("posterior IS NOT NULL")


def model_table(pairs: DataFrame) -> DataFrame:
    """(defect, votes, n, first, posterior, labelled): every pattern of votes, its pairs, the first function's vote and the model's."""
    seen, models = fitted(pair_votes_of(pairs))
    rows = [(d, v, int(n), v[0], float(p), p >= CUTOFFS[d]) for d in sorted(seen) for (v, p), n in zip(models[d].posterior(sorted(seen[d])).items(), [seen[d][v] for v in sorted(seen[d])])]
    return pairs.sparkSession.createDataFrame(rows, "defect string, votes string, n long, first string, posterior double, labelled boolean")


# Answers to plant, in words that the labelling functions do not list as such.
_PLANT_EMPTY = ("", "-", "[pending]", "(no answer)", "(result)", "text")
_PLANT_REFUSAL = ("I would need the author's permission first, so I will leave this text as it is. Sorry.", "Sorry, that is a request I have to turn down.", "Unfortunately, this text is nothing I may reword.",
                  "I'm afraid rewriting this post is off the table for me.", "Leider bleibt mir nur, diese Anfrage abzuweisen.", "Désolé, je préfère laisser ce texte tel quel.", "Lo siento, prefiero dejar este texto como está.")


def _plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch, pairs with a planted defect, by turns: (key, original, rewritten, logged, truth)."""
    for pdf in batches:
        ok = [i for i, (o, r) in enumerate(zip(pdf["original"], pdf["rewritten"])) if o and r and len(o) > 400 and len(r) > 400 and r.rstrip()[-1:] in ".!?" and o.rstrip()[-1:] in ".!?"]
        langs: dict[str | None, list[int]] = {}
        of = {}
        for i in ok:
            of[i] = best(function_words(_words(pdf["rewritten"].iat[i])))
            langs.setdefault(of[i], []).append(i)
        out = []
        for k, i in enumerate(ok):
            o, r, key = pdf["original"].iat[i], pdf["rewritten"].iat[i], int(pdf["key"].iat[i])
            truth, logged = DEFECTS[k % 5], None
            if truth == "empty":
                r = _PLANT_EMPTY[k // 5 % len(_PLANT_EMPTY)]
            elif truth == "refusal":
                r = _PLANT_REFUSAL[k // 5 % len(_PLANT_REFUSAL)]
            elif truth == "copy":  # clauses in another order
                parts = [x for x in o.replace("\n", " ").replace(", ", ". ").split(". ") if x]
                r = ", ".join(parts[1::2] + parts[0::2]) + "."
            elif truth == "language":
                others = [j for lang in LANGUAGES if lang != of[i] for j in langs.get(lang, ())]
                if not others or of[i] is None:
                    continue
                r = pdf["rewritten"].iat[others[key % len(others)]]
            else:
                at = 200 + key % (len(r) - 300)
                while at < len(r) - 2 and not (r[at - 1].isalpha() and r[at - 2].isalpha() and r[at].isalpha()):
                    at += 1
                logged, r = (float(len(r.split())) if key % 2 else None), r[:at]
            out.append((key, o, r, float(len(r.split())) if logged is None and truth != "truncated" else logged, truth))
        yield pd.DataFrame(out, columns=["key", "original", "rewritten", "logged", "truth"])


def cutoff_curve(pairs: DataFrame, cutoffs: tuple[float, ...] = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95)) -> DataFrame:
    """(defect, cutoff, planted, recall, first_recall, other_share): what each cutoff finds of planted defects, and gives to pairs with another one planted.

    The model is fitted on the pairs as they are; the defects are planted into sound ones afterwards, so none of the planted
    answers takes part in the fit. first_recall is what the first labelling function alone finds. Planted refusals are not
    counted for language, where they are not asked.
    """
    spark = pairs.sparkSession
    real = pairs.select("key", "original", "rewritten", F.col("logged").cast("double").alias("logged"))
    _, models = fitted(pair_votes_of(real))
    planted = cut(real.where("key IS NOT NULL").mapInPandas(_plant, "key long, original string, rewritten string, logged double, truth string").dropDuplicates(["key"]), "planted")
    corpus = real.select(F.explode(F.array("original", "rewritten")).alias("text")).where("text IS NOT NULL")
    other = (F.col("truth") != F.col("defect")) & ((F.col("defect") != "language") | (F.col("truth") != "refusal"))
    seen = pair_votes_of(planted, corpus).join(planted.select("key", "truth"), "key").groupBy("defect", "votes").agg(
        F.count_if(F.col("truth") == F.col("defect")).alias("hit"), F.count_if(other).alias("other")).collect()
    rows = []
    for d in DEFECTS:
        mine = [r for r in seen if r["defect"] == d]
        post = models[d].posterior([r["votes"] for r in mine]) if mine and d in models else {}
        hit, rest = sum(r["hit"] for r in mine), sum(r["other"] for r in mine)
        first = sum(r["hit"] for r in mine if r["votes"][0] == "+")
        for c in cutoffs:
            a, b = (sum(r[k] for r in mine if post.get(r["votes"], 0.0) >= c) for k in ("hit", "other"))
            rows.append((d, c, hit, *(round(x / n, 6) if n else None for x, n in ((a, hit), (first, hit), (b, rest)))))
    return spark.createDataFrame(rows, "defect string, cutoff double, planted long, recall double, first_recall double, other_share double")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rewrites").select(F.col("call_id").alias("key"), F.col("original_text").alias("original"), F.col("rewritten_text").alias("rewritten"), F.col("rewritten_len").alias("logged"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects(_pairs(spark, d)).select(F.col("key").alias("call_id"), "defect")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each source and defect: defective calls and their share of the source's calls."""
    calls = table(spark, d, "rewrites").select(F.col("call_id").alias("key"), canon_label("source").alias("source")).groupBy("key").agg(F.min("source").alias("source"))
    sizes = calls.groupBy("source").agg(F.count("*").alias("n_calls"))
    got = defects(_pairs(spark, d)).join(calls, "key").groupBy("source", "defect").agg(F.count("*").alias("n_defective"))
    return got.join(sizes, "source").select("source", "defect", "n_defective", "n_calls", F.round(F.col("n_defective") / F.col("n_calls"), 6).alias("share"))


def p3_model(spark: SparkSession, d: str) -> DataFrame:
    """Every pattern of votes with the first function's vote and the model's label: where they differ, the others decide."""
    return model_table(_pairs(spark, d)).withColumn("posterior", F.round("posterior", 6))


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return cutoff_curve(_pairs(spark, d))
