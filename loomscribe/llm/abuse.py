"""Problem 8: abusive, hateful or sexually explicit language, by nearest labelled sentences.

A text is as bad as its worst sentence. Each sentence is compared with labelled examples by exact TF-IDF
cosine through an inverted index with block maxima: a sentence whose upper bound stays under the least
similarity cannot have a bad neighbour and is left at once; for the others whole blocks of examples are
skipped by their bound, and the rest is scored exactly. The bound needs only the terms that labelled texts have; of the
sentences that pass it, the lengths are made exact by a join of their other terms with the counts of all documents.
Distance-weighted votes of the nearest examples give the score, the nearest bad example the evidence; an isotonic
curve fitted on held-out labelled documents turns the score into a probability.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions.labels import canon_label
from loomscribe.runtime import cut, table

BAD = ("abusive", "hateful", "sexual")
#: At most so many labelled documents of each kind (bad, ok) are used as examples, chosen by hash.
MAX_LABELLED = 2000
LEAST_SIMILARITY = 0.3
NEIGHBOURS = 9
PRIOR_WEIGHT = 0.08
CUTOFF = 0.5
BLOCK = 64
#: Longer sentences are read in parts of so many words, each of which overlaps half of the one before.
SENTENCE_WORDS = 40
#: Parts of the labelled documents of which each is scored by examples from the others.
FOLDS = 5
#: The evidence that a bad example needs is never set higher than this by a high share of bad labels.
MOST_EVIDENCE = 0.8

# Letters of other scripts that look like Latin ones, and signs written for letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһԛѡтмкнвзгΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορτυχνικ", "aeopcyxijsdhqwtmkhb3rABEZHIKMNOPTYXaoptuxvik")
LEET = str.maketrans("@$013457!|€£", "asoieastiiel")
_INVISIBLE = re.compile(r"[­​-‏⁠﻿︀-️]")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_MAY_COMBINE = re.compile("[\u0483-\u1dff\u20d0-\u20ff\u2cef-\ufe2f\U000101fd-\U0001efff]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-_*·]))(?:[^\W\d_]\1){1,}[^\W\d_](?![^\W_])")
#: Every match of _SPACED holds this, which is searched faster: it begins with one of a few signs.
_MAY_SPACE = re.compile(r"([ .\-_*·])[^\W\d_]\1[^\W\d_](?![^\W_])")
_NUMBERED = re.compile(r"(?<=[^\W\d_])\d{2,}$")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_EDGE = ".,;:?\"'“”‘’«»()[]{}<>…_`~#+=–—-"
_STOP = re.compile(r"[.!?]+[\"'”’»)\]*_]*$")


def fold(text: str) -> str:
    """Lower case, without accents, invisible characters, look-alike letters and letter-spacing."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
        if re.search(r"[Ͱ-ӿԀ-ԯ]", text):
            text = text.translate(HOMOGLYPHS)
        text = _ACCENTS.sub("", unicodedata.normalize("NFD", text))
        if _MAY_COMBINE.search(text):
            text = "".join(c for c in text if not unicodedata.combining(c))
    text = text.lower().replace("ß", "ss")
    return _SPACED.sub(lambda m: re.sub(r"[\W_]", "", m.group()), text) if _MAY_SPACE.search(text) else text


def term(raw: str) -> str:
    """The index term of a folded word: signs read as letters, stretched letters and plural s removed; "" for none.

    Masked letters stay as *, for Vocabulary to fill in. Numbers are no terms.
    """
    w = raw.strip(_EDGE).rstrip("!")
    if not w:
        return ""
    if not w.isalpha():
        w = _NUMBERED.sub("", w)  # guest272 is guest
        letters = sum(c.isalpha() for c in w)
        if not letters:
            return ""
        if any(c in "@$013457!|€£" for c in w) and letters * 2 >= len(w):
            w = w.translate(LEET)
        w = re.sub(r"[^\w*]|_", "", w)
        if not w.replace("*", ""):
            return ""
    w = _REPEATED.sub(r"\1", w)
    return w[:-1] if len(w) > 4 and w.endswith("s") and not w.endswith("ss") else w


class Known(dict):
    """Values by key, each made by a function when it is first asked for: a lookup of a known key runs no Python."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        got = self[key] = self.make(key)
        return got


class Tokens:
    """Codes of raw words, kept for the words met so far: index of the term, and whether a sentence ends there.

    -2 is no term. Where a vocabulary is given, a term outside it has a code below -2, and other[-3 - code] is the term.
    packed has 2 * code, and 1 more where a sentence ends.
    """

    def __init__(self, terms: dict[str, int] | None = None, masks: dict[int, list[str]] | None = None) -> None:
        self.terms, self.masks = terms, masks
        self.names: list[str] = []
        self.index: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.packed = Known(self._pack)
        self.other: list[str] = []
        self.other_at: dict[str, int] = {}

    def _pack(self, raw: str) -> int:
        w = term(raw)
        if "*" in w and self.masks is not None:
            w = fill_mask(w, self.masks)
        if not w:
            c = -2
        elif self.terms is None:
            c = self.index.setdefault(w, len(self.index))
            if c == len(self.names):
                self.names.append(w)
        elif (c := self.terms.get(w, -1)) < 0:
            k = self.other_at.setdefault(w, len(self.other))
            if k == len(self.other):
                self.other.append(w)
            c = -3 - k
        return 2 * c + bool(_STOP.search(raw))

    def __call__(self, raw: str) -> tuple[int, bool]:
        p = self.packed[raw]
        return p >> 1, bool(p & 1)

    def spare(self) -> None:
        """To be called between texts: forgets the words met once there are a million."""
        if len(self.packed) > 1_000_000:
            self.reset()


def fill_mask(masked: str, words: dict[int, list[str]]) -> str:
    """The first word that a masked one such as f*ck can stand for, else the masked word itself."""
    pattern = re.compile(re.escape(masked).replace(r"\*", "[a-z]"))
    for length in (len(masked), len(masked) + 1):
        for w in words.get(length, ()):
            if pattern.fullmatch(w if length == len(masked) else w[:-1]):
                return w
    return masked


def parts_of(n: int) -> list[tuple[int, int]]:
    """Starts and ends of the parts of a sentence of n words."""
    half = SENTENCE_WORDS // 2
    return [(0, n)] if n <= SENTENCE_WORDS else [(i, min(n, i + SENTENCE_WORDS)) for i in range(0, n - half, half)]


def sentences(text: str, tokens: Tokens) -> Iterator[tuple[list[int], str]]:
    """(term codes, words) of each sentence or line, long ones in parts."""
    for line in fold(text).split("\n"):
        first = 0
        raw = line.split()
        got = [tokens(w) for w in raw]
        for i, (_, stop) in enumerate(got):
            if stop or i + 1 == len(raw):
                for a, b in parts_of(i + 1 - first):
                    codes = [c for c, _ in got[first + a : first + b] if c != -2]
                    if codes:
                        yield codes, " ".join(raw[first + a : first + b])
                first = i + 1


def _batch_codes(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences or parts of the texts one after another: term codes, the sentence of each code, and the text of each sentence."""
    tokens.spare()
    flat = array("q")
    owner_of_line: list[int] = []
    sizes: list[int] = []
    code_of = tokens.packed.__getitem__
    for k, t in enumerate(texts):
        for line in fold(t).split("\n"):
            raw = line.split()
            if raw:
                flat.extend(map(code_of, raw))
                owner_of_line.append(k)
                sizes.append(len(raw))
    packed = np.frombuffer(flat, dtype=np.int64) if flat else np.zeros(0, np.int64)
    codes, end = packed >> 1, (packed & 1).astype(bool)
    if not len(codes):
        return codes, codes, codes
    end[np.cumsum(sizes) - 1] = True
    owner = np.repeat(owner_of_line, sizes)
    sid = np.concatenate([[0], np.cumsum(end)[:-1]])
    at = np.arange(len(codes))
    counts = np.bincount(sid)
    if counts.max() > SENTENCE_WORDS:
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        places = [(f + a, f + b) for f, n in zip(firsts.tolist(), counts.tolist()) for a, b in parts_of(n)]
        at = np.concatenate([np.arange(a, b) for a, b in places])
        sid = np.repeat(np.arange(len(places)), [b - a for a, b in places])
    starts = _firsts(sid)
    return codes[at], sid, owner[at[starts]]


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins; x is not empty."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]])


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens = Tokens()
    for pdf in batches:
        texts = [t for t in pdf["text"] if t]
        for i in range(0, len(texts), 500):
            codes, sid, owner = _batch_codes(texts[i : i + 500], tokens)
            ok = codes >= 0
            each = np.int64(len(tokens.names) + 1)
            pair = np.sort(sid[ok] * each + codes[ok])
            df = np.bincount(pair[_firsts(pair)] % each, minlength=len(tokens.names)) if len(pair) else np.zeros(0, int)
            seen = np.flatnonzero(df)
            yield pd.DataFrame({"term": [*(tokens.names[j] for j in seen), ""], "df": np.append(df[seen], len(owner))})


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, df): in how many sentences of all documents a term stands; the empty term has the number of sentences."""
    return docs.select("text").where("text IS NOT NULL").mapInPandas(_count_terms, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def document_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, kind): the verdict on each document; bad where at least half of its raters say so, each by their last word.

    Nulls, unsure and unknown verdicts do not count; kind is the most frequent bad verdict, or ok.
    """
    v = labels.select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), canon_label("verdict").alias("verdict"), "labelled_at")
    v = v.where(F.col("verdict").isin("ok", *BAD) & F.col("doc_id").isNotNull())
    v = v.groupBy("doc_id", "rater").agg(F.max_by("verdict", F.struct("labelled_at", "verdict")).alias("verdict"))
    n = v.groupBy("doc_id", "verdict").agg(F.count("*").alias("n"))
    got = n.groupBy("doc_id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("verdict") != "ok", F.col("n")).otherwise(0)).alias("bad"),
                                  F.max_by("verdict", F.when(F.col("verdict") != "ok", F.struct("n", "verdict"))).alias("kind"))
    return got.select("doc_id", F.when(F.col("bad") * 2 >= F.col("all"), F.col("kind")).otherwise(F.lit("ok")).alias("kind"))


class Index:
    """Examples as unit TF-IDF vectors: postings by term, and the largest weight of each term in each block."""

    def __init__(self, weights: np.ndarray, rows: list[list[int]], bad: np.ndarray, kinds: list[str], texts: list[str]) -> None:
        order = np.argsort(~bad, kind="stable")  # bad examples first, so that blocks are nearly pure
        rows, self.bad = [rows[i] for i in order], bad[order]
        self.kinds, self.texts = [kinds[i] for i in order], [texts[i] for i in order]
        self.weights = weights
        ids, terms, values = [], [], []
        for i, row in enumerate(rows):
            t, v = self.vector(row)
            ids.append(np.full(len(t), i))
            terms.append(t)
            values.append(v)
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        ids, terms, values = cat(ids, np.int64), cat(terms, np.int64), cat(values, np.float64)
        self.blocks = -(-len(rows) // BLOCK)
        by_block = np.lexsort((ids, terms))
        self.ids, terms, self.values = ids[by_block], terms[by_block], values[by_block]
        self.at = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.used = np.unique(terms)
        self.local = np.full(len(weights), -1)
        self.local[self.used] = np.arange(len(self.used))
        self.block_max = np.zeros((len(self.used), max(1, self.blocks)))
        np.maximum.at(self.block_max, (self.local[terms], self.ids // BLOCK), self.values)
        n_bad = int(self.bad.sum())
        self.bad_max = np.zeros(len(weights))
        mine = self.ids < n_bad
        np.maximum.at(self.bad_max, terms[mine], self.values[mine])
        self.bad_blocks = -(-n_bad // BLOCK)

    def vector(self, codes, other: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the vocabulary and their weights in the unit vector of a sentence; each term counts once.

        other: the squared weights of the sentence's terms outside the vocabulary.
        """
        codes = np.asarray(codes)
        t = np.unique(codes[codes >= 0])
        w = self.weights[t]
        length = np.sqrt((w**2).sum() + other)
        return t, w / length if length else w

    def neighbours(self, codes, other: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Examples at least LEAST_SIMILARITY near, and their cosine, nearest first; empty where no bad one can be."""
        t, q = self.vector(codes, other)
        inside = self.local[t] >= 0
        t, q = t[inside], q[inside]
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(t):
            return none
        bound = q @ self.block_max[self.local[t]]
        live = bound >= LEAST_SIMILARITY
        if not live[: self.bad_blocks].any():
            return none
        score = np.zeros(self.blocks * BLOCK)
        for term_, weight in zip(t, q):
            a, b = self.at[term_], self.at[term_ + 1]
            ids = self.ids[a:b]
            keep = live[ids // BLOCK]
            score[ids[keep]] += weight * self.values[a:b][keep]
        near = np.flatnonzero(score >= LEAST_SIMILARITY)
        near = near[np.lexsort((near, -score[near]))][:NEIGHBOURS]
        return near, score[near]

    def vote(self, near: np.ndarray, similarity: np.ndarray, prior: float) -> float:
        """Share of bad among the neighbours, each with its squared similarity, and a prior as one faint neighbour."""
        w = similarity**2
        return float((w @ self.bad[near] + PRIOR_WEIGHT * prior) / (w.sum() + PRIOR_WEIGHT))


def bad_share(docs: list[tuple[str, str]], stands_for: tuple[float, float]) -> float:
    """Share of bad among all labelled documents, of which docs (kind, text) are a sample."""
    n_bad = sum(k != "ok" for k, _ in docs)
    bad, ok = n_bad * stands_for[0], (len(docs) - n_bad) * stands_for[1]
    return bad / (bad + ok) if docs else 0.0


def choose_examples(docs: list[tuple[str, str]], tokens: Tokens, weights: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> tuple[list, np.ndarray, list, list]:
    """Examples from labelled documents (kind, text): term codes, whether bad, kind, sentence.

    stands_for: how many labelled documents each bad and each ok one of docs stands for, where docs are a sample.

    A label holds for a whole document, of which most sentences are harmless. A sentence of a bad document is a
    bad example where its terms stand mostly in bad documents; a document with no such sentence (a rater's
    error) gives none. Sentences of ok documents are ok examples where they come near any bad one.
    """
    parts, n_bad, n_ok = [], Counter(), Counter()
    base = max(1e-3, bad_share(docs, stands_for))
    per_bad, per_ok = (x / min(stands_for) for x in stands_for)  # pseudo-counts below stay in documents of the sample
    for kind, text in docs:
        got = list(sentences(text, tokens))
        terms = {c for codes, _ in got for c in codes if c >= 0}
        (n_ok if kind == "ok" else n_bad).update(terms)
        parts.append((kind, got))
    share = np.full(len(weights), base)
    for c in {*n_bad, *n_ok}:
        seen_bad = per_bad * max(0.0, n_bad[c] - 0.6)
        share[c] = (seen_bad + base) / (seen_bad + per_ok * n_ok[c] + 1)

    def evidence(codes: list[int]) -> float:
        t = [c for c in set(codes) if c >= 0]
        w = weights[t] if t else np.zeros(0)
        return float(w @ share[t] / w.sum()) if len(t) else 0.0

    def core(codes: list[int]) -> list[int]:
        """The part from the first to the last telling term, with two words around: a sentence may run into a harmless one."""
        telling = [i for i, c in enumerate(codes) if c >= 0 and share[c] >= 0.5]
        return codes[max(0, telling[0] - 2) : telling[-1] + 3] if telling else codes

    rows, bad, kinds, texts = [], [], [], []
    seen: set[tuple] = set()
    least = max(0.3, min(2 * base / (1 + base), MOST_EVIDENCE))
    for kind, got in parts:
        if kind == "ok":
            continue
        scored = [(evidence(codes), codes, s) for codes, s in got]
        top = max((e for e, _, _ in scored), default=0.0)
        for e, codes, s in scored:
            if e < max(least, 0.7 * top):
                continue
            codes = core(codes)
            if (key := (True, *sorted(set(codes)))) not in seen:
                seen.add(key)
                rows.append(codes)
                bad.append(True)
                kinds.append(kind)
                texts.append(s)
    probe = Index(weights, rows, np.array(bad, dtype=bool), kinds, texts) if rows else None
    for kind, got in parts:
        if kind != "ok" or probe is None:
            continue
        for codes, s in got:
            key = (False, *sorted(set(codes)))
            if key not in seen and len(probe.neighbours(codes)[0]):
                rows.append(codes)
                bad.append(False)
                kinds.append("ok")
                texts.append(s)
                seen.add(key)
    return rows, np.array(bad, dtype=bool), kinds, texts


class Judge:
    """The index of the labelled documents (kind, text), with what is needed to score other texts by it.

    df: in how many sentences of all documents each term of the labelled texts stands; total: all sentences.
    """

    def __init__(self, docs: list[tuple[str, str]], df: dict[str, int], total: int, stands_for: tuple[float, float] = (1.0, 1.0)) -> None:
        names = sorted(df)
        self.index_of = {w: i for i, w in enumerate(names)}
        self.weights = np.array([term_weight(total, df[w]) for w in names] or [1.0])
        self.masks: dict[int, list[str]] = {}
        per_bad = stands_for[1] / stands_for[0]
        term_of = Known(term)
        bad_words = Counter(w for k, t in docs if k != "ok" for w in {term_of[x] for x in fold(t).split()} if w and "*" not in w)
        ok_words = Counter(w for k, t in docs if k == "ok" for w in {term_of[x] for x in fold(t).split()})
        for w, n in sorted(bad_words.items(), key=lambda x: (-x[1] / (x[1] + per_bad * ok_words[x[0]]), -x[1], x[0])):
            if n >= 2 and n > per_bad * ok_words[w] and w.isalpha() and len(w) > 3:
                self.masks.setdefault(len(w), []).append(w)
        rows, bad, kinds, texts = choose_examples(docs, self.tokens(), self.weights, stands_for)
        self.index = Index(self.weights, rows, bad, kinds, texts) if len(rows) else None
        self.prior = bad_share(docs, stands_for)

    def tokens(self) -> Tokens:
        return Tokens(self.index_of, self.masks)

    def candidates(self, texts: list[str], tokens: Tokens) -> list[tuple[int, int, list[int], list[str]]]:
        """(text, sentence, codes, other terms) of the sentences that may have a bad neighbour: the bound takes their other terms for nothing."""
        out: list[tuple[int, int, list[int], list[str]]] = []
        if self.index:  # code -1 is the last place, for all terms outside the vocabulary
            weight, bad_weight = np.append(self.weights, 0.0), np.append(self.weights * self.index.bad_max, 0.0)
        for lo in range(0, len(texts) if self.index else 0, 500):
            codes, sid, owner = _batch_codes(texts[lo : lo + 500], tokens)
            if not len(codes):
                continue
            w, bad = weight[np.maximum(codes, -1)], bad_weight[np.maximum(codes, -1)]
            starts = _firsts(sid)
            # repeated terms make this bound larger, and no sentence is shorter than its heaviest term
            loose = (np.add.reduceat(bad, starts) >= LEAST_SIMILARITY * np.maximum.reduceat(w, starts)) & (np.maximum.reduceat(bad, starts) > 0)
            if not loose.any():
                continue
            # of the sentences that pass it, each term once: codes by sentence, in rising order
            at = np.flatnonzero(loose[sid])
            low, each = codes.min(), np.int64(codes.max() - codes.min() + 1)
            pair = np.sort(sid[at] * each + (codes[at] - low))
            pair = pair[_firsts(pair)]
            mine_of, mine = pair // each, pair % each + low
            w, bad = weight[np.maximum(mine, -1)], bad_weight[np.maximum(mine, -1)]
            starts = _firsts(mine_of)
            ends = np.append(starts[1:], len(mine))
            # the sums are in another order than those of `neighbours`, which decides
            near = np.add.reduceat(bad, starts) >= LEAST_SIMILARITY * np.sqrt(np.add.reduceat(w**2, starts)) - 1e-9
            for a, b in zip(starts[near], ends[near]):
                if not len(self.index.neighbours(mine[a:b])[0]):
                    continue
                s, c = int(mine_of[a]), mine[a:b]
                out.append((lo + int(owner[s]), int(s - np.searchsorted(owner, owner[s])), c[c >= 0].tolist(), sorted(tokens.other[-3 - x] for x in c[c < -2])))
        return out

    def score(self, codes: list[int], other: float) -> tuple[float, str, str, float] | None:
        """(score, kind, example, similarity) of a sentence, or None where no bad example is near."""
        near, sim = self.index.neighbours(np.asarray(codes, dtype=np.int64), other)
        bads = np.flatnonzero(self.index.bad[near]) if len(near) else []
        if not len(bads):
            return None
        best = near[bads[0]]
        return self.index.vote(near, sim, self.prior), self.index.kinds[best], self.index.texts[best], float(sim[bads[0]])


def term_weight(total: float, df: float) -> float:
    return float(np.log((1 + total) / (1 + df)) + 0.05)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, str]], tuple[float, float], list]:
    """At most MAX_LABELLED labelled documents (kind, text) of each kind, how many each stands for, and their ids."""
    chosen = document_labels(labels)
    same = W.partitionBy(F.col("kind") == "ok")
    rank = F.row_number().over(same.orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = chosen.withColumn("_n", F.count("*").over(same)).withColumn("_r", rank).where(F.col("_r") <= MAX_LABELLED).drop("_r")
    sample = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("kind", "text", "doc_id", "_n")  # at most 2 MAX_LABELLED rows
    rows = sorted(tuple(r) for r in sample.dropDuplicates(["doc_id"]).collect())
    all_bad, all_ok = (max((n for k, _, _, n in rows if (k == "ok") == ok), default=1) for ok in (False, True))
    return [(k, t) for k, t, _, _ in rows], (max(1.0, all_bad / MAX_LABELLED), max(1.0, all_ok / MAX_LABELLED)), [i for _, _, i, _ in rows]


def labelled_counts(counts: DataFrame, sample: list[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """The counts of the terms of the labelled sample, and the number of all sentences; no other terms reach the driver."""
    own = Tokens()
    for _, t in sample:
        for _ in sentences(t, own):
            pass
    total = counts.where("term = ''").agg(F.sum("df")).first()[0] or 0
    mine = counts.sparkSession.createDataFrame([(w,) for w in own.names], "term string")
    return {r["term"]: r["df"] for r in counts.join(F.broadcast(mine), "term", "left_semi").where("term <> ''").collect()}, total  # the bounded sample's terms


def isotonic(raw: np.ndarray, bad: np.ndarray) -> list[tuple[float, float]]:
    """Knots (score, probability) of the rising curve nearest to the observed shares, by pooling neighbours that fall."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # sum of scores, sum of bad, n
    for x, y in zip(raw[order], bad[order]):
        pools.append([float(x), float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return [(a / n, b / n) for a, b, n in pools]


def held_out(spark: SparkSession, sample: list[tuple[str, str]], df: dict[str, int], total: int, stands_for: tuple[float, float], folds: int = FOLDS) -> pd.DataFrame:
    """(bad, score) of every labelled document, scored by examples from the other folds only, one fold a task.

    Terms outside the other folds' texts count with the weight of a term never seen.
    """
    rows = spark.createDataFrame(sample, "kind string, text string").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["fold"].iat[0])
        all_ = list(zip(pdf["kind"], pdf["text"]))
        train, test = [x for x in all_ if hash_fold(x[1], folds) != f], [x for x in all_ if hash_fold(x[1], folds) == f]
        names = Tokens()
        for _, t in train:
            for _ in sentences(t, names):
                pass
        judge = Judge(train, {w: df[w] for w in names.names if w in df}, total, stands_for)
        got = np.zeros(len(test))
        for k, _, codes, other in judge.candidates([t for _, t in test], judge.tokens()):
            hit = judge.score(codes, sum(term_weight(total, df.get(w, 0)) ** 2 for w in other))
            got[k] = max(got[k], hit[0]) if hit else got[k]
        return pd.DataFrame({"bad": [k != "ok" for k, _ in test], "score": got})

    if not sample:
        return pd.DataFrame({"bad": np.zeros(0, bool), "score": np.zeros(0)})
    return rows.repartition(folds, "fold").groupBy("fold").applyInPandas(run, "bad boolean, score double").toPandas()


def hash_fold(text: str, folds: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) % folds


def scores(docs: DataFrame, labels: DataFrame, calibrate: bool = False) -> DataFrame:
    """(doc_id, score, kind, sentence, example, similarity) of docs(doc_id, text); with calibrate also probability.

    score is 0..1; kind, sentence and example are the evidence: the worst sentence and its nearest bad example.
    Null and empty texts score 0 without evidence, and so do all texts where nothing is labelled bad. Term counts are
    made over all documents, and every term of a sentence counts with its own; examples come from at most MAX_LABELLED
    labelled documents of each kind, which are weighted to the numbers of all labelled documents. Rows with one doc_id have
    the highest score of them.
    """
    spark = docs.sparkSession
    counts = cut(term_counts(docs), "terms")
    sample, stands_for, _ = labelled_sample(docs, labels)
    df, total = labelled_counts(counts, sample)
    judge = Judge(sample, df, total, stands_for)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = judge.tokens()
        for pdf in batches:
            ids, hashes = pdf["doc_id"].tolist(), pdf["text_hash"].tolist()
            got = [(ids[k], hashes[k], s, codes, other) for k, s, codes, other in judge.candidates([t or "" for t in pdf["text"]], tokens)]
            yield pd.DataFrame(got, columns=["doc_id", "text_hash", "sentence", "codes", "other"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = cut(rows.mapInPandas(find, f"doc_id {kind}, text_hash long, sentence int, codes array<int>, other array<string>"), "candidates")
    by = ["doc_id", "text_hash", "sentence"]
    weight = F.log((1.0 + F.lit(float(total))) / (1.0 + F.coalesce(F.col("df"), F.lit(0)))) + 0.05
    terms = found.select(*by, F.explode("other").alias("term")).distinct()
    lengths = terms.join(counts, "term", "left").groupBy(*by).agg(F.sum(weight * weight).alias("rest"))
    exact = found.join(lengths, by, "left").select(*by, "codes", F.coalesce("rest", F.lit(0.0)).alias("rest"))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, s, codes, rest in zip(pdf["doc_id"], pdf["sentence"], pdf["codes"], pdf["rest"]):
                hit = judge.score(codes, rest)
                if hit:
                    out.append((i, s, *hit))
            yield pd.DataFrame(out, columns=["doc_id", "sentence", "score", "kind", "example", "similarity"])

    rated = exact.mapInPandas(rate, f"doc_id {kind}, sentence int, score double, kind string, example string, similarity double")
    worst = rated.groupBy("doc_id").agg(F.max_by(F.struct("score", "kind", "sentence", "example", "similarity"), F.struct("score", -F.col("sentence"), "similarity", "example")).alias("w"))
    got = docs.select("doc_id").join(worst, "doc_id", "left").select(
        "doc_id", F.round(F.coalesce("w.score", F.lit(0.0)), 6).alias("score"), "w.kind", "w.sentence", "w.example", F.round("w.similarity", 6).alias("similarity"))
    if not calibrate:
        return got
    seen = held_out(spark, sample, df, total, stands_for)
    knots = isotonic(seen["score"].to_numpy(), seen["bad"].to_numpy(dtype=float)) or [(0.0, 0.0)]
    x, y = [k[0] for k in knots], [k[1] for k in knots]
    p = F.lit(y[0])
    for a, b, u, v in zip(x, x[1:], y, y[1:]):
        p = F.when(F.col("score") >= b, v).when(F.col("score") > a, u + (F.col("score") - a) / (b - a) * (v - u)).otherwise(p) if b > a else p
    return got.withColumn("probability", F.round(p, 6))


def reliability(docs: DataFrame, labels: DataFrame, bins: int = 5) -> DataFrame:
    """(low, high, n, mean_score, bad_share, recall, precision): held-out labelled documents by bins of their score.

    Every document is scored by examples from other folds. recall and precision are those of CUTOFF over all bins, against the
    verdicts as they are, raters' errors included.
    """
    counts = cut(term_counts(docs), "terms")
    sample, stands_for, _ = labelled_sample(docs, labels)
    df, total = labelled_counts(counts, sample)
    seen = held_out(docs.sparkSession, sample, df, total, stands_for)
    hit, bad = (seen["score"] >= CUTOFF).to_numpy(), seen["bad"].to_numpy(dtype=bool)
    recall, precision = (float((hit & bad).sum() / n) if n else None for n in (bad.sum(), hit.sum()))
    rows = []
    for k in range(bins):
        mine = seen[(seen["score"] >= k / bins) & ((seen["score"] < (k + 1) / bins) | (k + 1 == bins))]
        if len(mine):
            rows.append((k / bins, (k + 1) / bins, len(mine), round(float(mine["score"].mean()), 6), round(float(mine["bad"].mean()), 6), recall, precision))
    return docs.sparkSession.createDataFrame(rows, "low double, high double, n long, mean_score double, bad_share double, recall double, precision double")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "review_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("score") >= CUTOFF).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with score, evidence, and the probability by the calibration curve."""
    return scores(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "review_labels"), calibrate=True)


def p8_reliability(spark: SparkSession, d: str) -> DataFrame:
    return reliability(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "review_labels"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: documents, bad documents, their rate and the mean score."""
    source = table(spark, d, "documents").select("doc_id", canon_label("source").alias("source"))
    got = source.join(_scores(spark, d), "doc_id", "left").groupBy("source")
    got = got.agg(F.count("*").alias("n_docs"), F.count_if(F.col("score") >= CUTOFF).alias("n_bad"), F.round(F.avg("score"), 6).alias("mean_score"))
    return got.select("*", F.round(F.col("n_bad") / F.col("n_docs"), 6).alias("bad_rate"))
