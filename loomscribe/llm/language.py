"""Language of short texts by function words: English, German, French, Spanish."""

from __future__ import annotations

import re
from collections import Counter

# Frequent function words that few other languages of the four share.
FUNCTION_WORDS = {
    "en": "the of and to in that for with on at by from is are was be this their they it its not but have has as when why before after while which would could should there about into over your you we our what who than so".split(),
    "de": "der die das und ist nicht mit den dem von zu auf für im ein eine einen einem einer des sich auch es bei aus nach wie werden wird sind oder aber wenn weil wir ihre ihren ihrer über vor zwischen am zum zur um bis durch ohne gegen noch nur".split(),
    "fr": "le la les des et est une dans pour avec sur qui que par au aux du ne pas plus sont ce cette ces leurs leur ont pendant après avant sans mais ou où nous vous être fait entre deux chaque depuis si son sa ses il elle".split(),
    "es": "el la los las y es una un en para con por que del al no más son este esta estos sus su se como pero sin sobre entre desde hasta cuando porque antes después cada muy ha han lo le nos si ya también fue nuestros".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
#: Of each function word, the places of its languages.
FUNCTION_WORD_OF: dict[str, tuple[int, ...]] = {}
for _i, _l in enumerate(LANGUAGES):
    for _w in FUNCTION_WORDS[_l]:
        FUNCTION_WORD_OF[_w] = (*FUNCTION_WORD_OF.get(_w, ()), _i)
_PIECES = {
    "en": ("th", "ing ", "ed ", "wh", "sh", " a ", "ow", "ly "),
    "de": ("sch", "ung", "ch ", "ei", "en ", "ä", "ü", "ß"),
    "fr": ("eau", "é", "è", "ux ", "qu'", "l'", "d'", "oi"),
    "es": ("ción", "ñ", "os ", "as ", "í", "ó", "ue", "ar "),
}
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"\w+")


def votes(words: list[str] | Counter) -> list[float]:
    """Function words of each language in words, or in counts of words; a word of several languages counts in parts."""
    got = [0.0] * len(LANGUAGES)
    counts = words if isinstance(words, Counter) else Counter(words)
    if len(counts) < len(FUNCTION_WORD_OF):
        for w, n in counts.items():
            if w in FUNCTION_WORD_OF:
                v = FUNCTION_WORD_OF[w]
                for i in v:
                    got[i] += n / len(v)
        return got
    for w, v in FUNCTION_WORD_OF.items():
        if w in counts:
            for i in v:
                got[i] += counts[w] / len(v)
    return got


def best(got: list[float], least: float = 2.0) -> str | None:
    """The language with the most votes, or None where there are too few or it is a tie."""
    order = sorted(got, reverse=True)
    return LANGUAGES[got.index(order[0])] if order[0] >= least and order[0] > order[1] else None


def language(text: str | None, least: float = 2.0) -> str | None:
    return best(votes(_WORD.findall(text.lower())), least) if text else None


def by_pieces(text: str) -> str | None:
    """The language whose typical letter groups are most frequent."""
    low = text.lower()
    got = [float(sum(low.count(p) for p in _PIECES[x])) for x in LANGUAGES]
    return best(got, 3.0)


def share_by_sentence(text: str) -> dict[str, float]:
    """Share of the words in sentences of each language, among sentences whose language is clear."""
    got = dict.fromkeys(LANGUAGES, 0.0)
    for s in _SENTENCE.split(text.lower()):
        words = _WORD.findall(s)
        tally = [0.0] * len(LANGUAGES)
        for v in filter(None, map(FUNCTION_WORD_OF.get, words)):
            for i in v:
                tally[i] += 1 / len(v)
        lang = best(tally, 1.0)
        if lang:
            got[lang] += len(words)
    total = sum(got.values())
    return {k: v / total for k, v in got.items()} if total else got
