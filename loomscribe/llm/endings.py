"""How a text ends: rules for closed and broken endings, and what is left open for evidence from other texts."""

from __future__ import annotations

import re

# Marks that stand where text was left out, and abbreviations that never end a sentence.
OMISSION = re.compile(r"(?:\[\s*(?:…|\.{3}|truncated|cut|continued|gekürzt|tronqué|truncado|cortado)\s*\]|\(\s*(?:…|\.{3})\s*\)|…|\.{3})\s*$", re.I)
ABBREVIATION = re.compile(
    r"(?:^|[\s(\[])(?:e\. ?g|i\. ?e|vs|incl|excl|approx|esp|resp|cf|viz|z\. ?b|d\. ?h|u\. ?a|bzw|inkl|ggf|ca|p\. ?ex|c\. ?-?à-?d|env|p\. ?ej|aprox|dr|mr|mrs|prof|sr|sra|no|nr|núm|fig|vol)\.$", re.I)
PLACEHOLDER_WORDS = {"none", "null", "n/a", "na", "nan", "nil", "empty", "tbd", "todo", "undefined", "no text", "no content", "no output", "placeholder", "leer", "vide", "vacío"}

BLANK = re.compile(r"[\s​‌‍⁠﻿]+")
EDGE = "​‌‍⁠﻿ \t\r\n\f\v   "
MARKER = re.compile(r"^\s*(?:>\s*)*(?:[-*+•–]\s+|\d{1,3}[.)]\s+|#{1,6}\s+)*")
TERMINAL = re.compile(r"[.!?。！？]+[\"'”’»)\]*_`]*$")
URL_END = re.compile(r"(?:https?://|www\.)[^\s/()\[\]]+\.[a-z]{2,}(?:/\S*)?$", re.I)
TAG_LINE = re.compile(r"^(?:#\w[\w-]*\s*)+$")
EMOJI_END = re.compile(r"[\U0001F300-\U0001FAFF☀-➿️]$")
BROKEN_TAG = re.compile(r"<[a-zA-Z/!][^<>\n]{0,200}$")
BROKEN_ENTITY = re.compile(r"\w&#?\w{0,8}$")
BROKEN_CHARS = re.compile(r"(?:�|[ÂÃâÄÅ])$")

_TAG = re.compile(r"<[^<>]{0,40}>")
_WORDS = re.compile(r"[^\W\d_]{2,}")

COMPLETE, CUT, OPEN = "complete", "cut", "open"
SEPARATOR = re.compile(r"[|\s:-]+")
_ENTITY = re.compile(r"&#?\w{0,8}$")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$")
_NUMBERED = re.compile(r"\d{1,3}[.)]$")
# Codes of the mark that a word ends with; those below 8 close a sentence, link or piece of markup, 0 is none.
_OPENERS = ",;:-–—(/&"


def mark_of(raw: str) -> int:
    """Which mark a raw word ends with, as a code: 1 to 7 close something, from 8 on they do not, 0 is a mere word."""
    if raw.isalnum():
        return 0
    if TERMINAL.search(raw):
        return 8 if is_abbreviation(raw) else 1
    if raw[-1] in _OPENERS:
        return 16 + _OPENERS.index(raw[-1])
    if BROKEN_CHARS.search(raw) or _ESCAPE.search(raw):
        return 9
    if _ENTITY.search(raw) and not raw.startswith(("http", "www.")):
        return 10
    if URL_END.search(raw):
        return 2
    if raw[0] == "#" and len(raw) > 1 and raw[1].isalnum():
        return 3
    if EMOJI_END.search(raw):
        return 4
    return 5 if raw.endswith((")", "]", "**", ">", "|", "`")) else 0


def kind_of_line(first: str) -> int:
    """0 prose, 1 list item, 2 heading, 3 table row, 4 quotation, by the first raw word of a line."""
    if first[0].isalpha():
        return 0
    if first[0] == "|":
        return 3
    if first[0] == ">":
        return 4
    if first.strip("#") == "":
        return 2
    return 1 if first in ("-", "*", "+", "•", "–") or _NUMBERED.fullmatch(first) else 0


def without_omission(text: str) -> str:
    """The text without a mark of omission at its end."""
    t = text.strip(EDGE)
    left_out = OMISSION.search(t, max(0, len(t) - 40))
    return t[: left_out.start()].rstrip(EDGE) if left_out else t


def has_content(text: str | None) -> bool:
    """False for null and blank texts and for placeholders such as N/A, {}, [], <p></p>, (empty), ##."""
    if not text:
        return False
    start = text[:120]
    if "<" not in start and sum(len(w) > 1 and w.isalpha() for w in start.split()) >= 6:
        return True
    if len(_WORDS.findall(_TAG.sub(" ", text[:400]))) >= 6:
        return True
    bare = BLANK.sub(" ", _TAG.sub(" ", text)).strip(" .,:;!?-–—_*#|()[]{}<>`\"'“”«»…~=+/\\")
    if not bare or not any(c.isalnum() for c in bare):
        return False
    return bare.lower() not in PLACEHOLDER_WORDS


def is_abbreviation(line: str) -> bool:
    return bool(ABBREVIATION.search(line[-24:]))


def ending(text: str) -> str:
    """complete, cut, or open, of a text with content; open endings lack punctuation and need evidence."""
    t = text.strip(EDGE)
    left_out = OMISSION.search(t, max(0, len(t) - 40))
    if left_out:
        base = t[: left_out.start()].rstrip(EDGE).rsplit("\n", 1)[-1][-200:]
        return COMPLETE if not base or (TERMINAL.search(base) and not is_abbreviation(base)) else CUT
    line = t.rsplit("\n", 1)[-1].strip(EDGE)
    if t.count("```") % 2 or BROKEN_CHARS.search(t, max(0, len(t) - 4)):
        return CUT
    if line.startswith("|"):
        before = t.rsplit("\n", 2)[-2].strip() if t.count("\n") else ""
        if not line.endswith("|") or re.fullmatch(r"[|\s:-]+", line):
            return CUT
        return CUT if before.startswith("|") and before.count("|") != line.count("|") else COMPLETE
    if line.startswith("```"):
        return COMPLETE
    if line.count("`") % 2 or line.count("**") % 2 or line.count("(") > line.count(")") or line.count("[") > line.count("]"):
        return CUT
    end = line[-240:]
    if BROKEN_TAG.search(end) or BROKEN_ENTITY.search(end[-16:]):
        return CUT
    if TERMINAL.search(end[-16:]):
        return CUT if is_abbreviation(end.rstrip("\"'”’»)]*_`")) else COMPLETE
    if TAG_LINE.match(line) or URL_END.search(line) or EMOJI_END.search(end):
        return COMPLETE
    if line.endswith((")", "]", "**", ">", "|", "`")):
        return COMPLETE
    body = MARKER.sub("", line)
    if not body or body in "-*+•" or line.endswith((",", ";", ":", "-", "–", "—", "(", "/", "&")):
        return CUT
    return OPEN


def norm(word: str) -> str:
    return word.strip(".,;:!?…\"'“”‘’«»()[]{}*_`~<>|#").lower()


def tail(text: str) -> tuple[str, str, str]:
    """The last three words of the last line, the line's start as ^; the last may be cut inside."""
    line = text.strip(EDGE).rsplit("\n", 1)[-1]
    words: list[str] = []
    for raw in MARKER.sub("", line).split():
        w = norm(raw)
        if w:
            words.append(w)
        if TERMINAL.search(raw) and not is_abbreviation(raw):
            words.clear()
    got = ["^", "^", *words][-3:]
    return got[0], got[1], got[2] if words else ""


def last_words(text: str) -> list[str]:
    """The normal forms of the words of the last line, list and heading marks dropped."""
    raw = text.strip(EDGE).rsplit("\n", 1)[-1].split()
    while raw and not norm(raw[0]):
        raw.pop(0)
    return [norm(w) for w in raw]


def mask(word: str) -> str:
    """X for names and addresses, 0 for numbers, else the word's normal form."""
    return "0" if any(c.isdigit() for c in word) else "X" if word[:1].isupper() or "://" in word else norm(word)


def skeleton(text: str) -> str:
    """The last line with names, numbers and addresses masked: the form of a sign-off."""
    words = MARKER.sub("", text.strip(EDGE).rsplit("\n", 1)[-1]).split()
    return " ".join([norm(words[0]) or "-"] + [mask(w) or "-" for w in words[1:]]) if words else ""
