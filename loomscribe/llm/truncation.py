"""Problem 2: texts that stop before their end, by self-joins by prefix.

Whole values: hashes of prefixes of fixed lengths choose the values that may be a prefix of another; these are
sorted, and a value is a strict prefix of a longer copy exactly where the next one in order begins with it. A cut
text seldom has a longer copy as a whole, so the same join is made on endings: the last word is looked up, as a prefix,
among all words of the corpus that stand after the same two words, the same word, or anywhere; the last line is
looked up among all lines that begin with it; and the shape of the ending (open markup, the mark it ends with, or
the kind of line and how far its sentence has come) among all places of that shape. Where the longer copies go on and
hardly ever end there, the text was cut. Every row carries the evidence that decided it. The rules of endings.py only
leave out texts that end in a closed way; `rules=False` asks the join about every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions.labels import canon_label
from loomscribe.llm.endings import (
    COMPLETE, OPEN, SEPARATOR, TERMINAL, ending, has_content, is_abbreviation, kind_of_line, last_words, mark_of, mask, norm, skeleton, tail, without_omission)
from loomscribe.llm.refusals import is_refusal
from loomscribe.runtime import cut, table

#: Lengths of the prefixes whose hashes choose candidates: 4, 16, 64, ... characters, up to the value's own length.
SHORTEST, GROWTH = 4, 4
#: Texts counted at once, and rows of counts that a task holds before it passes them on.
CHUNK, HELD_ROWS = 2500, 600_000
#: A tail, line or shape that ends lines at least this often, among all its copies, may end a text.
END_SHARE = 0.2
#: A last line whose form ends at least so many texts, and at least that share of all lines that begin like it.
SIGN_OFFS, SIGN_OFF_SHARE = 5, 0.5
#: A last line of two to LINE_WORDS words is complete when it stands whole inside at least LINES texts, and that share of
#: the lines of its kind that begin with it: a cut never leaves a line inside a text.
LINE_WORDS, LINES, LINE_SHARE = 8, 2, 0.01
# What the counts of `windows` are about.
AFTER_TWO, AFTER_ONE, ANYWHERE, LINE, HEAD, SHAPE, GROUP, FORM = 2, 1, 0, 3, 4, 5, 6, 7
# Codes of shapes: below PLAIN the ending has a mark or open markup, from PLAIN on it is a mere word.
FENCE, TABLE_RULE, TABLE, MARKUP, MARK, PLAIN = 1, 2, 8, 64, 128, 256


class _Words(dict):
    """The code of each raw word met so far, with what is known of it by code: hashes, end mark, markup, and what it makes of its line."""

    def __init__(self) -> None:
        self.hash: list[int] = []
        self.ends: list[bool] = []
        self.text: list[str] = []
        self.mask: list[int] = []
        self.mark: list[int] = []
        self.markup: list[tuple[int, int, int, int, int, int, int]] = []
        self.bar: list[bool] = []
        self.line: list[tuple[int, bool, int, int, bool]] = []
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
        import xxhash

        w = norm(raw)
        c = self[raw] = len(self.hash)
        self.hash.append(xxhash.xxh64_intdigest(w) if w else 0)
        self.ends.append(not raw.isalnum() and bool(TERMINAL.search(raw)) and not is_abbreviation(raw))
        self.text.append(w)
        self.mask.append(xxhash.xxh64_intdigest(mask(raw)))
        self.mark.append(mark_of(raw))
        self.bar.append(raw.endswith("|"))
        self.line.append((kind_of_line(raw), not w, raw.count("|"), raw.count("```"), bool(raw.strip("|:-"))))
        if raw.isalnum():
            self.markup.append((0, 0, 0, 0, 0, 0, 0))
        else:
            opens, closes = raw.rfind("<"), raw.rfind(">")
            tag = 1 if opens > closes and raw[opens + 1 : opens + 2].isascii() and raw[opens + 1 : opens + 2].strip("0123456789=- ") else -1 if closes >= 0 else 0
            self.markup.append((raw.count("**"), raw.count("`"), raw.count("(") - raw.count(")"), raw.count("[") - raw.count("]"), tag, raw.count("|"), raw.count("```")))
        return c


_START = 0x5BD1E995_9E3779B9
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def context_hash(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = two * _M1 + (one ^ _M2) * _M2
        return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    import xxhash

    return _START if word == "^" else xxhash.xxh64_intdigest(word)


def line_hashes(h: np.ndarray, place: np.ndarray, first: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """At each word the hash of its line so far and of its kind; place counts words in the line, first is the line's first index."""
    p = place.astype(np.uint64) + np.uint64(1000) * kind.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(29))) * (_M1 * (np.uint64(2) * p + np.uint64(1)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x ^ (x >> np.uint64(32)), dtype=np.uint64)])
        return sums[1:] - sums[first]


class Places:
    """All words of some texts, one after another, with line, sentence and markup around each."""

    def __init__(self, texts: list[str], words: _Words) -> None:
        stop = "\x01"  # a word for the end of a line, which no text has
        while any(stop in t for t in texts):
            stop += "\x01"
        raws: list[str] = []
        sizes: list[int] = []
        for t in texts:
            raws += t.replace("\n", f" {stop} ").split()
            raws.append(stop)
            sizes.append(len(raws))
        end, c = words[stop], np.fromiter(map(words.__getitem__, raws), np.int64, len(raws))
        del raws
        known = words.array("line", np.int64).reshape(-1, 5)  # by code: kind of a line that begins so, no normal form, bars, fences, other than bars and rules
        stops = np.flatnonzero(c == end)
        starts = np.concatenate([[0], stops[:-1] + 1])
        number = np.flatnonzero(stops > starts)  # of the lines that are not blank
        starts, stops = starts[number], stops[number]
        text_of = np.searchsorted(sizes, stops, side="right")
        total = lambda what: np.concatenate([[0], np.cumsum(known[:, what][c])])
        kinds = known[:, 0][c[starts]]
        bars, fences, cells, rule = total(2), np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=bool)
        tables = np.flatnonzero(kinds == 3)
        if len(tables):
            cells[tables] = bars[stops[tables]] - bars[starts[tables]]
            other = total(4)
            rule[tables] = other[stops[tables]] == other[starts[tables]]
        again = np.concatenate([[False], text_of[1:] == text_of[:-1]])  # not the first line of its text
        self.rules = int(np.count_nonzero(rule[:-1] & again[1:]))
        if known[:, 3].any():
            fences = total(3)[starts]
            fences -= fences[np.maximum.accumulate(np.where(again, 0, np.arange(len(starts))))]
        before = np.zeros(len(starts), dtype=np.int64)
        before[1:] = np.where(again[1:] & (number[1:] == number[:-1] + 1), cells[:-1], 0)
        real = np.flatnonzero(known[:, 1][c] == 0)  # the others are list marks, heading marks
        begin = np.append(real, len(c))[np.searchsorted(real, starts)]
        some = np.flatnonzero(~rule & (begin < stops))
        starts, stops, begin, kinds, text_of, before, fences = (x[some] for x in (starts, stops, begin, kinds, text_of, before, fences))
        pipes = bars[begin] - bars[starts]
        many = stops - begin
        self.words, self.n = words, int(many.sum())
        if not self.n:
            return
        self.stops = np.cumsum(many) - 1
        self.starts, self.text_of = self.stops + 1 - many, text_of
        self.c = c = c[np.repeat(begin - self.starts, many) + np.arange(self.n)]
        self.final = self.stops[np.append(text_of[1:] != text_of[:-1], True)]
        self.h = words.array("hash", np.uint64)[c]
        self.mark = words.array("ends", bool)[c]
        mark = words.array("mark", np.int64)[c]
        self.line = line = np.repeat(np.arange(len(self.starts)), self.stops - self.starts + 1)
        self.first = first = self.starts[line]
        self.at = at = np.arange(len(c))
        self.end = self.mark.copy()
        self.end[self.stops] = True
        self.start = np.zeros(len(c), dtype=bool)
        self.start[self.starts] = True
        self.start[1:] |= self.end[:-1]
        # The final word of a text tells nothing where it has no end mark: that is what is asked.
        self.unsure = np.zeros(len(c), dtype=bool)
        self.unsure[self.final] = ~(self.mark[self.final] | ((mark[self.final] > 0) & (mark[self.final] < 8)))
        self.kind = kind = kinds[line]
        fences_, cells = fences[line], pipes[line]
        flags = np.zeros(len(c), dtype=np.int64)
        table = words.array("markup", np.int64)
        some = np.logical_or.reduceat(table.any(axis=1)[c], self.starts)
        where = np.flatnonzero(some[line])  # the words of the few lines with any markup
        if len(where):
            markup = table[c[where]]
            own = np.searchsorted(where, first[where])
            sums = np.concatenate([np.zeros((1, 7), np.int64), np.cumsum(markup, axis=0)])
            run = sums[1:] - sums[own]
            event = np.maximum.accumulate(np.where(markup[:, 4] != 0, np.arange(len(where)), -1))
            tag = (event >= own) & (markup[np.maximum(event, 0), 4] > 0)
            flags[where] = (run[:, 0] % 2) + 2 * (run[:, 1] % 2) + 4 * (run[:, 2] > 0) + 8 * (run[:, 3] > 0) + 16 * tag
            cells[where] += run[:, 5]
            fences_[where] += run[:, 6]
        fence = fences_ % 2 == 1
        wide = before[line]
        closed = words.array("bar", bool)[c]
        # Words of the sentence so far, and whether one ended before it in the line.
        stop = np.maximum.accumulate(np.where(np.concatenate([[False], self.mark[:-1]]), at, -1))
        later = stop > first
        far = np.minimum(at - np.where(later, stop, first) + 1, 20)
        shape = np.where(mark > 0, MARK + mark, PLAIN + 64 * kind + 32 * later + far)
        shape = np.where(flags > 0, MARKUP + flags, shape)
        shape = np.where(kind == 3, TABLE + closed + 2 * (cells < wide), shape)
        self.shape = np.where(fence, FENCE, shape)
        # Inside a fence, and after a mark that promises more, only the end of the text counts: lines end there anyway.
        self.over = np.where(fence | (mark >= 8), False, self.end)
        self.over[self.final] = True

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The two words and the one word before each, none across the start of a line or sentence."""
        caret = np.uint64(_START)
        one = np.where(self.start, caret, np.concatenate([[caret], self.h[:-1]]))
        return np.where(self.start, caret, np.concatenate([[caret], one[:-1]])), one


def coarse(shape: np.ndarray) -> np.ndarray:
    """Groups of shapes, for a shape that stands nowhere else: open, ends with a closing mark, ends with any other or none."""
    closing = (shape > MARK) & (shape < MARK + 8)
    return np.where(shape < MARK, 1, np.where(closing, 2, 3))


def _counted(level: int, ctx: np.ndarray, goes_on: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    got = pd.DataFrame({"ctx": ctx.view(np.int64), "goes_on": goes_on.astype(np.int64), "ends": ends.astype(np.int64)}).groupby("ctx", as_index=False, sort=False).sum()
    return got.assign(level=np.int32(level), word="")[["level", "ctx", "word", "goes_on", "ends"]]


def window_counts(texts: list[str], words: _Words, wanted: np.ndarray | None = None) -> pd.DataFrame:
    """(level, ctx, word, goes_on, ends) of all places in the texts, but for final words without an end mark.

    wanted: the bit map of the contexts that are asked about; places of others are left out of the first five levels, but for ANYWHERE.

    AFTER_TWO, AFTER_ONE, ANYWHERE: a word after two words, one word or any; LINE: a beginning of up to LINE_WORDS words of
    a line, ends counts the texts where it is the whole line; HEAD: in how many texts two words, names and numbers masked,
    begin a line or sentence; SHAPE and GROUP: places of a shape.
    """
    x = Places(texts, words)
    if not x.n:
        return pd.DataFrame({"level": [], "ctx": [], "word": [], "goes_on": [], "ends": []})
    two, one = x.contexts()
    out = []
    zero = np.zeros(x.n, dtype=np.uint64)
    asked = lambda ctx: np.ones(len(ctx), dtype=bool) if wanted is None else wanted[ctx & np.uint64(BITS - 1)]
    every = (x.h != 0) & ~x.unsure
    for level, ctx in ((AFTER_TWO, context_hash(two, one)), (AFTER_ONE, context_hash(zero, one)), (ANYWHERE, zero)):
        keep = every if level == ANYWHERE else every & asked(ctx)
        if not keep.any():
            continue
        kept = np.flatnonzero(keep)
        if level == ANYWHERE:  # raw words are counted, then those of one normal form are put together
            total, ends = np.bincount(x.c[kept]), np.bincount(x.c[kept], weights=x.end[kept])
            some = np.flatnonzero(total)
            first = np.zeros(len(total), dtype=np.int64)
            first[x.c[kept[::-1]]] = kept[::-1]
            kept, total, ends = first[some], total[some], ends[some]
        else:
            total, ends = np.ones(len(kept)), x.end[kept].astype(float)
        inverse, values = pd.factorize(context_hash(ctx[kept] ^ np.uint64(level + 1), x.h[kept]))
        first = np.empty(len(values), dtype=np.int64)
        first[inverse[::-1]] = np.arange(len(inverse))[::-1]
        at = kept[first]
        ends = np.bincount(inverse, weights=ends, minlength=len(at)).astype(np.int64)
        total = np.bincount(inverse, weights=total, minlength=len(at)).astype(np.int64)
        out.append(pd.DataFrame({"level": np.int32(level), "ctx": ctx[at].view(np.int64), "word": [words.text[i] for i in x.c[at]], "goes_on": total - ends, "ends": ends}))
    place = x.at - x.first
    lines = line_hashes(x.h, place, x.first, x.kind)
    few = (place > 0) & (place < LINE_WORDS) & ~np.isin(x.stops, x.final[x.unsure[x.final]])[x.line] & asked(lines)
    whole = few & (x.at == x.stops[x.line])
    goes_on = few & ~whole
    out.append(_counted(LINE, lines[goes_on], np.ones(goes_on.sum()), np.zeros(goes_on.sum())))
    once = pd.DataFrame({"ctx": lines[whole].view(np.int64), "t": x.text_of[x.line[whole]]}).drop_duplicates()["ctx"].to_numpy()
    out.append(_counted(LINE, once, np.zeros(len(once)), np.ones(len(once))))
    inside = ~np.isin(x.stops, x.final[x.unsure[x.final]])
    first = np.flatnonzero(x.start)
    own = x.line[first]
    real = inside[own] & (first < x.stops[own])
    first, own = first[real], own[real]
    masked = words.array("mask", np.uint64)[x.c]
    begin = context_hash(x.h[first], masked[first + 1])
    real = asked(begin)
    heads = pd.DataFrame({"ctx": begin[real].view(np.int64), "t": x.text_of[own[real]]}).drop_duplicates()["ctx"].to_numpy()
    out.append(_counted(HEAD, heads, np.ones(len(heads)), np.zeros(len(heads))))
    sure = ~x.unsure
    over, shape = x.over[sure], x.shape[sure].astype(np.int64)
    out.append(_counted(SHAPE, shape, ~over, over))
    out.append(_counted(GROUP, coarse(shape), ~over, over))
    if x.rules:
        out.append(_counted(SHAPE, np.array([TABLE_RULE], dtype=np.int64), np.array([x.rules]), np.array([0])))
    return pd.concat(out)


def _count_windows(wanted: np.ndarray | None):
    packed = None if wanted is None else np.packbits(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if packed is None else np.unpackbits(packed).astype(bool)
        words, held, size = _Words(), [], 0
        by = ["level", "ctx", "word"]
        for pdf in batches:
            texts = [t for t in pdf["text"] if t]
            for i in range(0, len(texts), CHUNK):
                if len(words) > 500_000:
                    words = _Words()
                held.append(window_counts(texts[i : i + CHUNK], words, bits))
                size += len(held[-1])
                if size > HELD_ROWS:
                    one = pd.concat(held).groupby(by, as_index=False, sort=False).sum()
                    held, size = [one], len(one)
                    if size > HELD_ROWS / 2:
                        yield one
                        held, size = [], 0
        if held:
            yield pd.concat(held).groupby(by, as_index=False, sort=False).sum()

    return run


def windows(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(level, ctx, word, goes_on, ends) of all texts(text); equal texts count once."""
    raw = texts.select("text").where("text IS NOT NULL").distinct().mapInPandas(_count_windows(wanted), "level int, ctx long, word string, goes_on long, ends long")
    return raw.groupBy("level", "ctx", "word").agg(F.sum("goes_on").alias("goes_on"), F.sum("ends").alias("ends"))


ASKED = "how string, marked boolean, c2 long, c1 long, c3 long, c4 long, p string, form long, shape long"
_COMPLETE = (COMPLETE, None, None, None, None, None, None, None, None)


def ask(texts: list[str | None], words: _Words, rules: bool = True, refuses: list[bool] | None = None) -> list[tuple]:
    """What is asked about the ending of each text, in the order of ASKED; how is null for texts without content and refusals.

    refuses: whether each text is a refusal, where that is known; null texts are then those without content.
    """
    out: list[tuple] = []
    open_: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        if (t is None or refuses[i]) if refuses else (not has_content(t) or is_refusal(t)):
            out.append((None, *_COMPLETE[1:]))
            continue
        how = ending(t)
        out.append(_COMPLETE if how == COMPLETE else (how, *_COMPLETE[1:]))
        if how != COMPLETE or not rules:
            open_.append((i, without_omission(t)))
    if not open_:
        return out
    x = Places([t for _, t in open_], words)
    last_of = {}
    if x.n:
        last_of = dict(zip(x.text_of[x.line[x.final]].tolist(), x.final.tolist()))
        lines = line_hashes(x.h, x.at - x.first, x.first, x.kind)
    for k, (i, t) in enumerate(open_):
        how = out[i][0]
        at = last_of.get(k)
        if at is None:
            continue
        rule = bool(SEPARATOR.fullmatch(t.rstrip().rsplit("\n", 1)[-1])) and "|" in t[-400:]
        shape = TABLE_RULE if rule else int(x.shape[at])
        a, b, p = tail(t)
        c2 = c1 = c3 = c4 = None
        form = None
        if shape >= PLAIN and p:
            two, one = np.array([word_hash(a)], dtype=np.uint64), np.array([word_hash(b)], dtype=np.uint64)
            c2, c1 = int(context_hash(two, one).view(np.int64)[0]), int(context_hash(np.zeros(1, dtype=np.uint64), one).view(np.int64)[0])
            masked, ws = skeleton(t), last_words(t)
            form = int(np.uint64(word_hash(masked)).view(np.int64))
            if 2 <= len(ws) <= LINE_WORDS:
                c3 = int(lines[at].view(np.int64))
            two_words = masked.split()[:2]
            if len(two_words) == 2:
                c4 = int(context_hash(np.array([word_hash(ws[0])], dtype=np.uint64), np.array([word_hash(two_words[1])], dtype=np.uint64)).view(np.int64)[0])
        out[i] = (OPEN if how == COMPLETE else how, shape < PLAIN, c2, c1, c3, c4, p if c2 is not None else None, form, shape)
    return out


def as_frame(asked: list[tuple]) -> pd.DataFrame:
    """The columns of ASKED; whole numbers stay whole beside nulls."""
    kind = {"long": "Int64", "boolean": "boolean", "string": "object"}
    names = [f.split() for f in ASKED.split(", ")]
    columns = zip(*asked) if asked else [()] * len(names)
    return pd.DataFrame({n: pd.array(list(c), dtype=kind[k]) for (n, k), c in zip(names, columns)})


def _ask(rules: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            got = as_frame(ask(pdf["text"].tolist(), words, rules))
            got.insert(0, "same", pdf["same"].to_numpy())
            got.insert(0, "key", pdf["key"].to_numpy())
            yield got

    return run


def _successors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted texts, those that the next one begins with; of the last text itself and the first, for the joints of partitions."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    columns = ["part", "same", "text", "follows", "joint"]
    first = held = None
    for pdf in batches:
        out = []
        for same, t in zip(pdf["same"].tolist(), pdf["text"]):
            if held is None:
                first = t
            elif t.startswith(held[1]) and len(t) > len(held[1]):
                out.append((part, held[0], None, t[len(held[1]) : len(held[1]) + 40], None))
            held = (same, t)
        yield pd.DataFrame(out, columns=columns)
    if held is not None:
        yield pd.DataFrame([(part, held[0], held[1], None, first)], columns=columns)


def strict_prefixes(values: DataFrame, corpus: DataFrame) -> DataFrame:
    """(same, follows): values(text) that are a strict prefix of a longer text in values or corpus, and how the longer one goes on.

    Blanks at the end do not count; same is the hash of the value as it is. Hashes of prefixes of 4, 16, 64, ... characters
    choose what may match: a value's longest such prefix must begin another text. These candidates are range-sorted, where a
    strict prefix stands right before texts that it begins; a prefix that many texts share makes no group of its own.
    """
    blank_end = lambda c: F.endswith(c, F.lit(" ")) | F.endswith(c, F.lit("\n")) | F.endswith(c, F.lit("\r")) | F.endswith(c, F.lit("\t"))
    bare = lambda c: F.when(blank_end(F.col(c)), F.rtrim(F.col(c), F.lit(" \n\r\t"))).otherwise(F.col(c))  # noqa: E731  (trimming goes through the whole text)
    enough = F.length(F.substring("text", 1, SHORTEST)) >= SHORTEST
    steps = lambda c: F.floor(F.log(float(GROWTH), F.length(c) / float(SHORTEST)) + 1e-9).cast("int")
    key = lambda c, i: F.xxhash64(i, F.substring(c, F.lit(1), F.lit(SHORTEST) * F.pow(F.lit(GROWTH), i).cast("int")))
    mine = values.select(F.xxhash64("text").alias("same"), bare("text").alias("text")).where(enough).withColumn("tid", F.xxhash64("text"))
    every = mine.select("text", "tid").unionByName(corpus.select(bare("text").alias("text")).where(enough).withColumn("tid", F.xxhash64("text")))
    asked = cut(mine.select("same", "tid", key(F.col("text"), steps("text")).alias("h")).distinct(), "asked")
    begins = every.select("tid", F.explode(F.transform(F.sequence(F.lit(0), steps("text")), lambda i: key(F.col("text"), i))).alias("h"))
    begins = cut(begins.join(asked.select("h").distinct(), "h", "left_semi").distinct(), "begins")
    shared = begins.groupBy("h").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo <> hi").select("h")
    ids = begins.join(shared, "h", "left_semi").select("tid").distinct()
    held = cut(every.join(ids, "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text")), "candidates")
    order = held.select(F.col("tid").alias("same"), "text").repartitionByRange("text").sortWithinPartitions("text")
    got = cut(order.mapInPandas(_successors, "part int, same long, text string, follows string, joint string"), "successors")
    joints = got.where("joint IS NOT NULL")  # one row for each partition
    after = joints.withColumn("next", F.lead("joint").over(W.orderBy("part")))
    across = after.where(F.startswith("next", "text") & (F.length("next") > F.length("text")))
    across = across.select("same", F.expr("substring(next, length(text) + 1, 40)").alias("follows"))
    found = got.where("follows IS NOT NULL").select("same", "follows").unionByName(across).withColumnRenamed("same", "tid")
    return asked.select("tid", "same").join(found, "tid").select("same", "follows").distinct()


BITS = 1 << 22


def bit_map(contexts: DataFrame) -> np.ndarray:
    """Which of BITS hash values the column ctx of contexts has: a fixed 512 KB, however many contexts there are.

    A place whose bit is not set is asked about by nobody and need not be counted; with very many contexts all bits are set
    and everything is counted.
    """
    at = F.pmod(F.col("ctx"), F.lit(BITS))
    rows = contexts.select(F.floor(at / 32768).alias("b"), (at % 32768).cast("int").alias("at")).groupBy("b").agg(F.bitmap_construct_agg("at").alias("m")).collect()
    out = np.zeros(BITS, dtype=bool)
    for r in rows:
        out[r["b"] * 32768 : (r["b"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["m"], dtype=np.uint8), bitorder="little")
    return out


def evidence(asked: DataFrame, corpus: DataFrame, longer: DataFrame) -> DataFrame:
    """(same, why, is_cut, tails, shapes) of each distinct text of asked(same, ASKED) whose ending is not complete.

    corpus(text) is where the endings are looked up; longer(same, follows) has texts that are strict prefixes of others.
    why is the evidence that decides: copy (a longer copy goes on within the word or sentence), word (its last word is
    only ever part of longer ones), line, sign-off, tail, shape or none (a text that nothing in the corpus resembles is
    not called cut). tails and shapes are votes (+ cut, - complete, 0 unknown) of these two alone.
    """
    open_ = asked.where(F.col("how").isNotNull() & (F.col("how") != COMPLETE) & F.col("shape").isNotNull()).dropDuplicates(["same"])
    ph = F.xxhash64("p")
    zero = F.lit(0).cast("long")
    asks = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("ctx"), h.alias("ph")) for k, c, h in (
        (AFTER_TWO, F.col("c2"), ph), (AFTER_ONE, F.col("c1"), ph), (ANYWHERE, F.when(F.col("p").isNotNull(), zero), ph), (LINE, F.col("c3"), zero), (HEAD, F.col("c4"), zero),
        (FORM, F.col("form"), zero))]))
    rows = open_.select("same", asks.alias("a")).select("same", "a.level", "a.ctx", "a.ph").where("ctx IS NOT NULL AND ph IS NOT NULL")
    rows = cut(rows, "asks")
    w = cut(windows(corpus, bit_map(rows.where(F.col("level").isin(AFTER_TWO, AFTER_ONE, LINE, HEAD)))), "windows")
    contexts = rows.where(F.col("level").isin(AFTER_TWO, AFTER_ONE)).select("level", "ctx").distinct()
    words = w.where(F.col("level").isin(AFTER_TWO, AFTER_ONE)).join(contexts, ["level", "ctx"], "left_semi").unionByName(w.where(F.col("level") == ANYWHERE))
    prefix = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.xxhash64(F.substring(F.col("word"), F.lit(1), i))))
    words = words.where("word <> ''").select("level", "ctx", "goes_on", "ends", F.length("word").alias("n"), prefix.alias("i", "ph"))
    same = F.col("i") + 1 == F.col("n")
    words = words.groupBy("level", "ctx", "ph").agg(
        F.sum(F.when(same, F.col("ends")).otherwise(0)).alias("ends"),
        F.sum(F.when(same, F.col("goes_on")).otherwise(F.col("goes_on") + F.col("ends"))).alias("longer"),
        F.sum(F.when(same, F.col("ends") + F.col("goes_on")).otherwise(0)).alias("whole"))
    others = w.where(F.col("level").isin(LINE, HEAD)).select("level", "ctx", zero.alias("ph"), "ends", F.col("goes_on").alias("longer"), F.col("ends").alias("whole"))
    forms = open_.where("form IS NOT NULL").groupBy(F.col("form").alias("ctx")).agg(F.count("*").alias("ends")).select(F.lit(FORM).alias("level"), "ctx", zero.alias("ph"), "ends", zero.alias("longer"), F.col("ends").alias("whole"))
    seen = rows.join(words.unionByName(others).unionByName(forms), ["level", "ctx", "ph"])
    of = lambda k, c: F.max(F.when(F.col("level") == k, F.col(c)))
    seen = seen.groupBy("same").agg(*[of(k, c).alias(f"{c}{k}") for k in (AFTER_TWO, AFTER_ONE, ANYWHERE, LINE, HEAD, FORM) for c in ("ends", "longer", "whole")])
    shape = w.where(F.col("level") == SHAPE).select(F.col("ctx").alias("shape"), F.col("ends").alias("s_ends"), F.col("goes_on").alias("s_on"))
    group = w.where(F.col("level") == GROUP).select(F.col("ctx").alias("g"), F.col("ends").alias("g_ends"), F.col("goes_on").alias("g_on"))
    near = F.when(F.col("shape") < MARK, 1).when((F.col("shape") > MARK) & (F.col("shape") < MARK + 8), 2).otherwise(3).cast("long")
    goes = longer.select("same", (~F.startswith("follows", F.lit("\n"))).alias("on"), F.regexp_like("follows", F.lit(r"^[\p{L}\p{N}]")).alias("inside"))
    got = open_.select("same", "marked", "p", "c4", "shape", near.alias("g")).join(F.broadcast(shape), "shape", "left").join(F.broadcast(group), "g", "left")  # there are some hundred shapes
    got = got.join(seen, "same", "left").join(goes.groupBy("same").agg(F.max("on").alias("on"), F.max("inside").alias("inside")), "same", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = lambda k: n(f"ends{k}") + n(f"longer{k}") > 0
    stops = lambda k, share=END_SHARE: n(f"ends{k}") >= share * (n(f"ends{k}") + n(f"longer{k}"))
    vote = lambda c: F.when(c, F.lit("-")).otherwise(F.lit("+"))
    tails = F.when(known(AFTER_TWO), vote(stops(AFTER_TWO))).when(known(AFTER_ONE), vote(stops(AFTER_ONE))).when(
        (n(f"whole{ANYWHERE}") > 0) & (F.length("p") > 1), vote(stops(ANYWHERE))).when(n(f"longer{ANYWHERE}") > 0, F.lit("+")).otherwise(F.lit("0"))
    shapes = F.when(n("s_ends") + n("s_on") > 0, vote(n("s_ends") >= END_SHARE * (n("s_ends") + n("s_on")))).when(
        n("g_ends") + n("g_on") > 0, vote(n("g_ends") >= END_SHARE * (n("g_ends") + n("g_on")))).otherwise(F.lit("0"))
    got = got.withColumn("tails", tails).withColumn("shapes", shapes)
    line = (n(f"whole{LINE}") >= LINES) & stops(LINE, LINE_SHARE)
    part = ((n(f"whole{AFTER_TWO}") == 0) & (n(f"longer{AFTER_TWO}") > 0))
    sign_off = F.col("c4").isNotNull() & (n(f"whole{FORM}") >= SIGN_OFFS) & (n(f"whole{FORM}") >= SIGN_OFF_SHARE * (n(f"whole{FORM}") + n(f"longer{HEAD}")))
    plain = ~F.col("marked")
    closed = F.col("shape").between(MARK + 1, MARK + 7)
    copy = F.coalesce(F.col("inside") | (F.col("on") & ~closed), F.lit(False))
    why = (F.when(copy, F.lit("copy")).when(plain & line, F.lit("line")).when(plain & part, F.lit("word")).when(plain & sign_off, F.lit("sign-off"))
           .when(plain & (F.col("tails") != "0"), F.lit("tail")).when(F.col("shapes") != "0", F.lit("shape")).otherwise(F.lit("none")))
    is_cut = (F.when(F.col("why").isin("copy", "word"), True).when(F.col("why") == "tail", F.col("tails") == "+").when(F.col("why") == "shape", F.col("shapes") == "+").otherwise(False))
    return got.withColumn("why", why).withColumn("is_cut", is_cut).select("same", "why", "is_cut", "tails", "shapes")


def truncated(texts: DataFrame, corpus: DataFrame, longer_in: DataFrame | None = None, rules: bool = True) -> DataFrame:
    """(key, why): texts(key long, text) that were cut off, and the evidence (copy, word, tail or shape).

    corpus(text) is where endings are looked up, usually the texts themselves and their originals; longer copies are sought
    in it and in longer_in(text). Null and blank texts, placeholders and refusals are never cut; rows with one key count
    as cut if any of their texts is, and equal texts are judged and counted once. rules: leave out at once what ends in a closed
    sentence, link, tag line, table row, bracket or bold line. An empty input gives an empty result.
    """
    keyed = texts.where("key IS NOT NULL AND text IS NOT NULL").select("key", "text", F.xxhash64("text").alias("same"))
    judged = cut(keyed.mapInPandas(_ask(rules), "key long, same long, " + ASKED).where(f"how IS NOT NULL AND how <> '{COMPLETE}'"), "endings")
    asks = keyed.join(judged.select("same").distinct(), "same", "left_semi").select("text")
    found = evidence(judged, corpus, strict_prefixes(asks, corpus if longer_in is None else corpus.unionByName(longer_in)))
    return judged.select("key", "same").distinct().join(found.where("is_cut"), "same").groupBy("key").agg(F.min("why").alias("why"))


def _texts(rewrites: DataFrame) -> DataFrame:
    return rewrites.select(F.explode(F.array("original_text", "rewritten_text")).alias("text")).where("text IS NOT NULL")


def truncated_calls(rewrites: DataFrame, mirrors: DataFrame | None = None) -> DataFrame:
    """(key, why) of rewrites(call_id, original_text, rewritten_text) whose rewritten text was cut; longer copies may stand in mirrors(text), too."""
    texts = rewrites.select(F.col("call_id").alias("key"), F.col("rewritten_text").alias("text"))
    return truncated(texts, _texts(rewrites), None if mirrors is None else mirrors.select("text").where("text IS NOT NULL"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_calls(table(spark, d, "rewrites"), table(spark, d, "mirrors")).select(F.col("key").alias("call_id"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: calls, cut calls, their share, and how many each kind of evidence decides."""
    rewrites = table(spark, d, "rewrites")
    calls = rewrites.select(F.col("call_id").alias("key"), canon_label("source").alias("source")).groupBy("key").agg(F.min("source").alias("source"))
    got = calls.join(truncated_calls(rewrites, table(spark, d, "mirrors")), "key", "left").groupBy("source")
    got = got.agg(F.count("*").alias("n_calls"), F.count("why").alias("n_cut"), *[F.count_if(F.col("why") == k).alias(f"n_by_{k}") for k in ("copy", "word", "tail", "shape")])
    return got.select("*", F.round(F.col("n_cut") / F.col("n_calls"), 6).alias("cut_share"))
