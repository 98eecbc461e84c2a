"""Problem 4: long verbatim spans that several records share, by super-k-mer partitioning.

Windows of k consecutive words are never listed one by one. Each window belongs to the bucket of its
minimiser, the smallest hash among its m-word pieces; consecutive windows with one minimiser travel together
as one packed string (a super-k-mer). Only buckets that several records reach can hold a shared window, so
the packed strings of all others never leave their task. In the buckets, equal packed strings are counted
first; then the windows themselves are compared as strings, so the count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.runtime import cut, table

WINDOW = 50
PIECE = 20
HOT_BUCKET = 20_000
#: A super-k-mer is cut after so many windows: a text that repeats itself has one minimiser for all of them.
MOST_WINDOWS = 1024
_CHUNK_CHARS = 2_000_000


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met so far."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def minimisers(h: np.ndarray, lengths: np.ndarray, k: int = WINDOW, m: int = PIECE) -> tuple[np.ndarray, ...]:
    """Super-k-mers of the texts whose word hashes h stand one after another.

    Returns, for each: index of its text, its first window's word in the text, number of windows, minimiser.
    """
    none = tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    n = len(h)
    if n < k:
        return none
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
        inverse = np.uint64(pow(int(base), -1, 2**64))
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - m, inverse)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up, dtype=np.uint64)])
        piece = (sums[m:] - sums[:-m]) * down
        piece ^= piece >> np.uint64(33)
        piece *= np.uint64(0xFF51AFD7ED558CCD)
        piece ^= piece >> np.uint64(33)
    low, width = piece, 1
    span = k - m + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(low)]
    ok = np.arange(len(low)) + k <= ends[text]
    at = np.flatnonzero(ok)
    if not len(at):
        return none
    value, owner = low[at], text[at]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(at))
    fresh |= (place - np.maximum.accumulate(np.where(fresh, place, 0))) % MOST_WINDOWS == 0
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(at)))
    starts = ends - lengths
    return owner[first], at[first] - starts[owner[first]], count, value[first].view(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _CHUNK_CHARS):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def super_kmers(records: DataFrame, k: int = WINDOW, m: int = PIECE) -> DataFrame:
    """(rec, text_id, minimiser, start, windows) of records(rec, text_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            texts = pdf["text"].tolist()
            rec, text_id = pdf["rec"].to_numpy(), pdf["text_id"].to_numpy()
            for i, j in _chunks(texts):
                words = [t.split() for t in texts[i:j]]
                lengths = np.array([len(w) for w in words], dtype=np.int64)
                flat = [x for w in words for x in w]
                h = np.fromiter(map(hashes.__getitem__, flat), dtype=np.uint64, count=len(flat))
                owner, start, count, value = minimisers(h, lengths, k, m)
                yield pd.DataFrame({"rec": rec[i:j][owner], "text_id": text_id[i:j][owner], "minimiser": value, "start": start.astype(np.int32), "windows": count.astype(np.int32)})

    return records.select("rec", "text_id", "text").mapInPandas(run, "rec long, text_id long, minimiser long, start int, windows int")


def _pack(batches: Iterator[pd.DataFrame], k: int = WINDOW) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = {"rec": [], "text_id": [], "minimiser": [], "start": [], "windows": [], "packed": []}
        for rec, text_id, text, pieces in zip(pdf["rec"], pdf["text_id"], pdf["text"], pdf["pieces"]):
            words = text.split()
            for p in pieces:
                out["rec"].append(rec)
                out["text_id"].append(text_id)
                out["minimiser"].append(p["minimiser"])
                out["start"].append(p["start"])
                out["windows"].append(p["windows"])
                out["packed"].append(" ".join(words[p["start"] : p["start"] + p["windows"] + k - 1]))
        yield pd.DataFrame(out)


def window_slices(packed: str, k: int) -> list[str]:
    """The windows of k words of a packed string."""
    cuts = [-1]
    at = packed.find(" ")
    while at >= 0:
        cuts.append(at)
        at = packed.find(" ", at + 1)
    cuts.append(len(packed))
    return [packed[cuts[j] + 1 : cuts[j + k]] for j in range(len(cuts) - k)]


def _ranges(flags: list[bool]) -> list[dict]:
    out, j = [], 0
    while j < len(flags):
        if flags[j]:
            i = j
            while j < len(flags) and flags[j]:
                j += 1
            out.append({"a": i, "b": j - 1})
        else:
            j += 1
    return out


def count_bucket(packed: list[str], lo: list[int], hi: list[int], k: int) -> list[list[dict]]:
    """For each distinct packed string of a bucket, the ranges of its windows that several records hold."""
    slices = [window_slices(p, k) for p in packed]
    seen: dict[str, tuple[int, int]] = {}
    for ws, a, b in zip(slices, lo, hi):
        for w in ws:
            old = seen.get(w)
            seen[w] = (a, b) if old is None else (min(a, old[0]), max(b, old[1]))
    return [_ranges([seen[w][0] != seen[w][1] for w in ws]) for ws in slices]


def _count(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []

        def done() -> pd.DataFrame:
            ranges = count_bucket([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], k)
            got = [(key, r[0], x) for r, x in zip(rows, ranges) if x]
            return pd.DataFrame(got, columns=["minimiser", "packed_id", "ranges"])

        ready, size = [], 0
        for pdf in batches:
            for bucket, pid, packed, lo, hi in zip(pdf["minimiser"], pdf["packed_id"], pdf["packed"], pdf["lo"], pdf["hi"]):
                if bucket != key and rows:
                    ready.append(done())
                    size += len(ready[-1])
                    rows = []
                    if size > 5000:
                        yield pd.concat(ready)
                        ready, size = [], 0
                key = bucket
                rows.append((pid, packed, lo, hi))
        if rows:
            ready.append(done())
        if ready:
            yield pd.concat(ready)

    return run


def _single_windows(k: int):
    """Every window of a super-k-mer as one of its own, with the window's hash as its bucket."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            out = []
            for rec, text_id, start, packed in zip(pdf["rec"], pdf["text_id"], pdf["start"], pdf["packed"]):
                for j, w in enumerate(window_slices(packed, k)):
                    out.append((rec, text_id, np.int64(np.uint64(xxhash.xxh64_intdigest(w))), start + j, 1, w))
            yield pd.DataFrame(out, columns=["rec", "text_id", "minimiser", "start", "windows", "packed"])

    return run


_OCCURRENCE = "rec long, text_id long, minimiser long, start int, windows int, packed string"


def shared_windows(records: DataFrame, k: int = WINDOW, m: int = PIECE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(rec, text_id, first, last): runs of windows (by their first word) that another record holds too.

    records(rec long, text string): rows with one rec are one record; null texts and texts of fewer than k
    words have no windows. A window that only one record holds, however often, is not shared. A bucket with
    more than hot_bucket different packed strings is split: its windows get buckets of their own, by hash.
    """
    texts = records.where("rec IS NOT NULL AND text IS NOT NULL").select("rec", F.xxhash64("text").alias("text_id"), "text")
    pairs = cut(super_kmers(texts, k, m), "superkmers")
    shared = pairs.groupBy("minimiser").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("minimiser")
    wanted = pairs.join(shared, "minimiser", "left_semi").distinct()
    wanted = wanted.groupBy("rec", "text_id").agg(F.collect_list(F.struct("minimiser", "start", "windows")).alias("pieces"))
    held = texts.join(wanted, ["rec", "text_id"]).select("rec", "text_id", "text", "pieces")
    occ = cut(held.mapInPandas(lambda b: _pack(b, k), _OCCURRENCE).withColumn("packed_id", F.xxhash64("packed", F.lit(k))), "packed")
    size = occ.groupBy("minimiser", "packed_id").agg(F.count("*").alias("n")).groupBy("minimiser").agg(F.count("*").alias("n"))
    hot = cut(size.where(F.col("n") > hot_bucket).select("minimiser"), "hot")
    if not hot.isEmpty():
        split = occ.join(hot, "minimiser", "left_semi").select("rec", "text_id", "minimiser", "start", "windows", "packed").mapInPandas(_single_windows(k), _OCCURRENCE)
        split = split.withColumn("packed_id", F.xxhash64("packed", F.lit(k)))
        occ = cut(occ.join(hot, "minimiser", "left_anti").select(*split.columns).unionByName(split), "packed")
    strings = occ.groupBy("minimiser", "packed_id", "packed").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"))
    strings = strings.select("minimiser", "packed_id", "packed", "lo", "hi").repartition("minimiser").sortWithinPartitions("minimiser")
    counted = strings.mapInPandas(_count(k), "minimiser long, packed_id long, ranges array<struct<a:int,b:int>>")
    runs = occ.drop("packed").join(counted, ["minimiser", "packed_id"]).select("rec", "text_id", "start", F.explode("ranges").alias("r"))
    return runs.select("rec", "text_id", (F.col("start") + F.col("r.a")).alias("first"), (F.col("start") + F.col("r.b")).alias("last"))


def merged_spans(runs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(rec, text_id, start, n_words): maximal stretches whose windows are all shared, overlapping ones joined."""
    runs = runs.select("rec", "text_id", "first", (F.col("last") + k).alias("end")).distinct()
    w = W.partitionBy("rec", "text_id").orderBy("first", "end")
    runs = runs.withColumn("_far", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    runs = runs.withColumn("_new", F.when(F.col("first") <= F.col("_far"), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    got = runs.groupBy("rec", "text_id", "_g").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    return got.select("rec", "text_id", "start", (F.col("end") - F.col("start")).alias("n_words"))


def _cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for rec, text, spans in zip(pdf["rec"], pdf["text"], pdf["spans"]):
            words = text.split()
            out += [(rec, s["start"], s["n_words"], " ".join(words[s["start"] : s["start"] + s["n_words"]])) for s in spans]
        yield pd.DataFrame(out, columns=["call_id", "start_word", "n_words", "span"])


def _records(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "mirrors").select(F.col("call_id").alias("rec"), "text")
    b = table(spark, d, "rewrites").select(F.col("call_id").alias("rec"), F.col("rewritten_text").alias("text"))
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_windows(_records(spark, d)).select(F.col("rec").alias("call_id")).distinct()


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every shared stretch with its text."""
    records = _records(spark, d)
    spans = merged_spans(shared_windows(records)).groupBy("rec", "text_id").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    texts = records.where("text IS NOT NULL").withColumn("text_id", F.xxhash64("text")).join(spans, ["rec", "text_id"])
    return texts.select("rec", "text", "spans").mapInPandas(_cut_texts, "call_id long, start_word int, n_words int, span string").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each record: its words, how many of them stand in shared stretches, and their share."""
    records = _records(spark, d)
    spans = merged_spans(shared_windows(records)).groupBy("rec", "text_id").agg(F.sum("n_words").alias("shared"), F.count("*").alias("n_spans"))
    words = F.regexp_count("text", F.lit(r"(?U)[^\s\x1c-\x1f]+"))
    sizes = records.where("text IS NOT NULL").select("rec", F.xxhash64("text").alias("text_id"), words.alias("words")).distinct()
    both = sizes.join(spans, ["rec", "text_id"], "left").groupBy(F.col("rec").alias("call_id"))
    got = both.agg(F.sum("words").alias("n_words"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared_words"), F.coalesce(F.sum("n_spans"), F.lit(0)).alias("n_spans"))
    return got.select("*", F.round(F.coalesce(F.try_divide("shared_words", "n_words"), F.lit(0.0)), 6).alias("share"))
