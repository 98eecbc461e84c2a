"""Problem 6: whole texts into training windows of fixed capacity, by vector best-fit."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.llm.tokens import with_tokens
from loomscribe.runtime import cut, table


@dataclass(frozen=True)
class Capacity:
    """What one window holds: tokens, documents, and attention cost (half the squared lengths of its texts).

    A window of one text of 2,048 tokens would cost 2048 * 2049 / 2. The default grants half of that, the cost of a text of
    1,448 tokens, so that a few windows do not take far longer than the others; a text that alone costs more has a window of its own.
    """

    tokens: int = 2048
    documents: int = 32
    attention: float = 2048 * 2049 / 4

    def demand(self, n: np.ndarray) -> np.ndarray:
        return np.stack([n, np.ones_like(n), n * (n + 1) / 2], axis=1).astype(float)


WEIGHTS = (1.0, 0.1, 0.1)
SHARD_ITEMS = 4096


def best_fit(lengths: np.ndarray, capacity: Capacity = Capacity(), weights=WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The bin of each item, longest items first.

    Among the bins whose residual holds the item in every dimension, "norm" takes the one that is left with
    the smallest weighted norm of its residual, "dot" the one with the largest weighted dot product of demand
    and residual; ties go to the oldest bin. An item that no bin could ever hold gets one of its own.
    """
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    demand = capacity.demand(np.asarray(lengths)) / caps
    w = np.asarray(weights, dtype=float)
    order = np.argsort(-np.asarray(lengths), kind="stable")
    least = demand[:, 0].min(initial=1.0)
    where = np.zeros(len(demand), dtype=np.int64)
    left, names, used, made = np.empty((256, 3)), np.empty(256, dtype=np.int64), 0, 0
    slack = 1e-9
    for i in order:
        d = demand[i]
        open_ = left[:used]
        fits = np.flatnonzero((open_ >= d - slack).all(axis=1))
        if len(fits):
            rest = open_[fits]
            score = ((rest - d) ** 2) @ w if rule == "norm" else -(rest * d) @ w
            k = fits[np.argmin(score)]
            left[k] -= d
        else:
            if used == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            k = used
            left[k], names[k] = 1.0 - d, made
            used, made = used + 1, made + 1
        where[i] = names[k]
        if left[k, 0] < least - slack or left[k, 1] <= slack:  # full: out of the search
            left[k:used - 1], names[k:used - 1] = left[k + 1:used].copy(), names[k + 1:used].copy()
            used -= 1
    return where


def pack(sizes: DataFrame, capacity: Capacity = Capacity(), shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece, n_tokens, window): sizes(doc_id, text_hash, n_tokens) assigned to windows.

    A text longer than the capacity is cut into full pieces, each a window of its own, and a rest that is
    packed like any other item; all other texts stay whole. Rows with the same id and text are one item;
    texts without tokens need no window (window is null). Items are spread by hash over shards of about
    shard_items, and each shard is packed in one task; at most a few windows a shard stay half empty.
    """
    cap = capacity.tokens
    items = cut(sizes.select("doc_id", "text_hash", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).distinct(), "items")
    empty = items.where("n_tokens = 0").select("doc_id", "text_hash", F.lit(0).alias("piece"), "n_tokens", F.lit(None).cast("string").alias("window"))
    long_ = items.where(F.col("n_tokens") > cap)
    full = long_.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_tokens") / cap).cast("int") - 1)))
    full = full.select("doc_id", "text_hash", "piece", F.lit(cap).cast("long").alias("n_tokens"),
                       F.concat_ws("-", F.lit("w"), F.col("doc_id").cast("string"), F.hex("text_hash"), F.col("piece").cast("string")).alias("window"))
    rest = long_.where(F.col("n_tokens") % cap > 0).select(
        "doc_id", "text_hash", F.floor(F.col("n_tokens") / cap).cast("int").alias("piece"), (F.col("n_tokens") % cap).alias("n_tokens"))
    whole = items.where(F.col("n_tokens").between(1, cap)).select("doc_id", "text_hash", F.lit(0).alias("piece"), "n_tokens")
    pool = whole.unionByName(rest)
    shards = max(1, math.ceil(pool.count() / shard_items))
    pool = pool.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(shards)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "text_hash"], ascending=[False, True, True], kind="stable")
        bins = best_fit(pdf["n_tokens"].to_numpy(), capacity)
        pdf["window"] = [f"s-{s}-{b}" for s, b in zip(pdf["shard"], bins)]
        return pdf[["doc_id", "text_hash", "piece", "n_tokens", "window"]]

    kind = items.schema["doc_id"].dataType.simpleString()
    packed = pool.groupBy("shard").applyInPandas(run, f"doc_id {kind}, text_hash long, piece int, n_tokens long, window string")
    return packed.unionByName(full).unionByName(empty).select("doc_id", "piece", "n_tokens", "window")


def over_capacity(packed: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Documents that had to be cut: those with more than one piece."""
    return packed.where("piece = 1").select("doc_id").distinct()


def fill_report(packed: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """One row: windows, tokens, share of the windows' room that is used, fewest windows possible, and how many each capacity closes.

    A window is closed by the capacity of which it has used the largest share; in by_attention and by_documents that share
    is at least 0.9, in by_own are the texts that alone exceed the attention capacity.
    """
    cost = F.col("n_tokens") * (F.col("n_tokens") + 1) / 2
    w = packed.where("window IS NOT NULL").groupBy("window").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.sum(cost).alias("c"))
    t, n, c = F.col("t") / capacity.tokens, F.col("n") / capacity.documents, F.col("c") / capacity.attention
    own = (F.col("n") == 1) & (c > 1)
    r = w.agg(F.count("*").alias("n_windows"), F.sum("t").alias("n_tokens"), F.max("t").alias("most_tokens"), F.max("n").alias("most_documents"),
              F.round(F.max(F.when(~own, c)), 6).alias("most_attention"), F.count_if(own).alias("by_own"),
              F.count_if(~own & (c > t) & (c > n) & (c >= 0.9)).alias("by_attention"), F.count_if((n > t) & (n > c) & (n >= 0.9)).alias("by_documents"))
    used = F.round(F.col("n_tokens") / (F.col("n_windows") * capacity.tokens), 6)
    return r.select("*", F.ceil(F.col("n_tokens") / capacity.tokens).alias("least_windows"), used.alias("filled"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(with_tokens(table(spark, d, "documents").select("doc_id", "text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return over_capacity(_packed(spark, d))


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(_packed(spark, d))
