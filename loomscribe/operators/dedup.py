"""Near duplicates within a group: keep a text only if it is unlike every text kept before it.

The rule depends on order: a text that is like a dropped one may stay. It is run as a fixed point over pairs of
similar texts, found by an exact prefix-filtered join on word shingles, so no group is ever held in one task.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions.text import ngrams, words
from loomscribe.runtime import cut

SHINGLE = 5
LIKENESS = 0.8


def greedy_keep(shingles: list[set], likeness: float = LIKENESS) -> list[bool]:
    """The rule itself on sets in order, one by one: what greedy_near_duplicates must agree with."""
    kept, out = [], []
    for s in shingles:
        like = any(s and k and len(s & k) >= likeness * len(s | k) for k in kept)
        out.append(not like)
        if not like:
            kept.append(s)
    return out


def similar_pairs(sets: DataFrame, likeness: float) -> DataFrame:
    """(g, a, b): pairs a < b of sets(g, o, s array<long>) of one group with Jaccard likeness at or above the bound.

    Two such sets share one of the first n - ceil(likeness n) + 1 shingles of each in any common order; the order is
    rarest first, so shingles of boilerplate are hardly ever in a prefix. Every candidate is then compared exactly.
    """
    items = sets.select("g", "o", F.size("s").alias("n"), F.explode("s").alias("x"))
    freq = items.groupBy("g", "x").agg(F.count("*").alias("f")).where("f > 1")
    rare = items.join(freq, ["g", "x"])  # a shingle of one set alone cannot be shared, but keeps its place in the prefix
    place = F.row_number().over(W.partitionBy("g", "o").orderBy("f", "x"))
    shared = F.count("*").over(W.partitionBy("g", "o"))
    room = F.col("n") - F.ceil(F.lit(likeness) * F.col("n") - 1e-9) + 1
    prefix = rare.withColumn("p", place + F.col("n") - shared).where(F.col("p") <= room).select("g", "o", "n", "x")
    a, b = prefix.alias("a"), prefix.alias("b")
    close = (F.col("a.n") >= likeness * F.col("b.n")) & (F.col("b.n") >= likeness * F.col("a.n"))
    cand = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.o") < F.col("b.o")) & close)
    cand = cand.select(F.col("a.g").alias("g"), F.col("a.o").alias("a"), F.col("b.o").alias("b")).distinct()
    full = cand.join(sets.select("g", F.col("o").alias("a"), F.col("s").alias("sa")), ["g", "a"]).join(sets.select("g", F.col("o").alias("b"), F.col("s").alias("sb")), ["g", "b"])
    both = F.size(F.array_intersect("sa", "sb"))
    return full.where(both >= likeness * (F.size("sa") + F.size("sb") - both) - 1e-9).select("g", "a", "b")


def greedy_near_duplicates(docs: DataFrame, group: str, order: str, text: str, likeness: float = LIKENESS) -> DataFrame:
    """(group, order, kept) of every row; order must be unique in its group.

    Texts with the same shingles as an earlier one are dropped; texts shorter than five words have no shingle and
    stay. Each round decides the texts whose earlier similar texts are all decided: dropped if one of them is kept.
    """
    tok = docs.select(F.col(group).alias("g"), F.col(order).alias("o"), words(text).alias("w"))
    sets = tok.select("g", "o", F.array_sort(F.transform(ngrams(F.col("w"), SHINGLE), lambda x: F.xxhash64(x))).alias("s"))
    sets = cut(sets.withColumn("h", F.xxhash64("s")), "shingles")
    first = sets.where(F.size("s") > 0).groupBy("g", "h").agg(F.min("o").alias("first"))
    lead = sets.join(first, (sets.g == first.g) & (sets.o == first["first"]), "left_semi").select("g", "o", "s")
    pairs = cut(similar_pairs(lead, likeness), "pairs")
    state = cut(pairs.select("g", F.col("b").alias("o")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "state")
    while not state.where("kept IS NULL").isEmpty():
        known = state.select("g", F.col("o").alias("a"), F.col("kept").alias("ka"), F.lit(True).alias("later"))
        seen = pairs.join(known, ["g", "a"], "left").withColumn("ka", F.when(F.col("later").isNull(), F.lit(True)).otherwise(F.col("ka")))
        by = seen.groupBy("g", F.col("b").alias("o")).agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("hit"), F.count_if(F.col("ka").isNull()).alias("open"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), F.lit(False)).when(F.col("open") == 0, F.lit(True))
        state = cut(state.join(by, ["g", "o"]).select("g", "o", new.alias("kept")), "state")
    copies = sets.where(F.size("s") > 0).join(first, ["g", "h"]).where("o <> first").select("g", "o", F.lit(False).alias("dup"))
    out = sets.select("g", "o").join(state, ["g", "o"], "left").join(copies, ["g", "o"], "left")
    return out.select(F.col("g").alias(group), F.col("o").alias(order), F.coalesce("dup", "kept", F.lit(True)).alias("kept"))
