"""Order-dependent picks: first, last, capped and top rows of a group, quotas, running splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.runtime import cut


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that combines before the shuffle.

    The order must be total for a repeatable pick; keys of null are a key.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return ranked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return ranked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def capped(df: DataFrame, group: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """At most cap rows of each group, in order; Spark keeps only cap rows of a group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def quota(df: DataFrame, capped_if: Column, order: Sequence[Column], share: float) -> DataFrame:
    """Rows where capped_if holds, in order, at most so many that they are `share` of the result, and all others."""
    others = df.where(~F.coalesce(capped_if, F.lit(False)))
    n = math.floor(share / (1 - share) * others.count() + 1e-9)
    return df.where(capped_if).orderBy(*order).limit(n).unionByName(others)


ROWS_PER_TASK = 1_000_000


def running_sums(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], inclusive: bool = False, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """df with, for each name, the sum of its column over all rows before (inclusive: and including) a row in order.

    Rows are split into ranges of the order of about rows_per_task rows; each task sums inside its range and adds the
    totals of the ranges before. Only a table that fits one task's bound is summed in one. The order must be total
    where sums of tied rows may not mix.
    """
    ranges = math.ceil(df.count() / rows_per_task)
    upto = 0 if inclusive else -1
    if ranges <= 1:
        w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
        return df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(k) for k, c in sums.items()])
    parts = cut(df.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_p").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t_{k}") for k, c in sums.items()])
    over = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    totals = totals.select("_p", *[F.coalesce(F.sum(f"_t_{k}").over(over), F.lit(0)).alias(f"_b_{k}") for k in sums])
    w = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
    inside = parts.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_i_{k}") for k, c in sums.items()])
    out = inside.join(F.broadcast(totals), "_p")
    return out.select(*df.columns, *[(F.col(f"_b_{k}") + F.col(f"_i_{k}")).alias(k) for k in sums])


def ranked_upto(df: DataFrame, group: Sequence[str], hash_: str, key: str, limits: DataFrame, upto: Column, rows_per_bucket: int = 100_000) -> DataFrame:
    """df with rank, from 1, in its group by (hash_, key), up to a limit of the group from limits (a row a group).

    hash_ is a whole number of 32 bits. A group may hold most rows: its rows are ranked in buckets of the hash, after the
    number of rows in the buckets before, and buckets beyond the limit are never ranked.
    """
    n = max(1, math.ceil(df.count() / rows_per_bucket))
    rows = df.withColumn("_b", F.floor(F.col(hash_) * n / 2**32))
    counts = rows.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    over = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).join(limits.select(*group, upto.alias("_upto")), list(group)).where("_before < _upto")
    rows = rows.join(counts.drop("_n"), [*group, "_b"])
    rows = rows.withColumn("rank", F.col("_before") + F.row_number().over(W.partitionBy(*group, "_b").orderBy(hash_, key)))
    return rows.where("rank <= _upto").drop("_b", "_before", "_upto")


def prefix_sum_split(groups: DataFrame, size: str, order: Sequence[Column], cuts: Sequence[tuple[str, float]]) -> DataFrame:
    """The split of each group by the share of all rows before it in order."""
    total = groups.agg(F.sum(size).alias("_all"))
    before = F.col("_before") / F.col("_all")
    out = None
    for name, upto in cuts[:-1]:
        out = F.when(before < upto, F.lit(name)) if out is None else out.when(before < upto, F.lit(name))
    summed = running_sums(groups, order, {"_before": F.col(size)}).crossJoin(F.broadcast(total))  # total is one row
    return summed.withColumn("split", out.otherwise(F.lit(cuts[-1][0]))).drop("_before", "_all")


def average_rank(value: str, partition: Sequence[str] = (), descending: bool = False) -> Column:
    """Rank with ties averaged."""
    w = W.partitionBy(*partition)
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(W.partitionBy(*partition, value)) - 1) / 2.0
