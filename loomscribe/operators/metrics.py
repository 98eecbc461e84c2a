"""Agreement, classification and test statistics as DataFrame aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscribe.operators.relational import running_sums


def class_f1(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, tp, fp, fn, f1) for every class among labels and predictions; without hits F1 is 0."""
    hit = df.select(*by, F.explode(F.array_distinct(F.array(F.col(y).cast("string"), F.col(p).cast("string")))).alias("class"),
                    F.col(y).cast("string").alias("_y"), F.col(p).cast("string").alias("_p"))
    got = hit.groupBy(*by, "class").agg(
        F.count_if((F.col("_y") == F.col("class")) & (F.col("_p") == F.col("class"))).alias("tp"),
        F.count_if((F.col("_y") != F.col("class")) & (F.col("_p") == F.col("class"))).alias("fp"),
        F.count_if((F.col("_y") == F.col("class")) & (F.col("_p") != F.col("class"))).alias("fn"))
    return got.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def macro_f1(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    f1 = class_f1(df, y, p, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("_tp"), F.sum("fn").alias("_fn"))
    return f1.select(*by, "macro_f1", (F.col("_tp") / (F.col("_tp") + F.col("_fn"))).alias("accuracy"))


def score_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """(score, pos, neg) counts of each distinct score: all that ranking metrics need."""
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Sum of precision times recall gained, over distinct scores from the highest."""
    c = running_sums(score_curve(df, y, score), [F.col("score").desc()], {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")}, inclusive=True)
    return c.agg((F.sum(F.col("pos") * F.col("tp") / F.col("n")) / F.sum("pos")).alias("auprc"))


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Chance that a positive scores above a negative, ties counting half."""
    c = running_sums(score_curve(df, y, score), [F.col("score")], {"below": F.col("neg")})
    return c.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def cohens_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two label columns beyond chance; rows with a null are left out."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    side = t.select(F.col("a").alias("k"), F.col("n").alias("na"), F.lit(0).alias("nb")).unionAll(t.select("b", F.lit(0), F.col("n")))
    chance = side.groupBy("k").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    same = t.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("o"))
    pe = F.col("e") / (F.col("n") * F.col("n"))
    po = F.col("o") / F.col("n")
    return same.crossJoin(chance).select("n", po.alias("observed"), pe.alias("expected"), F.try_divide(po - pe, 1 - pe).alias("kappa"))  # one row each


def krippendorff_alpha(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Nominal alpha over units with at least two values, from value counts per unit; expected disagreement is 1 - sum p^2."""
    n = df.where(F.col(value).isNotNull()).groupBy(unit, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    m = n.groupBy(unit).agg(F.sum("n").alias("m")).where("m >= 2")
    c = n.join(m, unit)
    obs = c.agg((F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1))).alias("d"), F.sum("n").alias("total"), F.count_distinct(unit).alias("units"))
    p = c.groupBy("v").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    return obs.crossJoin(p).select("units", F.col("total").alias("n_values"),  # one row each
                                   F.try_divide(F.col("d"), F.col("total")).alias("observed"), (1 - F.col("sq") / (F.col("total") * F.col("total"))).alias("expected"),
                                   (1 - F.try_divide(F.try_divide(F.col("d"), F.col("total")), 1 - F.col("sq") / (F.col("total") * F.col("total")))).alias("alpha"))


def total_variation(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Half the sum of differences of two columns' value shares for each key; a missing value is a value."""
    sides = df.select(key, F.coalesce(F.col(a).cast("string"), F.lit("(none)")).alias("v"), F.lit(1).alias("x"))
    other = df.select(key, F.coalesce(F.col(b).cast("string"), F.lit("(none)")).alias("v"), F.lit(-1).alias("x"))
    d = sides.unionAll(other).groupBy(key, "v").agg(F.sum("x").alias("d"), F.count_if(F.col("x") > 0).alias("n"))
    return d.groupBy(key).agg((F.sum(F.abs("d")) / (2.0 * F.sum("n"))).alias("tvd"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction. Ranks come from counts of distinct values, so no window holds the rows."""
    v = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    t = running_sums(v.groupBy("v").agg(F.sum("n").alias("t")), [F.col("v")], {"below": F.col("t")})
    t = t.select("v", "t", (F.col("below") + (F.col("t") + 1) / 2.0).alias("rank"))
    r = v.join(t, "v").groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    h = r.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    ties = t.agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return h.crossJoin(ties).select("groups", "n", (raw / (1 - F.col("ties") / (n * n * n - n))).alias("h"))  # one row each


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p of b against c discordant pairs, at every size: the binomial tail from its largest term down."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    largest = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    total = term = 1.0
    while k > 0 and term > 1e-18 * total:
        term *= k / (n - k + 1)
        total += term
        k -= 1
    return min(1.0, 2 * math.exp(largest + math.log(total)))


def chi_squared_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom >= x): from the tail of one or two degrees up by steps of two."""
    if x <= 0:
        return 1.0
    half = x / 2
    tail, at = (math.erfc(math.sqrt(half)), 1) if df % 2 else (math.exp(-half), 2)
    while at < df:
        tail += math.exp(at / 2 * math.log(half) - half - math.lgamma(at / 2 + 1))
        at += 2
    return min(1.0, tail)
