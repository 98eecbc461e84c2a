"""Bootstrap intervals from sufficient statistics of units, with draws any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_counts(df: DataFrame, unit: str, y: str, p: str) -> DataFrame:
    """(unit, tp, fp, fn, tn) of a binary prediction."""
    c = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b))
    return df.groupBy(unit).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))


def bootstrap_counts(units: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """(b, tp, fp, fn, tn): sums over n units drawn with replacement, for each replicate b.

    How often a unit is drawn in a replicate is close to Poisson(1) for many units and independent between
    units, so every unit draws its own multiplicity from a hash: no unit needs to know the others, and the job is
    one map and one aggregate however many units there are.
    """
    u = F.conv(F.substring("_h", 1 + 8 * F.col("_i"), F.lit(8)), 16, 10).cast("long") / F.lit(2.0**32)
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    times = sum((F.when(u >= c, 1).otherwise(0) for c in cuts[1:]), F.when(u >= cuts[0], 1).otherwise(0))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("_k").cast("string")))  # one hash has the draws of four replicates
    rep = units.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)))).withColumn("_h", hashed)
    rep = rep.withColumn("_i", F.explode(F.array(*map(F.lit, range(4))))).withColumn("b", 4 * F.col("_k") + F.col("_i") + 1).where(F.col("b") <= replicates).withColumn("_t", times)
    return rep.groupBy("b").agg(*[F.sum(F.col("_t") * F.col(c)).alias(c) for c in ("tp", "fp", "fn", "tn")])


def binary_macro_f1(tp="tp", fp="fp", fn="fn", tn="tn"):
    one = F.coalesce(F.try_divide(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn)), F.lit(0.0))
    zero = F.coalesce(F.try_divide(2 * F.col(tn), 2 * F.col(tn) + F.col(fp) + F.col(fn)), F.lit(0.0))
    return (one + zero) / 2
