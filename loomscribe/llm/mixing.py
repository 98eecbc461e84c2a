"""Problem 7: a mixture of sources by target shares of tokens, along a curriculum."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions.labels import canon_label
from loomscribe.llm.tokens import with_tokens
from loomscribe.runtime import cut, table

#: A curriculum of piecewise linear weights: the source with the shortest texts falls from 1 + SLOPE to 1 - SLOPE over the
#: training time, that with the longest rises as much, the others lie between; any other schedule may be given instead.
SLOPE = 0.5
Schedule = Mapping[str, Sequence[tuple[float, float]]]
ROWS_PER_BUCKET = 100_000


def demand_segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(cumulative demand before, at its end, start, weight at the start, slope) of each segment; the whole demand is 1."""
    knots = sorted((float(t), max(0.0, float(w))) for t, w in knots)
    if knots[0][0] > 0:
        knots = [(0.0, knots[0][1]), *knots]
    if knots[-1][0] < 1:
        knots = [*knots, (1.0, knots[-1][1])]
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total = sum(areas)
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    out, done = [], 0.0
    for (a, b), area in zip(zip(knots, knots[1:]), areas):
        if area > 0:
            slope = (b[1] - a[1]) / (b[0] - a[0]) / total
            out.append((done, done + area / total, a[0], a[1] / total, slope))
            done += area / total
    return out


def mix_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: tokens at hand, wanted, reachable with max_repeats, and whether the target is met.

    sizes(source, n_tokens): every row counts once; the mixture has as many tokens as all rows together.
    A source without documents has no tokens; a null max_repeats is 1, a null target 0. wanted is the target in whole tokens, rounded up.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    goal = targets.select("source", F.coalesce(F.col("target_permille"), F.lit(0)).cast("long").alias("permille"),
                          F.coalesce(F.col("max_repeats"), F.lit(1)).cast("long").alias("max_repeats"))
    plan = goal.join(have, "source", "left").crossJoin(F.broadcast(total))  # total is one row
    plan = plan.withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    want, most = F.col("permille") * F.col("total"), F.col("tokens") * F.col("max_repeats") * 1000
    plan = plan.withColumn("met", most >= want)
    return plan.withColumn("wanted", F.floor((want + 999) / 1000)).withColumn("reachable", F.least(F.col("wanted"), F.col("tokens") * F.col("max_repeats")))


def length_schedule(sizes: DataFrame, targets: DataFrame, slope: float = SLOPE) -> dict[str, list[tuple[float, float]]]:
    """Short texts first: the weights of each source of targets(source) over time, by the rank of the mean size of its texts.

    Only the mean sizes of the target sources reach the driver, a row a target.
    """
    mean = sizes.where("n_tokens > 0").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.avg("n_tokens").alias("m"))
    order = [r["source"] for r in sorted(mean.collect(), key=lambda r: (r["m"], r["source"]))]
    lean = {s: slope * (2 * i / (len(order) - 1) - 1) if len(order) > 1 else 0.0 for i, s in enumerate(order)}
    return {s: [(0.0, 1 - x), (1.0, 1 + x)] for s, x in lean.items()}


def mix(sizes: DataFrame, targets: DataFrame, schedule: Schedule | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens), sorted by training position in 0..1.

    schedule: weight of a source over training time 0..1, as knots of a piecewise linear curve; sources that it does not name
    are constant. Without one, length_schedule makes it from the sizes.

    sizes(doc_id, source, n_tokens). The texts of a source stand in hash order, one copy after another, as
    long as the copy's first token lies before the tokens that the source gives. The text at cumulative token c
    gets the position at which the integral of the source's weight schedule demands that token. A source may
    hold a third of all rows, so running sums are made in hash buckets, each after the sum of those before it.
    Sources without a target, and texts without tokens, are not in the mixture.
    """
    spark = sizes.sparkSession
    sizes = cut(sizes.select("doc_id", "source", "n_tokens"), "sizes")
    plan = cut(mix_plan(sizes, targets), "plan")
    if schedule is None:
        schedule = length_schedule(sizes, targets)
    n = max(1, math.ceil(sizes.count() / rows_per_bucket))
    h = F.xxhash64("doc_id", "n_tokens")
    rows = sizes.where("n_tokens > 0").withColumn("_h", h).withColumn("_b", F.floor(F.shiftrightunsigned(F.col("_h"), 33) * n / 2**31))
    sums = rows.groupBy("source", "_b").agg(F.sum("n_tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source", "_b", before.alias("_before"))
    inside = W.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, ["source", "_b"])
    rows = rows.withColumn("_c", F.col("_before") + F.col("_in")).join(plan.select("source", "tokens", "reachable"), "source")
    last = F.ceil((F.col("reachable") - F.col("_c")) / F.col("tokens")).cast("int") - 1  # the last copy that starts in time
    rows = rows.where(last >= 0).withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    given = F.greatest(F.col("reachable"), F.col("copy") * F.col("tokens") + F.col("_c") + 1)
    rows = rows.withColumn("_y", (F.col("copy") * F.col("tokens") + F.col("_c")) / given)
    flat = demand_segments(((0.0, 1.0), (1.0, 1.0)))
    kind = "source string, segs array<struct<y0:double,y1:double,t0:double,w:double,slope:double>>"
    curves = spark.createDataFrame([(s, demand_segments(k)) for s, k in schedule.items()], kind)
    rows = rows.join(F.broadcast(curves), "source", "left")  # one row a scheduled source, a parameter
    even = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("y0", "y1", "t0", "w", "slope"), s)]) for s in flat])
    seg = F.try_element_at(F.filter(F.coalesce("segs", even), lambda s: s.y1 > F.col("_y")), F.lit(1))
    rows = rows.withColumn("_s", F.coalesce(seg, F.element_at(F.coalesce("segs", even), -1)))
    rest = F.col("_y") - F.col("_s.y0")  # solve w t + slope t^2 / 2 = rest, in the form that has no 0 / 0
    root = F.sqrt(F.greatest(F.lit(0.0), F.col("_s.w") * F.col("_s.w") + 2 * F.col("_s.slope") * rest))
    t = F.col("_s.t0") + F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (F.col("_s.w") + root))
    return rows.select(t.alias("position"), "doc_id", "source", "copy", "n_tokens").orderBy("position", "source", "copy", "doc_id")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", canon_label("source").alias("source"), "text")
    return with_tokens(docs)


def mix_report(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each target: wanted and mixed tokens, copies, reached share; met where the finished mixture holds the target's share of all tokens."""
    got = mix(sizes, targets).groupBy("source").agg(F.sum("n_tokens").alias("mixed"), (F.max("copy") + 1).alias("copies"))
    plan = mix_plan(sizes, targets).drop("met").join(got, "source", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    share = F.col("mixed") / F.sum("mixed").over(W.partitionBy(F.lit(1)))  # a row a target
    return plan.select("source", "permille", "tokens", "wanted", "reachable", (F.col("mixed") * 1000 >= F.col("permille") * F.col("total")).alias("met"), "mixed",
                       F.coalesce("copies", F.lit(0)).alias("copies"), F.round(share, 6).alias("share"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the finished mixture holds less than their target."""
    return p7_report(spark, d).where("NOT met").select("source")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: target and reached share of the mixture, copies used, and whether the target is met."""
    return mix_report(cut(_sizes(spark, d).select("doc_id", "source", "n_tokens"), "sizes"), table(spark, d, "mix_targets"))
