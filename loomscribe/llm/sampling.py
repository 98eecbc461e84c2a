"""Problem 5: a sample that follows target shares of categories, with minimums and a report of gaps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions.labels import STRATA, VERTICALS, canon_label, canon_vertical, known, not_blank
from loomscribe.runtime import cut, table

MARGINS = (("stratum",), ("vertical",))
ROWS_PER_BUCKET = 100_000


def rake(cells: list[dict], margins=MARGINS, rounds: int = 2000, tol: float = 1e-9) -> list[float]:
    """Expected sample size of each cell, by iterative proportional fitting to the target totals of several margins.

    cells: dicts with the category columns, `target` (wanted records) and `have` (usable records). The fit starts from the
    targets of the cells and is scaled to the wanted total of every margin in turn, never above what a cell has: what a
    short cell lacks is made up by the other cells of its stratum and of its vertical, as far as they have the records.
    Cells without a target stay empty. The fit ends when no cell moves by more than tol in a round.
    """
    if not cells:
        return []
    want = np.array([c["target"] for c in cells], dtype=float)
    have = np.array([c["have"] for c in cells], dtype=float)
    fit = np.minimum(want, have)
    groups = []
    for margin in margins:
        keys: dict = {}
        groups.append(np.array([keys.setdefault(tuple(c[m] for m in margin), len(keys)) for c in cells], dtype=np.int64))
    for _ in range(rounds):
        old = fit.copy()
        for g in groups:
            goal = np.bincount(g, want)
            for _ in range(len(cells)):  # cells that reach what they have leave the rest of the margin to the others
                now, free = np.bincount(g, fit), (fit < have) & (fit > 0)
                room = np.bincount(g, np.where(free, fit, 0.0))
                grow = np.divide(goal - now + room, room, out=np.ones(len(goal)), where=room > 1e-12)
                down = np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)
                scale = np.where(goal < now, down, grow)[g]
                new = np.where((goal < now)[g] | free, np.minimum(fit * scale, have), fit)
                moved = np.abs(new - fit).max(initial=0.0)
                fit = new
                if moved <= tol:
                    break
        if np.abs(fit - old).max(initial=0.0) <= tol:
            break
    return fit.tolist()


def whole_quotas(fit: list[float], have: list[int], least: list[int], n: int) -> list[int]:
    """Whole numbers near fit, repaired to every minimum that can be met, that sum to n where the minimums leave room for it.

    The fit is rounded by largest remainders; then cells below their minimum are filled up, and cells above theirs
    give up what lies furthest above the fit.
    """
    low = [min(h, m) for h, m in zip(have, least)]
    q = [min(h, math.floor(f + 1e-9)) for f, h in zip(fit, have)]
    order = sorted(range(len(q)), key=lambda i: (q[i] - fit[i], i))
    for i in order:
        if sum(q) < n and q[i] < have[i] and fit[i] > q[i]:
            q[i] += 1
    q = [max(x, lo) for x, lo in zip(q, low)]
    while sum(q) > n:
        above = [i for i in range(len(q)) if q[i] > low[i]]
        if not above:
            break
        for i in sorted(above, key=lambda i: (fit[i] - q[i], i))[: sum(q) - n]:
            q[i] -= 1
    return q


def cell_plan(posts: DataFrame, targets: DataFrame, fraction: float = 0.2) -> DataFrame:
    """One row for each cell with posts or a target: have, needed, raked size, weight and quota.

    posts(doc_id, stratum, vertical) are distinct and usable. n is the fraction of them, rounded down; a listed cell
    needs ceil(target_permille * n / 1000) posts and at least min_docs. Only the counts of cells reach the
    driver: one row for each pair of known labels, or listed target. Repeated targets count once (the largest).
    """
    spark = posts.sparkSession
    goal = targets.groupBy("stratum", "vertical").agg(
        F.max(F.coalesce(F.col("target_permille"), F.lit(0))).alias("permille"), F.max(F.coalesce(F.col("min_docs"), F.lit(0))).alias("min_docs"))
    have = posts.groupBy("stratum", "vertical").agg(F.count("*").alias("have"))
    same = (F.col("g.stratum").eqNullSafe(F.col("h.stratum"))) & (F.col("g.vertical").eqNullSafe(F.col("h.vertical")))
    both = goal.alias("g").join(have.alias("h"), same, "full").select(
        F.coalesce("g.stratum", "h.stratum").alias("stratum"), F.coalesce("g.vertical", "h.vertical").alias("vertical"),
        "permille", "min_docs", F.coalesce("have", F.lit(0)).alias("have"))
    cells = sorted((r.asDict() for r in both.collect()), key=lambda c: (str(c["stratum"]), str(c["vertical"])))
    total = sum(c["have"] for c in cells)
    n = math.floor(total * round(1000 * fraction) / 1000)
    for c in cells:
        c["listed"] = c["permille"] is not None
        c["permille"], c["min_docs"] = c["permille"] or 0, c["min_docs"] or 0
        c["target"] = c["permille"] * n / 1000
        c["needed"] = max(-(-c["permille"] * n // 1000), c["min_docs"])
    fit = rake(cells)
    least = [c["min_docs"] if c["have"] >= c["needed"] else c["have"] for c in cells]  # a cell that cannot be filled gives all it has
    quota = whole_quotas(fit, [c["have"] for c in cells], least, min(n, round(sum(fit))))
    rows = [(c["stratum"], c["vertical"], c["listed"], c["permille"], c["min_docs"], c["have"], c["needed"], float(c["target"]), float(f), q)
            for c, f, q in zip(cells, fit, quota)]
    return spark.createDataFrame(rows, "stratum string, vertical string, listed boolean, permille long, min_docs long, have long, needed long, target double, fitted double, quota long")


def draw(posts: DataFrame, plan: DataFrame, seed: int = 7, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(doc_id, stratum, vertical, weight): of each cell the `quota` records with the smallest keys -ln(u) / weight.

    weight = fitted / have of the record's cell, quota / have where a minimum put records into a cell without a fit; u is a hash of (seed, doc_id), so the draw is the same on
    every run. A cell may hold a third of all rows: keys are counted in buckets, whole buckets below the cut
    are taken, and only the records of the bucket that holds the cut are ranked.
    """
    cells = F.broadcast(plan.where("quota > 0").select(F.col("stratum").alias("_s"), F.col("vertical").alias("_v"), "fitted", "have", "quota"))  # a row a cell
    posts = posts.select("doc_id", "stratum", "vertical")
    rows = posts.join(cells, (F.col("stratum") == F.col("_s")) & (F.col("vertical") == F.col("_v")))
    weight = F.when(F.col("fitted") > 0, F.col("fitted")).otherwise(F.col("quota")) / F.col("have")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 1) / F.lit(float(2**53))
    rows = rows.withColumn("weight", weight).withColumn("_u", u).withColumn("key", -F.log(u) / weight)
    buckets = max(1, math.ceil(posts.count() / rows_per_bucket)) * 4
    rows = cut(rows.withColumn("_b", F.floor((1 - F.col("_u")) * buckets)), "keys")  # the key falls as u grows
    counts = rows.groupBy("_s", "_v", "_b").agg(F.count("*").alias("_n"), F.first("quota").alias("_q"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_s", "_v").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).where("_before < _q").select("_s", "_v", "_b", "_before", "_n", "_q")
    rows = rows.join(counts, ["_s", "_v", "_b"])
    sure = rows.where("_before + _n <= _q")
    inside = W.partitionBy("_s", "_v", "_b").orderBy("key", "doc_id")
    last = rows.where("_before + _n > _q").withColumn("_r", F.row_number().over(inside)).where("_before + _r <= _q").drop("_r")
    return sure.unionByName(last).select("doc_id", "stratum", "vertical", F.round("weight", 9).alias("weight"))


def usable_posts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct posts with a known stratum, a known vertical and a text that is not blank (in any of their rows)."""
    rows = table(spark, d, "story_human_frozen").select(
        "doc_id", known(canon_label("stratum"), STRATA).alias("stratum"), known(canon_vertical("vertical"), VERTICALS).alias("vertical"), not_blank("story_human").alias("full"))
    posts = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("stratum").alias("stratum"), F.min("vertical").alias("vertical"), F.bool_or("full").alias("full"))
    return posts.where("full AND stratum IS NOT NULL AND vertical IS NOT NULL").drop("full")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sample_targets")
    return t.select(canon_label("stratum").alias("stratum"), canon_vertical("vertical").alias("vertical"), "target_permille", "min_docs")


def filled(posts: DataFrame, targets: DataFrame) -> DataFrame:
    """The plan with what the finished sample holds of each cell: drawn, and unmet where it holds all posts of a listed cell and they are fewer than needed."""
    plan = cell_plan(posts, targets)
    drawn = draw(posts, plan).groupBy("stratum", "vertical").agg(F.count("*").alias("drawn")).withColumnsRenamed({"stratum": "_s", "vertical": "_v"})
    got = plan.join(F.broadcast(drawn), F.col("stratum").eqNullSafe(F.col("_s")) & F.col("vertical").eqNullSafe(F.col("_v")), "left").drop("_s", "_v")  # a row a cell
    got = got.withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return got.withColumn("unmet", F.col("listed") & (F.col("drawn") < F.col("needed")) & (F.col("drawn") >= F.col("have")))


def gaps(cells: DataFrame) -> DataFrame:
    """(margin, stratum, vertical, have, target, fitted, drawn, target_permille, drawn_permille, gap, unmet) of every cell, stratum and vertical.

    gap is what the sample lacks of the target; cells is the result of filled, a row a cell.
    """
    parts = []
    for name, by in (("cell", ("stratum", "vertical")), ("stratum", ("stratum",)), ("vertical", ("vertical",))):
        keys = [F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in ("stratum", "vertical")]
        sums = [F.sum(c).alias(c) for c in ("permille", "have", "target", "fitted", "drawn")]
        got = cells.groupBy(*by).agg(*sums, F.bool_or("unmet").alias("unmet"), F.sum("needed").alias("needed"))
        parts.append(got.select(F.lit(name).alias("margin"), *keys, "permille", "have", "needed", F.round("target", 6).alias("target"), F.round("fitted", 6).alias("fitted"), "drawn", "unmet"))
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    total = F.sum("drawn").over(W.partitionBy("margin"))  # some dozens of rows
    share = F.coalesce(F.try_divide(F.lit(1000.0) * F.col("drawn"), total), F.lit(0.0))
    return all_.withColumn("drawn_permille", F.round(share, 3)).withColumn("gap", F.round(F.greatest(F.col("target") - F.col("drawn"), F.lit(0.0)), 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    posts = cut(usable_posts(spark, d), "posts")
    return filled(posts, _targets(spark, d)).where("unmet").select("stratum", "vertical")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    posts = cut(usable_posts(spark, d), "posts")
    return draw(posts, cell_plan(posts, _targets(spark, d)))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each cell, stratum and vertical: usable posts, target, raked size, drawn posts, drawn permille, and the gap to the target."""
    posts = cut(usable_posts(spark, d), "posts")
    return gaps(filled(posts, _targets(spark, d)))
