"""Problem 1: train, validation and test splits that keep all records of one owner together."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.functions.labels import SPLITS, canon_label, known
from loomscribe.functions.urls import company_key, site_of
from loomscribe.llm.components import connected_components
from loomscribe.runtime import cut, table

SHARES = {"train": 0.73, "val": 0.14, "test": 0.13}


def owners(frame: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, owner): the owner of each document.

    frame(domain, company) links sites to companies; places(doc_id, domain) has the domains given for a
    document in any table. Sites of one company, and sites given for one document, have one owner. A
    document without any site owns itself; a site that the frame lacks is an owner; blank names link nothing.
    """
    pairs = places.select("doc_id", site_of("domain").alias("site")).where("doc_id IS NOT NULL").repartition("doc_id").distinct()
    first = pairs.groupBy("doc_id").agg(F.min("site").alias("site"), F.max("site").alias("last"))
    first = cut(first, "doc_site")
    sites = frame.select(F.concat(F.lit("s:"), site_of("domain")).alias("a"), F.concat(F.lit("c:"), company_key("company")).alias("b"))
    site = F.concat(F.lit("s:"), F.col("site"))
    several = pairs.alias("p").join(first.where("site <> last").alias("f"), "doc_id").where("p.site <> f.site")
    several = several.select(F.concat(F.lit("s:"), "f.site").alias("a"), F.concat(F.lit("s:"), "p.site").alias("b"))
    comp = connected_components(sites.unionByName(several))
    named = first.join(comp.select(F.substring_index("node", "s:", -1).alias("site"), "component").where("node LIKE 's:%'"), "site", "left")
    return named.select("doc_id", F.coalesce("component", site, F.concat(F.lit("d:"), F.col("doc_id").cast("string"))).alias("owner"))


def greedy_cuts(histogram: list[tuple[int, int]], shares: Mapping[str, float]) -> list[tuple[int, list[int]]]:
    """Largest first, each group to the split furthest below its target, for runs of equal groups at once.

    histogram: (size, number of groups). The result gives, for each size, up to which rank among the groups
    of that size each split reaches. Groups of one size are alike, so only how many go to each split matters:
    the c largest of the shortfalls D_k, D_k - size, D_k - 2 size, ... of all splits k. Ties go to the first split.
    """
    names = list(shares)
    total = sum(s * c for s, c in histogram)
    short = [shares[k] / sum(shares.values()) * total for k in names]
    out = []
    for size, count in sorted(histogram, reverse=True):
        low, high = min(short) - (count + 1) * size, max(short)
        for _ in range(80):
            mid = (low + high) / 2
            if sum(max(0, math.floor((d - mid) / size) + 1) for d in short) > count:
                low = mid
            else:
                high = mid
        take = [max(0, math.floor((d - high) / size) + 1) for d in short]
        while sum(take) < count:
            k = max(range(len(short)), key=lambda i: (short[i] - take[i] * size, -i))
            take[k] += 1
        while sum(take) > count:
            k = min((i for i in range(len(short)) if take[i]), key=lambda i: (short[i] - (take[i] - 1) * size, -i))
            take[k] -= 1
        short = [d - n * size for d, n in zip(short, take)]
        out.append((size, [sum(take[: i + 1]) for i in range(len(take))]))
    return out


def rank_alike(groups: DataFrame, rows_per_bucket: int = 100_000) -> DataFrame:
    """Adds rank, from 0, among the rows of one size, in order of a hash.

    A third of all groups may have one size; so the rows of a size are ranked in hash buckets, each after the
    number of rows in the buckets before it, and no window holds more than about rows_per_bucket rows.
    """
    n = max(1, math.ceil(groups.count() / rows_per_bucket))
    g = groups.select("owner", "size").withColumn("_h", F.xxhash64("owner")).withColumn("_b", F.pmod(F.col("_h"), F.lit(n)))
    counts = g.groupBy("size", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("size").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("size", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("size", "_b").orderBy("_h", "owner")
    ranked = g.withColumn("_r", F.row_number().over(inside) - 1).join(counts, ["size", "_b"])
    return ranked.select("owner", "size", (F.col("_before") + F.col("_r")).alias("rank"))


def assign_groups(sizes: DataFrame, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """(owner, size, split) for sizes(owner, size): greedy, largest first.

    The driver gets only the histogram of sizes: N records have at most sqrt(2 N) distinct sizes.
    """
    spark = sizes.sparkSession
    names = list(shares)
    bars = [(r["size"], r["n"]) for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()]
    plan = spark.createDataFrame([(s, *c) for s, c in greedy_cuts(bars, shares)], "size long, " + ", ".join(f"_{k} long" for k in names))
    split = F.coalesce(*[F.when(F.col("rank") < F.col(f"_{k}"), F.lit(k)) for k in names])
    return rank_alike(sizes).join(plan, "size").select("owner", "size", split.alias("split"))


def group_splits(records: DataFrame, owner: DataFrame, shares: Mapping[str, float] = SHARES) -> DataFrame:
    """(doc_id, source, owner, split): every distinct record with the split of its owner.

    records(doc_id, source): repeated rows count once; rows without doc_id have no owner and are left out;
    a null source is a source of its own. Empty input gives an empty result. One owner may hold a third of all
    records: the joins on owner and on site have one row for each of them on the other side, so a hot key grows no
    product, and Spark's skew handling splits its rows.
    """
    rec = records.select("doc_id", "source").where("doc_id IS NOT NULL").distinct().join(owner, "doc_id")
    rec = cut(rec, "records")
    sizes = cut(rec.groupBy("owner").agg(F.count("*").alias("size")), "sizes")
    return rec.join(assign_groups(sizes, shares).select("owner", "split"), "owner").select("doc_id", "source", "owner", "split")


def straddling(posts: DataFrame, owner: DataFrame) -> DataFrame:
    """(doc_id): every post whose owner has posts in more than one split; posts(doc_id, split), null splits ignored."""
    p = cut(posts.where("doc_id IS NOT NULL").join(owner, "doc_id").select("doc_id", "owner", "split"), "posts")
    torn = p.groupBy("owner").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return p.join(torn, "owner", "left_semi").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()


def _owners(spark: SparkSession, d: str) -> DataFrame:
    places = [table(spark, d, t).select("doc_id", "domain") for t in ("splits", "features_encoded", "story_human_frozen", "mirrors")]
    union = places[0]
    for x in places[1:]:
        union = union.unionByName(x)
    return owners(table(spark, d, "site_frame"), union)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "splits").select("doc_id", known(canon_label("doc_split"), SPLITS).alias("split"))
    return straddling(posts, _owners(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "splits").select("doc_id", F.lit("human").alias("source"))
    texts = table(spark, d, "features_encoded").select("doc_id", canon_label("source").alias("source"))
    return posts.unionByName(texts)


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return group_splits(_records(spark, d), _owners(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each source, and of all records (source is null), and each split: records, owners, reached share and its gap to the target."""
    got = p1_splits(spark, d).groupBy("source", "owner", "split").agg(F.count("*").alias("n"))
    got = cut(got, "by_owner")
    by = got.groupBy("source", "split").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_owners")).where("source IS NOT NULL")
    whole = got.groupBy("owner", "split").agg(F.sum("n").alias("n")).groupBy("split").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_owners"))
    both = by.unionByName(whole.select(F.lit(None).cast("string").alias("source"), "split", "n_records", "n_owners"))
    target = F.create_map(*[F.lit(x) for kv in SHARES.items() for x in kv])[F.col("split")]
    share = F.col("n_records") / F.sum("n_records").over(W.partitionBy("source"))  # three rows a source
    return both.select("source", "split", "n_records", "n_owners", F.round(share, 6).alias("share"), target.alias("target"), F.round(share - target, 6).alias("gap"))
