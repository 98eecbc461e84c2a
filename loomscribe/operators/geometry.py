"""Nearest neighbours, rarity, dispersion, clusters and projections of vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomscribe.runtime import cut

QUERY_BLOCK, ROW_BLOCK = 4096, 16384
LINK_BLOCK = 8192


def unit_vector(c: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = lambda n: F.transform(c, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.element_at(F.transform(F.array(length), scaled), 1)  # bound once: inside the inner lambda it would be summed for every element


def _nearest_in(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows x of each query q, other than itself and, where both have a group, than its own group."""
    out = [pd.DataFrame({"query": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0)})]
    if not len(q) or not len(x):
        return out[0]
    names, own = q["id"].to_numpy(), x["id"].to_numpy()
    v, m = np.stack(q["vec"].to_numpy()).astype(np.float64), np.stack(x["vec"].to_numpy()).astype(np.float64)
    groups = (q["apart"].to_numpy(), x["apart"].to_numpy()) if "apart" in q else None
    square = (m**2).sum(axis=1)
    for a in range(0, len(names), 256):
        part = v[a : a + 256]
        d = square[None, :] - 2 * part @ m.T  # the order of the distances, up to rounding
        d[names[a : a + 256][:, None] == own[None, :]] = np.inf
        if groups:
            d[groups[0][a : a + 256][:, None] == groups[1][None, :]] = np.inf
        slack = 1e-9 * (1 + square.max(initial=0.0))
        worst = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(part), np.inf)
        for i in range(len(part)):
            near = np.flatnonzero((d[i] <= worst[i] + slack) & np.isfinite(d[i]))
            exact = np.sqrt(((m[near] - part[i]) ** 2).sum(axis=1))
            first = np.lexsort((own[near], exact))[:k]
            out.append(pd.DataFrame({"query": names[a + i], "id": own[near][first], "distance": exact[first]}))
    return pd.concat(out)


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, apart: str | None = None) -> DataFrame:
    """(query, id, distance): the k nearest rows (id, vec) of each query (id, vec), by Euclidean distance, without itself.

    apart: a column of both tables; rows that share a query's value of it are not asked. Exact search: queries stand in
    blocks and rows in shards by hash of the id; each block meets each shard in one task, which keeps k rows a query; the
    final choice sees k rows a shard and query. Nothing but the two numbers of rows reaches the driver. Equal distances go
    to the smaller id; null ids and vectors take no part.
    """
    extra = [F.col(apart).alias("apart")] if apart else []
    queries, rows = (x.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec", *extra) for x in (queries, rows))
    blocks, shards = max(1, -(-queries.count() // block)), max(1, -(-rows.count() // row_block))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.withColumn("_b", part(blocks)).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    x = rows.withColumn("_s", part(shards)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = q.groupBy("_b", "_s").cogroup(x.groupBy("_b", "_s")).applyInPandas(lambda a, b: _nearest_in(a, b, k), "query long, id long, distance double")
    w = W.partitionBy("query").orderBy("distance", "id")
    return met.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def links(rows: DataFrame, least: float, block: int = LINK_BLOCK) -> DataFrame:
    """(a, b, cosine) of all pairs of rows (id, unit vec) whose cosine is at least `least`, a < b.

    Exact self-join: rows stand in blocks by hash of the id, each pair of blocks is one group, and each row goes to
    as many groups as there are blocks. Nothing but the number of rows reaches the driver. Null vectors have no links.
    """
    rows = rows.where("id IS NOT NULL AND vec IS NOT NULL").select("id", "vec")
    blocks = max(1, -(-rows.count() // block))
    own = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = (pdf["_b"] == pdf["_i"]).to_numpy()
        two = (pdf["_b"] == pdf["_j"]).to_numpy()
        ids, vec = pdf["id"].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        same = bool(pdf["_i"].iloc[0] == pdf["_j"].iloc[0])
        a, x, b, y = ids[one], vec[one], ids[two], vec[two]
        out = [pd.DataFrame({"a": a[:0], "b": b[:0], "cosine": np.zeros(0)})]
        for lo in range(0, len(a), 512):
            cosine = x[lo : lo + 512] @ y.T
            p, q = np.nonzero(cosine >= least)
            left, right, c = a[lo + p], b[q], cosine[p, q]
            keep = left < right if same else left != right
            out.append(pd.DataFrame({"a": np.minimum(left, right)[keep], "b": np.maximum(left, right)[keep], "cosine": c[keep]}))
        return pd.concat(out)

    return met.groupBy("_i", "_j").applyInPandas(run, "a long, b long, cosine double")


def single_linkage(rows: DataFrame, least: float, sweep: Sequence[float] = ()) -> DataFrame:
    """(id, cluster, links, and a cluster_NN for each bound of the sweep) of all rows (id, unit vec), by links at cosine `least` or more.

    A cluster is named by its smallest id; a row without links is its own cluster. links counts the row's links at
    `least`; the bounds of the sweep are above it, so its links are among these.
    """
    pairs = cut(links(rows, least), "links")
    bounds = [(0, least), *enumerate(sweep, 1)]
    holds = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in bounds]), lambda x: x.t <= F.col("cosine"))
    edges = pairs.select("a", "b", F.explode(holds).alias("x")).select(F.struct("x.k", F.col("a").alias("id")).alias("a"), F.struct("x.k", F.col("b").alias("id")).alias("b"))
    names = ["cluster", *(f"cluster_{round(100 * t)}" for t in sweep)]
    found = smallest_reachable(edges).groupBy(F.col("node.id").alias("id")).agg(*[F.max(F.when(F.col("node.k") == k, F.col("cluster.id"))).alias(n) for k, n in enumerate(names)])
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    got = rows.select("id").join(found, "id", "left").join(degree, "id", "left")
    return got.select("id", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("links", F.lit(0)).alias("links"), *[F.coalesce(n, "id").alias(n) for n in names[1:]])


def dispersion(long: DataFrame, group: str, item: str, place: str, value: str) -> DataFrame:
    """(group, mean distance of the group's items to its centroid) of vectors in long form."""
    centre = long.groupBy(group, place).agg(F.avg(value).alias("_m"))
    d = long.join(centre, [group, place]).groupBy(group, item).agg(F.sqrt(F.sum(F.pow(F.col(value) - F.col("_m"), 2))).alias("_d"))
    return d.groupBy(group).agg(F.avg("_d").alias("mean_distance"), F.count("*").alias("n"))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, cluster) of undirected edges (a, b): the smallest node each one reaches, by label propagation to a fixed point.

    Every round also takes each label to its own label's label, so long chains need few rounds; labels only ever fall, so it ends.
    """
    both = cut(edges.select("a", "b").unionAll(edges.select("b", "a")).distinct(), "edges")
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("cluster")), "label")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("cluster").alias("_c"))
        new = label.join(near, label.node == near.a, "left").select("node", F.least("cluster", F.coalesce("_c", "cluster")).alias("cluster"), F.col("cluster").alias("_old"))
        hop = new.select(F.col("node").alias("cluster"), F.col("cluster").alias("_up"))
        new = cut(new.join(hop, "cluster", "left").select("node", F.least("cluster", F.coalesce("_up", "cluster")).alias("cluster"), "_old"), "label")
        if new.where("cluster <> _old").isEmpty():
            return new.drop("_old")
        label = new.drop("_old")


def discriminant_axes(sums: list[tuple[object, int, list[float], list[list[float]]]], axes: int = 2) -> np.ndarray:
    """Fisher axes from (class, n, sum of vectors, sum of outer products) of each class."""
    n = np.array([s[1] for s in sums], dtype=float)
    mean = np.array([s[2] for s in sums]) / n[:, None]
    within = sum(np.array(s[3]) - s[1] * np.outer(m, m) for s, m in zip(sums, mean))
    centre = (n[:, None] * mean).sum(axis=0) / n.sum()
    between = sum(k * np.outer(m - centre, m - centre) for k, m in zip(n, mean))
    values, vectors = np.linalg.eig(np.linalg.pinv(within + 1e-9 * np.eye(len(centre))) @ between)
    order = np.argsort(-values.real)[:axes]
    v = vectors[:, order].real
    return v / np.linalg.norm(v, axis=0) * np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1, 1)
