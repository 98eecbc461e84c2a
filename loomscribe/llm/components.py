"""Connected components by distributed union-find.

Every level runs union-find on bounded blocks of edges, one block a task, and keeps of each block only
its forest (node, root). Where forests of several blocks share a node, their roots are linked; those
links are the smaller graph of the next level, which is cut into fewer blocks. The merge ends when one
block holds the rest. Edges go to blocks by a hash of both ends, so the edges of a hub are spread over all blocks and
none holds more than `edges_per_task`; nothing reaches the driver but row counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscribe.runtime import cut

EDGES_PER_TASK = 1_000_000
#: Blocks are planned this full, so that the uneven fall of the hash leaves none over the bound.
FILL = 0.8


def local_forest(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the root of each one's tree.

    The root is the node with the smallest hash of (level, node), so that a node that stays a root in
    one level is unlikely to stay one in the next: the graph of the roots shrinks by a constant factor.
    """
    codes, nodes = pd.factorize(np.concatenate([a, b]))
    nodes = np.asarray(nodes, dtype=object)
    order = np.argsort(pd.util.hash_array(np.array([f"{level}|{x}" for x in nodes], dtype=object)), kind="stable")
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[order] = np.arange(len(nodes))
    codes = rank[codes]
    a, b = codes[: len(a)], codes[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pa, pb = parent[a], parent[b]
        apart = pa != pb
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(pa, pb)[apart], np.minimum(pa, pb)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    named = nodes[order]
    return named, named[parent]


def _forest(level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [x for x in batches if len(x)]
        if frames:
            edges = pd.concat(frames)
            node, root = local_forest(edges["a"].to_numpy(object), edges["b"].to_numpy(object), level)
            yield pd.DataFrame({"node": node, "root": root})

    return run


def blocks_of(edges: DataFrame, n: int, edges_per_task: int) -> DataFrame:
    """The n edges in blocks of at most edges_per_task; one block where all of them fit."""
    if n <= edges_per_task:
        return edges.coalesce(1)
    return edges.repartition(math.ceil(n / (FILL * edges_per_task)), F.xxhash64("a", "b"))


def connected_components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) for every node of the edges (a, b), both strings; component is its smallest node.

    Nulls in either column are no edge; an edge from a node to itself names the node; repeated edges
    count once; an empty input gives an empty result.
    """
    e = edges.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a IS NOT NULL AND b IS NOT NULL")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    level = 0
    while n := e.count():
        forest = cut(blocks_of(e, n, edges_per_task).mapInPandas(_forest(level), "node string, root string"), "forest")
        if n <= edges_per_task:
            maps.append(forest)
            break
        best = cut(forest.groupBy("node").agg(F.min_by("root", F.struct(F.xxhash64(F.lit(level), "root"), "root")).alias("root")), "best")
        maps.append(best)
        links = forest.alias("f").join(best.alias("g"), "node").where("f.root <> g.root")
        links = links.select(F.least("f.root", "g.root").alias("a"), F.greatest("f.root", "g.root").alias("b"))
        e, level = cut(links.distinct(), "edges"), level + 1
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = maps.pop()
    while maps:
        lower = maps.pop().withColumnRenamed("root", "mid")
        upper = labels.select(F.col("node").alias("mid"), F.col("root"))
        labels = lower.join(upper, "mid", "left").select("node", F.coalesce("root", "mid").alias("root"))
    names = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(names, "root").select("node", "component")
