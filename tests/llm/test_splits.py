import random

from loomscribe.llm import splits as S
from loomscribe.llm.components import connected_components, local_forest


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_components_in_many_blocks(spark):
    rnd = random.Random(5)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"x{rnd.randrange(80)}", f"x{rnd.randrange(80)}") for _ in range(60)]
    edges += [("n0", "n0"), ("lone", "lone"), (None, "n1"), ("n1", None), ("n1", "n2"), ("n1", "n2")]
    df = spark.createDataFrame([(a, b, "extra") for a, b in edges], "a string, b string, node string")
    want = brute(edges)
    for per_task in (7, 1000):
        got = {r["node"]: r["component"] for r in connected_components(df, edges_per_task=per_task).collect()}
        assert got == want


def test_components_hot_node(spark):
    df = spark.createDataFrame([("hub", f"leaf{i}") for i in range(300)], "a string, b string")
    assert {r["component"] for r in connected_components(df, edges_per_task=50).collect()} == {"hub"}


def test_blocks_of_a_star_keep_the_bound(spark):
    from loomscribe.llm.components import blocks_of

    star = spark.range(20_000).selectExpr("'hub' AS a", "concat('leaf', id) AS b")
    sizes = [len(x) for x in blocks_of(star, 20_000, 2000).rdd.glom().collect()]
    assert sum(sizes) == 20_000 and len(sizes) >= 10 and max(sizes) <= 2000
    assert {r["component"] for r in connected_components(star, edges_per_task=2000).collect()} == {"hub"}


def test_report_of_every_source(spark, monkeypatch):
    own = spark.createDataFrame([(f"d{i}", f"o{i % 40}", "val") for i in range(400)], "doc_id string, owner string, split string")
    records = own.selectExpr("doc_id", "'human' AS source", "owner", "split").unionByName(own.selectExpr("doc_id", "'aster' AS source", "owner", "split"))
    monkeypatch.setattr(S, "p1_splits", lambda *_: records)
    got = {(r["source"], r["split"]): r for r in S.p1_report(spark, "").collect()}
    assert got[None, "val"]["n_records"] == 800 and got["aster", "val"]["n_records"] == 400 and got["human", "val"]["n_owners"] == got[None, "val"]["n_owners"] == 40
    assert got["human", "val"]["gap"] == round(1 - 0.14, 6)


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_local_forest_roots():
    import numpy as np

    node, root = local_forest(np.array(["a", "b", "x"], object), np.array(["b", "c", "y"], object), 0)
    r = dict(zip(node, root))
    assert r["a"] == r["b"] == r["c"] != r["x"] == r["y"]


def test_greedy_matches_one_by_one():
    rnd = random.Random(1)
    sizes = [rnd.choice([1, 1, 1, 2, 3, 9, 40]) for _ in range(400)]
    bars = {}
    for s in sizes:
        bars[s] = bars.get(s, 0) + 1
    total, names = sum(sizes), list(S.SHARES)
    short = [S.SHARES[k] * total for k in names]
    want = {}
    for s in sorted(sizes, reverse=True):
        k = max(range(3), key=lambda i: (round(short[i], 6), -i))
        short[k] -= s
        want.setdefault(s, [0, 0, 0])[k] += 1
    got = {s: [c[0], c[1] - c[0], c[2] - c[1]] for s, c in S.greedy_cuts(list(bars.items()), S.SHARES)}
    assert {s: sum(v) for s, v in got.items()} == bars
    reached = [sum(s * v[i] for s, v in got.items()) for i in range(3)]
    other = [sum(s * v[i] for s, v in want.items()) for i in range(3)]
    assert all(abs(a - b) <= 1 for a, b in zip(reached, other))
    assert S.greedy_cuts([], S.SHARES) == []


def test_rank_alike_is_dense_in_buckets(spark):
    g = spark.createDataFrame([(f"o{i}", 1 + i % 2, "clash") for i in range(500)], "owner string, size long, rank string")
    rows = S.rank_alike(g, rows_per_bucket=20).collect()
    for size in (1, 2):
        assert sorted(r["rank"] for r in rows if r["size"] == size) == list(range(250))


def test_owners_and_straddling(spark):
    frame = spark.createDataFrame(
        [("https://www.acme.example/x", "ACME  Tools, Inc."), ("acme-app.example", "Acme Tools GmbH"), ("other.example", "Other Co"), (None, "Nobody"), ("blank.example", " "), ("acme.test", "Acme Learning Ltd")],
        "domain string, company string")
    places = spark.createDataFrame(
        [("p1", "blog.acme.example"), ("p2", "ACME-APP.example:443"), ("p3", "other.example"), ("p4", None), ("p4", "acme.example."), ("p5", None), ("p6", "new.example"), ("p7", "acme.test"), (None, "acme.example"), ("p1", "acme.example")],
        "doc_id string, domain string")
    own = S.owners(frame, places)
    o = {r["doc_id"]: r["owner"] for r in own.collect()}
    assert o["p1"] == o["p2"] == o["p4"] and len({o["p1"], o["p3"], o["p5"], o["p6"], o["p7"]}) == 5
    posts = spark.createDataFrame([("p1", "train"), ("p2", "test"), ("p3", "val"), ("p3", None), ("p4", None), ("p6", "val")], "doc_id string, split string")
    assert sorted(r[0] for r in S.straddling(posts, own).collect()) == ["p1", "p2", "p4"]


def test_group_splits_keep_owners_whole(spark):
    rows = [(f"d{i}", "human" if i % 3 else None) for i in range(900)] + [("d1", "human")] * 5 + [(None, "human")]
    own = spark.createDataFrame([(f"d{i}", f"o{i % 70 if i % 3 else 0}") for i in range(900)], "doc_id string, owner string")
    got = S.group_splits(spark.createDataFrame(rows, "doc_id string, source string"), own).collect()
    assert len(got) == 900
    by = {}
    for r in got:
        by.setdefault(r["owner"], set()).add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    share = {k: sum(r["split"] == k for r in got) / 900 for k in S.SHARES}
    assert abs(share["train"] - 0.73) < 0.03 and abs(share["val"] - 0.14) < 0.03
    assert S.group_splits(spark.createDataFrame([], "doc_id string, source string"), own).count() == 0
