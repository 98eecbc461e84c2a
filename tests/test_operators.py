import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscribe.operators import dedup, geometry, metrics, relational, resample


def test_keep_first_and_last_with_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "w"), ("a", 2, "y"), (None, 5, "z"), (None, 4, "q")], "k string, t int, v string")
    first = {r["k"]: r["v"] for r in relational.keep_one(df, ["k"], [F.col("t"), F.col("v")]).collect()}
    last = {r["k"]: r["v"] for r in relational.keep_last(df, ["k"], [F.col("t"), F.col("v")]).collect()}
    assert first == {"a": "w", None: "q"} and last == {"a": "y", None: "z"}
    assert relational.keep_one(df.limit(0), ["k"], [F.col("t")]).count() == 0


def test_capped_quota_and_prefix_split(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else "o", i) for i in range(40)], "id int, kind string, n int")
    assert relational.capped(df, ["kind"], [F.col("id")], 3).count() == 6
    q = relational.quota(df, F.col("kind") == "s", [F.col("n").desc()], 0.4)
    assert q.where("kind = 's'").count() == 13 and q.count() == 33
    g = spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "g string, n int")
    got = {r["g"]: r["split"] for r in relational.prefix_sum_split(g, "n", [F.col("g")], (("train", 0.6), ("val", 0.85), ("test", 1.0))).collect()}
    assert got == {"a": "train", "b": "train", "c": "val"}


def test_classification_metrics_against_numpy(spark):
    r = random.Random(0)
    rows = [(r.random() < 0.3, round(r.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame([(int(y), s, int(s > 0.5)) for y, s in rows], "y int, s double, p int")
    y, s = np.array([a for a, _ in rows], int), np.array([b for _, b in rows])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert metrics.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(auc)
    ap = sum(((s >= t) & (y == 1)).sum() / (s >= t).sum() * ((s == t) & (y == 1)).sum() for t in set(s.tolist())) / y.sum()
    assert metrics.average_precision(df, "y", "s").first()["auprc"] == pytest.approx(ap)
    p = (s > 0.5).astype(int)
    f1 = np.mean([2 * ((y == k) & (p == k)).sum() / ((y == k).sum() + (p == k).sum()) for k in (0, 1)])
    m = metrics.macro_f1(df, "y", "p").first()
    assert m["macro_f1"] == pytest.approx(f1) and m["accuracy"] == pytest.approx((y == p).mean())
    unit = resample.unit_counts(df.withColumn("u", F.lit("one")), "u", "y", "p").first()
    assert unit["tp"] + unit["fp"] + unit["fn"] + unit["tn"] == 300


def test_macro_f1_of_a_label_only_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "y string, p string")
    got = {r["class"]: r["f1"] for r in metrics.class_f1(df, "y", "p").collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": 0.0}


def test_kappa_and_alpha(spark):
    same = spark.createDataFrame([("x", "x"), ("y", "y"), (None, "x")], "a string, b string")
    k = metrics.cohens_kappa(same, "a", "b").first()
    assert k["n"] == 2 and k["kappa"] == 1.0
    votes = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y"), (3, "y"), (3, "y"), (4, "x"), (5, None)], "u int, v string")
    a = metrics.krippendorff_alpha(votes, "u", "v").first()
    assert (a["units"], a["n_values"]) == (3, 6) and a["observed"] == pytest.approx(2 / 6) and a["expected"] == pytest.approx(0.5) and a["alpha"] == pytest.approx(1 / 3)


def test_kruskal_wallis_with_ties(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 2.0), ("b", 5.0), ("c", 7.0), ("c", 9.0), ("c", None)]
    h = metrics.kruskal_wallis(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()["h"]
    v = np.array([x for _, x in rows if x is not None])
    g = np.array([x for x, y in rows if y is not None])
    rank = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    raw = 12 / (7 * 8) * sum(rank[g == k].sum() ** 2 / (g == k).sum() for k in "abc") - 24
    assert h == pytest.approx(raw / (1 - (27 - 3) / (343 - 7)))


def test_mcnemar():
    assert metrics.mcnemar_p(0, 0) == 1.0
    assert metrics.mcnemar_p(2, 8) == pytest.approx(2 * sum(math.comb(10, i) for i in range(3)) / 1024)


def test_total_variation_counts_missing(spark):
    df = spark.createDataFrame([("f", "a", "a"), ("f", "a", None), ("f", "b", "b"), ("f", None, None)], "k string, x string, y string")
    assert metrics.total_variation(df, "k", "x", "y").first()["tvd"] == pytest.approx(0.25)


def test_bootstrap_resamples_units(spark):
    u = spark.createDataFrame([(f"u{i}", 1, 0, 0, 1) for i in range(400)], "u string, tp int, fp int, fn int, tn int")
    b = resample.bootstrap_counts(u, "u", 50, 3).withColumn("f", resample.binary_macro_f1()).collect()
    n = [r["tp"] for r in b]
    assert len(b) == 50 and abs(np.mean(n) - 400) < 12 and 12 < np.std(n) < 30 and all(r["f"] == 1.0 for r in b)


def test_greedy_near_duplicates_equal_the_rule(spark):
    r = random.Random(8)
    base = [[f"w{r.randrange(60)}" for _ in range(60)] for _ in range(4)]
    docs = []
    for i in range(80):
        w = list(base[i % 4])
        for _ in range(r.randrange(3)):
            w[r.randrange(60)] = f"z{r.randrange(5)}"
        if i % 11 == 0:
            w = w[:3]
        docs.append(("g" if i % 3 else None, i, " ".join(w)))
    docs += [("g", 200, ""), ("g", 201, None)]
    got = {(x["g"], x["i"]): x["kept"] for x in dedup.greedy_near_duplicates(spark.createDataFrame(docs, "g string, i int, t string").na.fill({"g": "-"}), "g", "i", "t").collect()}
    for g in ("g", None):
        mine = sorted((i, (t or "").split()) for k, i, t in docs if k == g)
        keep = dedup.greedy_keep([{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, w in mine])
        assert [got[(g or "-", i)] for i, _ in mine] == keep
    assert sum(not v for v in got.values()) > 10


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(5)
    got = {}
    for r in geometry.nearest(df.where("id % 20 < 4"), df, 5, block=7).collect():
        got.setdefault(r["query"], []).append((round(r["distance"], 9), r["id"]))
    for q, near in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((round(d[i], 9), i) for i in range(300) if i != q)[:5]
        assert sorted(near) == want
    assert (0.0, 7) in got[3]


def test_label_propagation(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 29)]
    got = {r["node"]: r["cluster"] for r in geometry.smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 29


def test_running_sums_in_ranges(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(9), r.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, n int, k double").repartition(4)
    for per in (60, 10_000):
        for inclusive in (False, True):
            got = {x["id"]: x["s"] for x in relational.running_sums(df, [F.col("k").desc()], {"s": F.col("n")}, inclusive, per).collect()}
            acc, want = 0, {}
            for i, n, _ in sorted(rows, key=lambda x: -x[2]):
                want[i] = acc + (n if inclusive else 0)
                acc += n
            assert got == want


def test_single_linkage_equals_brute_force(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(6, 16))
    x = np.concatenate([centre[i] + s * r.normal(size=(40, 16)) for i, s in enumerate((0.05, 0.3, 0.5, 0.7, 1.0, 1.5))] + [np.zeros((1, 16))])
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    ids = [int(i) for i in r.permutation(len(x)) * 20 + 1]  # none divisible by 20
    got = {q["id"]: q for q in geometry.single_linkage(spark.createDataFrame(list(zip(ids, x.tolist())), "id long, vec array<double>"), 0.6, (0.7, 0.9)).collect()}
    assert sorted(got) == sorted(ids)
    cosine = x @ x.T
    for least, name in ((0.6, "cluster"), (0.7, "cluster_70"), (0.9, "cluster_90")):
        near = cosine >= least
        label = np.array(ids)
        while (new := np.minimum(label, np.where(near, label[None, :], 10**9).min(axis=1))).tolist() != label.tolist():
            label = new
        assert [got[i][name] for i in ids] == label.tolist(), name
    linked = cosine >= 0.6
    np.fill_diagonal(linked, False)
    assert [got[i]["links"] for i in ids] == linked.sum(axis=1).tolist() and linked.sum(axis=1).max() > 25


def test_links_in_blocks(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(150, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(999, None)], "id long, vec array<double>")
    a, b = np.nonzero(np.triu(x @ x.T >= 0.5, 1))
    for block in (20, 1000):
        got = [(q["a"], q["b"]) for q in geometry.links(df, 0.5, block).collect()]
        assert len(got) == len(set(got)) and set(got) == set(zip(a.tolist(), b.tolist()))
    assert geometry.single_linkage(df.limit(0), 0.5, (0.7,)).count() == 0


def test_mcnemar_is_exact_at_every_size(spark, monkeypatch):
    from fractions import Fraction

    from loomscribe.plans import stats

    for b, c in ((0, 0), (3, 3), (0, 60), (480, 530), (900, 1100), (2600, 2400)):
        n = b + c
        want = min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)), 2**n)))
        assert metrics.mcnemar_p(b, c) == pytest.approx(want, rel=1e-9), (b, c)
        monkeypatch.setattr(stats, "m13_m14_error_overlap", lambda s, d, b=b, c=c: s.createDataFrame([(b, c)], "only_first long, only_second long"))
        assert stats.m13_mcnemar(spark, "").first()["p"] == pytest.approx(want, rel=1e-9), (b, c)
    assert 0 < metrics.mcnemar_p(10_000_000, 10_009_000) < 0.05


def test_nearest_against_brute_force_in_blocks(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(150, 6)).round(1)
    x[20:26] = x[3]  # ties
    rows = [(i, x[i].tolist(), i % 3) for i in range(150)] + [(500, None, 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    for apart in (None, "label"):
        for block, row_block in ((7, 11), (4096, 16384)):
            got = {}
            for r in geometry.nearest(df.where("id % 4 = 0"), df, 5, block=block, row_block=row_block, apart=apart).collect():
                got.setdefault(r["query"], []).append((round(r["distance"], 9), r["id"]))
            assert set(got) == set(range(0, 150, 4))
            for q in got:
                d = [(round(float(np.sqrt(((x[q] - x[j]) ** 2).sum())), 9), j) for j in range(150) if j != q and (apart is None or j % 3 != q % 3)]
                assert sorted(got[q]) == sorted(d)[:5]
    assert geometry.nearest(df.limit(0), df, 5).count() == 0 and geometry.nearest(df, df.limit(0), 5).count() == 0


def test_long_chains_settle(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r["cluster"] for r in geometry.smallest_reachable(edges).collect()} == {0}


def test_ranks_upto_a_limit_in_buckets(spark):
    df = spark.range(3000).selectExpr("id AS k", "id % 2 AS g", "crc32(cast(id AS string)) AS h", "1 AS rank")
    limits = spark.createDataFrame([(0, 700), (1, 5)], "g long, n int")
    from pyspark.sql import functions as F

    from loomscribe.operators.relational import ranked_upto

    want = {}
    for r in sorted(df.collect(), key=lambda r: (r["h"], r["k"])):
        want.setdefault(r["g"], []).append(r["k"])
    for per in (50, 100_000):
        got = {}
        for r in ranked_upto(df.drop("rank"), ["g"], "h", "k", limits, F.col("n"), rows_per_bucket=per).collect():
            got.setdefault(r["g"], []).append((r["rank"], r["k"]))
        assert {g: [k for _, k in sorted(v)] for g, v in got.items()} == {0: want[0][:700], 1: want[1][:5]}


def test_tfidf_against_numpy(spark):
    from collections import Counter

    from loomscribe.operators.weights import tfidf

    docs = ["a b a", "b c", "A b C d", "", None, "a"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, term string")
    terms = [Counter(w + [f"{p} {q}" for p, q in zip(w, w[1:])]) for w in ((t or "").lower().split() for t in docs)]
    count = Counter(t for d in terms for t in d)
    for most in (None, 2):
        keep = {t for t in count if count[t] >= 2}
        if most:
            total = Counter({t: sum(d[t] for d in terms) for t in keep})
            keep = {t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]}
        got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf(df, min_docs=2, most_terms=most).collect()}
        want = {}
        for i, d in enumerate(terms):
            v = {t: (1 + np.log(n)) * (np.log((1 + len(docs)) / (1 + count[t])) + 1) for t, n in d.items() if t in keep}
            size = np.sqrt(sum(x * x for x in v.values()))
            want |= {(i, t): x / size for t, x in v.items()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert tfidf(df.limit(0)).count() == 0


def test_chi_squared_tail():
    from loomscribe.operators.metrics import chi_squared_tail

    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.0705, 5, 0.05), (18.307, 10, 0.05), (9.047, 5, 0.1072), (0, 3, 1.0)):
        assert abs(chi_squared_tail(x, df) - p) < 1e-4


def test_tables_are_released_and_clusters_need_a_shared_folder(spark, monkeypatch):
    import os

    from loomscribe import runtime

    runtime.release(spark)
    path = runtime.cut(spark.range(3), "mine").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and runtime.release(spark) == 1 and not os.path.exists(path)

    class Far:
        class sparkContext:
            master, applicationId = "spark://far:7077", "x"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.workdir(Far)
