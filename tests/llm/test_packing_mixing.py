import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomscribe.llm import mixing as Mx
from loomscribe.llm import packing as P
from loomscribe.llm.tokens import encoder, with_tokens, VOCABULARY


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.sampled_from(["norm", "dot"]), st.integers(1, 9), st.floats(60, 6000))
def test_best_fit_holds_every_capacity(lengths, rule, docs, attention):
    cap = P.Capacity(100, docs, attention)
    bins = P.best_fit(np.array(lengths, dtype=np.int64), cap, rule=rule)
    for b in set(bins.tolist()):
        mine = [n for n, x in zip(lengths, bins) if x == b]
        assert sum(mine) <= 100 and len(mine) <= docs
        assert len(mine) == 1 or sum(n * (n + 1) / 2 for n in mine) <= attention + 1e-3


def test_best_fit_is_near_the_least():
    rnd = np.random.default_rng(0)
    n = rnd.integers(20, 900, 2000)
    bins = P.best_fit(n)
    assert len(set(bins.tolist())) <= np.ceil(n.sum() / 2048) * 1.01 + 1


def test_attention_and_documents_bind(spark):
    rnd = np.random.default_rng(1)
    long_, tiny = np.concatenate([rnd.integers(1100, 1400, 200), rnd.integers(600, 700, 200), rnd.integers(1800, 2048, 20)]), rnd.integers(2, 6, 20_000)
    reports = []
    for n in (long_, tiny):
        tight, loose = P.best_fit(n), P.best_fit(n, P.Capacity(2048, 10**6, 1e18))
        assert len(set(tight.tolist())) > len(set(loose.tolist()))  # the other two capacities change the packing
        sizes = spark.createDataFrame([(i, i, int(x)) for i, x in enumerate(n)], "doc_id long, text_hash long, n_tokens long")
        reports.append(P.fill_report(P.pack(sizes)).first())
    a, b = reports
    assert a["by_attention"] > 0 and a["by_own"] == 20 and a["most_attention"] <= 1
    assert b["by_documents"] > 0 and b["most_documents"] == 32


def test_pack_keeps_texts_whole(spark):
    rows = [(i, i, n, 7) for i, n in enumerate([0, 1, 2047, 2048, 2049, 4096, 4097, 500, 500, 30])] + [(3, 3, 2048, 7), (77, 77, None, 7)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text_hash long, n_tokens long, window int"), shard_items=4).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {0: 0, 1: 1, 2: 2047, 3: 2048, 4: 2049, 5: 4096, 6: 4097, 7: 500, 8: 500, 9: 30, 77: 0}
    assert sorted(k for k, v in pieces.items() if len(v) > 1) == [4, 5, 6]
    room = {}
    for r in got:
        assert (r["window"] is None) == (r["n_tokens"] == 0)
        room[r["window"]] = room.get(r["window"], 0) + r["n_tokens"]
    assert max(v for k, v in room.items() if k) <= 2048
    packed = spark.createDataFrame(got)
    assert sorted(r[0] for r in P.over_capacity(packed).collect()) == [4, 5, 6]
    assert P.pack(spark.createDataFrame([], "doc_id long, text_hash long, n_tokens long")).count() == 0


def test_tokens_of_odd_texts(spark):
    texts = [None, "", "a <|endoftext|> b", "naïve 🙂 Straße", "word " * 20_000]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, text_hash int")
    got = {r["doc_id"]: r["n_tokens"] for r in with_tokens(df).collect()}
    enc = encoder(VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_plan_targets_met_or_not(spark):
    sizes = spark.createDataFrame([("a", 600), ("a", 200), ("b", 100), ("b", 100), (None, 0)], "source string, n_tokens long")
    targets = spark.createDataFrame([("a", 800, 1), ("b", 401, 2), ("c", 1, 9), ("b2", 0, None), ("a2", None, 1)], "source string, target_permille int, max_repeats int")
    met = {r["source"]: r["met"] for r in Mx.mix_plan(sizes, targets).collect()}
    assert met == {"a": True, "b": False, "c": False, "b2": True, "a2": True}


def test_mix_reaches_targets_and_follows_the_schedule(spark):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 7) for i in range(3000)] + [(5000, "none", 9), (5001, None, 4), (5002, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 300, 1), ("small", 500, 2)], "source string, target_permille int, max_repeats int")
    schedule = {"small": ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0))}
    total = sum(r[2] for r in rows)
    for per in (100, 100_000):
        got = Mx.mix(sizes, targets, schedule, rows_per_bucket=per).collect()
        pos = [r["position"] for r in got]
        assert pos == sorted(pos) and 0 <= pos[0] and pos[-1] <= 1
        mixed = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in ("big", "small")}
        assert abs(mixed["big"] - 0.3 * total) < 20 and abs(mixed["small"] - 0.5 * total) < 20
        uses = {}
        for r in got:
            uses[r["doc_id"]] = uses.get(r["doc_id"], 0) + 1
        assert max(uses.values()) <= 2
        early = sum(r["n_tokens"] for r in got if r["source"] == "small" and r["position"] <= 0.5) / mixed["small"]
        assert abs(early - 0.75) < 0.01  # the integral of 2 - 2t up to 1/2
        early = sum(r["n_tokens"] for r in got if r["source"] == "big" and r["position"] <= 0.5) / mixed["big"]
        assert abs(early - 0.5) < 0.01
    assert Mx.mix(spark.createDataFrame([], "doc_id long, source string, n_tokens long"), targets).count() == 0


def test_short_texts_come_first_without_a_schedule(spark):
    rows = [(i, "short" if i % 2 else "long", 10 if i % 2 else 100) for i in range(2000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("long", 500, 1), ("short", 50, 1), ("none", 10, 1)], "source string, target_permille int, max_repeats int")
    got = Mx.mix(sizes, targets).collect()
    mean = {s: np.mean([r["position"] for r in got if r["source"] == s]) for s in ("short", "long")}
    assert mean["short"] < 0.45 < 0.55 < mean["long"]
    assert Mx.length_schedule(sizes, targets)["short"] == [(0.0, 1.5), (1.0, 0.5)]


def test_met_is_read_from_the_mixture(spark):
    sizes = spark.createDataFrame([(1, "a", 333), (2, "a", 334), (3, "b", 333), (4, "b", 1)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 667, 1), ("b", 333, 1), ("c", 1, 5), ("e", 0, 5)], "source string, target_permille int, max_repeats int")
    got = {r["source"]: r for r in Mx.mix_report(sizes, targets).collect()}
    assert {s: r["met"] for s, r in got.items()} == {"a": False, "b": True, "c": False, "e": True}  # 667 of 1001 tokens are under 667 permille
    assert got["a"]["mixed"] == 667 and got["b"]["mixed"] == 334


def test_demand_segments_cover_the_whole():
    for knots in (((0, 1), (1, 1)), ((0, 0), (0.3, 2), (1, 0)), ((0.2, 1), (0.7, 3))):
        seg = Mx.demand_segments(knots)
        assert abs(seg[0][0]) < 1e-12 and abs(seg[-1][1] - 1) < 1e-12
        assert all(abs(a[1] - b[0]) < 1e-12 for a, b in zip(seg, seg[1:]))
