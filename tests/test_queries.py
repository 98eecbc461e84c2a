import glob
import os

import duckdb
import pytest

from loomscribe.plans import registry

SF = "/root/testdata/sf0.001"
LEARNED = {"ml3_boosted_trees", "ml5_six_way", "ml6_length_logistic", "ml7_permutation_importance", "ml8_core_values", "ml15_cross_validation", "ml16_ablation", "ml16_learning_curve", "ml10_core_importance", "ml20_frozen_model"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def plain(rows):
    def cell(x):
        if x is None or x != x:
            return "None"
        if isinstance(x, bool) or isinstance(x, str):
            return str(x)
        try:
            return f"{float(x):.9g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - LEARNED))
def test_query_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    if name in registry.ORACLE:
        rel = duck.execute(registry.ORACLE[name])
        names = [x[0] for x in rel.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert plain(got) == plain([[r[i] for i in order] for r in rel.fetchall()])


def rows(spark, name, sf=SF):
    return [r.asDict() for r in registry.QUERIES[name](spark, sf).collect()]


def test_classifiers_beat_the_most_frequent_label(spark):
    from loomscribe.plans.base import predicted
    from loomscribe.plans.corpus import doc_splits

    sf = SF.replace("0.001", "0.01")  # the smallest tables have some fifty texts to test on
    test = predicted(spark, sf).join(doc_splits(spark, sf), "doc_id").where("split = 'test'")
    share = test.agg({"label_ai": "avg"}).first()[0]
    plain = max(share, 1 - share) / (1 + max(share, 1 - share))  # macro-F1 of one label: half its F1
    trees = rows(spark, "ml3_boosted_trees", sf)[0]
    assert plain < trees["macro_f1"] <= 1 and 0 < trees["auprc"] <= 1 and trees["trees"] in (5, 10)
    assert 0 < rows(spark, "ml6_length_logistic", sf)[0]["macro_f1"] <= 1
    six = rows(spark, "ml5_six_way", sf)
    assert sum(r["n"] for r in six if r["source"] == r["predicted"]) >= max(sum(r["n"] for r in six if r["source"] == s) for s in {r["source"] for r in six}) * 0.8


def test_importance_and_core(spark):
    imp = rows(spark, "ml7_permutation_importance")
    assert len(imp) == 8 and all(-1 <= r["importance"] <= 1 for r in imp) and max(r["importance"] for r in imp) > 0
    core = rows(spark, "ml8_core_values")
    assert len(core) == 8 and abs(sum(r["share"] for r in core) - 1) < 1e-4
    for r in core:
        assert 0 <= r["stability"] <= 1 and 0 <= r["in_top"] <= 1
        assert not r["core"] or (r["importance"] > r["null95"] and r["stability"] >= 0.55 and r["in_top"] >= 0.6 and abs(r["gap"]) >= 0.2 and r["spread"] <= 0.35)


def test_frozen_model_on_reworded_texts(spark):
    got = {r["source"]: r for r in rows(spark, "ml20_frozen_model")}
    assert got["human"]["n_attacked"] == 0 and got["human"]["accuracy_before"] == got["human"]["accuracy_after"]
    assert all(0 <= r["accuracy_after"] <= 1 and r["n_attacked"] <= r["n"] for r in got.values()) and sum(r["n_attacked"] for r in got.values()) > 0


def test_folds_ablation_and_curve(spark):
    folds = rows(spark, "ml15_cross_validation")
    assert [r["fold"] for r in sorted(folds, key=lambda r: r["fold"])] == [0, 1, 2, 3, 4] and len({r["mean"] for r in folds}) == 1
    assert all(0 <= r["macro_f1"] <= 1 for r in folds) and folds[0]["learns"]
    gone = {r["without"]: r["macro_f1"] for r in rows(spark, "ml16_ablation")}
    assert set(gone) == {"none", "f01", "f02", "f03", "f04", "f05", "f06"} and all(0 <= v <= 1 for v in gone.values())
    curve = rows(spark, "ml16_learning_curve")
    assert sorted((r["percent"], r["seed"]) for r in curve) == [(p, s) for p in (25, 50, 75) for s in (1, 2, 3)] + [(100, 1)]
    assert rows(spark, "ml16_learning_curve") == curve  # the draws repeat


def test_entry_lists_every_query():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(registry.QUERIES) <= set(q) and set(o) <= set(q)


def test_core_does_not_import_the_training_data_package():
    import re

    root = os.path.dirname(os.path.dirname(os.path.abspath(registry.__file__)))
    for p in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            assert not re.search(r"loomscribe\.llm|from loomscribe import llm", open(p).read()), p
