"""Classifiers on encoded features: imputation with indicators, fixed splits, grids, importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomscribe.functions.hashing import draw
from loomscribe.operators.metrics import macro_f1


def with_indicators(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Each column with nulls as 0, and an indicator of its nulls: Spark's trees take neither null nor NaN."""
    out, names = df, []
    for c in columns:
        missing = F.col(c).isNull() | F.isnan(c)
        out = out.withColumn(f"{c}__filled", F.when(missing, 0.0).otherwise(F.col(c).cast("double"))).withColumn(f"{c}__missing", missing.cast("double"))
        names += [f"{c}__filled", f"{c}__missing"]
    return out, names


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    filled, names = with_indicators(df, columns)
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled)


def boosted(train: DataFrame, test: DataFrame, label: str, trees: int = 20, depth: int = 4, step: float = 0.2, weight: str | None = None) -> DataFrame:
    """test with prediction and probability of gradient-boosted trees fitted on train."""
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step, seed=7, maxBins=32)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return gbt.fit(train).transform(test)


def best_on_validation(train: DataFrame, val: DataFrame, label: str, grid: Sequence[dict]) -> dict:
    """The first configuration with the highest macro-F1 on a fixed validation split."""
    best, top = grid[0], -1.0
    for config in grid:
        got = macro_f1(boosted(train, val, label, **config), label, "prediction").first()
        if got and got["macro_f1"] is not None and got["macro_f1"] > top:
            best, top = config, got["macro_f1"]
    return best


def six_way(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=30, maxDepth=6, seed=7).fit(train).transform(test)


def logistic(train: DataFrame, test: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=0.001, standardization=True)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(train).transform(test)


def permutation_importance(model, test: DataFrame, columns: Sequence[str], label: str, seed: int = 7) -> list[tuple[str, float]]:
    """Loss of macro-F1 when a column (with its indicator) is replaced by another row's: rows stand in hash order in buckets and are shifted by half a bucket."""
    base = macro_f1(model.transform(assembled(test, columns)), label, "prediction").first()["macro_f1"]
    buckets = max(1, test.count() // 50_000)
    h = draw(seed, *columns)
    own = Window.partitionBy("_b").orderBy("_h")
    rows = test.withColumn("_h", h).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets))).withColumn("_k", F.row_number().over(own))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("_b")))
    out = []
    for i, c in enumerate(columns):
        shifted = rows.select("_b", ((F.col("_k") + F.floor(F.col("_n") / 2) + i) % F.col("_n") + 1).alias("_k"), F.col(c).alias("_v"))
        mixed = rows.join(shifted, ["_b", "_k"]).withColumn(c, F.col("_v")).drop("_v")
        got = macro_f1(model.transform(assembled(mixed, columns)), label, "prediction").first()["macro_f1"]
        out.append((c, base - got))
    return out
