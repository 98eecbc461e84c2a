"""Append logs as streams: whatever has arrived is folded in, batch by batch, and a rerun changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscribe.operators.relational import keep_last
from loomscribe.runtime import workdir


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a table, be it one file or a folder of files."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a file stream takes a single file only through a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(pattern)


def run_to_end(stream: DataFrame, step, out: str) -> DataFrame:
    """Applies step to each micro-batch until all input is read; batch n goes to out/batch=n, so a repeated batch replaces itself."""
    spark = stream.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/data/batch={n}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{out}/data").parquet(f"{out}/data")


def compacted(stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: the last of each batch, then the last of those."""
    out = f"{workdir(stream.sparkSession)}/stream-{uuid.uuid4().hex[:12]}"
    last = run_to_end(stream, lambda b: keep_last(b, keys, [F.col(c) for c in order]), out)
    return keep_last(last.drop("batch"), keys, [F.col(c) for c in order])


def folded_counts(stream: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Counts by keys: partial counts of each batch, then their sums; late rows count where they belong."""
    out = f"{workdir(stream.sparkSession)}/stream-{uuid.uuid4().hex[:12]}"
    part = run_to_end(stream, lambda b: b.groupBy(*keys).agg(F.count("*").alias("n")), out)
    names = [c for c in part.columns if c not in ("n", "batch")]
    return part.groupBy(*names).agg(F.sum("n").alias("n"))
