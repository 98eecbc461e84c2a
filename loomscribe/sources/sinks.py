"""Writers: contract CSV, append logs and their compaction, schema migration, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscribe.operators.relational import keep_last


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The contract columns only, in order; refuses to overwrite."""
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def compact(log: DataFrame, keys: Sequence[str], order: Sequence[Column], path: str) -> None:
    """The last row of each key of a log as Parquet."""
    keep_last(log, keys, order).write.mode("errorifexists").parquet(path)


def migrate(df: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    """The columns of the current schema: missing ones as null, others cast, unknown ones dropped."""
    return df.select(*[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema])


def export_by(df: DataFrame, path: str, *columns: str) -> None:
    df.write.mode("errorifexists").partitionBy(*columns).parquet(path)


def manifest(df: DataFrame, name: str) -> DataFrame:
    """(name, rows, digest): a digest of the rows that does not depend on their order or files."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(38,0)")).alias("s")).select(F.lit(name).alias("name"), "rows", F.substring(F.sha2(F.coalesce(F.col("s").cast("string"), F.lit("")), 256), 1, 16).alias("digest"))


def json_report(df: DataFrame, path: str, **facts) -> None:
    """One JSON line a row, with the same facts (version, seed, ...) in each; refuses to overwrite."""
    df.select(*[F.lit(v).alias(k) for k, v in sorted(facts.items())], "*").write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def markdown_rows(df: DataFrame, digits: int = 3) -> DataFrame:
    """(line) of a Markdown table's rows: numbers with a fixed number of digits, bars escaped, nulls as a dash."""
    def cell(f):
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        text = F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)) if kind in ("double", "float") else c.cast("string")
        return F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("-"))

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(f) for f in df.schema.fields]), F.lit(" |")).alias("line"))


def markdown_head(columns: Sequence[str]) -> tuple[str, str]:
    return "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)
