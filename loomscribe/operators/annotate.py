"""Work-lists for external annotators: what is not done yet is annotated, errors are kept apart and asked again."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"[^ \t\r\n\f\v]+")

Annotator = Callable[[str], str]


def open_work(work: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose key has no answer in the log; an error row is no answer."""
    return work.join(log.where("answer IS NOT NULL").select(*keys), list(keys), "left_anti")


def annotate(work: DataFrame, keys: Sequence[str], text: str, annotator: Annotator, tries: int = 3) -> DataFrame:
    """(keys, answer, error): one answer a row, at most `tries` attempts; after the last failure the error is kept.

    The annotator runs inside tasks, so a client of a model service must be made there; how many calls run at once
    is the number of partitions.
    """
    kinds = {f.name: f.dataType.simpleString() for f in work.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers, errors = [], []
            for t in pdf[text]:
                answer, error = None, None
                for _ in range(tries):
                    try:
                        answer, error = annotator(t or ""), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = type(e).__name__
                answers.append(answer)
                errors.append(error)
            yield pdf[list(keys)].assign(answer=answers, error=errors)

    return work.select(*keys, text).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", answer string, error string")


def by_length(text: str) -> str:
    """A rule in place of a model: long, medium, short or empty."""
    n = len(_PART.findall(text))
    return "empty" if n == 0 else "short" if n < 80 else "medium" if n < 400 else "long"


def two_votes(log: DataFrame, keys: Sequence[str], strict: bool) -> DataFrame:
    """(keys, kept) of keep votes: strict needs all, else one is enough; an error counts as keep."""
    keep = F.coalesce(F.col("keep"), F.lit(True))
    return log.groupBy(*keys).agg((F.bool_and(keep) if strict else F.bool_or(keep)).alias("kept"))
