"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file of a byte-level BPE vocabulary of many languages, as the texts are; the folder may be set for the whole job.
VOCABULARY = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """Replaces the text column by its 64-bit hash `text_hash` and its number of tokens.

    Null and empty texts have 0 tokens. A text is encoded whole, however long; strings of special tokens
    are ordinary text. The other columns are kept; any with the names of the new ones are replaced.
    """
    keep = [f for f in df.schema.fields if f.name not in (text, out, "text_hash")]
    df = df.select(*[f"`{f.name}`" for f in keep], text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf.pop(text)]
            pdf[out] = pd.Series(n, index=pdf.index, dtype="int64")
            yield pdf

    hashed = df.withColumn("text_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    schema = schema + ", text_hash long"

    def reorder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in run(batches):
            yield pdf[[*(f.name for f in keep), out, "text_hash"]]

    return hashed.mapInPandas(reorder, schema)
