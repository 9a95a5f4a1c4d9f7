"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this public vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(folder: str, vocabulary: str):
    """Read once in each Python process, whose `sys` keeps it: a function sent to a worker has no module there."""
    import tiktoken

    kept = sys.__dict__.setdefault("_rankloom_encodings", {})
    if (folder, vocabulary) in kept:
        return kept[folder, vocabulary]
    lines = (Path(folder) / vocabulary).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    kept[folder, vocabulary] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[folder, vocabulary]


def token_count(text: Column, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 of a null or empty one. Marks of special tokens are ordinary text."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(folder, vocabulary)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def ordinals(df: DataFrame, by: list[str], order: list[str], out: str, *, rows: int, part_rows: int = 50_000) -> DataFrame:
    """df with out: 0, 1, ... within each group of `by`, however large a group is.

    Groups are split by a hash of `order` (which must identify a row) into parts of some part_rows
    rows; a row's number is its place in its part plus the sizes of the parts before. rows is the
    number of rows of df.
    """
    from pyspark.sql import Window

    from rankloom.sources.shared import joined, stored

    parts = max(1, rows // part_rows)
    at = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(at.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return joined(at.withColumn("_place", place), sizes, [*by, "_part"]).withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
