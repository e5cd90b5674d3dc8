"""Token lists as a model takes them: a first token, and rows of a batch filled up on the right."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_bos(tokens: Column, bos: Column | None) -> Column:
    """``tokens`` after the tokenizer's first token; unchanged where the tokenizer has none."""
    return tokens if bos is None else F.concat(F.array(bos), tokens)


def filler(pad: int | None, eos: int | None = None) -> int:
    """What fills a row up: the tokenizer's own filler, else its last token, else 0."""
    return pad if pad is not None else eos if eos is not None else 0


def pad_right(tokens: Column, width: Column, fill: int) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(width - F.size(tokens), F.lit(0))))


def pad_batches(rows: DataFrame, batch: str, tokens: str, fill: int) -> DataFrame:
    """``rows`` with ``width``, the longest list of its batch, and the lists filled up to it; a null list counts as empty."""
    rows = rows.withColumn(tokens, F.coalesce(F.col(tokens), F.array().cast("array<bigint>")))
    rows = rows.withColumn("width", F.max(F.size(tokens)).over(Window.partitionBy(batch)))
    return rows.withColumn(tokens, pad_right(F.col(tokens), F.col("width"), fill))


def pad_arrays(lists: Sequence[Sequence[int]], fill: int) -> np.ndarray:
    """The same for a batch in memory, to be handed to a model; without any token it has no columns."""
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, np.int64)
    for i, t in enumerate(lists):
        out[i, : len(t)] = t
    return out
