"""Multi-stream inputs and closed-form weights of a shared sparse code.

A stream is a vector for each position. Inputs are quantised to whole numbers and weights are whole
numbers, so logits are exact and a top-k can't depend on the order of a sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stream:
    """Dimensions [first, last) of the source vector, times ``factor``."""

    name: str
    first: int
    last: int
    factor: float

    @property
    def dims(self) -> int:
        return self.last - self.first


STREAMS = (Stream("a", 0, 64, 1.0), Stream("b", 0, 48, 4.0), Stream("c", 16, 48, 0.1))
LATENTS = 64
TOP_K = 8


def weight(stream: int, latents: int = LATENTS) -> np.ndarray:
    """latents x dims of a stream, by a closed form over latent, source dimension and stream."""
    s = STREAMS[stream]
    latent, dim = np.arange(latents)[:, None], np.arange(s.first, s.last)[None, :]
    return ((latent * 131 + dim * 71 + stream * 17) % 997 - 498).astype(np.float64)


def stream_vectors(embeddings: DataFrame) -> DataFrame:
    """(pos_id, x0, x1, x2): the quantised vectors of all streams, one row for each position."""

    def quantised(s: Stream) -> Column:  # a lambda's second parameter would be the place in the array
        return F.transform(F.slice("embedding", s.first + 1, s.dims), lambda v: F.floor(v.cast("double") * F.lit(s.factor) * 10000.0 + 0.5).cast("double"))

    columns = [quantised(s).alias(f"x{i}") for i, s in enumerate(STREAMS)]
    return embeddings.where("embedding IS NOT NULL").select(F.col("vec_id").alias("pos_id"), *columns)


def long_vectors(vectors: DataFrame) -> DataFrame:
    """(pos_id, stream_idx, x): one row for each position and stream."""
    each = F.array(*[F.struct(F.lit(i).alias("stream_idx"), F.col(f"x{i}").alias("x")) for i in range(len(STREAMS))])
    return vectors.select("pos_id", F.inline(each))
