"""A Bloom filter of fixed size over long keys, built on executors and merged by words of 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.words import U64, mix

BITS = 25  # 4 MB, whatever the input's size; at worst it lets every row pass


def positions(keys: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    a = mix(keys.astype(np.int64).view(np.uint64) + U64(0x9E3779B97F4A7C15))
    return [(a >> U64(shift)) & U64((1 << bits) - 1) for shift in (0, 32)]


def bloom_bytes(keys: DataFrame, bits: int = BITS) -> bytes:
    """The filter of the one long column of ``keys``; nulls are left out.

    Tasks give words of 64 bits that aren't zero, which are merged by partial aggregation; what reaches the
    driver is 2**bits / 64 rows at most.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            place = np.unique(np.concatenate(positions(x, bits)))
            if len(place):
                word, first = np.unique(place >> U64(6), return_index=True)
                mask = np.bitwise_or.reduceat(U64(1) << (place & U64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    rows = keys.mapInArrow(build, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[rows.column("word").to_numpy()] = rows.column("mask").to_numpy()
    return bitmap.tobytes()


def maybe(keys: np.ndarray, bitmap: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which keys may be in the filter; all that are in it are among them."""
    out = np.ones(len(keys), bool)
    for p in positions(keys, bits):
        out &= (bitmap[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1 == 1
    return out
