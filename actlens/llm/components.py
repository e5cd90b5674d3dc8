"""Connected components of a graph held in tables, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.scratch import Scratch, redealt

#: Edges that a task holds.
HELD = 1 << 18


def stars(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge to its component's smallest node for each other node of some edges."""
    nodes, at = np.unique(np.concatenate((v, u)), return_inverse=True)
    a, b = at[: len(v)], at[len(v) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges (v, u), v > u, that connect the same nodes as ``edges`` (v, u): stars for some ``HELD`` edges of a task.

    A node keeps one edge in them, so what follows doesn't grow with the edges of a dense component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return stars(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for b in batches:
            if len(b):
                held.append((b.column("v").to_numpy(), b.column("u").to_numpy()))
                n += len(b)
            if n >= HELD:
                held = [merged()]
                n = len(held[0][0])
                if n >= HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["v", "u"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["v", "u"])

    return edges.mapInArrow(run, "v long, u long")


def fingerprint(pairs: DataFrame):
    """The number of rows and the sum of their digests."""
    return pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 50, of: tuple[str, ...] | None = None) -> DataFrame:
    """(node, root) for the ends of ``edges`` (a, b: longs); root is the smallest node that is reachable.

    Each round links every node to its smallest neighbour, first for larger neighbours and then for
    smaller ones; a star on each component's smallest node is the fixed point. Neighbours are
    reduced to a minimum by partial aggregation, and Spark may split the rows of a node of any degree in the joins.
    Each task reduces its edges to stars before it writes them, at first and in each round: that too only lowers the ends of
    edges. Each round is a written table; ``of`` are saved tables that bound the size of ``edges``.
    """
    pairs = edges.select(F.col("a").cast("long").alias("v"), F.col("b").cast("long").alias("u")).where("v <> u")
    pairs = scratch.save(forest(scratch.fit(pairs, of) if of else pairs), f"{name}-0")
    mark = fingerprint(pairs)
    for i in range(1, max_rounds + 1):
        both = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(redealt(least, "v", "w"), F.col("v") == F.col("w")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(redealt(least, "v", "w"), F.col("v") == F.col("w"))
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u"))).where("u <> v").distinct()
        pairs = scratch.save(forest(scratch.fit(small, (f"{name}-{i - 1}",))), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = fingerprint(pairs)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).union(pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
